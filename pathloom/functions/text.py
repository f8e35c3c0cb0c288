"""Tokenizers as native column expressions, and the registry users extend."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .paths import _col

# Fixed patterns: a word is a run of letters and digits in any script.
WORD = r"[\p{IsAlphabetic}\p{N}]+"
HAN = r"\p{IsHan}"
OTHER_CJK = r"[\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"
HAN_OR_WORD_RUN = r"\p{IsHan}+|[\p{IsAlphabetic}\p{N}&&[^\p{IsHan}]]+"


def tokenize_words(text: Column | str) -> Column:
    """Runs of letters and digits, case kept."""
    return F.regexp_extract_all(_col(text), F.lit(WORD), F.lit(0))


def _pairs(run: Column) -> Column:
    """Overlapping two-character pieces of a run (the run itself if it has one character)."""
    last_start = F.greatest(F.char_length(run) - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), last_start), lambda i: F.substring(run, i, F.lit(2)))


def segment_han(text: Column | str) -> Column:
    """Han runs become character pairs; other runs of letters and digits stay whole."""
    runs = F.regexp_extract_all(_col(text), F.lit(HAN_OR_WORD_RUN), F.lit(0))
    return F.flatten(
        F.transform(runs, lambda run: F.when(run.rlike("^" + HAN), _pairs(run)).otherwise(F.array(run)))
    )


def is_mandarin(text: Column | str) -> Column:
    """Whether a whole text is Chinese: at least half its letters are Han, no kana or hangul."""
    text = _col(text)
    han = F.regexp_count(text, F.lit(HAN))
    letters = F.regexp_count(text, F.lit(r"\p{IsAlphabetic}"))
    # The first test ends the common all-Latin case after one scan.
    return text.rlike(HAN) & ~text.rlike(OTHER_CJK) & (han * 2 >= letters)


def route_language(text: Column | str) -> Column:
    return F.when(is_mandarin(text), F.lit("cmn")).otherwise(F.lit("other"))


def tokenize_mixed(text: Column | str) -> Column:
    """The index tokenizer: Han segmentation for Chinese texts, words otherwise."""
    return F.when(is_mandarin(text), segment_han(text)).otherwise(tokenize_words(text))


Tokenizer = Callable[[Column], Column]

_REGISTRY: dict[str, Tokenizer] = {
    "mixed": tokenize_mixed,
    "words": tokenize_words,
    "han": segment_han,
}


def register_tokenizer(name: str, tokenizer: Tokenizer) -> None:
    """Make ``tokenizer`` (Column of text -> Column of ``array<string>``) available by name.

    Python code joins in as ``pandas_udf(ArrayType(StringType()))``, which runs on
    Arrow batches.
    """
    if not callable(tokenizer):
        raise TypeError("a tokenizer maps a Column to a Column")
    _REGISTRY[name] = tokenizer


def tokenizer(name: str) -> Tokenizer:
    try:
        return _REGISTRY[name]
    except KeyError:
        raise KeyError(f"no tokenizer registered as {name!r}") from None


def tokenize(text: Column | str, name: str = "mixed") -> Column:
    return tokenizer(name)(_col(text))
