"""The corpus pipeline: five stages from ``documents`` to packed sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pathloom.llm import decontaminate, packing, quality, simhash_gray, suffix_dedup
from pathloom.llm.common import saved, table
from pathloom.llm.queries import ratings, tokenizer_path

#: The near-duplicate stage: shingle length and largest bit distance as operator 9 has them.
SHINGLE_WORDS, BITS_APART = 3, 3


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    A null text is an empty one, and is judged like any other. Rows with a null or a repeated id are
    judged each by its own text. A score at the threshold stays. Without ratings no document is rejected,
    and an empty table stays empty.
    """
    return quality.select_good(docs, ratings(spark, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates.

    Texts without words (null, empty, blanks) have fingerprint 0 and are one group. Rows without an id all
    stay, and so do all rows that repeat a kept id. An empty table stays empty.
    """
    return simhash_gray.keep_first(docs, shingles=(SHINGLE_WORDS,), most=BITS_APART)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that also start in a document with a smaller id.

    ``n_chars`` follows the text. Documents of which nothing is left stay, with an empty text.
    """
    length = F.length("text").cast("long")
    known = F.col("n_chars").isNotNull() & length.isNotNull()
    return suffix_dedup.drop_repeats(docs).withColumn("n_chars", F.when(known, length).otherwise(F.col("n_chars")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark passages; their texts stay whole.

    Null and empty texts have no words and stay. Rows with a null or a repeated id are judged each by its
    own text. An item without words marks nothing; an empty benchmark keeps all documents.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the packed sequences.

    A null text is an empty one, a piece of the end id alone. Rows with a null or a repeated id are packed
    each. Which of equally long pieces takes which slot is open. An empty table gives no pieces.
    """
    packed = packing.pack(docs, tokenizer_path(spark), added_tokens=True)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: The classifier and the tokenizer cannot be written in SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
