"""Spelling variants against brute force over all pairs, small partitions, odd rows."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

from pathloom.llm import spelling_variants
from pathloom.llm.spelling_variants import Acceptor, group_variants, near_pairs, word_counts


def near(a, b):
    """Whether two different words are one insertion, deletion or replacement apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


words = st.lists(st.text("abé", min_size=0, max_size=5), max_size=40).map(lambda ws: sorted(set(ws)))


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_composition_finds_each_pair_once(first, second):
    machine = Acceptor()
    p, q = machine.add(first), machine.add(second)
    same_length = [w for w in first if len(w) == 3]
    r = machine.add(same_length)
    want = [(a, b) for i, a in enumerate(same_length) for b in same_length[i + 1 :] if near(a, b)]
    assert sorted(machine.replacements(r)) == sorted(want)
    want = [(a, b) for a in first for b in second if len(b) == len(a) + 1 and near(a, b)]
    assert sorted(machine.insertions(p, q)) == sorted(want)
    # Minimal: no two states accept the same words.
    languages = [tuple(sorted(machine.shared(s, s))) for s in range(len(machine.arcs))]
    assert len(set(languages)) == len(languages)


def brute_groups(vocabulary, ratio=5):
    out = {}
    for word, n in vocabulary.items():
        others = [w for w in vocabulary if near(word, w)]
        best = min(others, key=lambda w: (-vocabulary[w], w), default=None)
        out[word] = (best if best is not None and vocabulary[best] >= ratio * n else None, n, len(others))
    roots = {}
    for word in vocabulary:
        root = word
        while out[root][0] is not None:
            root = out[root][0]
        roots[word] = root
    return {(w, f, roots[w], n, k, vocabulary.get(f)) for w, (f, n, k) in out.items()}


@pytest.mark.parametrize("group", [4096, 3, 1])
@pytest.mark.parametrize("alphabet, low, high, size", [("ab", 2, 9, 250), ("abcdefgh", 6, 7, 300), ("aé\x00\U0001F600", 2, 6, 200)])
def test_groups_are_what_brute_force_finds(frame, group, alphabet, low, high, size):
    rng = random.Random(size)
    vocabulary = {"".join(rng.choices(alphabet, k=rng.randint(low, high))): 0 for _ in range(size)}
    vocabulary = {w: rng.choice((1, 5, 6, 30, 31, 200, 5**6)) for w in vocabulary}
    df = frame(list(vocabulary.items()), "word string, n long")
    pairs = [(r.word, r.near) for r in near_pairs(df, group).collect()]
    assert sorted(pairs) == sorted((a, b) for a in vocabulary for b in vocabulary if near(a, b))
    assert {tuple(r) for r in group_variants(df, group=group).collect()} == brute_groups(vocabulary)


def test_long_chains_reach_their_root(frame):
    vocabulary = {"a" * k: 5**k for k in range(2, 27)}
    out = {r.word: r for r in group_variants(frame(list(vocabulary.items()), "word string, n long")).collect()}
    assert {r.root for r in out.values()} == {"a" * 26}
    assert out["aa"].form == "aaa" and out["a" * 26].form is None


def brute_counts(rows, every=None):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if every and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


@pytest.mark.parametrize("every", [None, 3, 199])
def test_words_of_whole_texts(frame, every):
    rng = random.Random(8)
    vocabulary = ["Größe", "straße", "Éclair", "éclairs", "abcdef", "abcdeF", "naïveté", "x÷yzabc", "ŠŠabcdefŠ", "short", "longer7longer"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=30)) + "!") for i in range(60)]
    rows += [(None, "abcdef naïveté " * 9), (3, rows[3][1]), (4, ""), (5, None), (6, "straße," * 100_000), (7, "a" * 300_000)]
    df = frame([(i, t, "own") for i, t in rows], "doc_id long, text string, word string")
    got = {r.word: r.n for r in word_counts(df, typo_every=every).collect()}
    assert got == brute_counts(rows, every)


def test_empty_tables(frame, spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out = group_variants(word_counts(docs))
    assert out.count() == 0 and out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert [tuple(r) for r in group_variants(frame([("alone", 9)], "word string, n long")).collect()] == [("alone", None, "alone", 9, 0, None)]
    assert spelling_variants.GROUP > 1
