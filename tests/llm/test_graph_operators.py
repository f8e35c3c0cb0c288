"""SimHash near-duplicates and substring dedup against brute force."""

import os
import random
import re

import numpy as np
import pytest
import xxhash

from pathloom.llm import components, simhash_gray, suffix_dedup


def plain_simhash(text, k=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    n, ones = max(1, len(words) - k + 1), [0] * 64
    for i in range(n):
        h = xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42)
        for j in range(64):
            ones[j] += h >> j & 1
    return sum(1 << j for j in range(64) if 2 * ones[j] > n)


def chained(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return [root(i) for i in range(n)]


def clustered(rng, groups, each, apart):
    codes = set()
    for _ in range(groups):
        base = rng.getrandbits(64)
        for _ in range(each):
            code = base
            for bit in rng.sample(range(64), rng.randint(0, apart)):
                code ^= 1 << bit
            codes.add(code)
    return np.array(sorted(codes), np.uint64)


def test_gray_neighbours_differ_in_one_bit():
    every = np.arange(1 << 10, dtype=np.uint64)
    rank = simhash_gray.gray_rank(every)
    order = every[np.argsort(rank)]
    assert sorted(rank.tolist()) == every.tolist() and set(np.bitwise_count(order[1:] ^ order[:-1]).tolist()) == {1}


@pytest.mark.parametrize("n", [1, 2, 16, 17, 129, 1500])
def test_index_finds_every_pair(n):
    rng = random.Random(n)
    codes = clustered(rng, 40, 60, 5)[:n]
    index = simhash_gray.GrayIndex(codes)
    got = {tuple(p) for at in range(0, n, 50) for p in zip(*[x.tolist() for x in index.links(at, min(at + 50, n), 3)])}
    near = np.bitwise_count(index.codes[:, None] ^ index.codes[None]) <= 3
    assert got == set(zip(*[x.tolist() for x in np.nonzero(np.triu(near, 1))]))


@pytest.mark.parametrize("group", [4096, 20])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, group):
    monkeypatch.setattr(simhash_gray, "GROUP", group)
    rng = random.Random(7)
    top = rng.getrandbits(40) << 24
    codes = np.unique(np.concatenate((clustered(rng, 30, 12, 4), np.array([top | rng.getrandbits(24) for _ in range(300)], np.uint64))))
    signed = codes.view(np.int64).tolist()
    found = simhash_gray.links(spark.createDataFrame([(c,) for c in signed], "code long").repartition(3), 3).collect()
    place = {c: i for i, c in enumerate(signed)}
    near = np.bitwise_count(codes[:, None] ^ codes[None]) <= 3
    assert all(near[place[r.a], place[r.b]] for r in found)
    want = chained(len(codes), zip(*[x.tolist() for x in np.nonzero(np.triu(near, 1))]))
    assert chained(len(codes), [(place[r.a], place[r.b]) for r in found]) == want


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(100)] + [(5000, 5000), (7, 7), (-3, -2), (-2, -1), (None, 4)]
    rng = random.Random(1)
    edges = [e if rng.random() < 0.5 else e[::-1] for e in edges]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(100)}, -3: -3, -2: -3, -1: -3}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_odd_rows(frame):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    long = rng.choices(words, k=300)
    texts = {10: " ".join(long), 11: " ".join(long[:150] + ["new"] + long[151:]), 12: " ".join(long).upper(), 13: None, 14: "", 15: " \n", 16: "one", 17: "One", 9: "two words", 18: "x " * 5000}
    rows = [(i, t, 0) for i, t in texts.items()] + [(10, texts[10], 1), (None, "one", 2)]
    found = simhash_gray.near_duplicates(frame(rows, "doc_id long, text string, component_id int")).collect()
    assert len(found) == len(rows)
    ids = [i for i, _, _ in rows]
    codes = np.array([plain_simhash(t) for _, t, _ in rows], np.uint64)
    parts = chained(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if np.bitwise_count(codes[a] ^ codes[b]) <= 3])
    least = {p: min((i for i, q in zip(ids, parts) if q == p and i is not None), default=None) for p in parts}
    want = sorted((str(i), int(c.view(np.int64)), str(least[p])) for i, c, p in zip(ids, codes, parts))
    assert sorted((str(r.doc_id), r.code, str(r.component_id)) for r in found) == want
    kept = simhash_gray.keep_first(frame(rows, "doc_id long, text string, component_id int"), shingles=(3,))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(a for a, _, c in want if a in (c, "None"))
    assert simhash_gray.near_duplicates(frame([], "doc_id long, text string")).count() == 0


# ------------------------------------------------------------------ substrings


def test_suffixes_stand_in_order_with_their_common_prefixes():
    rng = random.Random(9)
    for trial in range(150):
        strings = [bytes(rng.choices(b"ab\xc3"[: 1 + trial % 3], k=rng.randint(1, 13))) for _ in range(rng.randint(1, 8))]
        owner, size, lcp, bwt = suffix_dedup.column_order(strings)
        rows = [strings[i][len(strings[i]) - t :] for i, t in zip(owner, size)]
        assert rows == sorted(s[i:] for s in strings for i in range(len(s) + 1))
        for i, t, symbol in zip(owner, size, bwt):
            assert symbol == (strings[i][len(strings[i]) - t - 1] + 1 if t < len(strings[i]) else 0)
        for r in range(1, len(rows)):
            same = next((k for k, (a, b) in enumerate(zip(rows[r - 1], rows[r])) if a != b), min(len(rows[r - 1]), len(rows[r])))
            assert lcp[r] == same


def test_suffixes_of_more_than_255_bytes_stand_in_order():
    rng = random.Random(14)
    core = bytes(rng.choices(b"ab", k=300))
    strings = [core, b"a" + core, core[:290] + b"c", bytes(rng.choices(b"ab", k=3)), b""]
    owner, size, lcp, bwt = suffix_dedup.column_order(strings)
    rows = [strings[i][len(strings[i]) - t :] for i, t in zip(owner, size)]
    assert rows == sorted(s[i:] for s in strings for i in range(len(s) + 1))
    for i, t, symbol in zip(owner, size, bwt):
        assert symbol == (strings[i][len(strings[i]) - t - 1] + 1 if t < len(strings[i]) else 0)
    for r in range(1, len(rows)):
        assert lcp[r] == len(os.path.commonprefix([rows[r - 1], rows[r]]))


def test_equal_windows_have_equal_anchors():
    rng = random.Random(10)
    core = bytes(rng.choices(range(97, 123), k=200))
    for size in (20, 36, 50):
        maps = []
        for _ in range(3):
            text = bytes(rng.choices(range(97, 123), k=rng.randint(0, 90))) + core + b"z" * rng.choice([0, 500])
            own = {}
            hashes, first, last = suffix_dedup.anchors(np.frombuffer(text, np.uint8), 50, size)
            assert first[0] == 0 and last[-1] == len(text) - 50 and (first[1:] == last[:-1] + 1).all()
            assert (last - first).max() <= 50 - size
            for h, a, b in zip(hashes.tolist(), first.tolist(), last.tolist()):
                for i in range(a, b + 1):
                    assert own.setdefault(text[i : i + 50], h) == h
            maps.append(own)
        for w in maps[0].keys() & maps[1].keys() & maps[2].keys():
            assert maps[0][w] == maps[1][w] == maps[2][w]


def brute_repeats(rows, length):
    """Rows in order of id: the mask of removed bytes of each."""
    first, out = {}, {}
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            first.setdefault(raw[i : i + length], doc)
    for doc, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if doc is not None and first[raw[i : i + length]] < doc:
                gone[i : i + length] = True
        out[str(doc), text] = gone
    return out


@pytest.mark.parametrize("common", [65_536, 3])
def test_repeats_are_those_of_brute_force(frame, monkeypatch, common):
    monkeypatch.setattr(suffix_dedup, "COMMON", common)
    monkeypatch.setattr(suffix_dedup, "COLLECTION", 64)
    rng = random.Random(11)
    words = ["alpha", "beta", "né", "of", "the", "zz"]
    shared = [" ".join(rng.choices(words, k=rng.randint(12, 60))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [rng.choice(shared)[rng.randint(0, 30) :] if rng.random() < 0.5 else " ".join(rng.choices(words, k=15)) for _ in range(rng.randint(0, 4))]
        rows.append((i, "|".join(parts)))
    rows += [(100, "a" * 3000), (101, "a" * 49), (102, "ba" * 200 + "a" * 60), (103, None), (104, ""), (20, rows[20][1]), (21, rows[3][1]), (105, rows[5][1]), (None, rows[6][1]), (106, "é" * 80), (107, "xé" + "é" * 40)]
    want = brute_repeats(rows, 50)
    docs = frame([(*r, 0) for r in rows], "doc_id long, text string, repeats int")
    found = suffix_dedup.find_repeats(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        gone = want[str(r.doc_id), r.text]
        raw = np.frombuffer((r.text or "").encode(), np.uint8)
        assert (r.repeats.n_bytes, r.repeats.n_removed, bytes(r.repeats.kept)) == (len(raw), int(gone.sum()), raw[~gone].tobytes())
        assert sum(b - a for a, b in r.repeats.spans) == r.repeats.n_removed
    cut = {(r.doc_id, len(r.text or "")): r.text for r in suffix_dedup.drop_repeats(docs).collect()}
    assert (103, 0) in cut and len(cut) >= 55
    assert suffix_dedup.find_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("passed_on", [4096, 2])
def test_common_anchors_keep_all_their_strings_together(spark, frame, monkeypatch, passed_on):
    """Several common anchors in one batch, and batches that end within an anchor."""
    monkeypatch.setattr(suffix_dedup, "COMMON", 3)
    monkeypatch.setattr(suffix_dedup, "PASSED_ON", passed_on, raising=False)
    rng = random.Random(12)
    word = lambda n: "".join(rng.choices("abcdefghij", k=n))
    cores, left, right = [word(30) for _ in range(4)], [word(35) for _ in range(5)], [word(35) for _ in range(5)]
    texts = [a + core + b for core in cores for a in left for b in right]
    rng.shuffle(texts)
    want = brute_repeats(list(enumerate(texts)), 50)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = suffix_dedup.find_repeats(frame(list(enumerate(texts)), "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r.doc_id: r.repeats.n_removed for r in found} == {i: int(want[str(i), t].sum()) for i, t in enumerate(texts)}


def test_repeats_of_long_strings_are_those_of_brute_force(frame):
    rng = random.Random(15)
    core = "".join(rng.choices("abcdefghij", k=700))
    rows = [(i, "".join(rng.choices("abcdefghij", k=150)) + core[rng.randint(0, 300) : rng.randint(500, 700)]) for i in range(12)]
    want = brute_repeats(rows, 200)
    found = suffix_dedup.find_repeats(frame(rows, "doc_id long, text string"), length=200).collect()
    assert {r.doc_id: r.repeats.n_removed for r in found} == {i: int(want[str(i), t].sum()) for i, t in rows}
    assert any(r.repeats.n_removed for r in found)


def test_texts_of_one_id_are_all_told_of_an_earlier_document(spark):
    rng = random.Random(13)
    word = lambda n: "".join(rng.choices("abcdefghij", k=n))
    core = word(90)
    rows = [(5, "one " + core), (5, core + " two"), (5, "one " + core), (5, word(70)), (1, "head " + core + " tail"), (6, word(80))]
    # The texts of id 5 are in one slice, the earlier document is in another.
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string")
    want = brute_repeats(rows, 50)
    found = suffix_dedup.find_repeats(docs).collect()
    assert sorted((r.doc_id, r.text, r.repeats.n_removed) for r in found) == sorted((i, t, int(want[str(i), t].sum())) for i, t in rows)
