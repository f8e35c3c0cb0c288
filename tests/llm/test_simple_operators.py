"""Decontamination, packing, WARC, URL rules, weighted sampling: brute force and odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pathloom.llm import decontaminate, packing, url_rules, warc_segments, weighted_sampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ------------------------------------------------------------------ decontamination


def brute_contamination(text, items, n=13):
    words = WORD.findall(lower(text))
    hit, found = set(), set()
    for item, passage in items:
        own = WORD.findall(lower(passage))
        size = min(n, len(own))
        for i in range(len(own) - size + 1) if size else ():
            for j in range(len(words) - size + 1):
                if words[j : j + size] == own[i : i + size]:
                    hit.update(range(j, j + size))
                    if item is not None:
                        found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_grams", [1_000_000, 3])
def test_contamination_is_what_brute_force_finds(frame, block_grams):
    rng = random.Random(1)
    vocabulary = ["The", "é", "ab1", "Über", "x", "naïve"]
    texts = [" ".join(rng.choices(vocabulary, k=k)) + "!" for k in (0, 1, 5, 30, 60, 60)]
    items = [(1, "The é, x"), (1, "The é, x"), (2, "Zz"), (10, " ".join(rng.choices(vocabulary, k=16))), (None, "x x"), (5, None), (6, "?")]
    texts += [f"{items[3][1]} tail", None, "", "THE-É_x" * 300]
    docs = frame([(i, t, "old") for i, t in enumerate(texts)] + [(3, texts[3], "again"), (None, "the é x", "n")], "doc_id long, text string, contamination string")
    found = decontaminate.find_contamination(docs, frame(items, "item_id long, text string"), block_grams=block_grams)
    rows = found.collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = "the é x" if r.doc_id is None else texts[r.doc_id]
        c = r.contamination
        assert (c.n_words, c.n_hit, list(c.item_ids)) == brute_contamination(text, items)
        assert sum(b - a for a, b in c.spans) == c.n_hit


def test_decontaminate_removes_documents_or_spans(frame):
    passage = " ".join(f"w{i}" for i in range(13))
    docs = frame([(1, f"Before {passage} after."), (2, "clean text"), (3, None), (4, "y " * 400 + passage)], "doc_id long, text string")
    bench = frame([(7, passage)], "item_id long, text string")
    kept = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench).collect()}
    assert set(kept) == {2, 3, 4} and kept[4].endswith(passage)
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, remove="spans").collect()}
    assert cut[1] == "Before after." and cut[2] == "clean text" and cut[3] is None and "w1" not in cut[4]
    none = frame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, none).count() == 4
    assert decontaminate.find_contamination(docs.limit(0), bench).count() == 0


# ------------------------------------------------------------------ packing


def test_pieces_are_the_tokenizers_and_fill_sequences_without_gaps(frame):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(2)
    words = ["the", "naïve", "Straße", "12345", "!!!", "\n\n", "don't", "<|endoftext|>", "日本", "  "]
    texts = [" ".join(rng.choices(words, k=k)) for k in (1, 3, 10, 40, 40, 200)] + [None, "", "a" * 5000]
    docs = frame([(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 2), (None, "x", 3)], "doc_id long, text string, offset int")
    rows = packing.pack(docs, path, size=64).collect()
    reader = Tokenizer.from_file(path)
    reader.encode_special_tokens = True
    want = []
    for doc, text in [*enumerate(texts), (3, texts[3]), (None, "x")]:
        ids = reader.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids) + 1, 64)]
        want += [(str(doc), p, a, b - a, tuple(ids[a:b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, tuple(r.ids)) for r in rows) == sorted(want)
    places = {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(docs.limit(0), path).count() == 0


def test_added_tokens_and_long_blanks_are_those_of_the_tokenizers_default(spark, tmp_path):
    from tokenizers import Tokenizer

    from pathloom.llm import queries

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", " <|endoftext|", "plain text", " " * 1_200_000 + "a", "", "\n" * 100_000 + "<|endoftext|>x"]
    reader = Tokenizer.from_file(path)
    want = [reader.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 220, 50256, 275]
    whole = packing.WholeEncoder(path, True)
    assert [whole(t) for t in texts] == want
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.QUERIES["op8_best_fit_packing"](spark, str(tmp_path)).collect()
    for doc, own in enumerate(want):
        own = [*own, 2]
        first = len(own) % 1024 or 1024
        cuts = [0, *range(first, len(own) + 1, 1024)]
        crcs = [zlib.crc32(np.array(own[a:b], "<u4").tobytes()) for a, b in zip(cuts, cuts[1:])]
        assert [r.ids_crc32 for r in sorted(rows, key=lambda r: r.piece) if r.doc_id == doc] == crcs


def test_the_plan_places_every_piece_and_wastes_little():
    rng = random.Random(3)
    for _ in range(60):
        size = rng.choice([5, 16, 100])
        counts = {rng.randint(1, size): rng.randint(1, 50) for _ in range(rng.randint(1, 12))}
        used, load = {k: [] for k in counts}, {}
        for length, first, last, start, each, room in packing.plan(counts, size):
            for rank in range(first, last):
                used[length].append(rank)
                key = start + (rank - first) // each
                load.setdefault(key, []).append((room + (rank - first) % each * length, length))
        assert all(sorted(used[k]) == list(range(c)) for k, c in counts.items())
        for own in load.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= size
        need = -(-sum(k * c for k, c in counts.items()) // size)
        large = sum(c for k, c in counts.items() if 2 * k > size)
        assert len(load) <= 11 * max(need, large) / 9 + 1


# ------------------------------------------------------------------ WARC


def test_chunked_framing_round_trip():
    for payload in (b"", b"a", b"x" * 70_000, b"WARC/1.1\r\n" * 5000, b"\r\n0\r\n\r\n"):
        body = warc_segments.chunked(payload)
        assert warc_segments.unchunked(body) == payload and warc_segments.VERSION not in body
    for broken in (b"", b"zz\r\n", b"5\r\nab\r\n0\r\n\r\n", b"2\r\nab\r\n"):
        assert warc_segments.unchunked(broken) is None


def test_archives_come_back_whole(frame, spark, tmp_path):
    long = "é" * 60_000 + "WARC/1.1\r\nX"
    same = "s" * 200
    pages = [(1, "u", long), (2, "http://x/WARC/1.1", same), (3, None, same), (4, "v", None), (5, "", "s"), (6, "w", "s"), (7, "w", long), (7, "w", long), (9, "w", "\x00\r\n\r\n")]
    table = frame([(*p, "x") for p in pages] + [(None, "n", "n", "x")], "page_id long, url string, html string, record string")
    warc_segments.write_archives(table, str(tmp_path / "a"), segment=1000)
    records = warc_segments.read_records(spark, str(tmp_path / "a"))
    assert records.where("type = 'continuation'").count() > 50
    got = {r.page_id: r for r in warc_segments.reassembled(records).collect()}
    for page, _, html in pages:
        payload = (html or "").encode()
        assert got[page].status == "ok"
        if page in (3, 7):
            assert got[page].type == "revisit" and got[page].refers_to == {3: 2, 7: 1}[page]
            assert got[page].digest == hashlib.sha256(payload).hexdigest()
        else:
            assert got[page].type == "response" and bytes(got[page].payload) == payload
    report = {r.page_id: r for r in warc_segments.archive_report(table).collect()}
    assert len(report) == 8
    for page, _, html in pages:
        payload = (html or "").encode()
        assert (report[page].payload_bytes, report[page].payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
    assert warc_segments.archive_report(table.limit(0)).count() == 0


def test_broken_segments_are_told(frame, spark, tmp_path):
    table = frame([(1, "u", "abc" * 3000)], "page_id long, url string, html string")
    warc_segments.write_archives(table, str(tmp_path / "a"), segment=1000)
    records = warc_segments.read_records(spark, str(tmp_path / "a")).cache()

    def status(rows):
        return [r.status for r in warc_segments.reassembled(rows).collect()]

    assert status(records) == ["ok"] and status(records.unionByName(records)) == ["ok"]
    assert status(records.where("segment <> 2 OR segment IS NULL")) == ["missing segment"]
    assert status(records.withColumn("total", F.col("total") + 1)) == ["wrong length"]
    assert status(records.withColumn("digest", F.lit("00"))) == ["wrong digest"]
    shorter = records.withColumn("block", F.when(F.col("segment") == 3, F.lit(None)).otherwise(F.col("block")))
    assert status(shorter) == ["short block"]


# ------------------------------------------------------------------ URL rules


def test_hosts_paths_and_listed_rules(frame):
    urls = [
        ("http://A.COM/x?y#z", "a.com", "/x", "com/", "allow"), ("https://b.example.com/en/1", "b.example.com", "/en/1", "example.com/en/", "block"),
        ("x://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"), ("s://q.net/fr/?a", "q.net", "/fr/", "net/fr/", "block"),
        ("http://a.com", "a.com", "", None, "allow"), ("notcom/x", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
        ("http://xcom/y", "xcom", "/y", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"), ("u://com/", "com", "/", "com/", "allow"),
    ]
    judged = url_rules.judge(frame([(i, u[0], "h") for i, u in enumerate(urls)], "page_id long, url string, host string"), min_support=0.9)
    rows = {r.page_id: r for r in judged.collect()}
    assert len(rows) == len(urls)
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule)
        if rule:
            assert rows[i].verdict == verdict
        assert rows[i].verdict in ("allow", "block")
    assert url_rules.judge(frame([], "page_id long, url string")).count() == 0


def test_mined_rules_are_those_of_brute_force(frame):
    rng = random.Random(4)
    rows = []
    for _ in range(200):
        tokens = sorted({rng.choice("abcde") for _ in range(3)})
        rows.append((tokens, "block" if "a" in tokens and rng.random() < 0.9 else rng.choice(["allow", "block"])))
    rules = url_rules.mine_rules(frame(rows + [(["a"], None), (None, "allow")], "tokens array<string>, label string"), 0.05, 0.6).collect()
    every = {}
    share = {v: sum(label == v for _, label in rows) / len(rows) for v in ("allow", "block")}
    for tokens in {tuple(sorted(s)) for t, _ in rows for k in range(1, 2 ** len(t)) for s in [[x for i, x in enumerate(t) if k >> i & 1]]}:
        inside = [label for t, label in rows if set(tokens) <= set(t)]
        for verdict in ("allow", "block"):
            n = inside.count(verdict)
            if n >= 0.05 * len(rows) and n / len(inside) >= max(0.6, share[verdict] + 1e-12):
                every[tokens, verdict] = n / len(inside)
    kept = {k: c for k, c in every.items() if not any(o != k and o[1] == k[1] and set(o[0]) < set(k[0]) and every[o] >= c for o in every)}
    assert {(tuple(r.tokens), r.verdict): pytest.approx(r.confidence) for r in rules} == kept
    index = url_rules.RuleIndex([(list(r.tokens), r.verdict, r.confidence, r.support) for r in rules])
    for tokens, _ in rows[:50]:
        best = max((c for (t, _), c in kept.items() if set(t) <= set(tokens)), default=0.0)
        assert index.best(tokens)[1] == pytest.approx(best)
    urls = frame([(i, t) for i, (t, _) in enumerate(rows[:50])] + [(99, None)], "i int, tokens array<string>")
    made = frame([(list(r.tokens), r.verdict, r.confidence, r.support) for r in rules], "tokens array<string>, verdict string, confidence double, support double")
    one = {r.i: (r.mined.verdict, r.mined.confidence) for r in url_rules.apply_rules(urls, made).collect()}
    many = {r.i: (r.mined.verdict, r.mined.confidence) for r in url_rules.apply_rules(urls, made, block_rules=2).collect()}
    assert {k: v[1] for k, v in one.items()} == {k: v[1] for k, v in many.items()} and one[99] == (None, 0.0)


# ------------------------------------------------------------------ weighted sampling


def test_collision_rate_is_generalised_jaccard():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(200):
        hashes, k = rng.integers(1, 1 << 62, 60).astype(np.uint64), int(rng.integers(5, 55))
        a, b = rng.integers(1, 9, 60).astype(float), rng.integers(1, 9, 60).astype(float)
        low, high = {}, {}
        for i, h in enumerate(hashes.tolist()):
            x, y = a[i] * (i < k + 5), b[i] * (i >= k - 5)
            low[h], high[h] = min(x, y), max(x, y)
        alike = weighted_sampling.likeness(
            weighted_sampling.sample(hashes[: k + 5], a[: k + 5]), weighted_sampling.sample(hashes[k - 5 :], b[k - 5 :])
        )
        errors.append(alike - sum(low.values()) / sum(high.values()))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.08


@pytest.mark.parametrize("parts", [1, 7])
def test_neighbours_in_order_of_ids(frame, spark, parts):
    rng = random.Random(6)
    rows = [(i * 3, " ".join(rng.choices(["Aa", "b", "é", "dd"], k=rng.randint(0, 30)))) for i in range(40)] + [(200, None), (201, ""), (202, "z" * 9000), (30, "twice"), (None, "no id")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = weighted_sampling.neighbour_likeness(frame([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string")).collect()
        alone = weighted_sampling.neighbour_likeness(frame([(1, "a b c d")], "doc_id long, text string")).collect()
        none = weighted_sampling.neighbour_likeness(frame([], "doc_id long, text string")).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0], r[1].encode()))
    want = []
    for i, (doc, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        changed = weighted_sampling.edited(text, following)
        own, other, after = (weighted_sampling.fingerprint(t) for t in (text, changed, following))
        want.append((str(doc), len(text), hashlib.sha256(changed.encode()).hexdigest(), weighted_sampling.shown(own), weighted_sampling.shown(other), weighted_sampling.likeness(own, other), weighted_sampling.likeness(own, after)))
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    assert len(alone) == 1 and alone[0].near_next == 1.0 and none == 0
