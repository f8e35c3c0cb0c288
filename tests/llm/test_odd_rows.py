"""One odd row must not end a query: forged record marks, long URLs, long texts, crowded turns, repeated ratings."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pathloom.llm import chat_repair, decontaminate, quality, recurrent_lm, simhash_gray, suffix_dedup, url_rules, warc_segments

# ------------------------------------------------------------------ WARC


@pytest.mark.parametrize("cut", range(1, len(warc_segments.VERSION) + 1))
def test_no_piece_makes_a_record_mark(cut):
    mark = warc_segments.VERSION[:cut]
    for before in range(0, 12):
        payload = b"x" * before + mark + b"1\r\n" * 3 + warc_segments.VERSION + mark
        for size in (8, 9, 10, before + cut, 64):
            framed = warc_segments.chunked(payload, size)
            assert warc_segments.VERSION not in framed + warc_segments.END
            assert warc_segments.unchunked(framed) == payload
        for segment in range(8, 60, 7):
            for record in warc_segments.page_records(1, "http://a/WARC/1.1", payload, None, segment):
                assert warc_segments.VERSION not in record + warc_segments.END


def test_pages_that_end_in_a_mark_are_read_back(frame):
    mark, size = "WARC/1.1", warc_segments.CHUNK
    tails = [mark[:k] for k in range(9)] + [mark + "\r", mark + "\r\n", mark * 3]
    htmls = [lead + tail for tail in tails for lead in ("", "y" * 200, "z" * (size - len(tail)), "é" * warc_segments.SEGMENT)]
    # Blocks cut where a segment ends: the mark moves over the end.
    htmls += ["s" * (size * 2 - 140 + k) + mark + "tail" * 50 for k in range(0, 40, 3)]
    report = warc_segments.archive_report(frame(list(enumerate(htmls)), "page_id long, html string").withColumn("url", F.lit("http://x/"))).collect()
    assert {r.page_id: r.payload_bytes for r in report} == {i: len(h.encode()) for i, h in enumerate(htmls)}


# ------------------------------------------------------------------ URL rules


def test_a_long_url_in_a_few_rows(frame):
    long = [f"q:{i}" for i in range(60)]
    rows = [(long, "block"), (long[:1] + ["s:http"], "allow"), (["s:http"], "allow")]
    found = {tuple(r.tokens): r for r in url_rules.mine_rules(frame(rows, "tokens array<string>, label string"), min_rows=1).collect()}
    assert set(found) == {("q:1",), ("s:http",)}
    assert sorted(found["q:1",].alike[0]) == sorted(long[1:]) and found["q:1",].confidence == 1
    assert url_rules.mine_rules(frame(rows, "tokens array<string>, label string")).count() == 0  # below five rows


def test_a_long_url_that_repeats_in_a_large_table(frame):
    rng = random.Random(2)
    long = [f"q:{i}" for i in range(60)]
    rows = [(["s:http", f"p0:{rng.randint(0, 30)}"], rng.choice(["allow", "block"])) for _ in range(9980)] + [(["s:http", *long], "block")] * 20
    rules = url_rules.mine_rules(frame(rows, "tokens array<string>, label string"))
    assert ["q:0"] in [r.tokens for r in rules.collect()]
    urls = frame([(1, ["q:37"]), (2, long), (3, ["none"]), (4, None)], "i int, tokens array<string>")
    got = {r.i: r.mined.verdict for r in url_rules.apply_rules(urls, rules).collect()}
    assert got == {1: "block", 2: "block", 3: None, 4: None}


# ------------------------------------------------------------------ recurrent LM


def dense(docs, lanes):
    """All windows from full matrices, as the definition says."""
    sizes = np.array([len(d) for d in docs])
    own = recurrent_lm.dealt(sizes, lanes)
    length = np.array([sum(sizes[d] for d in lane) for lane in own])
    y, start, who = np.zeros((length.max(), len(own)), int), np.ones((length.max(), len(own)), bool), np.zeros((length.max(), len(own)), int)
    for i, lane in enumerate(own):
        at = 0
        for d in lane:
            y[at : at + sizes[d], i], who[at : at + sizes[d], i] = docs[d], d
            start[at + 1 : at + sizes[d], i] = False
            at += sizes[d]
    x = np.vstack((np.zeros((1, len(own)), int), y[:-1]))
    x[start] = 0
    return x, y, start, who, length


@pytest.mark.parametrize("lanes", [1, 3, 16])
def test_windows_are_those_of_whole_lanes(lanes):
    rng = np.random.default_rng(lanes)
    docs = [rng.integers(0, 60, n) for n in (1, 200, 63, 64, 65, 1, 1, 130, 700, 2)]
    x, y, start, who, length = dense(docs, lanes)
    at = 0
    for wx, wy, wstart, live, kept, wwho in recurrent_lm.side_by_side(docs, lanes):
        cut = slice(at, at + len(wx)), slice(0, kept)
        assert kept == (length > at).sum() and (live == (np.arange(at, at + len(wx))[:, None] < length[None, :kept])).all()
        for got, want in ((wx, x), (wy, y), (wwho, who)):
            assert (got[live] == want[cut][live]).all()
        assert (wstart[live] == start[cut][live]).all() and not wx[~live].any()
        at += len(wx)
    assert at == length.max()


def test_one_very_long_text_beside_short_ones():
    docs = [np.zeros(2_000_000, np.int16)] + [np.zeros(5, np.int16)] * 300
    tracemalloc.start()
    windows = sum(1 for _ in recurrent_lm.side_by_side(docs, recurrent_lm.LANES))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert windows == -(-2_000_000 // recurrent_lm.WINDOW) and peak < 100 << 20


@pytest.mark.parametrize("most", [0, 30, 100, 100_000])
def test_frequent_words_are_cut_by_count(frame, monkeypatch, most):
    rng = random.Random(4)
    counts = {f"w{i}".encode(): rng.choice((1, 2, 3, 50, 1000, 1001, 7_000_000)) for i in range(300)}
    counts[recurrent_lm.END] = 500
    monkeypatch.setattr(recurrent_lm, "FREQUENT", most)
    words = recurrent_lm.vocabulary(frame([(bytearray(w), n) for w, n in counts.items()], "word binary, n long"))
    ranked = sorted(counts.items(), key=lambda w: (-w[1], w[0]))
    assert len(words.words) <= most and words.words == [w for w, _ in ranked[: len(words.words)]]
    assert (words.n, words.v) == (sum(counts.values()), 301)
    assert sorted(words.own, key=words.own.get) == [recurrent_lm.END, *[w for w, _ in ranked if w != recurrent_lm.END][: recurrent_lm.OWN - 1]]


# ------------------------------------------------------------------ chat repair, quality


def test_crowded_turns_are_repaired_at_the_same_cost(frame, monkeypatch):
    """Turns without numbers, or of one number: cut by rows, with the result of whole conversations."""
    rng = random.Random(6)
    rows = [(1, None, rng.choice(["user", "assistant", "system", None]), f"t{i % 50}") for i in range(700)]
    rows += [(2, 5, rng.choice(["user", "assistant"]), None) for _ in range(300)] + [(None, i, "user", "x") for i in range(20)]
    df = frame(rows, "conv_id long, turn long, role string, text string")
    columns = ["conv_id", "turn", "role", "was", "action", "text", "rendered"]
    costs = chat_repair.Costs()
    price = {k: getattr(costs, k) for k in ("insert", "relabel", "merge", "unknown")}
    totals = []
    for block, crowded in ((512, 10_000), (8, 4), (4, 1)):
        monkeypatch.setattr(chat_repair, "BLOCK", block)
        monkeypatch.setattr(chat_repair, "CROWDED", crowded)
        out = chat_repair.repair(df).select(*columns).collect()
        kept = sorted((str(r.conv_id), str(r.was), r.text) for r in out if r.action != "insert")
        assert kept == sorted((str(c), str(w), t or "") for c, _, w, t in rows)
        kinds = lambda r: [("unknown" if chat_repair.number_of(r.was) == chat_repair.START else k) if k == "relabel" else k for k in r.action.split("+")]
        changed = Counter((r.conv_id, kind) for r in out for kind in kinds(r))
        totals.append({c: sum(price[kind] * changed[c, kind] for kind in price) for c in (1, 2, None)})
    assert totals[0] == totals[1] == totals[2]


def test_a_rated_document_that_repeats(frame):
    docs = frame([(1, "good words here")] * 500 + [(2, "bad stuff"), (3, None)], "doc_id long, text string")
    ratings = frame([(1, 2), (2, 0), (3, 1)], "doc_id long, grade int")
    model = quality.fit(docs, ratings, sample=10)
    rated = quality.score(docs, model).select("doc_id", "rating.*").distinct().collect()
    assert len(rated) == 3
    # The scores are those of the formula, written out.
    hasher = quality.Hasher()
    for r in rated:
        features, values = hasher.row({1: "good words here", 2: "bad stuff", 3: None}[r.doc_id])
        s = float((model.weights[features] * values).sum())
        below = [0.0, *[1 / (1 + np.exp(s - t)) for t in model.thresholds], 1.0]
        chances = np.diff(below)
        assert r.expected_grade == pytest.approx(sum(k * c for k, c in enumerate(chances)), abs=1e-4)
        assert r.tail_probability == pytest.approx(chances[-1], abs=1e-4)


CLASHING = ["rating", "Contamination", "repeats", "_row", "_own", "_id", "_mark", "_runs", "_length", "tokens", "_new", "code", "component_id", "mark", "first", "part", "piece", "n"]


def test_columns_with_the_operators_own_names_stay(frame):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(i, t, "en", "s", 1, *(f"{c} {i}" for c in CLASHING)) for i, t in enumerate([text, text, text + " more", "a b c", None])]
    docs = frame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING))
    items = frame([(1, " ".join(f"word{i}" for i in range(20)))], "item_id long, text string")
    grades = frame([(0, 2), (1, 2), (3, 0)], "doc_id long, grade int")
    kept = {
        "quality": quality.select_good(docs, grades, least_chance=0.0),
        "near": simhash_gray.keep_first(docs),
        "repeats": corpus_pipeline.cut_repeats(docs.sparkSession, docs, ""),
        "documents": decontaminate.decontaminate(docs, items),
        "spans": decontaminate.decontaminate(docs, items, remove="spans"),
    }
    ids = {"quality": [0, 1, 2, 3, 4], "near": [0, 2, 3, 4], "repeats": [0, 1, 2, 3, 4], "documents": [3, 4], "spans": [0, 1, 2, 3, 4]}
    for name, out in kept.items():
        assert out.columns == docs.columns, name
        got = {r.doc_id: r for r in out.collect()}
        if name != "near":
            assert sorted(got) == ids[name], name
        assert all(r[c] == f"{c} {d}" for d, r in got.items() for c in CLASHING), name
    reports = suffix_dedup.find_repeats(docs).collect()
    assert {r.doc_id: r["repeats"]["n_removed"] for r in reports} == {0: 0, 1: len(text), 2: len(text), 3: 0, 4: 0}
    assert all(r[c] == f"{c} {r.doc_id}" for r in reports for c in CLASHING if c != "repeats")


def test_urls_with_clashing_columns(frame):
    rows = [(i, u, f"t {i}", f"n {i}", f"m {i}") for i, u in enumerate(["http://a.com/x", "http://a.net/es/x", "http://b.org/es/x", None])]
    out = url_rules.judge(frame(rows, "page_id int, url string, tokens string, _new string, Mined string"))
    assert sorted((r.page_id, r.tokens, r["_new"]) for r in out.collect()) == [(i, f"t {i}", f"n {i}") for i in range(4)]
    assert [c for c in out.columns if c.lower() == "mined"] == ["mined"]
