"""The registered queries against SQL, and the pipeline stage by stage."""

import os
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from check import TABLES, canonical
from pathloom.llm import queries, simhash_gray

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame, want = queries.QUERIES[name](spark, SF), db.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(frame.columns)
    names = sorted(columns)
    got = canonical([tuple(r) for r in frame.collect()], [frame.columns.index(c) for c in names])
    assert got == canonical(want.fetchall(), [columns.index(c) for c in names])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES) - {"pipeline"}))
def test_query_returns_its_table(spark, name):
    table = {"op2": "conversations", "op4": "pages"}.get(name.split("_")[0], "documents")
    rows = queries.QUERIES[name](spark, SF).count()
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert rows >= n if name[:4] in ("op2_", "op8_") else rows == n


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.saved(stage(spark, docs, SF), "test")
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert after and set(after) <= set(before)
        if name != "suffix-array dedup":
            assert all(before[d] == t for d, t in after.items())
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(before)


def test_stages_take_odd_documents(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "x " * 40_000, "en", None, 80_000), (3, "x " * 40_000, "en", None, 80_000), (None, "no id", "fr", "s", 5), (5, "a b c", None, "s", 5), (6, "a b c", None, "s", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows_here in (("odd", rows), ("none", [])):
        folder = tmp_path / name
        docs = spark.createDataFrame(rows_here, schema)
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, str(folder)).collect()
        assert bool(out) == bool(rows_here)
        places = {}
        for r in out:
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for own in places.values():
            own.sort()
            assert [a for a, _ in own] == np.cumsum([0, *[b for _, b in own[:-1]]]).tolist() and sum(b for _, b in own) <= 1024


def test_packed_ids_of_the_query(spark):
    rows = queries.QUERIES["op8_best_fit_packing"](spark, SF).collect()
    assert all(0 <= r.ids_crc32 < 1 << 32 for r in rows) and zlib.crc32(b"\x02\x00\x00\x00") < 1 << 32
    need = -(-sum(r.length for r in rows) // 1024)
    assert len({r.sequence_id for r in rows}) <= need * 1.05 + 1


def test_documents_cut_whole_stay_with_empty_texts(spark):
    text = "a text that is longer than fifty bytes, and is in two documents"
    docs = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, text, "en", "s", len(text)), (3, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert "stay, with an empty text" in corpus_pipeline.cut_repeats.__doc__
    assert sorted((r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()) == [(1, text, len(text)), (2, "", 0), (3, "", 0)]


@pytest.mark.parametrize("shingles", [(3,), (3, 5)])
def test_near_copies_go_as_brute_force_says(spark, shingles):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    root = {d: d for d in rows}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for words in shingles:
        codes = {d: simhash_gray.simhash(t, words) for d, t in rows.items()}
        for a in sorted(codes):
            for b in sorted(codes):
                if a < b and (codes[a] ^ codes[b]).bit_count() <= 3:
                    low, high = sorted((top(a), top(b)))
                    root[high] = low
    want = sorted(d for d in rows if top(d) == d)
    assert want != sorted(rows)
    assert sorted(r.doc_id for r in simhash_gray.keep_first(docs, shingles=shingles).collect()) == want
    if shingles == (corpus_pipeline.SHINGLE_WORDS,):
        assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == want
