"""Packed postings on their way to the files of the index, and what a build needs of the disk."""

import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pathloom.operators import postings as P, ranking as R
from pathloom.session import cut_lineage, work_dir
from pathloom.sources import index_table
from pathloom.sources.index_table import IndexTable

COLUMNS = ["term", "doc_id", "tf", "dl", "positions"]


def as_rows(frame):
    return sorted((r.term, r.doc_id, r.tf, r.dl, tuple(r.positions)) for r in frame.select(*COLUMNS).collect())


@pytest.mark.parametrize("opened", [1, 1 << 20])
def test_packed_rows_come_back_whole(opened, monkeypatch):
    """Ids in no order, negative and far apart, that come twice; pieces of any size."""
    monkeypatch.setattr(P, "OPEN_BYTES", opened)
    monkeypatch.setattr(P, "PACK_POSTINGS", 7)
    rng = random.Random(opened)
    terms = pa.array(sorted(f"t{i}" for i in range(30)))
    want, packed = [], []
    for _ in range(4):
        found = sorted((rng.randrange(30), rng.choice([-(1 << 62), -300, 0, 5, 5, 255, 256, 70_000, 1 << 62]) + rng.randrange(3)) for _ in range(200))
        places = [sorted(rng.sample(range(100_000), rng.choice([1, 1, 2, 300]))) for _ in found]
        want += [(terms[c].as_py(), d, len(p), 3 * len(p), tuple(p)) for (c, d), p in zip(found, places)]
        code, ids = (P.np.array(x, P.np.int64) for x in zip(*found))
        tf = P.np.array([len(p) for p in places], P.np.int64)
        flat = P.np.array([i for p in places for i in p], P.np.int64)
        packed += P._packed(terms, code, ids, tf, 3 * tf, flat, pa.array(["t3", "t7"]))
    rows = pa.Table.from_batches(packed).sort_by([("term", "ascending"), ("first", "ascending")]).append_column("bucket", pa.array([0] * sum(map(len, packed)), pa.int32()))
    got, seen = [], set()
    for block in P.gather_blocks(rows.combine_chunks().to_batches()):
        for r in block.to_pylist():
            assert r["n"] == len(r["offsets"]) and r["offsets"] == sorted(r["offsets"]) and (r["max_tf"], r["min_dl"]) == (max(r["tfs"]), min(r["dls"]))
            assert (r["term"], r["block"]) not in seen
            seen.add((r["term"], r["block"]))
            got += [(r["term"], r["block"] * P.BLOCK + o, t, d, tuple(p)) for o, t, d, p in zip(r["offsets"], r["tfs"], r["dls"], r["positions"])]
    assert sorted(got) == sorted(want)


def test_index_needs_less_disk_than_its_tokens(spark, monkeypatch):
    """The postings are those of the column expressions; the names are stored once, and tokens nowhere."""
    rng = random.Random(2)
    texts = [" ".join(f"w{int(rng.paretovariate(0.4)) % 20_000}" for _ in range(rng.randint(0, 300))) for _ in range(400)] + [None, "", "one one"]
    docs = cut_lineage(spark.createDataFrame([(i // 2 * 7 - 300, f"/t/{i}", t) for i, t in enumerate(texts)], "doc_id long, path string, name string"))
    monkeypatch.setattr(P, "GROUP_TOKENS", 5000)
    kept = []
    monkeypatch.setattr(index_table, "cut_lineage", lambda df: (kept.append(df.columns), cut_lineage(df))[1])
    index = IndexTable.create(spark, work_dir(spark, "ix"), buckets=3).commit(adds=docs)
    assert not any("tokens" in columns for columns in kept)
    assert as_rows(index.postings()) == as_rows(P.build_postings(docs))
    size = lambda kind: sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(f"{index.root}/{kind}") for f in files if f.endswith(".parquet"))
    assert size("paths") < size("docs") / 5


def test_deletes_find_the_names_of_texts(spark):
    """Terms of removed documents are counted down, whether their names follow from the path or not."""
    rows = [(1, "/d/a.txt", "a.txt"), (1, "/d/a.txt", "red red"), (2, "/d/b", "blue x"), (3, "/d/c", None), (4, "/d/keep", "red x")]
    docs = spark.createDataFrame(rows, "doc_id long, path string, name string")
    index = IndexTable.create(spark, work_dir(spark, "ix"), buckets=2).commit(adds=docs)
    left = index.commit(deletes=spark.createDataFrame([("/d/a.txt",), ("/d/b",), ("/d/c",)], "path string"))
    assert sorted(map(tuple, left.terms().select("term", "df").collect())) == [("red", 1), ("x", 1)]
    assert (left.num_docs(), left.generation.n_tokens) == (1, 2) and left.docs().select(F.max("path")).first()[0] == "/d/keep"


@pytest.mark.parametrize("most", [None, 0])
def test_batches_shuffle_blocks_not_hits(spark, monkeypatch, most):
    """Each posting block is moved once however many requests ask for its term; scores are those of all hits."""
    rng = random.Random(4)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7)) % 50}" for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    docs = spark.createDataFrame([(i * 3, f"/t/{i}", t) for i, t in enumerate(texts)], "doc_id long, path string, name string")
    view = IndexTable.create(spark, work_dir(spark, "ix"), buckets=3).commit(adds=docs).view()
    asked = spark.createDataFrame([(q, f"w1 w2 w{q} w{q + 1}_w1") for q in range(20)], "query_id long, q string")
    terms = cut_lineage(R.clause_terms(R.word_clauses(asked), optional=True))
    summed = []
    sums = R.Matching.sums
    monkeypatch.setattr(R.Matching, "sums", lambda m, *args: (summed.append(sums(m, *args)), summed[-1])[1])
    row = lambda df: sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())
    assert row(R.best_hits(view, terms, 10, most=most)) == row(R.top_k(R.any_term_scores(view, R.clause_hits(view, terms)), 10))
    assert summed
    for df in summed:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(query_id" not in plan and plan.count("hashpartitioning(block#") == 1
