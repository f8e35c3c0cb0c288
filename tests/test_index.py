import datetime as dt
import math
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pathloom.operators import ranking as R
from pathloom.operators.postings import build_postings, doc_lengths
from pathloom.plans import search as S
from pathloom.plans.build import index_files
from pathloom.session import work_dir
from pathloom.sources.catalog import crawl
from pathloom.sources.index_table import IndexTable

from .names import names, tokens

AS_OF = dt.date(2024, 6, 1)

def paths_of(spark, paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def state(index):
    return (
        sorted(map(tuple, index.terms().select("term", "df").collect())),
        sorted(map(tuple, index.docs().select("doc_id", "path").collect())),
        index.generation.n_docs, index.generation.n_tokens,
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_random_changes_follow_the_model(spark, seed):
    """Adds, deletes and searches in random order, against a list of paths."""
    rng = random.Random(seed)
    pool = [f"/r/{n}" for n in names(seed, 30)]
    index, model = IndexTable.create(spark, work_dir(spark, "ix"), buckets=4), []
    nothing = paths_of(spark, []).selectExpr("path", "false AS is_dir", "0L AS size", "current_timestamp() AS mtime")
    for _ in range(6):
        gone = rng.sample(pool, rng.randint(0, 3))
        new = rng.choices(pool, k=rng.randint(1, 9))
        index = index.commit(adds=paths_of(spark, new), deletes=paths_of(spark, gone) if gone else None)
        model = [p for p in model if p not in gone] + new
        assert index.num_docs() == len(model)
        assert sorted(r.path for r in index.docs().collect()) == sorted(model)
        asked = rng.choice(tokens(os.path.basename(rng.choice(pool))))
        found = [r.path for r in S.search(index.view(), nothing, asked, AS_OF).collect()]
        assert sorted(found) == sorted(p for p in model if asked in tokens(os.path.basename(p)))
    live = index.docs().select("doc_id", "path", "name")
    assert state(index)[0] == sorted(map(tuple, build_postings(live).groupBy("term").count().collect()))
    packed = index.compact()
    assert state(packed) == state(index) and len(packed.generation.docs) == 1
    assert state(IndexTable.open(spark, index.root)) == state(index)
    assert packed.reset().num_docs() == 0


def test_the_whole_name_ranks_first(spark):
    own = [n for n in names(5, 40) if len(set(tokens(n))) > 1]
    index = IndexTable.create(spark, work_dir(spark, "ix"), buckets=4).commit(adds=paths_of(spark, [f"/r/{n}" for n in own]))
    for n in own[:4]:
        best = S.search_hits(index.view(), " ".join(tokens(n))).where("rank = 1").join(index.docs(), "doc_id").first()
        assert set(tokens(n)) <= set(tokens(best.name))
    assert S.search_hits(index.view(), "").count() == S.search_hits(index.view(), " -- ").count() == 0


def test_crawl_lists_what_is_there(spark, tmp_path):
    own = names(6, 25)
    for i, n in enumerate(own):
        folder = tmp_path / f"d{i % 3}"
        folder.mkdir(exist_ok=True)
        (folder / n).write_text("x" * i)
    files = crawl(spark, str(tmp_path), [f"{tmp_path}/d1"])
    index, errors = index_files(IndexTable.create(spark, work_dir(spark, "ix"), buckets=4), files)
    want = [str(tmp_path)] + [f"{tmp_path}/d{k}" for k in range(3)] + [f"{tmp_path}/d{i % 3}/{n}" for i, n in enumerate(own) if i % 3 != 1]
    assert sorted(r.path for r in index.docs().collect()) == sorted(want) and errors.count() == 0


@pytest.mark.parametrize("later", [False, True])
def test_an_id_that_comes_back_is_live(spark, later):
    def docs(*rows):
        return spark.createDataFrame(rows, "doc_id long, path string")

    index = IndexTable.create(spark, work_dir(spark, "ix"), buckets=2).commit(adds=docs((1, "/a/one"), (2, "/a/two"), (3, "/a/three")))
    gone = paths_of(spark, ["/a/one", "/a/two"])
    again = docs((1, "/a/one"), (2, "/b/other"))
    index = index.commit(deletes=gone).commit(adds=again) if later else index.commit(adds=again, deletes=gone)
    packed = index.compact()
    for table in (index, packed):
        assert sorted((r.doc_id, r.path) for r in table.docs().collect()) == [(1, "/a/one"), (2, "/b/other"), (3, "/a/three")]
        assert table.num_docs() == 3 == sum(r["count"] for r in table.docs().groupBy("path").count().collect())
        assert {r.term: r.df for r in table.terms().collect()} == {"one": 1, "other": 1, "three": 1}
        assert S.search_hits(table.view(), "other").count() == 1 and S.search_hits(table.view(), "two").count() == 0
    index = packed.commit(deletes=paths_of(spark, ["/b/other"]))
    assert index.num_docs() == 2 == index.docs().count()


def test_a_page_has_one_row_per_hit(spark):
    index = IndexTable.create(spark, work_dir(spark, "ix"), buckets=2).commit(adds=paths_of(spark, ["/d/x.txt", "/d/y.txt"]))
    files = spark.sql(
        "SELECT * FROM VALUES ('/d/x.txt', false, 1L, timestamp_seconds(100)), ('/d/x.txt', false, 2L, timestamp_seconds(300)),"
        " ('/d/x.txt', false, 3L, NULL), ('/d/y.txt', false, 4L, NULL) AS t(path, is_dir, size, mtime)"
    )
    page = S.search(index.view(), files, "txt", AS_OF).collect()
    assert sorted((r.path, r["size"]) for r in page) == [("/d/x.txt", 2.0), ("/d/y.txt", 4.0)]
    asked = spark.createDataFrame([(7, "x"), (8, "txt"), (9, "none")], "query_id long, q string")
    pages = S.search_batch(index.view(), files, asked, AS_OF).collect()
    assert sorted((r.query_id, r.path, r["size"]) for r in pages) == [(7, "/d/x.txt", 2.0), (8, "/d/x.txt", 2.0), (8, "/d/y.txt", 4.0)]
    assert {r.name for r in pages} == {"x.txt", "y.txt"} and {r["class"] for r in pages} == {"txt"}


def test_enrich_of_search(spark):
    root = work_dir(spark, "ix")
    index = IndexTable.create(spark, root, buckets=4).commit(adds=paths_of(spark, ["/d/conf.d", "/d/conf.txt", "/gone/conf", "/old/conf.x"]))
    files = spark.sql(
        "SELECT * FROM VALUES ('/d/conf.d', true, 4096L, timestamp_seconds(86400), NULL),"
        " ('/d/conf.txt', false, 7L, timestamp_seconds(1704067200), NULL),"
        " ('/old/conf.x', false, 9L, timestamp_seconds(-5), NULL) AS t(path, is_dir, size, mtime, error)"
    )
    page = {r.path: r for r in S.search(index.view(), files, "conf", AS_OF).collect()}
    assert page["/d/conf.d"]["class"] == "d" and page["/d/conf.d"].last_modified_date == dt.date(1970, 1, 2)
    assert page["/gone/conf"]["class"] == "unknown" and page["/gone/conf"]["size"] == 0.0
    assert page["/gone/conf"].last_modified_date == AS_OF == page["/old/conf.x"].last_modified_date
    assert page["/d/conf.txt"].name == "conf.txt" and page["/d/conf.txt"]["size"] == 7.0


def test_commits_are_isolated_and_single_writer(spark):
    root = work_dir(spark, "ix")
    first = IndexTable.create(spark, root, buckets=2).commit(adds=paths_of(spark, ["/a/x.txt"]), stream=("s", 3))
    second = first.commit(adds=paths_of(spark, ["/a/y.txt"]))
    assert first.docs().count() == 1 and second.docs().count() == 2
    assert IndexTable.open(spark, root, first.generation.number).docs().count() == 1
    assert second.commit(adds=paths_of(spark, ["/a/z.txt"]), stream=("s", 3)) is second
    with pytest.raises(FileExistsError):
        first.commit(adds=paths_of(spark, ["/a/other.txt"]))
    assert IndexTable.open(spark, root).num_docs() == 2
    with pytest.raises(FileNotFoundError):
        IndexTable.open(spark, work_dir(spark, "none"))


# ---------------------------------------------------------------- ranking against brute force

TEXTS = ["a b a b c", "b a", "c c c c", "a", "", "x y z a b", "b b b a c a b", "z-y x_a.b"] * 3


def brute(clauses):
    """{doc_id: score} for [(occur, [terms])]."""
    docs = [re.findall(r"[^\W_]+", t) for t in TEXTS]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d))
    idf = lambda t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
    out = {}
    for i, d in enumerate(docs):
        score, ok, positive = 0.0, True, False
        for occur, terms in clauses:
            tf = sum(d[p:p + len(terms)] == terms for p in range(len(d)))
            if tf and occur != "must_not":
                positive = True
                score += sum(map(idf, terms)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / avg))
            ok &= not (tf and occur == "must_not") and not (not tf and occur == "must")
        if ok and positive:
            out[i] = round(score, 6)
    return out


@pytest.fixture(scope="module")
def view(spark):
    docs = spark.createDataFrame([(i, f"/t/{i}", t) for i, t in enumerate(TEXTS)], "doc_id long, path string, name string")
    return IndexTable.create(spark, work_dir(spark, "ix"), buckets=3).commit(adds=docs).view()


CASES = [
    [("should", ["a"])],
    [("should", ["a"]), ("should", ["b"]), ("should", ["a"])],
    [("should", ["a", "b"])],
    [("should", ["a", "b", "a"]), ("should", ["c"])],
    [("must", ["a"]), ("should", ["c"])],
    [("must", ["a"]), ("must", ["c"]), ("must_not", ["x"])],
    [("must", ["b", "a"]), ("must_not", ["b", "b"])],
    [("should", ["a"]), ("must_not", ["a", "b"])],
    [("must_not", ["a"])],
    [("must", ["nowhere"]), ("should", ["a"])],
    [("should", ["a", "nowhere"])],
]


@pytest.mark.parametrize("small", [True, False])
def test_clauses_match_brute_force(spark, view, small):
    rows = [
        (q, c, occur, "_".join(terms)) for q, clauses in enumerate(CASES) for c, (occur, terms) in enumerate(clauses)
    ]
    frame = spark.createDataFrame(rows, "query_id long, clause int, occur string, text string")
    terms = R.clause_terms(frame)
    got = {}
    for r in R.score_hits(view, R.clause_hits(view, terms, small=small)).collect():
        got.setdefault(r.query_id, {})[r.doc_id] = round(r.score, 6)
    for q, clauses in enumerate(CASES):
        assert got.get(q, {}) == pytest.approx(brute(clauses), abs=2e-6), clauses


@pytest.mark.parametrize("small", [True, False])
def test_clause_by_clause_gives_the_same_scores(spark, view, small):
    rows = [
        (q, c, occur, "_".join(terms)) for q, clauses in enumerate(CASES) for c, (occur, terms) in enumerate(clauses)
    ]
    rows += [(90, 0, "must", "a"), (90, 1, "must", "a"), (90, 2, "must", "b_a"), (91, 0, "must", "c_c"), (91, 1, "should", "a_nowhere")]
    cases = [*enumerate(CASES), (90, [("must", ["a"]), ("must", ["a"]), ("must", ["b", "a"])]), (91, [("must", ["c", "c"])])]
    terms = R.clause_terms(spark.createDataFrame(rows, "query_id long, clause int, occur string, text string"))
    got = {}
    for r in R.bool_scores(view, terms, small=small).collect():
        got.setdefault(r.query_id, {})[r.doc_id] = round(r.score, 6)
    for q, clauses in cases:
        assert got.get(q, {}) == pytest.approx(brute(clauses), abs=2e-6), clauses


@pytest.fixture(scope="module")
def skewed(spark):
    """2,000 documents over several segments: common and rare words, some documents removed, an id that came back."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(40)], k=rng.randint(1, 60))) for _ in range(2000)]
    docs = spark.createDataFrame([(i, f"/t/{i}", t) for i, t in enumerate(texts)], "doc_id long, path string, name string")
    index = IndexTable.create(spark, work_dir(spark, "ix"), buckets=3).commit(adds=docs.where("doc_id < 1500"))
    index = index.commit(adds=docs.where("doc_id >= 1500"), deletes=paths_of(spark, [f"/t/{i}" for i in range(0, 1500, 3)]))
    back = spark.createDataFrame([(3, "/back/3", "w0 w1 w39 w39")], "doc_id long, path string, name string")
    return index.commit(adds=back)


@pytest.mark.parametrize("k, leading", [(1, 20), (10, 1), (500, 20)])
def test_score_bounds_keep_every_best_hit(spark, skewed, k, leading, monkeypatch):
    rng = random.Random(k)
    monkeypatch.setattr(R, "LEADING", leading)
    view = skewed.view()
    asked = [(q, " ".join(rng.choices([f"w{i}" for i in range(42)], k=rng.randint(1, 9)))) for q in range(25)] + [(30, "w0 w0 w0 w39"), (31, "w3_w1 w0 w20")]
    terms = R.clause_terms(R.word_clauses(spark.createDataFrame(asked, "query_id long, q string")), optional=True)
    looked_up = []
    opened = R.Matching.hits
    monkeypatch.setattr(R.Matching, "hits", lambda m, wanted, positions=False: (looked_up.append(opened(m, wanted, positions)), looked_up[-1])[1])
    got = sorted(map(tuple, R.best_hits(view, terms, k, most=0).select("query_id", "rank", "doc_id").collect()))
    want = R.best_hits(view, terms, k).select("query_id", "rank", "doc_id").collect()
    assert got == sorted(map(tuple, want))
    # Opened: for the estimate, for strong terms, for phrases; then for all terms, for phrases.
    assert len(looked_up) == 5
    if k == 1:
        assert looked_up[1].count() < looked_up[3].count()


def test_blocks_hold_every_posting_once(spark, skewed):
    live = skewed.docs().select("doc_id", "path", "name")
    as_rows = lambda df: sorted((r.term, r.doc_id, r.tf, r.dl, tuple(r.positions)) for r in df.select("term", "doc_id", "tf", "dl", "positions").collect())
    assert as_rows(skewed.postings()) == as_rows(build_postings(live)) == as_rows(skewed.compact().postings())
    for r in skewed.blocks().collect():
        assert r.n == len(r.offsets) == len(r.tfs) == len(r.dls) == len(r.positions) <= 256
        assert (r.max_tf, r.min_dl) == (max(r.tfs), min(r.dls)) and r.offsets == sorted(r.offsets) and 0 <= r.offsets[0] and r.offsets[-1] < 256
    bounds = {r.term: (r.max_tf, r.min_dl) for r in skewed.terms().collect()}
    for r in skewed.postings().collect():
        assert bounds[r.term][0] >= r.tf and bounds[r.term][1] <= r.dl


def test_a_rare_term_is_in_one_file(spark, monkeypatch):
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    docs = spark.range(20000).selectExpr("id AS doc_id", "concat('/n/', id) AS path", "concat('common t', id div 4, ' t', id % 5000) AS name")
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "50kb")
        index = IndexTable.create(spark, work_dir(spark, "ix"), buckets=2).commit(adds=docs.repartition(5))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    files = index.blocks().select("term", F.input_file_name().alias("file")).groupBy("term").agg(F.countDistinct("file").alias("files"))
    assert {r["files"] for r in files.where("term <> 'common'").collect()} == {1}
    assert files.where("term = 'common'").first()["files"] > 3


def test_plain_frames_give_the_same_scores(spark, view):
    docs = view.docs.select("doc_id", "path", "name")
    plain = R.view_of(doc_lengths(docs), build_postings(docs))
    asked = R.query_terms(spark, "a_b c")
    assert (asked.clauses, asked.phrases, asked.terms) == (2, True, ["a", "b", "c"])
    score = lambda v: sorted(map(tuple, R.any_term_scores(v, R.clause_hits(v, asked)).withColumn("score", F.round("score", 6)).collect()))
    assert score(plain) == score(view)


def test_requests_with_equal_text_share_an_answer(spark, view):
    asked = spark.createDataFrame([(i, " a b ") for i in range(5)] + [(9, "z"), (10, "  "), (11, "??")], "query_id long, q string")
    hits = S.batch_hits(view, asked, k=4)
    by = {}
    for r in hits.collect():
        by.setdefault(r.query_id, []).append((r.rank, r.doc_id, r.score))
    assert set(by) == {0, 1, 2, 3, 4, 9}
    assert all(sorted(by[i]) == sorted(by[0]) and len(by[i]) == 4 for i in range(5))
    want = sorted(brute([("should", ["a"]), ("should", ["b"])]).items(), key=lambda kv: (-kv[1], kv[0]))[:4]
    assert [d for _, d, _ in sorted(by[0])] == [d for d, _ in want]


@pytest.mark.parametrize("k", [3, 5000])
def test_top_k_is_whole(spark, k):
    scored = spark.range(20000).selectExpr("id % 3 AS query_id", "id AS doc_id", "CAST(id % 97 AS double) AS score")
    got = sorted((r.query_id, r["rank"], r.doc_id) for r in R.top_k(scored, k).collect())
    want = []
    for q in range(3):
        ranked = sorted((i for i in range(20000) if i % 3 == q), key=lambda i: (-(i % 97), i))[:k]
        want += [(q, r, d) for r, d in enumerate(ranked, 1)]
    assert got == sorted(want)


def test_plan_prunes(spark, view):
    asked = R.query_terms(spark, "a")
    hits = R.any_term_scores(view, R.clause_hits(view, asked), asked.clauses)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,a)" in plan
    assert "HashAggregate" not in plan and "Exchange hashpartitioning" not in plan
    assert "positions" not in plan


def test_hot_bucket_is_split(spark):
    """One term in every document: its bucket becomes several files, not one task's work."""
    docs = spark.range(40000).selectExpr("id AS doc_id", "concat('/n/', id) AS path", "concat('common ', uuid()) AS name")
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100kb")
        index = IndexTable.create(spark, work_dir(spark, "ix"), buckets=2).commit(adds=docs.repartition(6))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    hits = R.term_query(index.view(), "common")
    assert hits.count() == 40000
    assert hits.select(F.input_file_name()).distinct().count() > 2
