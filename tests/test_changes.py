import random

import pytest
from pyspark.sql import functions as F

from pathloom.operators import catalogs, changes as M, numbering, results as O
from pathloom.plans.build import init_index
from pathloom.session import work_dir
from pathloom.sources import settings as K
from pathloom.sources.events import split_bad_events
from pathloom.sources.index_table import IndexTable

DAY = 86400


def model(log):
    """Copies per path after applying a log one by one."""
    state = {}
    for _, path, action in sorted(log):
        state[path] = 0 if action == "delete" else state.get(path, 0) + 1
    return {p: n for p, n in state.items() if n}


def make_log(seed, n=600):
    rng = random.Random(seed)
    pick = lambda: "/hot" if rng.random() < 0.4 else f"/p{rng.randint(0, 30)}"
    return [(i * rng.choice([1, 1, 1]), pick(), "delete" if rng.random() < 0.15 else "add") for i in range(n)]


def as_frame(spark, log):
    return spark.createDataFrame(log, "seq long, path string, action string")


def as_dict(df):
    return {r.path: r.copies for r in df.collect()}


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_replay_equals_model(spark, chunk):
    log = make_log(chunk)
    changes = M.net_changes(as_frame(spark, log), chunk)
    adds = changes.groupBy("path").agg(F.sum("copies").alias("copies")).where("copies > 0")
    assert as_dict(adds) == model(log)
    last = {p: s for s, p, action in log if action == "delete"}
    assert {r.path: r.last_del for r in changes.where("last_del IS NOT NULL").collect()} == last


@pytest.mark.parametrize("cuts", [(100, 101), (1, 400), (300, 599)])
def test_batches_equal_whole_log(spark, cuts):
    log = make_log(5)
    frame, (a, b) = as_frame(spark, log), cuts
    parts = [frame.where(F.col("seq") < a), frame.where((F.col("seq") >= a) & (F.col("seq") < b)), frame.where(F.col("seq") >= b)]
    s = [M.batch_summary(p) for p in parts]
    empty = spark.createDataFrame([], "path string, copies long")
    one_by_one = M.merge_batch(M.merge_batch(M.merge_batch(empty, s[0]), s[1]), s[2])
    combined = M.merge_batch(empty, M.combine_summaries(s[0], M.combine_summaries(s[1], s[2])))
    assert as_dict(one_by_one) == as_dict(combined) == model(log)


def test_routing(spark):
    events = spark.createDataFrame(
        [
            (1, "create", ["/a", "/lib/x"], None), (2, "rename", ["/a", "/b"], [False, True]), (3, "remove", ["/b"], None),
            (4, "other", ["/a"], None), (5, "rename", ["/c"], None),
        ],
        "seq long, op string, paths array<string>, exists_after array<boolean>",
    )
    rows = lambda df: sorted((r.seq, r.path, r.action) for r in df.collect())
    assert rows(M.route_events(events, ["/lib"])) == [
        (1, "/a", "add"), (2, "/a", "delete"), (2, "/b", "add"), (3, "/b", "delete"), (5, "/c", "delete"),
    ]
    seen = spark.createDataFrame([("/c",), ("/z",)], "path string")
    assert (5, "/c", "add") in rows(M.route_events(events, files=seen))


def test_bad_events(spark):
    rows = [(1, "create", ["/a"], None), (None, "create", ["/b"], None), (2, None, ["/c"], None), (3, "create", ["/d"], "{torn")]
    events = spark.createDataFrame(rows, "seq long, op string, paths array<string>, _corrupt_record string")
    good, bad = split_bad_events(events)
    assert [r.seq for r in good.collect()] == [1] and bad.count() == 3 and bad.where("raw = '{torn'").count() == 1


def test_numbering(spark):
    rng = random.Random(1)
    keys = sorted({rng.randint(-50, 50) for _ in range(40)} | {rng.randint(-(2**40), 2**40) for _ in range(60)} | {2**62 + i for i in range(9)})
    rows = [(k, t) for k in keys for t in range(rng.randint(1, 3))]
    got = numbering.number_rows(spark.createDataFrame(rows, "k long, t int"), "k", ["t"])
    assert sorted((r.n, r.k, r.t) for r in got.collect()) == [(i, *r) for i, r in enumerate(sorted(rows), 1)]


@pytest.mark.parametrize("kind", ["one hot key", "hashed keys"])
def test_numbering_gives_no_task_much(spark, kind):
    rows = spark.range(30_000).select(
        (F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")) if kind == "one hot key" else F.xxhash64("id")).alias("k"),
        F.col("id").alias("t"),
    )
    numbered = numbering.number_rows(rows, "k", ["t"])
    want = sorted((r.k, r.t) for r in rows.collect())
    assert sorted((r.n, r.k, r.t) for r in numbered.collect()) == [(i, *r) for i, r in enumerate(want, 1)]
    parts = [r["count"] for r in numbering._in_order(rows, "k", "t").groupBy("_part").count().collect()]
    assert len(parts) > 2 and max(parts) < 15_000


def test_progress(spark):
    roots = spark.createDataFrame([("/b",), ("/a",), ("/c",), ("/d",)], "root string")
    assert [(r.root, r.percent) for r in numbering.progress(roots).orderBy("root").collect()] == [
        ("/a", 25.0), ("/b", 50.0), ("/c", 75.0), ("/d", 100.0),
    ]
    assert numbering.progress(roots.where("false")).count() == 0


# ---------------------------------------------------------------- catalogues and pages


def test_overlay_and_union(spark):
    first = spark.createDataFrame([("/i/a", 1), ("/i/b", 2)], "path string, size int")
    second = spark.createDataFrame([("/i/b", 20), ("/i/c", 30), ("/x", 9)] * 2, "path string, size int")
    assert [r.path for r in catalogs.union_catalogs(first, second, "/i").collect()] == ["/i/a", "/i/b", "/i/c"]
    wanted = spark.createDataFrame([("/i/a",), ("/i/b",), ("/i/c",), ("/none",)], "path string")
    got = {r.path: (r["size"], r.found) for r in catalogs.load_assets(wanted, first, second, ["size"]).collect()}
    assert got == {"/i/a": (1, True), "/i/b": (2, True), "/i/c": (30, True), "/none": (None, False)}


def test_page_columns_and_order(spark):
    page = spark.createDataFrame(
        [(1, "a", 5.0, 2), (2, "b", 5.0, 1), (3, "c", 1.0, 3)], "rank int, name string, size double, last_modified_date int"
    )
    order = lambda c, d="default": [r["rank"] for r in O.sort_results(page, c, d).collect()]
    assert order("size") == [3, 1, 2] and order("size", "descending") == [1, 2, 3]
    assert order("last_modified_date") == [2, 1, 3] and order("name", "descending") == [1, 2, 3]
    assert O.move_column(["a", "b", "c", "d"], 3, 0) == ["d", "a", "b", "c"]
    with pytest.raises(ValueError):
        O.project_result(page, ["owner"])


# ---------------------------------------------------------------- settings


def test_staleness_order(spark):
    now = 100 * DAY
    cases = [
        (None, "v1", "false", "true", "missing"), ("soon", "v1", "false", "true", "missing"),
        (str(now - 15 * DAY - 1), "v0", "true", "false", "age"), (str(now - 15 * DAY), "v1", "false", "true", None),
        (str(now + 5), "v1", "false", "true", None), (str(now), "v0", "true", "false", "version"),
        (str(now), None, "false", "true", "version"), (str(now), "v1", "true", "false", "refresh"),
        (str(now), "v1", "false", "false", "not indexed"), (str(now), "v1", None, None, None),
    ]
    states = spark.createDataFrame(cases, "last_indexed string, version string, refresh string, indexed string, want string")
    judged = K.index_staleness(states, now, "v1")
    assert judged.where("NOT (reason <=> want) OR stale <> (want IS NOT NULL)").count() == 0


def test_log(spark):
    path = work_dir(spark, "kv")
    K.append_log(K.pairs(spark, [("a", "1"), ("b", "1"), ("a", "2")], 1), path)
    K.append_log(K.pairs(spark, [("b", "9")], 2), path)
    log = K.read_log(spark, path)
    assert [tuple(r) for r in K.list_settings(log).collect()] == [("a", "2"), ("b", "9")]
    found, missing = K.lookup_settings(K.latest(log), spark.createDataFrame([("a",), ("z",)], "key string"))
    assert [r.value for r in found.collect()] == ["2"] and [r.key for r in missing.collect()] == ["z"]


def test_defaults_only_without_marker(spark):
    log = spark.createDataFrame([("s1", "config_file", "x"), ("s2", "other", "y")], "scope string, key string, value string")
    rows = K.defaults_for(log, [("indexed", "false")], log, ["scope"])
    assert [tuple(r) for r in rows.select("scope", "key", "value").collect()] == [("s2", "indexed", "false")]


def test_init_index_gate(spark):
    path, now = work_dir(spark, "kv"), 200 * DAY
    start = K.default_settings("/h", "/c", "/i", "v1", now - DAY, ["/a/skip"])
    K.append_log(K.pairs(spark, start, 1), path)
    files = spark.createDataFrame(
        [(p, None) for p in ["/a", "/a/one.txt", "/a/skip", "/a/skip/two.txt", "/bin", "/bin/sh"]] + [("/a/bad", "denied")],
        "path string, error string",
    ).selectExpr("path", "false AS is_dir", "1L AS size", "current_timestamp() AS mtime", "error")
    table = init_index(IndexTable.create(spark, work_dir(spark, "ix"), buckets=2), files, path, now, "v1")
    assert sorted(r.path for r in table.docs().collect()) == ["/a", "/a/one.txt", "/a/skip"]
    state = {r.key: r.value for r in K.list_settings(K.read_log(spark, path)).collect()}
    assert (state["indexed"], state["indexed_files"], state["indexed_progress"]) == ("true", "3", "100")
    assert state["last_indexed"] == str(now)
    again = init_index(table, files, path, now + DAY, "v1")
    assert again is table
    rebuilt = init_index(table, files, path, now + DAY, "v2")
    assert rebuilt.generation.number > table.generation.number and rebuilt.num_docs() == 3
