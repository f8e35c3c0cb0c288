import json
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from pathloom.operators.changes import path_copies
from pathloom.plans import search as S
from pathloom.plans.build import init_index
from pathloom.session import work_dir
from pathloom.sources.events import read_events
from pathloom.sources.index_table import IndexTable
from pathloom.sources.settings import append_log, list_settings, pairs, read_log
from pathloom.streaming.feed import apply_actions, follow
from pathloom.streaming.requests import answer_stream, read_queries

from .names import names
from .test_changes import as_frame, make_log, model


class Feed:
    def __init__(self, spark, **options):
        self.spark, self.base, self.options = spark, work_dir(spark, "feed"), options
        self.seq = 0
        IndexTable.create(spark, f"{self.base}/index", buckets=2)

    def send(self, events, torn=()):
        lines = []
        for op, paths, exists in events:
            lines.append(json.dumps({"seq": self.seq, "op": op, "paths": paths, "exists_after": exists}))
            self.seq += 1
        rows = [(line,) for line in [*lines, *torn]]
        self.spark.createDataFrame(rows, "value string").write.mode("append").text(f"{self.base}/in")
        follow(
            read_events(self.spark, f"{self.base}/in"), f"{self.base}/index", f"{self.base}/checkpoint",
            log_path=f"{self.base}/settings", bad_path=f"{self.base}/bad", **self.options,
        ).awaitTermination()
        return IndexTable.open(self.spark, f"{self.base}/index")


def test_random_feeds_follow_the_model(spark):
    """Creates, renames and removes in random order, in instalments, against a list of paths."""
    rng = random.Random(3)
    feed, model = Feed(spark, excludes=["/w/skip"], include="/w"), []
    pool = [f"/w/{n}" for n in names(3, 25)]
    counts = []
    for _ in range(3):
        events = []
        for _ in range(25):
            op = rng.choice(["create", "create", "rename", "remove"])
            a, b = rng.sample(pool, 2)
            if op == "rename":
                events.append((op, [a, b], [False, True]))
                model = [p for p in model if p != a] + [b]
            else:
                events.append((op, [a], None))
                model = model + [a] if op == "create" else [p for p in model if p != a]
        events += [("create", ["/w/skip/x"], None), ("create", ["/other/y"], None), ("create", ["/wide"], None), ("other", [pool[0]], None)]
        index = feed.send(events, torn=['{"seq": 7, "op'])
        assert sorted(r.path for r in index.docs().collect()) == sorted(model)
        counts.append(str(len(model)))
    log = read_log(spark, f"{feed.base}/settings")
    assert [(r.version, r.value) for r in log.orderBy("version").collect()] == list(enumerate(counts))
    assert spark.read.json(f"{feed.base}/bad").where("raw IS NOT NULL").count() == 3


def test_a_new_checkpoint_starts_a_new_stream(spark):
    feed = Feed(spark)
    feed.send([("create", ["/a/one"], None)])
    rows = spark.createDataFrame([(json.dumps({"seq": 1, "op": "create", "paths": ["/a/two"]}),)], "value string")
    rows.write.text(f"{feed.base}/more")

    def run(name):
        follow(read_events(spark, f"{feed.base}/more"), f"{feed.base}/index", f"{feed.base}/checkpoint-{name}", f"{feed.base}/bad", name=name).awaitTermination()

    with pytest.raises(StreamingQueryException, match="new name"):
        run("feed")
    run("second")
    run("second")
    assert sorted(r.path for r in IndexTable.open(spark, f"{feed.base}/index").docs().collect()) == ["/a/one", "/a/two"]


def test_a_rename_that_nobody_knows_about_is_a_bad_event(spark):
    feed = Feed(spark)
    index = feed.send([("create", ["/a/one"], None), ("rename", ["/a/one", "/a/two"], None), ("rename", ["/a/one", "/a/three"], [True, None])])
    assert [r.path for r in index.docs().collect()] == ["/a/one"]
    assert spark.read.json(f"{feed.base}/bad").where("raw IS NOT NULL").count() == 2
    files = spark.createDataFrame([("/a/two",)], "path string")
    known = Feed(spark, files=files)
    index = known.send([("create", ["/a/one"], None), ("rename", ["/a/one", "/a/two"], None)])
    assert [r.path for r in index.docs().collect()] == ["/a/two"]


def test_build_and_feed_share_one_log(spark):
    feed = Feed(spark)
    path = f"{feed.base}/settings"
    append_log(pairs(spark, [("version", "v1"), ("default_exclude_path", "[]")], 10**12), path)
    files = spark.sql("SELECT * FROM VALUES ('/a', 'x'), ('/a/b', NULL), ('/a/c', NULL) AS t(path, error)").selectExpr(
        "path", "false AS is_dir", "1L AS size", "current_timestamp() AS mtime", "error"
    )
    init_index(IndexTable.open(spark, f"{feed.base}/index"), files, path, 1_700_000_000, "v1", snapshot_seq=-1)

    def value(key):
        return {r.key: r.value for r in list_settings(read_log(spark, path)).collect()}[key]

    assert (value("indexed_files"), value("entries"), value("errors")) == ("2", "3", "1")
    feed.send([("create", ["/a/d"], None)])
    assert value("indexed_files") == "3"


@pytest.mark.parametrize("cuts", [[600], [50, 600], [1, 300, 301, 600]])
def test_any_split_equals_whole_log(spark, cuts):
    log, table = make_log(11), IndexTable.create(spark, work_dir(spark, "ix"), buckets=2)
    start = 0
    for batch, end in enumerate(cuts):
        part = [e for e in log if start <= e[0] < end]
        table, start = apply_actions(table, as_frame(spark, part), ("s", batch)), end
    got = {r.path: r.copies for r in path_copies(table.docs()).collect()}
    assert got == model(log) and table.num_docs() == sum(got.values())
    repeated = apply_actions(table, as_frame(spark, log), ("s", len(cuts) - 1))
    assert repeated is table


def test_backlog_is_applied_once(spark):
    feed = Feed(spark)
    built = IndexTable.open(spark, f"{feed.base}/index").commit(
        adds=spark.createDataFrame([("/a/x",)], "path string"), snapshot_seq=0
    )
    assert built.num_docs() == 1
    index = feed.send([("create", ["/a/x"], None), ("create", ["/a/y"], None)])
    assert sorted(r.path for r in index.docs().collect()) == ["/a/x", "/a/y"]


def test_commits_are_merged_by_tiers(spark):
    """A large first segment stays as it is; ids removed by merged commits stay removed in it."""
    base = work_dir(spark, "tiers")
    first = spark.range(5000).selectExpr("concat('/big/n', id) AS path")
    table = IndexTable.create(spark, f"{base}/index", buckets=2).commit(adds=first)
    big, model = table.generation.docs[0], [f"/big/n{i}" for i in range(5000)]
    for i in range(5):
        gone, new = [f"/big/n{i}", f"/c/n{i - 1}"], [f"/c/n{i}", f"/c/n{i}", f"/big/n{i}x"]
        frame = lambda paths: spark.createDataFrame([(p,) for p in paths], "path string")
        table = table.commit(adds=frame(new), deletes=frame(gone)).merge_tail(2)
        model = [p for p in model if p not in gone] + new
        assert table.generation.docs[0] == big and len(table.generation.docs) <= 4
        assert sorted(r.path for r in table.docs().collect()) == sorted(model) and table.num_docs() == len(model)
    packed = table.compact()
    terms = lambda t: sorted(map(tuple, t.terms().select("term", "df").collect()))
    assert terms(packed) == terms(table) == terms(IndexTable.open(spark, table.root, table.generation.number))


def test_deletes_read_only_the_slots_of_their_paths(spark, monkeypatch):
    """A thousand deletes, whose slots are partition filters; other slots are not scanned."""
    from pathloom.sources import index_table

    monkeypatch.setattr(index_table, "SLOT_ROWS", 20)
    paths = spark.range(3000).selectExpr("concat('/p/', id) AS path")
    table = IndexTable.create(spark, work_dir(spark, "ix"), buckets=2).commit(adds=paths)
    (slots,) = table.generation.slots.values()
    assert slots == 256
    gone = paths.where(index_table.slot_of("path", slots) < 90).limit(1000).persist()
    stored = table.stored_paths(gone)
    read = {r[0] for r in stored.select(F.regexp_extract(F.input_file_name(), "slot=(\\d+)", 1).cast("int")).distinct().collect()}
    touched = {r[0] for r in gone.select(index_table.slot_of("path", slots)).distinct().collect()}
    assert read == touched and len(read) < slots
    assert "PartitionFilters: [slot" in stored._jdf.queryExecution().executedPlan().toString()
    after = table.commit(deletes=gone)
    assert after.num_docs() == 2000 == after.docs().count()
    assert sorted(r.path for r in after.docs().collect()) == sorted(r.path for r in paths.subtract(gone).collect())


def test_requests(spark):
    base = work_dir(spark, "requests")
    index = IndexTable.create(spark, f"{base}/index", buckets=2).commit(
        adds=spark.createDataFrame([("/a/red.txt",), ("/a/blue.txt",)], "path string")
    )
    asked = spark.createDataFrame([(1, "red"), (2, "txt"), (3, " "), (4, "red")], "query_id long, q string")
    asked.write.json(f"{base}/in")
    answer_stream(
        read_queries(spark, f"{base}/in"), lambda q: S.batch_hits(index.view(), q), f"{base}/out", f"{base}/cp"
    ).awaitTermination()
    rows = spark.read.parquet(f"{base}/out").groupBy("query_id").agg(F.count("*").alias("n")).collect()
    assert {r.query_id: r.n for r in rows} == {1: 1, 2: 2, 4: 1}
