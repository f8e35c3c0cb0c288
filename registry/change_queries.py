"""Change application, settings, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.operators import changes as M, numbering
from pathloom.plans import search as S
from pathloom.plans.build import init_index
from pathloom.session import work_dir
from pathloom.sources import settings as K
from pathloom.sources.events import read_events, split_bad_events
from pathloom.sources.index_table import IndexTable
from pathloom.streaming.feed import follow
from pathloom.streaming.requests import answer_stream, read_queries

from .catalog_queries import PARENT, ROOT, ROOTS_SQL, _root_excludes
from .search_queries import BATCH_SQL, PAGES_SQL, corpus_files
from .tables import AS_OF, FEED_SQL, NAMED_SQL, docs, fs_events, index_of, k_of, kv_log, manifest, register, requests, table

NOW = 1706659200


def _actions(spark, sf_dir, excludes=()):
    return M.route_events(fs_events(spark, sf_dir), excludes)


# ---------------------------------------------------------------- routing and replay


@register("route_events", f"WITH {FEED_SQL} SELECT seq, pos, path, action FROM actions")
def route_events(spark, sf_dir):
    return _actions(spark, sf_dir)


@register(
    "resolve_rename",
    f"""WITH {FEED_SQL}, present AS (SELECT DISTINCT path FROM fs JOIN events ON seq = event_id WHERE op = 'create' AND value > 40)
SELECT seq, pos, path, CASE WHEN op = 'create' THEN 'add' WHEN op = 'remove' THEN 'delete'
  WHEN path IN (SELECT path FROM present) THEN 'add' ELSE 'delete' END AS action
FROM changes WHERE op <> 'other'""",
)
def resolve_rename(spark, sf_dir):
    """Renames without the flag: a catalogue snapshot tells what exists."""
    events = fs_events(spark, sf_dir)
    unknown = events.withColumn("exists_after", F.lit(None).cast("array<boolean>"))
    high = table(spark, sf_dir, "events").where("event_type IN ('click', 'signup') AND value > 40")
    present = high.select(F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("path"))
    return M.route_events(unknown, files=present)


@register("replay_log", f"WITH {FEED_SQL} SELECT path, copies FROM copies")
def replay_log(spark, sf_dir):
    return M.replay_log(_actions(spark, sf_dir))


def _cuts(spark, sf_dir):
    """Two uneven places to cut the feed at."""
    n = table(spark, sf_dir, "events").count()
    return n // 7, n // 2


@register("merge_batch", f"WITH {FEED_SQL} SELECT path, copies FROM copies")
def merge_batch(spark, sf_dir):
    actions = _actions(spark, sf_dir)
    a, b = _cuts(spark, sf_dir)
    state = M.replay_log(actions.where(F.col("seq") < a))
    middle = M.batch_summary(actions.where((F.col("seq") >= a) & (F.col("seq") < b)))
    last = M.batch_summary(actions.where(F.col("seq") >= b))
    return M.merge_batch(state, M.combine_summaries(middle, last))


@register(
    "commit_batches",
    f"""WITH {FEED_SQL}, n AS (SELECT seq, row_number() OVER (ORDER BY seq, pos) AS n FROM actions)
SELECT (n - 1) // 1000 AS batch, count(*) AS changes, max(seq) AS last_seq FROM n GROUP BY 1""",
)
def commit_batches(spark, sf_dir):
    batches = numbering.commit_batches(_actions(spark, sf_dir), "seq", ["pos"])
    return batches.groupBy("batch").agg(F.count("*").alias("changes"), F.max("seq").alias("last_seq"))


@register(
    "apply_adds",
    f"""WITH {NAMED_SQL} SELECT path, count(*) AS copies FROM (
  SELECT path FROM docs UNION ALL SELECT path FROM docs JOIN part ON doc_id = p_partkey WHERE p_size <= 5) GROUP BY path""",
)
def apply_adds(spark, sf_dir):
    small = table(spark, sf_dir, "part").where("p_size <= 5").select(F.col("p_partkey").alias("doc_id"))
    again = docs(spark, sf_dir).join(small, "doc_id", "left_semi").withColumn("doc_id", F.col("doc_id") + 1000000000)
    return M.path_copies(M.apply_adds(docs(spark, sf_dir), again))


@register(
    "apply_deletes",
    f"""WITH {NAMED_SQL} SELECT doc_id, path FROM docs
WHERE path NOT IN (SELECT path FROM docs JOIN part ON doc_id = p_partkey WHERE p_size > 45)""",
)
def apply_deletes(spark, sf_dir):
    large = table(spark, sf_dir, "part").where("p_size > 45").select(F.col("p_partkey").alias("doc_id"))
    gone = docs(spark, sf_dir).join(large, "doc_id", "left_semi")
    return M.apply_deletes(docs(spark, sf_dir), gone).select("doc_id", "path")


# ---------------------------------------------------------------- settings

LOG_SQL = """
log AS (SELECT event_type || '/' || user_id AS key, props AS value, event_id AS version FROM events)
"""


@register("kv_log", f"WITH {LOG_SQL} SELECT key, arg_max(value, version) AS value FROM log GROUP BY key")
def kv_log_query(spark, sf_dir):
    path = work_dir(spark, "settings")
    rows = kv_log(spark, sf_dir)
    n, _ = _cuts(spark, sf_dir)
    K.append_log(rows.where(F.col("version") >= n), path)
    K.append_log(rows.where(F.col("version") < n), path)
    return K.list_settings(K.read_log(spark, path))


@register(
    "kv_latest",
    f"""WITH {LOG_SQL}, cur AS (SELECT key, arg_max(value, version) AS value FROM log GROUP BY key)
SELECT w.key, cur.value, cur.key IS NULL AS missing
FROM (SELECT DISTINCT 'click/' || user_id + 50 AS key FROM events) w LEFT JOIN cur USING (key)""",
)
def kv_latest(spark, sf_dir):
    wanted = table(spark, sf_dir, "events").select(
        F.concat(F.lit("click/"), (F.col("user_id") + 50).cast("string")).alias("key")
    ).distinct()
    found, missing = K.lookup_settings(K.latest(kv_log(spark, sf_dir)), wanted)
    return found.withColumn("missing", F.lit(False)).unionByName(
        missing.withColumn("value", F.lit(None).cast("string")).withColumn("missing", F.lit(True))
    )


@register(
    "kv_batch",
    """SELECT key, value FROM (
  SELECT event_type || '/' || user_id AS key, props AS value,
         row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id // 500 DESC, event_id DESC) AS r FROM events)
WHERE r = 1""",
)
def kv_batch(spark, sf_dir):
    """Pairs written in batches of many: one version each, the last duplicate wins."""
    batches = kv_log(spark, sf_dir).withColumn("ord", F.col("version")).withColumn(
        "version", F.floor(F.col("version") / 500).cast("long")
    )
    return K.latest(batches)


STATE_SQL = """
slog AS (
  SELECT user_id || '/' || CAST(day(ts) // 7 AS BIGINT) AS index_id, event_id AS version,
    CASE event_type WHEN 'signup' THEN 'last_indexed' WHEN 'view' THEN 'version' WHEN 'click' THEN 'refresh'
         WHEN 'purchase' THEN 'indexed' ELSE 'other' END AS key,
    CASE event_type WHEN 'signup' THEN CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR) WHEN 'view' THEN 'v' || (k % 2)
         WHEN 'click' THEN CASE WHEN k % 5 = 0 THEN 'true' ELSE 'false' END
         WHEN 'purchase' THEN CASE WHEN k % 4 = 0 THEN 'false' ELSE 'true' END ELSE '' END AS value
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)),
cur AS (SELECT index_id, key, arg_max(value, version) AS value FROM slog WHERE key <> 'other' GROUP BY index_id, key),
states AS (
  SELECT index_id, max(value) FILTER (key = 'last_indexed') AS last_indexed, max(value) FILTER (key = 'version') AS version,
         max(value) FILTER (key = 'refresh') AS refresh, max(value) FILTER (key = 'indexed') AS indexed
  FROM cur GROUP BY index_id),
judged AS (
  SELECT index_id, CASE WHEN last_indexed IS NULL THEN 'missing'
    WHEN 1706659200 - CAST(last_indexed AS BIGINT) > 1296000 THEN 'age'
    WHEN version IS DISTINCT FROM 'v1' THEN 'version' WHEN refresh = 'true' THEN 'refresh'
    WHEN indexed = 'false' THEN 'not indexed' END AS reason FROM states)
"""


def _state_log(spark, sf_dir):
    """Many indexes at once: one per user and week, their state set by the user's events."""
    kind, k = F.col("event_type"), k_of()
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    flag = lambda test: F.when(test, F.lit("true")).otherwise(F.lit("false"))
    key = (
        F.when(kind == "signup", F.lit("last_indexed")).when(kind == "view", F.lit("version"))
        .when(kind == "click", F.lit("refresh")).when(kind == "purchase", F.lit("indexed")).otherwise(F.lit("other"))
    )
    value = (
        F.when(kind == "signup", seconds.cast("string"))
        .when(kind == "view", F.concat(F.lit("v"), (k % 2).cast("string")))
        .when(kind == "click", flag(k % 5 == 0))
        .when(kind == "purchase", flag(k % 4 != 0))
        .otherwise(F.lit(""))
    )
    week = F.floor(F.dayofmonth("ts") / 7).cast("string")
    return table(spark, sf_dir, "events").select(
        F.concat(F.col("user_id").cast("string"), F.lit("/"), week).alias("index_id"),
        key.alias("key"), value.alias("value"), F.col("event_id").alias("version"), F.lit(0).cast("long").alias("ord"),
    )


@register("index_staleness", f"WITH {STATE_SQL} SELECT index_id, reason, reason IS NOT NULL AS stale FROM judged")
def index_staleness(spark, sf_dir):
    states = K.state_rows(_state_log(spark, sf_dir), ["index_id"])
    return K.index_staleness(states, NOW, "v1").select("index_id", "reason", "stale")


@register(
    "reset_index",
    f"""WITH {STATE_SQL} SELECT index_id, key, value FROM judged
CROSS JOIN (VALUES ('indexed', 'false'), ('refresh', 'false'), ('indexed_files', '0'), ('indexed_progress', '0.0')) v(key, value)
WHERE reason IS NOT NULL""",
)
def reset_index(spark, sf_dir):
    states = K.state_rows(_state_log(spark, sf_dir), ["index_id"])
    stale = K.index_staleness(states, NOW, "v1").where("stale")
    return K.reset_rows(stale, ["index_id"]).select("index_id", "key", "value")


DEFAULTS = K.default_settings("/home", "/conf/app.db", "/conf/index", "v1", NOW, ["/home/Music"])
DEFAULTS_SQL = ", ".join(f"('{k}', '{v}')" for k, v in DEFAULTS)


@register(
    "kv_defaults",
    f"""WITH {STATE_SQL} SELECT index_id, key, value
FROM (SELECT DISTINCT index_id FROM slog WHERE index_id NOT IN (SELECT index_id FROM slog WHERE key = 'version'))
CROSS JOIN (VALUES {DEFAULTS_SQL}) v(key, value)""",
)
def kv_defaults(spark, sf_dir):
    log = _state_log(spark, sf_dir)
    return K.defaults_for(log, DEFAULTS, log, ["index_id"], marker="version").select("index_id", "key", "value")


@register(
    "init_index",
    f"""WITH {ROOTS_SQL}, keep AS (SELECT path FROM roots WHERE path NOT IN (SELECT prefix FROM ex)),
rest AS (SELECT prefix FROM ex WHERE prefix NOT IN (SELECT path FROM roots)),
e AS (SELECT path, error, {ROOT} AS root, {PARENT} AS up FROM files),
seen AS (SELECT error FROM e WHERE root IN (SELECT path FROM keep)
  AND NOT EXISTS (SELECT 1 FROM rest WHERE length(up) > length(root) AND starts_with(up, prefix))),
n AS (SELECT count(*) AS n FROM seen WHERE error IS NULL), nbad AS (SELECT count(*) AS bad FROM seen WHERE error IS NOT NULL)
SELECT 'indexed' AS key, 'true' AS value UNION ALL SELECT 'last_indexed', '{NOW}' UNION ALL SELECT 'refresh', 'false'
UNION ALL SELECT 'indexed_progress', '100' UNION ALL SELECT 'version', 'v1' UNION ALL SELECT 'indexed_files', CAST(n AS VARCHAR) FROM n
UNION ALL SELECT 'entries', CAST(n + bad AS VARCHAR) FROM n, nbad UNION ALL SELECT 'errors', CAST(bad AS VARCHAR) FROM nbad""",
)
def init_index_query(spark, sf_dir):
    path = work_dir(spark, "settings")
    excludes = _root_excludes(spark, sf_dir).agg(F.to_json(F.collect_list("prefix")).alias("value"))
    start = [("version", "v0"), ("last_indexed", str(NOW - 60)), ("refresh", "false"), ("indexed", "true")]
    K.append_log(K.pairs(spark, start, 1), path)
    K.append_log(
        excludes.select(F.lit("default_exclude_path").alias("key"), "value", F.lit(1).alias("version"), F.lit(9).alias("ord")),
        path,
    )
    empty = IndexTable.create(spark, work_dir(spark, "files"), buckets=8)
    init_index(empty, manifest(spark, sf_dir), path, NOW, "v1")
    return K.list_settings(K.read_log(spark, path)).where("key <> 'default_exclude_path'")


# ---------------------------------------------------------------- streams


def _feed_lines(events):
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))


@register(
    "read_events",
    f"""WITH {FEED_SQL} SELECT seq, op, 0::BIGINT AS pos, path, CASE WHEN op = 'rename' THEN k % 2 = 0 END AS exists_after FROM fs
UNION ALL SELECT seq, op, 1::BIGINT, path || '/' || k, true FROM fs WHERE op = 'rename'""",
)
def read_events_query(spark, sf_dir):
    base = work_dir(spark, "feed")
    _feed_lines(fs_events(spark, sf_dir)).write.text(f"{base}/in")
    stream = M.explode_events(split_bad_events(read_events(spark, f"{base}/in"))[0])
    stream.writeStream.format("parquet").option("path", f"{base}/out").option(
        "checkpointLocation", f"{base}/checkpoint"
    ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out").withColumn("pos", F.col("pos").cast("long"))


def _torn_lines(spark, sf_dir):
    marks = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), (k_of() == 13).alias("cut"))
    events = fs_events(spark, sf_dir)
    line = F.to_json(F.struct(*events.columns))
    torn = F.substring(line, F.lit(1), F.length(line) - 5)
    return events.join(marks, "seq").select(F.when(F.col("cut"), torn).otherwise(line).alias("value"))


def _run_feed(spark, sf_dir, excludes=(), index_root=None):
    """Feed the events in three uneven instalments, restarting the stream for each."""
    base = work_dir(spark, "watch")
    root = index_root or f"{base}/index"
    IndexTable.open_or_create(spark, root, buckets=4)
    events = fs_events(spark, sf_dir)
    a, b = _cuts(spark, sf_dir)
    seq = F.col("seq")
    for part in (seq < a, (seq >= a) & (seq < b), seq >= b):
        _feed_lines(events.where(part)).write.mode("append").text(f"{base}/in")
        follow(
            read_events(spark, f"{base}/in"), root, f"{base}/checkpoint", excludes=list(excludes),
            log_path=f"{base}/settings", bad_path=f"{base}/bad",
        ).awaitTermination()
    return IndexTable.open(spark, root), f"{base}/settings"


WATCH_EXCLUDES = ["/u/1"]
KEPT = "NOT starts_with(path, '/u/1')"


@register("stream_restart", f"WITH {FEED_SQL} SELECT path, copies FROM copies")
def stream_restart(spark, sf_dir):
    """Three instalments by three streams with checkpoints and names of their own, on one index."""
    base = work_dir(spark, "restart")
    IndexTable.create(spark, f"{base}/index", buckets=4)
    events = fs_events(spark, sf_dir)
    a, b = _cuts(spark, sf_dir)
    seq = F.col("seq")
    for i, part in enumerate((seq < a, (seq >= a) & (seq < b), seq >= b)):
        _feed_lines(events.where(part)).write.text(f"{base}/in{i}")
        for _ in range(2):  # a restart of the same stream finds nothing new
            follow(
                read_events(spark, f"{base}/in{i}"), f"{base}/index", f"{base}/checkpoint{i}", f"{base}/bad", name=f"feed{i}"
            ).awaitTermination()
    return M.path_copies(IndexTable.open(spark, f"{base}/index").docs())


@register(
    "stream_bad_events",
    f"WITH {FEED_SQL.replace('FROM events)', "FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) <> 13)", 1)} SELECT path, copies FROM copies",
)
def stream_bad_events(spark, sf_dir):
    """The feed with some lines cut short: they go aside, and the stream applies the rest."""
    base = work_dir(spark, "torn")
    IndexTable.create(spark, f"{base}/index", buckets=4)
    _torn_lines(spark, sf_dir).write.text(f"{base}/in")
    follow(read_events(spark, f"{base}/in"), f"{base}/index", f"{base}/checkpoint", f"{base}/bad").awaitTermination()
    return M.path_copies(IndexTable.open(spark, f"{base}/index").docs())


@register(
    "stream_included",
    f"WITH {FEED_SQL} SELECT path, copies FROM copies WHERE path = '/u/7' OR starts_with(path, '/u/7/')",
)
def stream_included(spark, sf_dir):
    """Only what is below the include root."""
    base = work_dir(spark, "include")
    IndexTable.create(spark, f"{base}/index", buckets=4)
    _feed_lines(fs_events(spark, sf_dir)).write.text(f"{base}/in")
    follow(
        read_events(spark, f"{base}/in"), f"{base}/index", f"{base}/checkpoint", f"{base}/bad", include="/u/7/"
    ).awaitTermination()
    return M.path_copies(IndexTable.open(spark, f"{base}/index").docs())


@register("stream_apply", f"WITH {FEED_SQL} SELECT path, copies FROM copies WHERE {KEPT}")
def stream_apply(spark, sf_dir):
    index, _ = _run_feed(spark, sf_dir, WATCH_EXCLUDES)
    return M.path_copies(index.docs())


@register("stream_distinct", f"WITH {FEED_SQL} SELECT path, copies FROM copies")
def stream_distinct(spark, sf_dir):
    """Every third event is delivered again with the next instalment, and every seventh at once and late."""
    base = work_dir(spark, "distinct")
    IndexTable.create(spark, f"{base}/index", buckets=4)
    events = fs_events(spark, sf_dir)
    a, b = _cuts(spark, sf_dir)
    seq = F.col("seq")
    parts = [seq < a, (seq >= a) & (seq < b), seq >= b]
    for part, before in zip(parts, [F.lit(False), *parts]):
        again = events.where((part & (seq % 7 == 0)) | (before & (seq % 3 == 0)))
        _feed_lines(events.where(part).unionByName(again)).write.mode("append").text(f"{base}/in")
        follow(
            read_events(spark, f"{base}/in"), f"{base}/index", f"{base}/checkpoint", f"{base}/bad", distinct_within="3650 days"
        ).awaitTermination()
    return M.path_copies(IndexTable.open(spark, f"{base}/index").docs())


@register(
    "stream_count",
    f"""WITH {FEED_SQL}, cuts AS (SELECT 0 AS version, count(*) // 7 AS cut FROM events
  UNION ALL SELECT 1, count(*) // 2 FROM events UNION ALL SELECT 2, count(*) FROM events),
dels AS (SELECT version, path, max(seq) AS last_del FROM actions JOIN cuts ON seq < cut WHERE action = 'delete' GROUP BY 1, 2),
live AS (SELECT c.version, a.path FROM actions a JOIN cuts c ON a.seq < c.cut
  LEFT JOIN dels d ON d.version = c.version AND d.path = a.path
  WHERE a.action = 'add' AND (d.last_del IS NULL OR a.seq > d.last_del))
SELECT version::BIGINT AS version, 'indexed_files' AS key, CAST(count(*) AS VARCHAR) AS value FROM live GROUP BY version""",
)
def stream_count(spark, sf_dir):
    _, log = _run_feed(spark, sf_dir)
    return K.read_log(spark, log).select("version", "key", "value")


@register("start_gate", f"WITH {FEED_SQL} SELECT path, copies FROM copies")
def start_gate(spark, sf_dir):
    """A bulk build covers the first half; the stream then brings the whole backlog."""
    _, half = _cuts(spark, sf_dir)
    empty = IndexTable.create(spark, f"{work_dir(spark, 'gate')}/index", buckets=4)
    covered = M.replay_log(_actions(spark, sf_dir).where(F.col("seq") < half))
    copies = covered.select("path", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("path")
    empty.commit(adds=copies, snapshot_seq=half - 1)
    index, _ = _run_feed(spark, sf_dir, index_root=empty.root)
    return M.path_copies(index.docs())


@register(
    "event_errors",
    """SELECT CASE WHEN k = 13 THEN 'bad' ELSE 'good' END AS status, count(*) AS n
FROM (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1""",
)
def event_errors(spark, sf_dir):
    """Some lines are cut short; they go to the side table and the rest is applied."""
    base = work_dir(spark, "errors")
    _torn_lines(spark, sf_dir).write.text(f"{base}/in")
    IndexTable.create(spark, f"{base}/index", buckets=4)

    def split(batch, batch_id):
        good, bad = split_bad_events(batch)
        good.write.mode("overwrite").parquet(f"{base}/good/batch={batch_id}")
        bad.write.mode("overwrite").json(f"{base}/bad/batch={batch_id}")

    read_events(spark, f"{base}/in").writeStream.foreachBatch(split).option(
        "checkpointLocation", f"{base}/checkpoint"
    ).trigger(availableNow=True).start().awaitTermination()
    good = spark.read.parquet(f"{base}/good").select(F.lit("good").alias("status"))
    bad = spark.read.schema("seq bigint, raw string").json(f"{base}/bad").select(F.lit("bad").alias("status"))
    return good.unionByName(bad).groupBy("status").agg(F.count("*").alias("n"))


@register("stream_pages", PAGES_SQL)
def stream_pages(spark, sf_dir):
    """A stream of requests, answered by whole result pages."""
    base = work_dir(spark, "page-requests")
    requests(spark, sf_dir).write.json(f"{base}/in")
    view, known = index_of(spark, sf_dir, "corpus").view(), corpus_files(spark, sf_dir)
    answer_stream(
        read_queries(spark, f"{base}/in"), lambda q: S.search_batch(view, known, q, AS_OF), f"{base}/out", f"{base}/checkpoint"
    ).awaitTermination()
    return spark.read.parquet(f"{base}/out").select(
        "query_id", F.col("rank").cast("long").alias("rank"), "class", "name", "path", "size", "last_modified_date"
    )


@register("search_stream", f"WITH {BATCH_SQL} SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 100")
def search_stream(spark, sf_dir):
    base = work_dir(spark, "requests")
    requests(spark, sf_dir).write.json(f"{base}/in")
    index = index_of(spark, sf_dir, "corpus")
    answer_stream(
        read_queries(spark, f"{base}/in"), lambda q: S.batch_hits(index.view(), q), f"{base}/out", f"{base}/checkpoint"
    ).awaitTermination()
    return spark.read.parquet(f"{base}/out").select(
        "query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank")
    )
