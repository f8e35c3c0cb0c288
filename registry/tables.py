"""The test tables seen as catalogue, documents, feed, settings and requests.

Every Spark frame here has a SQL twin (a list of common table expressions).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from pathloom.functions.paths import root_of
from pathloom.session import work_dir
from pathloom.sources.catalog import scan_files
from pathloom.sources.index_table import IndexTable

AS_OF = dt.date(2024, 6, 1)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query callable and, where there is one, its SQL twin."""

    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- catalogue from pages

FILES_SQL = """
leaf AS (
  SELECT page_id, length(html) AS size,
         regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?:/', '') AS path
  FROM pages),
parts AS (
  SELECT page_id, list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM leaf),
entries AS (
  SELECT path, page_id, size, ends_with(path, '/') AS is_dir FROM leaf
  UNION ALL
  SELECT '/' || array_to_string(list_slice(p, 1, i), '/'), page_id, 0, true
  FROM (SELECT page_id, p, unnest(range(1, len(p))) AS i FROM parts)),
merged AS (
  SELECT path, max(page_id) AS id, max(size)::BIGINT AS size, bool_and(is_dir) AS is_dir
  FROM entries GROUP BY path),
files AS (
  SELECT path, is_dir, size,
         CASE WHEN contains(path, '/es') THEN -3600 * (id + 1) ELSE 1704067200 + 3600 * id END AS mtime_s,
         CASE WHEN contains(path, 'spam-farm') AND NOT is_dir THEN 'PermissionError: denied' END AS error
  FROM merged)
"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as leaves, every ancestor as a directory; some old times, some unreadable."""
    url = F.regexp_replace("url", r"[?#].*$", "")
    leaf = table(spark, sf_dir, "pages").select(
        "page_id",
        F.length("html").cast("long").alias("size"),
        F.regexp_replace(url, r"^https?:/", "").alias("path"),
    )
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    above = leaf.withColumn("p", parts).where(F.size("p") > 1).select(
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size("p") - 1),
                lambda i: F.concat(F.lit("/"), F.array_join(F.slice("p", F.lit(1), i), "/")),
            )
        ).alias("path"),
        "page_id", F.lit(0).cast("long").alias("size"), F.lit(True).alias("is_dir"),
    )
    entries = leaf.select("path", "page_id", "size", F.col("path").endswith("/").alias("is_dir")).unionByName(above)
    merged = entries.groupBy("path").agg(
        F.max("page_id").alias("id"), F.max("size").alias("size"), F.bool_and("is_dir").alias("is_dir")
    )
    old = F.col("path").contains("/es")
    seconds = F.when(old, -3600 * (F.col("id") + 1)).otherwise(1704067200 + 3600 * F.col("id"))
    unreadable = F.col("path").contains("spam-farm") & ~F.col("is_dir")
    return merged.select(
        "path", "is_dir", "size",
        F.timestamp_seconds(seconds).alias("mtime"),
        F.when(unreadable, F.lit("PermissionError: denied")).alias("error"),
    )


_MANIFESTS: dict[tuple[str, str], str] = {}


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same catalogue as a stored manifest, written once per application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MANIFESTS:
        _MANIFESTS[key] = work_dir(spark, "manifest")
        files(spark, sf_dir).write.parquet(_MANIFESTS[key])
    return scan_files(spark, _MANIFESTS[key])


def rooted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).withColumn("root", root_of("path"))


# ---------------------------------------------------------------- documents from part

NAMED_SQL = """
docs AS (
  SELECT p_partkey AS doc_id,
         '/store/' || p_brand || '/' || p_name || '.' || lower(substr(p_type, 1, 3)) AS path
  FROM part),
named AS (SELECT doc_id, path, regexp_extract(path, '([^/]+)/*\\z', 1) AS name FROM docs),
catalog AS (
  SELECT '/store/' || p_brand || '/' || p_name || '.' || lower(substr(p_type, 1, 3)) AS path,
         false AS is_dir, sum(p_size)::BIGINT * 100 AS size,
         1704067200 + 86400 * max(p_size)::BIGINT AS mtime_s
  FROM part WHERE p_brand <> 'Brand#2' GROUP BY 1)
"""


def _part_path():
    return F.concat(
        F.lit("/store/"), "p_brand", F.lit("/"), "p_name", F.lit("."), F.lower(F.substring("p_type", 1, 3))
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed documents; the same path may occur many times."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), _part_path().alias("path"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of those paths; one brand is missing, as if deleted since."""
    part = table(spark, sf_dir, "part").where(F.col("p_brand") != "Brand#2")
    return part.groupBy(_part_path().alias("path")).agg(
        F.lit(False).alias("is_dir"),
        (F.sum("p_size") * 100).cast("long").alias("size"),
        F.timestamp_seconds(1704067200 + 86400 * F.max("p_size").cast("long")).alias("mtime"),
        F.lit(None).cast("string").alias("error"),
    )


# Stand-ins that turn Latin test names into Han names.
LATIN = "abcdefghijklmnopqrstuvwxyz"
HAN_LETTERS = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余"
VOWELS, HAN_VOWELS = "aeiou", "安恩因欧乌"

HAN_SQL = f"""
han AS (
  SELECT p_partkey AS doc_id,
         CASE WHEN p_type = 'ECONOMY' THEN translate(p_name, '{LATIN}', '{HAN_LETTERS}')
              WHEN p_type = 'SMALL' THEN translate(p_name, '{VOWELS}', '{HAN_VOWELS}')
              ELSE p_name END || '-' || p_size || '.txt' AS name
  FROM part),
han_counts AS (
  SELECT doc_id, name,
         length(regexp_replace(name, '[^\\p{{Han}}]', '', 'g')) AS han,
         length(regexp_replace(name, '[^\\p{{L}}]', '', 'g')) AS letters
  FROM han),
han_lang AS (
  SELECT doc_id, name, CASE WHEN han > 0 AND han * 2 >= letters THEN 'cmn' ELSE 'other' END AS lang
  FROM han_counts),
han_tokens AS (
  SELECT doc_id, name, lang,
         CASE WHEN lang = 'cmn' THEN flatten(list_transform(
                regexp_extract_all(regexp_replace(name, '(\\p{{Han}}+)', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}]+'),
                lambda r: CASE WHEN regexp_matches(r, '^\\p{{Han}}')
                     THEN list_transform(range(1, greatest(length(r), 2)), lambda i: substr(r, i, 2))
                     ELSE [r] END))
              ELSE regexp_extract_all(name, '[\\p{{L}}\\p{{N}}]+') END AS tokens
  FROM han_lang)
"""


def han_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    name = (
        F.when(F.col("p_type") == "ECONOMY", F.translate("p_name", LATIN, HAN_LETTERS))
        .when(F.col("p_type") == "SMALL", F.translate("p_name", VOWELS, HAN_VOWELS))
        .otherwise(F.col("p_name"))
    )
    return p.select(
        F.col("p_partkey").alias("doc_id"),
        F.concat(name, F.lit("-"), F.col("p_size").cast("string"), F.lit(".txt")).alias("name"),
    )


# ---------------------------------------------------------------- text corpus from documents

CORPUS_SQL = """
toks AS (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS t FROM documents),
tok AS (SELECT doc_id, unnest(t) AS term, unnest(range(len(t))) AS pos, len(t) AS dl FROM toks),
post AS (
  SELECT term, doc_id, count(*) AS tf, max(dl) AS dl FROM tok GROUP BY term, doc_id),
freq AS (SELECT term, count(*) AS df FROM post GROUP BY term),
stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
scored AS (
  SELECT p.term, p.doc_id, p.tf, p.dl,
         ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) AS idf,
         ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * (p.tf * 2.2e0)
           / (p.tf + 1.2e0 * (0.25e0 + 0.75e0 * p.dl / avgdl)) AS w
  FROM post p JOIN freq USING (term) CROSS JOIN stats)
"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, spread out where the table is one small file that a single task would read."""
    scan = table(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select(
        "doc_id", F.concat(F.lit("/doc/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("name")
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text, whole, as a query."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))


REQUESTS_SQL = """
asked_words AS (
  SELECT item_id AS query_id, unnest(w) AS word, unnest(range(len(w))) AS clause
  FROM (SELECT item_id, regexp_split_to_array(trim(text), '\\s+') AS w FROM benchmark)),
asked_terms AS (
  SELECT query_id, clause, word, unnest(regexp_extract_all(word, '[\\p{L}\\p{N}]+')) AS term FROM asked_words)
"""

# ---------------------------------------------------------------- index of a test folder

_INDEXES: dict[tuple[str, str, str], IndexTable] = {}


def index_of(spark: SparkSession, sf_dir: str, kind: str) -> IndexTable:
    """The stored index of ``corpus`` or ``docs``, built once per application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _INDEXES:
        source = corpus(spark, sf_dir) if kind == "corpus" else docs(spark, sf_dir)
        empty = IndexTable.create(spark, work_dir(spark, f"index-{kind}"), buckets=16)
        _INDEXES[key] = empty.commit(adds=source)
    return _INDEXES[key]


# ---------------------------------------------------------------- feed and settings from events

FEED_SQL = """
fs AS (
  SELECT event_id AS seq, '/u/' || user_id AS path, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
         CASE event_type WHEN 'click' THEN 'create' WHEN 'signup' THEN 'create'
              WHEN 'purchase' THEN 'rename' WHEN 'error' THEN 'remove' ELSE 'other' END AS op
  FROM events),
changes AS (
  SELECT seq, 0 AS pos, path, op, CASE WHEN op = 'rename' THEN k % 2 = 0 END AS there FROM fs
  UNION ALL
  SELECT seq, 1, path || '/' || k, op, true FROM fs WHERE op = 'rename'),
actions AS (
  SELECT seq, pos, path,
         CASE WHEN op = 'create' OR (op = 'rename' AND there) THEN 'add' ELSE 'delete' END AS action
  FROM changes WHERE op IN ('create', 'rename', 'remove')),
last_del AS (SELECT path, max(seq) AS last_del FROM actions WHERE action = 'delete' GROUP BY path),
copies AS (
  SELECT a.path, count(*) AS copies
  FROM actions a LEFT JOIN last_del d ON a.path = d.path
  WHERE a.action = 'add' AND (d.last_del IS NULL OR a.seq > d.last_del) GROUP BY a.path)
"""


def k_of():
    return F.get_json_object("props", "$.k").cast("long")


def fs_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rename names the old and the new path; the old one may be there again afterwards."""
    kind = F.col("event_type")
    op = (
        F.when(kind.isin("click", "signup"), F.lit("create"))
        .when(kind == "purchase", F.lit("rename"))
        .when(kind == "error", F.lit("remove"))
        .otherwise(F.lit("other"))
    )
    path = F.concat(F.lit("/u/"), F.col("user_id").cast("string"))
    target = F.concat(path, F.lit("/"), k_of().cast("string"))
    rename = kind == "purchase"
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        op.alias("op"),
        F.when(rename, F.array(path, target)).otherwise(F.array(path)).alias("paths"),
        F.when(rename, F.array(k_of() % 2 == 0, F.lit(True))).alias("exists_after"),
    )


def kv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat("event_type", F.lit("/"), F.col("user_id").cast("string")).alias("key"),
        F.col("props").alias("value"),
        F.col("event_id").alias("version"),
        F.lit(0).cast("long").alias("ord"),
    )

