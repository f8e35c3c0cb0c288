"""Sources, projections, filters, counts, catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.functions import paths as P, values as V
from pathloom.operators import catalogs, changes, filters, numbering
from pathloom.plans.build import crawl_entries, plan_roots
from pathloom.session import work_dir
from pathloom.sources import catalog as C

from .tables import (
    AS_OF, FILES_SQL, NAMED_SQL, catalog, docs, files, k_of, manifest, register, rooted_files, table,
)

NAME = "regexp_extract(path, '([^/]+)/*\\z', 1)"
EXT = f"regexp_extract({NAME}, '\\.([^.]+)\\z', 1)"
CLASS = (
    f"CASE WHEN {EXT} <> '' THEN {EXT} WHEN is_dir IS NULL THEN 'unknown' "
    "WHEN is_dir THEN 'folder' ELSE 'file' END"
)
ROOT = "regexp_extract(path, '^(/[^/]+)', 1)"
PARENT = "CASE WHEN regexp_replace(path, '/+[^/]*/*\\z', '') = '' THEN '/' ELSE regexp_replace(path, '/+[^/]*/*\\z', '') END"
DAY = (
    "CASE WHEN mtime_s >= 0 THEN date '1970-01-01' + CAST(floor(mtime_s / 86400.0) AS INTEGER) "
    f"ELSE date '{AS_OF}' END"
)


@register(
    "scan_files", f"WITH {FILES_SQL} SELECT path, is_dir, size, mtime_s, error FROM files"
)
def scan_files(spark, sf_dir):
    manifest = work_dir(spark, "manifest")
    files(spark, sf_dir).write.parquet(manifest)
    return C.scan_files(spark, manifest).select(
        "path", "is_dir", "size", F.unix_seconds("mtime").alias("mtime_s"), "error"
    )


@register("list_roots", f"WITH {FILES_SQL} SELECT path FROM files WHERE regexp_matches(path, '^/[^/]+/*$')")
def list_roots(spark, sf_dir):
    return C.list_roots(files(spark, sf_dir), "/")


@register(
    "list_docs",
    f"WITH {NAMED_SQL} SELECT doc_id, CASE WHEN p_type = 'ECONOMY' THEN 'Invalid UTF-8' ELSE path END AS path "
    "FROM docs JOIN part ON doc_id = p_partkey",
)
def list_docs(spark, sf_dir):
    bad = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), (F.col("p_type") == "ECONOMY").alias("bad"))
    raw = F.encode("path", "UTF-8")
    mixed = docs(spark, sf_dir).join(bad, "doc_id").select(
        "doc_id", F.when(F.col("bad"), F.concat(raw, F.unhex(F.lit("FF")))).otherwise(raw).alias("raw")
    )
    return changes.list_docs(mixed, "raw")


@register(
    "read_metadata",
    f"WITH {NAMED_SQL} SELECT path, is_dir, size, mtime_s FROM catalog WHERE path IN (SELECT path FROM docs WHERE contains(path, 'ring'))",
)
def read_metadata(spark, sf_dir):
    from pathloom.operators.results import read_metadata as read

    wanted = docs(spark, sf_dir).where(F.col("path").contains("ring"))
    return read(wanted, catalog(spark, sf_dir)).select(
        "path", "is_dir", "size", F.unix_seconds("mtime").alias("mtime_s")
    )


# ---------------------------------------------------------------- projections


@register("derive_name", f"WITH {FILES_SQL} SELECT path, {NAME} AS name FROM files")
def derive_name(spark, sf_dir):
    return files(spark, sf_dir).select("path", P.derive_name("path").alias("name"))


@register("derive_class", f"WITH {FILES_SQL} SELECT path, {CLASS} AS class FROM files")
def derive_class(spark, sf_dir):
    return files(spark, sf_dir).select("path", P.derive_class(P.derive_name("path"), "is_dir").alias("class"))


@register("mtime_date", f"WITH {FILES_SQL} SELECT path, {DAY} AS last_modified_date FROM files")
def mtime_date(spark, sf_dir):
    return files(spark, sf_dir).select("path", P.mtime_date("mtime", AS_OF).alias("last_modified_date"))


@register(
    "size_double",
    f"WITH {NAMED_SQL} SELECT doc_id, coalesce(CAST(size AS DOUBLE), 0.0e0) AS size FROM docs LEFT JOIN catalog USING (path)",
)
def size_double(spark, sf_dir):
    from pathloom.operators.joins import lookup_join

    joined = lookup_join(docs(spark, sf_dir), catalog(spark, sf_dir).select("path", "size"), "path", "left")
    return joined.select("doc_id", P.size_double("size").alias("size"))


@register(
    "format_size",
    """
SELECT id, unit, CASE WHEN size >= 1073741824 THEN printf('%.1f GB', size / 1073741824.0e0)
     WHEN size >= 1048576 THEN printf('%.1f MB', size / 1048576.0e0)
     WHEN size >= 1024 THEN printf('%.1f KB', size / 1024.0e0)
     ELSE printf('%.0f B', size) END AS label
FROM (SELECT o_orderkey AS id, u AS unit, CAST(CAST(floor(o_totalprice) AS BIGINT) * u // 256 AS DOUBLE) AS size
      FROM orders, (VALUES (CAST(1 AS BIGINT)), (256), (1024), (1048576)) t(u))
""",
)
def format_size(spark, sf_dir):
    units = F.explode(F.array(*[F.lit(u).cast("long") for u in (1, 256, 1024, 1048576)]))
    sized = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.floor("o_totalprice").alias("price"), units.alias("unit")
    )
    size = F.floor(F.expr("(price * unit) div 256")).cast("double")
    return sized.select("id", "unit", V.format_size(size).alias("label"))


@register(
    "format_percent",
    "SELECT event_id, CASE WHEN p = 100 THEN '100' ELSE printf('%.2f', p) END AS label "
    "FROM (SELECT event_id, CASE WHEN value > 100 THEN 100.0e0 ELSE value END AS p FROM events)",
)
def format_percent(spark, sf_dir):
    percent = F.least(F.col("value"), F.lit(100.0))
    return table(spark, sf_dir, "events").select("event_id", V.format_percent(percent).alias("label"))


@register(
    "parse_bool",
    "SELECT event_id, CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag "
    "FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)",
)
def parse_bool(spark, sf_dir):
    text = F.when(k_of() % 3 == 0, F.lit("true")).when(k_of() % 3 == 1, F.lit("false")).otherwise(F.lit("TRUE"))
    return table(spark, sf_dir, "events").select("event_id", V.parse_bool(text).alias("flag"))


@register(
    "normalize_query",
    "SELECT item_id, regexp_replace(text, '^\\s+|\\s+\\z', '', 'g') AS q FROM benchmark",
)
def normalize_query(spark, sf_dir):
    padded = F.concat(F.lit(" \t　"), "text", F.lit("\n  "))
    return table(spark, sf_dir, "benchmark").select("item_id", V.normalize_query(padded).alias("q"))


@register("decode_path", f"WITH {NAMED_SQL} SELECT doc_id, path FROM docs")
def decode_path(spark, sf_dir):
    raw = F.encode("path", "UTF-8")
    return docs(spark, sf_dir).select("doc_id", V.decode_path(raw).alias("path"))


@register(
    "parse_excludes",
    """SELECT event_id, '/u/' || user_id AS prefix FROM events
       UNION ALL SELECT event_id, '/k "' || CAST(json_extract(props, '$.k') AS BIGINT) || '"' FROM events""",
)
def parse_excludes(spark, sf_dir):
    prefixes = F.array(
        F.concat(F.lit("/u/"), F.col("user_id").cast("string")),
        F.concat(F.lit('/k "'), k_of().cast("string"), F.lit('"')),
    )
    settings = table(spark, sf_dir, "events").select("event_id", F.to_json(prefixes).alias("value"))
    return settings.select("event_id", F.explode(V.parse_prefix_list("value")).alias("prefix"))


# ---------------------------------------------------------------- filters

CRAWL_EXCLUDES = ["/blog.th", "/m.", "/www.cheap-pills.example.com/en"]


@register(
    "prune_subtrees",
    f"""WITH {FILES_SQL}, up AS (SELECT path, {PARENT} AS up FROM files)
SELECT path FROM up WHERE up = '/' OR NOT (starts_with(up, '/blog.th') OR starts_with(up, '/m.')
  OR starts_with(up, '/www.cheap-pills.example.com/en'))""",
)
def prune_subtrees(spark, sf_dir):
    return filters.prune_subtrees(files(spark, sf_dir), "/", CRAWL_EXCLUDES).select("path")


PREFIXES_SQL = """
ex AS (SELECT DISTINCT '/u/' || user_id || CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 2 = 0 THEN '/c' ELSE '/p' END AS prefix
       FROM events WHERE event_type = 'error' AND value > 60),
p AS (SELECT event_id, '/u/' || user_id || '/' || event_type AS path FROM events)
"""


@register(
    "exclude_prefix",
    f"WITH {PREFIXES_SQL} SELECT event_id, path FROM p WHERE NOT EXISTS (SELECT 1 FROM ex WHERE starts_with(path, prefix))",
)
def exclude_prefix(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    prefixes = events.where("event_type = 'error' AND value > 60").select(
        F.concat(
            F.lit("/u/"), F.col("user_id").cast("string"), F.when(k_of() % 2 == 0, F.lit("/c")).otherwise(F.lit("/p"))
        ).alias("prefix")
    ).distinct()
    watched = events.select(
        "event_id", F.concat(F.lit("/u/"), F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("path")
    )
    return filters.exclude_prefix(watched, prefixes).select("event_id", "path")


DEEP_SQL = f"""{NAMED_SQL},
keys AS (SELECT doc_id, path || '/' || repeat('sub/', CAST(doc_id % 60 AS INTEGER)) || 'x' AS path FROM docs),
ex AS (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN substr(path, 1, 18 + CAST(doc_id % 40 AS INTEGER)) ELSE path || repeat('/sub', CAST(doc_id % 60 AS INTEGER)) END AS prefix
       FROM docs WHERE doc_id % 3 = 1)
"""


def _deep(spark, sf_dir):
    """Paths of many depths and excludes of many lengths, some inside others."""
    named = docs(spark, sf_dir)
    times = F.expr("CAST(doc_id % 60 AS INT)")
    keys = named.select("doc_id", F.concat("path", F.lit("/"), F.repeat(F.lit("sub/"), times), F.lit("x")).alias("path"))
    cut = F.expr("substring(path, 1, CAST(18 + doc_id % 40 AS INT))")
    prefix = F.when(F.col("doc_id") % 2 == 0, cut).otherwise(F.concat("path", F.repeat(F.lit("/sub"), times)))
    return keys, named.where("doc_id % 3 = 1").select(prefix.alias("prefix"))


@register(
    "exclude_intervals",
    f"WITH {DEEP_SQL} SELECT doc_id, path FROM keys WHERE NOT EXISTS (SELECT 1 FROM ex WHERE starts_with(path, prefix))",
)
def exclude_intervals(spark, sf_dir):
    return filters.exclude_prefix(*_deep(spark, sf_dir))


@register(
    "exclude_components",
    f"WITH {DEEP_SQL} SELECT doc_id, path FROM keys WHERE NOT EXISTS (SELECT 1 FROM ex WHERE path = prefix OR starts_with(path, rtrim(prefix, '/') || '/'))",
)
def exclude_components(spark, sf_dir):
    return filters.exclude_prefix(*_deep(spark, sf_dir), component=True)


ROOTS_SQL = f"""{FILES_SQL},
roots AS (SELECT path FROM files WHERE regexp_matches(path, '^/[^/]+/*$')),
ex AS (SELECT DISTINCT {ROOT} AS prefix FROM files WHERE contains(path, '/es/')
       UNION SELECT '/m.' UNION SELECT '/none')
"""


def _root_excludes(spark, sf_dir):
    spanish = manifest(spark, sf_dir).where(F.col("path").contains("/es/")).select(P.root_of("path").alias("prefix"))
    return spanish.unionByName(spark.createDataFrame([("/m.",), ("/none",)], "prefix string")).distinct()


@register(
    "partition_roots",
    f"WITH {ROOTS_SQL} SELECT path, path IN (SELECT prefix FROM ex) AS excluded FROM roots",
)
def partition_roots(spark, sf_dir):
    excluded, remaining = filters.partition_roots(
        C.list_roots(manifest(spark, sf_dir)), _root_excludes(spark, sf_dir)
    )
    return excluded.withColumn("excluded", F.lit(True)).unionByName(remaining.withColumn("excluded", F.lit(False)))


@register(
    "remaining_excludes",
    f"WITH {ROOTS_SQL} SELECT prefix FROM ex WHERE prefix NOT IN (SELECT path FROM roots)",
)
def remaining_excludes(spark, sf_dir):
    excludes = _root_excludes(spark, sf_dir)
    excluded, _ = filters.partition_roots(C.list_roots(manifest(spark, sf_dir)), excludes)
    return filters.remaining_excludes(excludes, excluded)


@register(
    "lookup_path",
    f"WITH {NAMED_SQL} SELECT doc_id, path FROM docs WHERE path IN (SELECT d.path FROM docs d JOIN part ON d.doc_id = p_partkey WHERE p_size > 45)",
)
def lookup_path(spark, sf_dir):
    large = table(spark, sf_dir, "part").where("p_size > 45").select(F.col("p_partkey").alias("doc_id"))
    wanted = docs(spark, sf_dir).join(large, "doc_id", "left_semi").select("path").distinct()
    return filters.lookup_path(docs(spark, sf_dir), wanted)


# ---------------------------------------------------------------- counts


@register(
    "crawl_count",
    f"""WITH {FILES_SQL}, r AS (SELECT {ROOT} AS root, count(*) AS entries, count(error) AS errors FROM files GROUP BY 1)
SELECT root, entries, errors, CAST(sum(entries) OVER (ORDER BY root) AS BIGINT) AS total FROM r""",
)
def crawl_count(spark, sf_dir):
    return numbering.crawl_count(rooted_files(spark, sf_dir))


@register(
    "progress",
    f"""WITH {ROOTS_SQL}, r AS (SELECT path AS root FROM roots WHERE path NOT IN (SELECT prefix FROM ex))
SELECT root, round(row_number() OVER (ORDER BY root) / CAST(count(*) OVER () AS DOUBLE) * 100, 6) AS percent FROM r""",
)
def progress(spark, sf_dir):
    _, roots = filters.partition_roots(C.list_roots(manifest(spark, sf_dir)), _root_excludes(spark, sf_dir))
    done = numbering.progress(roots.withColumnRenamed("path", "root"))
    return done.select("root", F.round("percent", 6).alias("percent"))


@register(
    "checkpoints",
    """SELECT l_orderkey, l_linenumber, n FROM
(SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem)
WHERE n % 20000 = 0""",
)
def checkpoints(spark, sf_dir):
    entries = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return numbering.progress_marks(entries, "l_orderkey", tie=["l_linenumber"])


@register("path_copies", f"WITH {NAMED_SQL} SELECT path, count(*) AS copies FROM docs GROUP BY path")
def path_copies(spark, sf_dir):
    return changes.path_copies(docs(spark, sf_dir))


# ---------------------------------------------------------------- set operations


@register(
    "union_catalogs",
    f"WITH {FILES_SQL}, {NAMED_SQL} SELECT DISTINCT path FROM "
    "(SELECT path FROM files UNION ALL SELECT path FROM docs) WHERE starts_with(path, '/st') OR starts_with(path, '/sp')",
)
def union_catalogs(spark, sf_dir):
    first, second = files(spark, sf_dir), docs(spark, sf_dir)
    sites = catalogs.union_catalogs(first, second, "/sp")
    return catalogs.union_catalogs(first, second, "/st").unionByName(sites)


OVERLAY_SQL = f"""{NAMED_SQL},
older AS (
  SELECT '/store/' || p_brand || '/' || p_name || '.' || lower(substr(p_type, 1, 3)) AS path,
         max(p_size)::BIGINT AS size
  FROM part WHERE p_size > 20 GROUP BY 1)
"""


def _older(spark, sf_dir):
    path = F.concat(F.lit("/store/"), "p_brand", F.lit("/"), "p_name", F.lit("."), F.lower(F.substring("p_type", 1, 3)))
    return table(spark, sf_dir, "part").where("p_size > 20").groupBy(path.alias("path")).agg(
        F.max("p_size").cast("long").alias("size")
    )


@register(
    "overlay_catalogs",
    f"""WITH {OVERLAY_SQL} SELECT w.path, coalesce(c.size, o.size) AS size, c.path IS NOT NULL OR o.path IS NOT NULL AS found
FROM (SELECT DISTINCT path FROM docs) w LEFT JOIN catalog c ON w.path = c.path LEFT JOIN older o ON w.path = o.path""",
)
def overlay_catalogs(spark, sf_dir):
    wanted = docs(spark, sf_dir).select("path").distinct()
    loaded = catalogs.load_assets(wanted, catalog(spark, sf_dir), _older(spark, sf_dir), ["size"])
    return loaded.select("path", "size", "found")


# A user's kind table.
KINDS = [(False, "eco", "economy"), (False, "sma", "small"), (False, "lar", "large"), (True, "en", "english"), (True, "fr", "french")]
KINDS_SQL = ", ".join(f"({str(f).lower()}, '{k}', '{v}')" for f, k, v in KINDS)


@register(
    "kind_lookup",
    f"""WITH {FILES_SQL}, {NAMED_SQL}, everything AS (
  SELECT path, is_dir FROM files UNION ALL SELECT path, is_dir FROM catalog),
r AS (SELECT path, {NAME} AS name, {CLASS} AS class FROM everything),
kinds(is_folder, key, kind) AS (VALUES {KINDS_SQL})
SELECT r.path, r.class, coalesce(k.kind, CASE WHEN r.class = 'folder' THEN 'folder' ELSE 'document' END) AS kind
FROM r LEFT JOIN kinds k ON k.is_folder = (r.class = 'folder')
  AND k.key = CASE WHEN r.class = 'folder' THEN r.name ELSE r.class END""",
)
def kind_lookup(spark, sf_dir):
    everything = files(spark, sf_dir).select("path", "is_dir").unionByName(
        catalog(spark, sf_dir).select("path", "is_dir")
    )
    named = everything.withColumn("name", P.derive_name("path"))
    rows = named.withColumn("class", P.derive_class("name", "is_dir"))
    kinds = spark.createDataFrame(KINDS, "is_folder boolean, key string, kind string")
    return catalogs.kind_lookup(rows, kinds).select("path", "class", "kind")


@register(
    "crawl_entries",
    f"""WITH {ROOTS_SQL}, keep AS (SELECT path FROM roots WHERE path NOT IN (SELECT prefix FROM ex)),
rest AS (SELECT prefix FROM ex WHERE prefix NOT IN (SELECT path FROM roots)),
e AS (SELECT path, {ROOT} AS root, {PARENT} AS up FROM files)
SELECT root, path FROM e WHERE root IN (SELECT path FROM keep)
  AND NOT EXISTS (SELECT 1 FROM rest WHERE length(up) > length(root) AND starts_with(up, prefix))""",
)
def crawl_entries_query(spark, sf_dir):
    everything = manifest(spark, sf_dir)
    roots, excludes = plan_roots(everything, _root_excludes(spark, sf_dir))
    return crawl_entries(everything, roots, excludes).select("root", "path")


@register(
    "crawl_below",
    f"""WITH {FILES_SQL}, below AS (SELECT '/mnt' || path AS path FROM files UNION ALL SELECT '/mntx' || path FROM files)
SELECT regexp_extract(path, '^(/mnt/[^/]+)', 1) AS root, path FROM below WHERE starts_with(path, '/mnt/')""",
)
def crawl_below(spark, sf_dir):
    """A crawl root other than ``/``; the same tree beside it, under a longer name, is not entered."""
    listed = manifest(spark, sf_dir)
    everything = listed.withColumn("path", F.concat(F.lit("/mnt"), "path")).unionByName(
        listed.withColumn("path", F.concat(F.lit("/mntx"), "path"))
    )
    roots, excludes = plan_roots(everything, spark.createDataFrame([], "prefix string"), "/mnt")
    return crawl_entries(everything, roots, excludes, "/mnt").select("root", "path")
