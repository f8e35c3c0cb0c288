"""The operators on the test tables, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pathloom.llm import (
    chat_repair, decontaminate, hash_tree, packing, quality, recurrent_lm, simhash_gray, spelling_variants, suffix_dedup, url_rules,
    warc_segments, weighted_sampling, whitening,
)
from pathloom.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def tokenizer_path(spark: SparkSession) -> str:
    """Where the byte-level BPE file is; ``pathloom.tokenizer`` of the session names another."""
    import public_tokenizers

    return spark.conf.get("pathloom.tokenizer", None) or public_tokenizers.path("byte_bpe_50k.json")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", quality.grade_of().alias("grade"))


@register("op1_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, ratings(spark, sf_dir)))
    return scored.select("doc_id", "rating.expected_grade", "rating.tail_probability", "rating.grade", (F.col("rating.tail_probability") >= quality.LEAST_CHANCE).alias("selected"))


@register("op2_chat_repair")
def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair(table(spark, sf_dir, "conversations"))


CONTAMINATION_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
places AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM t, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, n, i FROM places JOIN windows USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(t.w) AS contaminated
FROM t LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@register("op3_benchmark_decontamination", CONTAMINATION_SQL)
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    n_words, n_hit = F.col("contamination.n_words"), F.col("contamination.n_hit")
    return found.select(
        "doc_id", n_words.alias("n_words"), n_hit.alias("n_hit"),
        F.size("contamination.item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("contamination.item_ids"), ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= n_words)).alias("contaminated"),
    )


@register("op4_url_filters")
def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select(
        "page_id", "host", "path", "rule", "verdict",
        F.col("mined.verdict").alias("mined_verdict"), F.col("mined.confidence").alias("mined_confidence"),
    )


@register("op5_recurrent_lm")
def recurrent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent_lm.score(table(spark, sf_dir, "documents"))


@register("op6_weighted_sampling")
def weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.neighbour_likeness(table(spark, sf_dir, "documents"))


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM f
"""


@register("op7_warc_segments", WARC_SQL)
def warc_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_segments.archive_report(table(spark, sf_dir, "pages"))


@register("op8_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(spark), added_tokens=True)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@register("op9_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_gray.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")


@register("op10_suffix_array_dedup")
def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.find_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "repeats.n_bytes", "repeats.n_removed", F.size("repeats.spans").cast("long").alias("n_spans"),
        F.sha2(F.col("repeats.kept"), 256).alias("kept_sha256"),
    )


@register("op11_embedding_whitening")
def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(table(spark, sf_dir, "embeddings"))


#: CRC-32 of a text as a DuckDB expression over its bytes ``x``: the table follows from the polynomial.
CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384))) AS t"


def crc_sql(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a DuckDB text expression, beside a row ``crc(t)`` from ``CRC_TABLE``."""
    x = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda i: ('0x' || i)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {x}), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295::BIGINT)::BIGINT"


TREE = hash_tree.even_tree(16)
GROWN = hash_tree.grow(TREE)

#: Draws of all nodes below each row's choice of the level above, level by level, for the tree and for the grown one.
SHARDS_SQL = f"""
WITH crc AS ({CRC_TABLE}),
leaves AS (
  SELECT false AS grown, 'r' || (s // 4) AS region, 'r' || (s // 4) || '.k' || (s // 2 % 2) AS rack, s::INTEGER AS shard FROM range(16) r(s)
  UNION ALL SELECT true, 'r' || (s // 4), 'r' || (s // 4) || '.k' || (s // 2 % 2), s::INTEGER FROM range(16) r(s)
  UNION ALL SELECT true, 'r16', 'r16.k0', 16),
d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(doc_id::VARCHAR, '') AS key FROM documents),
regions AS (SELECT grown, region, count(*) AS w FROM leaves GROUP BY ALL),
racks AS (SELECT grown, region, rack, count(*) AS w FROM leaves GROUP BY ALL),
one AS (SELECT DISTINCT key FROM d),
a AS (SELECT grown, key, arg_max(region, ln((('0x' || substr(md5(region || '/' || key), 1, 13))::BIGINT + 1) / 4503599627370496.0::DOUBLE) / w) AS region
  FROM one, regions GROUP BY grown, key),
b AS (SELECT grown, key, arg_max(rack, ln((('0x' || substr(md5(rack || '/' || key), 1, 13))::BIGINT + 1) / 4503599627370496.0::DOUBLE) / w) AS rack
  FROM a JOIN racks USING (grown, region) GROUP BY grown, key),
c AS (SELECT grown, key, arg_max(shard, ln((('0x' || substr(md5(rack || '.' || shard || '/' || key), 1, 13))::BIGINT + 1) / 4503599627370496.0::DOUBLE)) AS shard
  FROM b JOIN leaves USING (grown, rack) GROUP BY grown, key)
SELECT doc_id, (strlen(text) + 1)::BIGINT AS size, {crc_sql("text")} AS text_crc32, 'key' AS law, c.shard,
       row_number() OVER (PARTITION BY c.shard ORDER BY doc_id NULLS FIRST, strlen(text)) - 1 AS slot, g.shard AS grown_shard
FROM d, crc, c, c AS g WHERE d.key = c.key AND NOT c.grown AND d.key = g.key AND g.grown
"""


@register("op12_hash_tree_sharding", SHARDS_SQL)
def hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hash_tree.shard_table(table(spark, sf_dir, "documents"), TREE, GROWN)
    return placed.withColumn("law", F.lit("key"))


VARIANTS_SQL = f"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
hashed AS (SELECT run, {crc_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs, crc WHERE length(run) >= 6),
v AS (SELECT word, count(*) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run) + 2)::BIGINT) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5),
cuts AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
pairs AS (
  SELECT a.word, b.word AS near FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT word, rest FROM cuts WHERE rest IN (SELECT word FROM v)
  UNION SELECT rest, word FROM cuts WHERE rest IN (SELECT word FROM v)),
ranked AS (
  SELECT p.word, v.n, near, f.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near,
         row_number() OVER (PARTITION BY p.word ORDER BY f.n DESC, near) AS place
  FROM pairs p JOIN v ON v.word = p.word JOIN v f ON f.word = near),
forms AS (SELECT word, n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM ranked WHERE place = 1),
steps AS (SELECT word, form AS root, 1 AS step FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT s.word, f.form, step + 1 FROM steps s JOIN forms f ON f.word = s.root WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, step) AS root FROM steps GROUP BY word)
SELECT v.word, form, coalesce(root, v.word) AS root, n, coalesce(n_near, 0)::BIGINT AS n_near, form_n
FROM v LEFT JOIN forms USING (word) LEFT JOIN roots USING (word)
"""


@register("op13_spelling_variants", VARIANTS_SQL)
def spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.group_variants(spelling_variants.word_counts(table(spark, sf_dir, "documents"), typo_every=199))


@register("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
