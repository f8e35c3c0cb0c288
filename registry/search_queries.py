"""Tokenizing, index build, matching, ranking, result pages."""

from __future__ import annotations

from dataclasses import replace

import pandas as pd
from pyspark.sql import Window, functions as F, types as T

from pathloom.functions import text as X
from pathloom.operators import lexicon, postings as I, ranking as R, results as O
from pathloom.plans import search as S
from pathloom.plans.build import crawl_entries, index_files, plan_roots
from pathloom.operators.joins import restrict_scan
from pathloom.session import cut_lineage, work_dir
from pathloom.sources.index_table import IndexTable

from .catalog_queries import DAY, PARENT, ROOT, ROOTS_SQL, _root_excludes
from .tables import (
    AS_OF, CORPUS_SQL, HAN_SQL, NAMED_SQL, REQUESTS_SQL, catalog, corpus, docs, han_names, index_of,
    manifest, register, requests, table, texts,
)

# ---------------------------------------------------------------- text


@register("route_language", f"WITH {HAN_SQL} SELECT doc_id, name, lang FROM han_lang")
def route_language(spark, sf_dir):
    return han_names(spark, sf_dir).select("doc_id", "name", X.route_language("name").alias("lang"))


@register(
    "tokenize_words",
    """SELECT doc_id, unnest(range(len(t)))::BIGINT AS pos, unnest(t) AS term
FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS t FROM documents)""",
)
def tokenize_words(spark, sf_dir):
    tokens = texts(spark, sf_dir).select("doc_id", F.posexplode(X.tokenize_words("text")).alias("pos", "term"))
    return tokens.withColumn("pos", F.col("pos").cast("long"))


def _positions(frame):
    return frame.select("doc_id", F.posexplode("tokens").alias("pos", "term")).withColumn("pos", F.col("pos").cast("long"))


@register(
    "segment_cjk",
    f"WITH {HAN_SQL} SELECT doc_id, unnest(range(len(tokens)))::BIGINT AS pos, unnest(tokens) AS term FROM han_tokens WHERE lang = 'cmn'",
)
def segment_cjk(spark, sf_dir):
    chinese = han_names(spark, sf_dir).where(X.is_mandarin("name"))
    return _positions(chinese.select("doc_id", X.segment_han("name").alias("tokens")))


@register(
    "tokenize_mixed",
    f"WITH {HAN_SQL} SELECT doc_id, unnest(range(len(tokens)))::BIGINT AS pos, unnest(tokens) AS term FROM han_tokens",
)
def tokenize_mixed(spark, sf_dir):
    return _positions(han_names(spark, sf_dir).select("doc_id", X.tokenize("name", "mixed").alias("tokens")))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _dotted(names: pd.Series) -> pd.Series:
    return names.str.split(".")


@register(
    "register_tokenizer",
    f"""WITH {NAMED_SQL} SELECT doc_id, unnest(range(len(t)))::BIGINT AS pos, unnest(t) AS term
FROM (SELECT doc_id, string_split(name, '.') AS t FROM named)""",
)
def register_tokenizer(spark, sf_dir):
    X.register_tokenizer("dotted", _dotted)
    from pathloom.functions.paths import derive_name

    return _positions(docs(spark, sf_dir).select("doc_id", X.tokenize(derive_name("path"), "dotted").alias("tokens")))


# ---------------------------------------------------------------- index build

def _positions_text():
    return F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions")


@register(
    "build_postings",
    f"""WITH {CORPUS_SQL} SELECT term, doc_id, count(*) AS tf, max(dl)::BIGINT AS dl,
  string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM tok GROUP BY term, doc_id""",
)
def build_postings(spark, sf_dir):
    return I.build_postings(corpus(spark, sf_dir)).select(
        "term", "doc_id", F.col("tf").cast("long").alias("tf"), F.col("dl").cast("long").alias("dl"), _positions_text()
    )


@register("doc_lengths", f"WITH {CORPUS_SQL} SELECT doc_id, len(t)::BIGINT AS dl FROM toks")
def doc_lengths(spark, sf_dir):
    return I.doc_lengths(corpus(spark, sf_dir)).select("doc_id", F.col("dl").cast("long").alias("dl"))


@register(
    "corpus_stats",
    f"WITH {CORPUS_SQL} SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_tokens, round(avg(len(t)), 6) AS avg_len FROM toks",
)
def corpus_stats(spark, sf_dir):
    return I.corpus_stats(I.doc_lengths(corpus(spark, sf_dir))).withColumn("avg_len", F.round("avg_len", 6))


@register("doc_frequency", f"WITH {CORPUS_SQL} SELECT term, df FROM freq")
def doc_frequency(spark, sf_dir):
    return I.doc_frequency(I.build_postings(corpus(spark, sf_dir)))


LEXICON_SQL = f"""{HAN_SQL},
runs AS (SELECT unnest(regexp_extract_all(replace(name, ' ', ''), '\\p{{Han}}{{1,256}}')) AS run FROM han),
starts AS (SELECT run, unnest(range(1, length(run) + 1)) AS i FROM runs),
sub AS (SELECT run, i, unnest(range(1, least(4, length(run) - i + 1) + 1)) AS k FROM starts),
grams AS (SELECT substr(run, i, k) AS word, CASE WHEN i > 1 THEN substr(run, i - 1, 1) ELSE '' END AS before,
                 CASE WHEN i + k <= length(run) THEN substr(run, i + k, 1) ELSE '' END AS after FROM sub),
lefts AS (SELECT word, sum(c) AS n, round((ln(sum(c)) - sum(c * ln(c)) / sum(c)) * 1000) AS h
          FROM (SELECT word, before, count(*) AS c FROM grams GROUP BY ALL) GROUP BY word),
rights AS (SELECT word, round((ln(sum(c)) - sum(c * ln(c)) / sum(c)) * 1000) AS h
           FROM (SELECT word, after, count(*) AS c FROM grams GROUP BY ALL) GROUP BY word),
words AS (SELECT l.word, l.n::BIGINT AS n, least(l.h, r.h)::BIGINT AS freedom FROM lefts l JOIN rights r ON l.word = r.word),
letters AS (SELECT sum(n)::DOUBLE AS total FROM words WHERE length(word) = 1),
cuts AS (SELECT word, n, freedom, unnest(range(1, length(word))) AS k FROM words WHERE length(word) > 1),
bound AS (SELECT c.word, c.n, c.freedom, round(min(ln(c.n::DOUBLE * total / (h.n::DOUBLE * t.n))) * 1000)::BIGINT AS cohesion
          FROM cuts c JOIN words h ON h.word = substr(c.word, 1, c.k) JOIN words t ON t.word = substr(c.word, c.k + 1), letters
          GROUP BY ALL),
lex AS (
  SELECT word, n, cohesion, freedom, round(-ln(n / total) * 1000)::BIGINT AS cost FROM (
    SELECT word, n, freedom, cohesion FROM bound WHERE n >= 5 AND cohesion >= 1000 AND freedom >= 500
    UNION ALL SELECT word, n, freedom, NULL FROM words WHERE length(word) = 1), letters)"""

# The cheapest path letter by letter, then its words from the end to the start.
SEGMENT_SQL = f"""{LEXICON_SQL},
priced AS (SELECT run, map_from_entries(list({{'p': i * 16 + k, 'c': cost}})) AS costs
           FROM (SELECT DISTINCT run, i, k FROM sub) JOIN lex ON word = substr(run, i, k) GROUP BY run),
ahead AS (
  SELECT run, costs, 0::BIGINT AS i, [{{'cost': 0::BIGINT, 'k': 0::BIGINT}}] AS best FROM priced
  UNION ALL
  SELECT run, costs, i + 1, list_append(best, list_sort(list_transform(range(1, least(4, i + 1) + 1), lambda k:
    {{'cost': best[i + 2 - k].cost + coalesce(costs[(i + 2 - k) * 16 + k], 1125899906842624), 'k': k}}))[1])
  FROM ahead WHERE i < length(run)),
back AS (
  SELECT run, best, i AS place, []::VARCHAR[] AS words FROM ahead WHERE i = length(run)
  UNION ALL
  SELECT run, best, place - best[place + 1].k, list_prepend(substr(run, place - best[place + 1].k + 1, best[place + 1].k), words)
  FROM back WHERE place > 0),
held AS (SELECT doc_id, regexp_extract_all(replace(name, ' ', ''), '\\p{{Han}}{{1,256}}') AS rs FROM han),
each AS (SELECT doc_id, unnest(range(len(rs)))::INTEGER AS run_no, unnest(rs) AS run FROM held)
SELECT doc_id, run_no, array_to_string(words, ' ') AS words FROM each JOIN back USING (run) WHERE place = 0"""


def _joined_han(spark, sf_dir):
    return han_names(spark, sf_dir).withColumn("name", F.replace("name", F.lit(" "), F.lit("")))


@register("learn_lexicon", f"WITH {LEXICON_SQL} SELECT word, n, cohesion, freedom, cost FROM lex")
def learn_lexicon(spark, sf_dir):
    return lexicon.learn_lexicon(_joined_han(spark, sf_dir), "name")


@register("segment_learned", f"WITH RECURSIVE {SEGMENT_SQL}")
def segment_learned(spark, sf_dir):
    names = _joined_han(spark, sf_dir)
    cut = lexicon.segment(names, "name", lexicon.learn_lexicon(names, "name"))
    return cut.withColumn("words", F.array_join("words", " "))


CHANGED_SQL = f"""{NAMED_SQL},
gone AS (SELECT DISTINCT path FROM docs JOIN part ON doc_id = p_partkey WHERE p_size > 45),
changed AS (
  SELECT doc_id, path, name FROM named WHERE path NOT IN (SELECT path FROM gone)
  UNION ALL
  SELECT doc_id + 1000000000, path, name FROM named JOIN part ON doc_id = p_partkey WHERE p_size <= 5),
ctoks AS (SELECT doc_id, path, regexp_extract_all(name, '[\\p{{L}}\\p{{N}}]+') AS t FROM changed),
ctok AS (SELECT doc_id, unnest(t) AS term, unnest(range(len(t))) AS pos FROM ctoks)
"""


def changed_index(spark, sf_dir) -> IndexTable:
    """An index after two commits: all documents, then more copies and some deletes."""
    sizes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), "p_size")
    sized = docs(spark, sf_dir).join(sizes, "doc_id")
    again = sized.where("p_size <= 5").select((F.col("doc_id") + 1000000000).alias("doc_id"), "path")
    first = IndexTable.create(spark, work_dir(spark, "changed"), buckets=8).commit(adds=docs(spark, sf_dir))
    return first.commit(adds=again, deletes=sized.where("p_size > 45"))


@register(
    "write_index",
    f"""WITH {CHANGED_SQL} SELECT term, doc_id, count(*) AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions
FROM ctok GROUP BY term, doc_id""",
)
def write_index(spark, sf_dir):
    index = changed_index(spark, sf_dir)
    stored = IndexTable.open(spark, index.root)
    return stored.postings().select("term", "doc_id", F.col("tf").cast("long").alias("tf"), _positions_text())


@register("compact_index", f"WITH {CHANGED_SQL} SELECT term, count(DISTINCT doc_id) AS df FROM ctok GROUP BY term")
def compact_index(spark, sf_dir):
    return changed_index(spark, sf_dir).compact().terms().select("term", "df")


@register("num_docs", f"WITH {CHANGED_SQL} SELECT count(*) AS num_docs FROM changed")
def num_docs(spark, sf_dir):
    from pathloom.operators.changes import num_docs as count

    return count(changed_index(spark, sf_dir).docs())


@register(
    "index_files",
    f"""WITH {ROOTS_SQL}, keep AS (SELECT path FROM roots WHERE path NOT IN (SELECT prefix FROM ex)),
rest AS (SELECT prefix FROM ex WHERE prefix NOT IN (SELECT path FROM roots)),
e AS (SELECT path, {ROOT} AS root, {PARENT} AS up FROM files WHERE error IS NULL)
SELECT path, len(regexp_extract_all(regexp_extract(path, '([^/]+)/*\\z', 1), '[\\p{{L}}\\p{{N}}]+'))::BIGINT AS dl
FROM e WHERE root IN (SELECT path FROM keep)
  AND NOT EXISTS (SELECT 1 FROM rest WHERE length(up) > length(root) AND starts_with(up, prefix))""",
)
def index_files_query(spark, sf_dir):
    everything = manifest(spark, sf_dir)
    roots, excludes = plan_roots(everything, _root_excludes(spark, sf_dir))
    empty = IndexTable.create(spark, work_dir(spark, "files"), buckets=8)
    built, _ = index_files(empty, crawl_entries(everything, roots, excludes))
    return built.docs().select("path", F.col("dl").cast("long").alias("dl"))


# ---------------------------------------------------------------- matching and ranking


@register("term_query", f"WITH {CORPUS_SQL} SELECT doc_id, tf, dl::BIGINT AS dl FROM post WHERE term = 'the'")
def term_query(spark, sf_dir):
    hits = R.term_query(index_of(spark, sf_dir, "corpus").view(), "the")
    return hits.select("doc_id", F.col("tf").cast("long").alias("tf"), F.col("dl").cast("long").alias("dl"))


@register(
    "any_term_query",
    f"WITH {CORPUS_SQL} SELECT doc_id, round(sum(w), 6) AS score FROM scored WHERE term IN ('the', 'and', 'que') GROUP BY doc_id",
)
def any_term_query(spark, sf_dir):
    view = index_of(spark, sf_dir, "corpus").view()
    asked = R.query_terms(spark, "the and que")
    return R.any_term_scores(view, R.clause_hits(view, asked), asked.clauses).select("doc_id", F.round("score", 6).alias("score"))


PHRASE_SQL = f"""{CORPUS_SQL}, {REQUESTS_SQL},
pairs AS (
  SELECT a.query_id, a.clause, a.term AS t1, b.term AS t2
  FROM asked_terms a JOIN asked_terms b ON a.query_id = b.query_id AND b.clause = a.clause + 1),
doc_pairs AS (
  SELECT a.doc_id, a.term AS t1, b.term AS t2, count(*) AS tf, max(a.dl) AS dl
  FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 GROUP BY ALL),
idfs AS (SELECT term, ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) AS idf FROM freq CROSS JOIN stats),
phrase_hits AS (
  SELECT p.query_id, d.doc_id,
         sum((i1.idf + i2.idf) * (d.tf * 2.2e0) / (d.tf + 1.2e0 * (0.25e0 + 0.75e0 * d.dl / avgdl))) AS score
  FROM pairs p JOIN doc_pairs d USING (t1, t2) JOIN idfs i1 ON i1.term = t1 JOIN idfs i2 ON i2.term = t2
  CROSS JOIN stats GROUP BY p.query_id, d.doc_id)
"""


@register("phrase_query", f"WITH {PHRASE_SQL} SELECT query_id, doc_id, round(score, 6) AS score FROM phrase_hits")
def phrase_query(spark, sf_dir):
    """Every pair of neighbouring words of a request is a phrase."""
    view = index_of(spark, sf_dir, "corpus").view()
    clauses = cut_lineage(R.clause_terms(_phrases(spark, sf_dir, 2), optional=True))
    hits = R.clause_hits(view, clauses)
    return R.any_term_scores(view, hits).select("query_id", "doc_id", F.round("score", 6).alias("score"))


def _phrases(spark, sf_dir, words):
    """Every run of ``words`` neighbouring words of a request as one clause, numbered by its place."""
    split = F.split(F.trim("q"), r"\s+")
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - words + 1), lambda i: F.array_join(F.slice("w", i, F.lit(words)), " "))
    asked = requests(spark, sf_dir).select("query_id", split.alias("w")).where(F.size("w") >= words)
    return asked.select("query_id", F.posexplode(runs).alias("clause", "text")).withColumn("occur", F.lit("should"))


LONG_PHRASE_SQL = f"""{CORPUS_SQL}, {REQUESTS_SQL},
runs AS (
  SELECT a.query_id, a.clause, a.term AS t1, b.term AS t2, c.term AS t3
  FROM asked_terms a JOIN asked_terms b ON a.query_id = b.query_id AND b.clause = a.clause + 1
  JOIN asked_terms c ON a.query_id = c.query_id AND c.clause = a.clause + 2),
doc_runs AS (
  SELECT a.doc_id, a.term AS t1, b.term AS t2, c.term AS t3, count(*) AS tf, max(a.dl) AS dl
  FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN tok c ON a.doc_id = c.doc_id AND c.pos = a.pos + 2 GROUP BY ALL),
idfs AS (SELECT term, ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) AS idf FROM freq CROSS JOIN stats),
sums AS (
  SELECT r.query_id, d.doc_id,
         round(sum((i1.idf + i2.idf + i3.idf) * (d.tf * 2.2e0) / (d.tf + 1.2e0 * (0.25e0 + 0.75e0 * d.dl / avgdl))), 6) AS score
  FROM runs r JOIN doc_runs d USING (t1, t2, t3) JOIN idfs i1 ON i1.term = t1 JOIN idfs i2 ON i2.term = t2 JOIN idfs i3 ON i3.term = t3
  CROSS JOIN stats GROUP BY r.query_id, d.doc_id)
"""
RANKED_SQL = """SELECT query_id, doc_id, score, rank FROM (
  SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {}) WHERE rank <= 100"""


@register("phrase_page", f"WITH {LONG_PHRASE_SQL} {RANKED_SQL.format('sums')}")
def phrase_page(spark, sf_dir):
    """The 100 best documents of each request by its phrases of three words."""
    view = index_of(spark, sf_dir, "corpus").view()
    hits = S.clause_search(view, _phrases(spark, sf_dir, 3))
    return hits.withColumn("rank", F.col("rank").cast("long"))


OCCUR_SQL = "CASE WHEN regexp_matches(word, '^\\p{Lu}') THEN 'must' WHEN length(term) > 12 THEN 'must_not' ELSE 'should' END"


def _structured(spark, sf_dir):
    words = R.word_clauses(requests(spark, sf_dir))
    occur = (
        F.when(F.col("text").rlike(r"^\p{Lu}"), F.lit("must"))
        .when(F.length(F.regexp_extract("text", X.WORD, 0)) > 12, F.lit("must_not"))
        .otherwise(F.lit("should"))
    )
    return words.withColumn("occur", occur)


@register(
    "bool_query",
    f"""WITH {CORPUS_SQL}, {REQUESTS_SQL}, c AS (SELECT query_id, clause, term, {OCCUR_SQL} AS occur FROM asked_terms),
need AS (SELECT query_id, count(*) FILTER (occur = 'must') AS n FROM c GROUP BY query_id),
m AS (SELECT c.query_id, s.doc_id, sum(CASE WHEN occur <> 'must_not' THEN w END) AS score,
        count(*) FILTER (occur = 'must') AS musts, count(*) FILTER (occur = 'must_not') AS bad
      FROM c JOIN scored s USING (term) GROUP BY c.query_id, s.doc_id)
SELECT query_id, doc_id, round(score, 6) AS score FROM m JOIN need USING (query_id)
WHERE bad = 0 AND musts = n AND score IS NOT NULL""",
)
def bool_query(spark, sf_dir):
    """Capitalised words are required, very long ones forbidden, the rest optional."""
    view = index_of(spark, sf_dir, "corpus").view()
    clauses = cut_lineage(R.clause_terms(_structured(spark, sf_dir)))
    return R.bool_scores(view, clauses).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@register(
    "bool_page",
    f"""WITH {CORPUS_SQL}, {REQUESTS_SQL}, c AS (SELECT query_id, clause, term, {OCCUR_SQL} AS occur FROM asked_terms),
need AS (SELECT query_id, count(*) FILTER (occur = 'must') AS n FROM c GROUP BY query_id),
m AS (SELECT c.query_id, s.doc_id, round(sum(CASE WHEN occur <> 'must_not' THEN w END), 6) AS score,
        count(*) FILTER (occur = 'must') AS musts, count(*) FILTER (occur = 'must_not') AS bad
      FROM c JOIN scored s USING (term) GROUP BY c.query_id, s.doc_id),
kept AS (SELECT query_id, doc_id, score FROM m JOIN need USING (query_id) WHERE bad = 0 AND musts = n AND score IS NOT NULL)
{RANKED_SQL.format('kept')}""",
)
def bool_page(spark, sf_dir):
    """The 100 best documents of each structured request."""
    hits = S.clause_search(index_of(spark, sf_dir, "corpus").view(), _structured(spark, sf_dir))
    return hits.withColumn("rank", F.col("rank").cast("long"))


@register("rank_bm25", f"WITH {CORPUS_SQL} SELECT doc_id, round(w, 6) AS score FROM scored WHERE term = 'the'")
def rank_bm25(spark, sf_dir):
    view = index_of(spark, sf_dir, "corpus").view()
    df = R.term_query(replace(view, postings=view.terms), "the").select("df").scalar()
    weight = R.bm25(R.idf(view.n_docs, df), F.col("tf"), F.col("dl"), view.avg_len)
    return R.term_query(view, "the").select("doc_id", F.round(weight, 6).alias("score"))


TOP_SQL = """
SELECT doc_id, score, rank FROM (
  SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank
  FROM (SELECT doc_id, round(sum(w), 6) AS score FROM scored WHERE term IN ('the', 'of') GROUP BY doc_id))
WHERE rank <= 100"""


@register("top_k", f"WITH {CORPUS_SQL} {TOP_SQL}")
def top_k(spark, sf_dir):
    hits = S.search_hits(index_of(spark, sf_dir, "corpus").view(), "the of")
    return hits.select("doc_id", "score", F.col("rank").cast("long").alias("rank"))


@register("fetch_stored", f"WITH {CORPUS_SQL} SELECT '/doc/' || doc_id AS path, rank FROM ({TOP_SQL})")
def fetch_stored(spark, sf_dir):
    view = index_of(spark, sf_dir, "corpus").view()
    hits = cut_lineage(S.search_hits(view, "the of"))
    return O.fetch_stored(hits, restrict_scan(view.docs, "doc_id", hits), small=True).select("path", F.col("rank").cast("long").alias("rank"))


BATCH_SQL = f"""{CORPUS_SQL}, {REQUESTS_SQL},
sums AS (
  SELECT a.query_id, s.doc_id, round(sum(s.w), 6) AS score
  FROM asked_terms a JOIN scored s USING (term) GROUP BY a.query_id, s.doc_id),
ranked AS (
  SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sums)
"""


@register("search_batch", f"WITH {BATCH_SQL} SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 100")
def search_batch(spark, sf_dir):
    hits = S.batch_hits(index_of(spark, sf_dir, "corpus").view(), requests(spark, sf_dir))
    return hits.withColumn("rank", F.col("rank").cast("long"))


@register("bounded_batch", f"WITH {BATCH_SQL} SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 10")
def bounded_batch(spark, sf_dir):
    """The ten best documents of each request, by score bounds whatever the number of postings."""
    terms = cut_lineage(R.clause_terms(R.word_clauses(requests(spark, sf_dir)), optional=True))
    hits = R.best_hits(index_of(spark, sf_dir, "corpus").view(), terms, k=10, most=0)
    return hits.withColumn("rank", F.col("rank").cast("long"))


# ---------------------------------------------------------------- result pages

PAGES_SQL = f"""WITH {BATCH_SQL} SELECT query_id, rank, 'file' AS class, CAST(doc_id AS VARCHAR) AS name, '/doc/' || doc_id AS path,
  CAST(n_chars AS DOUBLE) AS size, DATE '1970-01-01' + CAST(doc_id AS INTEGER) AS last_modified_date
FROM ranked JOIN documents USING (doc_id) WHERE rank <= 100"""


def corpus_files(spark, sf_dir):
    """A catalogue that was crawled twice: each document has an older entry as well."""
    day = F.col("doc_id") * 86400
    entry = lambda size, mtime: table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/doc/"), F.col("doc_id").cast("string")).alias("path"), F.lit(False).alias("is_dir"),
        size.cast("long").alias("size"), F.timestamp_seconds(mtime).alias("mtime"),
    )
    return entry(F.col("n_chars"), day).unionByName(entry(F.lit(1), day - 100))


@register("search_pages", PAGES_SQL)
def search_pages(spark, sf_dir):
    """The whole result pages of many requests."""
    view = index_of(spark, sf_dir, "corpus").view()
    pages = S.search_batch(view, corpus_files(spark, sf_dir), requests(spark, sf_dir), AS_OF)
    return pages.withColumn("rank", F.col("rank").cast("long"))


PAGE_QUERY = "  red Ring eco bolt lar "
PAGE_SQL = f"""{NAMED_SQL},
ntoks AS (SELECT doc_id, path, name, regexp_extract_all(name, '[\\p{{L}}\\p{{N}}]+') AS t FROM named),
ntok AS (SELECT doc_id, unnest(t) AS term, len(t) AS dl FROM ntoks),
npost AS (SELECT term, doc_id, count(*) AS tf, max(dl) AS dl FROM ntok GROUP BY term, doc_id),
nfreq AS (SELECT term, count(*) AS df FROM npost GROUP BY term),
nstats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM ntoks),
nsum AS (
  SELECT doc_id, round(sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * (tf * 2.2e0)
           / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))), 6) AS score
  FROM npost JOIN nfreq USING (term) CROSS JOIN nstats
  WHERE term IN ('red', 'Ring', 'eco', 'bolt', 'lar') GROUP BY doc_id),
nrank AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM nsum),
page AS (
  SELECT rank, coalesce(nullif(regexp_extract(name, '\\.([^.]+)\\z', 1), ''),
                        CASE WHEN is_dir IS NULL THEN 'unknown' WHEN is_dir THEN 'folder' ELSE 'file' END) AS class,
         name, path, coalesce(CAST(size AS DOUBLE), 0.0e0) AS size, {DAY} AS last_modified_date
  FROM nrank JOIN named USING (doc_id) LEFT JOIN catalog USING (path) WHERE rank <= 100)
"""


def _page(spark, sf_dir):
    view = index_of(spark, sf_dir, "docs").view()
    return S.search(view, catalog(spark, sf_dir), PAGE_QUERY, AS_OF)


@register("search", f"WITH {PAGE_SQL} SELECT * FROM page")
def search(spark, sf_dir):
    return _page(spark, sf_dir).withColumn("rank", F.col("rank").cast("long"))


@register(
    "enrich",
    f"""WITH {NAMED_SQL} SELECT doc_id, path, name, regexp_extract(name, '\\.([^.]+)\\z', 1) AS class,
  coalesce(CAST(size AS DOUBLE), 0.0e0) AS size, {DAY} AS last_modified_date
FROM named LEFT JOIN catalog USING (path)""",
)
def enrich(spark, sf_dir):
    return O.enrich(docs(spark, sf_dir), catalog(spark, sf_dir), AS_OF)


@register("project_result", f"WITH {PAGE_SQL} SELECT size, class, name, path, last_modified_date FROM page")
def project_result(spark, sf_dir):
    from pathloom.schemas import RESULT_COLUMNS

    return O.project_result(_page(spark, sf_dir), O.move_column(list(RESULT_COLUMNS), 3, 0))


def _placed(page, column, direction):
    """The sort order as a column (a page has at most k rows)."""
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*O.sort_keys(column, direction)))
    return O.sort_results(page, column, direction).select(
        place.cast("long").alias("place"), "path", "size", "last_modified_date"
    )


def _placed_sql(keys):
    return f"WITH {PAGE_SQL} SELECT row_number() OVER (ORDER BY {keys}) AS place, path, size, last_modified_date FROM page"


@register("sort_size", _placed_sql("size DESC, rank"))
def sort_size(spark, sf_dir):
    return _placed(_page(spark, sf_dir), "size", "descending")


@register("sort_date", _placed_sql("last_modified_date, rank"))
def sort_date(spark, sf_dir):
    return _placed(_page(spark, sf_dir), "last_modified_date", "default")


@register("sort_guard", _placed_sql("rank"))
def sort_guard(spark, sf_dir):
    return _placed(_page(spark, sf_dir), "name", "descending")
