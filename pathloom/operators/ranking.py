"""Matching query clauses against postings, scoring, and the best k per query."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import tokenize
from ..functions.values import normalize_query
from ..session import cut_lineage
from .joins import fits_broadcast, lookup_join
from .postings import block_of, block_postings, block_rows, corpus_stats, id_of, offset_of, term_bounds, term_bucket

# Fixed values of the ranking function and the result page.
K1, B = 1.2, 0.75
TOP_K = 100


@dataclass(frozen=True)
class IndexView:
    """What a search reads. ``buckets`` is set when postings are partitioned by term bucket.

    ``postings`` are live; ``blocks`` are as stored and ``alive`` drops rows (doc_id, segment, ...) of
    removed documents.
    """

    docs: DataFrame  # doc_id, path, ...
    postings: DataFrame  # term, doc_id, tf, dl, positions [, segment, bucket]
    terms: DataFrame  # term, df, max_tf, min_dl [, bucket]
    n_docs: Column
    avg_len: Column
    blocks: DataFrame  # term, block, n, offsets, tfs, dls, positions, ... [, segment, bucket]
    buckets: int | None = None
    alive: Callable[[DataFrame], DataFrame] = lambda rows: rows


def view_of(docs: DataFrame, postings: DataFrame) -> IndexView:
    """A view over plain frames; statistics are scalar subqueries, not cross joins."""
    stats = corpus_stats(docs)
    blocks = block_postings(postings)
    return IndexView(
        docs=docs,
        postings=postings,
        blocks=blocks,
        terms=term_bounds(blocks),
        n_docs=stats.select("n_docs").scalar(),
        avg_len=stats.select("avg_len").scalar(),
    )


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)))


def bm25(idf_value: Column, tf: Column, dl: Column, avg_len: Column) -> Column:
    """Okapi BM25 (Robertson & Zaragoza 2009)."""
    norm = (1 - B) + B * dl / avg_len
    return idf_value * (tf * (K1 + 1)) / (tf + K1 * norm)


# ---------------------------------------------------------------- query side


def word_clauses(queries: DataFrame) -> DataFrame:
    """``(query_id, clause, occur, text)``: every white-space separated word may match."""
    trimmed = queries.select("query_id", normalize_query("q").alias("q")).where("q != ''")
    return trimmed.select(
        "query_id", F.posexplode(F.split("q", r"(?U)\s+")).alias("clause", "text")
    ).select("query_id", "clause", F.lit("should").alias("occur"), "text")


def clause_terms(clauses: DataFrame, tokenizer: str = "mixed", optional: bool = False) -> DataFrame:
    """``(query_id, clause, occur, n_must, n_terms, offset, term)``.

    A clause text that gives one token is a term clause, several tokens make a phrase
    and none drops the clause. ``n_must`` counts the required clauses of the query;
    ``optional`` says that there are none, so nothing has to be counted.
    """
    tokens = clauses.withColumn("tokens", tokenize("text", tokenizer)).where(F.size("tokens") > 0)
    # A query is a handful of clauses, so this window sees small groups only.
    of_query = Window.partitionBy("query_id")
    musts = F.lit(0) if optional else F.count_if(F.col("occur") == "must").over(of_query).cast("int")
    return tokens.withColumn("n_must", musts).select(
        "query_id", "clause", "occur", "n_must",
        F.size("tokens").alias("n_terms"),
        F.posexplode("tokens").alias("offset", "term"),
    )


@dataclass(frozen=True)
class QueryTerms:
    """Clause terms of one query text: a literal frame, and what is known about it."""

    frame: DataFrame
    terms: list[str]
    clauses: int
    phrases: bool


def query_terms(spark: SparkSession, q: str, tokenizer: str = "mixed") -> QueryTerms:
    """Tokenize one query text.

    The words of one query are read to the driver, so that they become literals of the
    scans.
    """
    query = spark.range(0, 1, 1, 1).select(F.lit(0).cast("long").alias("query_id"), F.lit(q).alias("q"))
    frame = clause_terms(word_clauses(query), tokenizer, optional=True)
    rows = frame.collect()
    if not rows:
        return QueryTerms(spark.createDataFrame([], frame.schema), [], 0, False)
    literals = F.array(*[
        F.struct(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in frame.schema]) for row in rows
    ])
    return QueryTerms(
        frame=spark.range(0, 1, 1, 1).select(F.inline(literals)),
        terms=sorted({row["term"] for row in rows}),
        clauses=len({row["clause"] for row in rows}),
        phrases=any(row["n_terms"] > 1 for row in rows),
    )


# ---------------------------------------------------------------- matching


def term_query(view: IndexView, term: str) -> DataFrame:
    """Postings of one exact term; the bucket literal prunes partitions."""
    hits = view.postings.where(F.col("term") == term)
    if view.buckets:
        hits = hits.where(F.col("bucket") == term_bucket(F.lit(term), view.buckets))
    return hits


def _restrict(view: IndexView, clauses: DataFrame, listed: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """Blocks and terms behind static filters, for a clause list known to be small.

    At most 256 terms, else at most ``view.buckets`` bucket numbers, become literals,
    so the scan prunes partitions and row groups.
    """
    if not view.buckets:
        return view.blocks, view.terms
    if listed is None:
        listed = [r["term"] for r in clauses.select("term").distinct().limit(257).collect()]
    if len(listed) <= 256:
        in_bucket = F.col("bucket").isin([term_bucket(F.lit(t), view.buckets) for t in listed])
        keep = in_bucket & F.col("term").isin(listed)
    else:
        keep = F.col("bucket").isin([r[0] for r in clauses.select("bucket").distinct().collect()])
    return view.blocks.where(keep), view.terms.where(keep)


@dataclass(frozen=True)
class Matching:
    """The clause terms of a search that the index knows, and the blocks they are in."""

    view: IndexView
    blocks: DataFrame
    known: DataFrame  # bucket, term, query_id, clause, occur, n_must, offset, n_terms, df, max_tf, min_dl, idf
    key: list[str]  # what joins both
    small: bool  # whether ``known`` may be broadcast
    phrases: bool
    dealt: bool = False  # whether hits are dealt by block, which they keep
    folded: bool = False  # whether hits stay blocks, with removed documents

    @property
    def place(self) -> list[str]:
        """What tells the block of a document: its ids may be in several segments."""
        return [*(["segment"] if "segment" in self.blocks.columns else []), *self.key, "block"]

    def hits(self, wanted: DataFrame, positions: bool = False) -> DataFrame:
        """All documents of the terms of ``wanted``, with its columns: blocks are joined first and opened then."""
        lists = ["offsets", "tfs", "dls", *(["positions"] if positions else [])]
        blocks = self.blocks.select(*self.place, *lists)
        if self.dealt and self.small:
            blocks = lookup_join(blocks, wanted, self.key, "left_semi", small=True).repartition("block")
        joined = lookup_join(blocks, wanted, self.key, spread=F.xxhash64("block"), small=self.small)
        return joined if self.folded else self.view.alive(block_rows(joined, positions, block=self.dealt))

    def sums(self, wanted: DataFrame, value: Column, *more: str) -> DataFrame:
        """(query_id, ``more``, doc_id, score): ``value`` of all documents of the terms of ``wanted``, added up.

        A document is in one block of ids. So the blocks of the asked terms are dealt by their number, each once however many
        queries ask for it, and the sums need no other shuffle, which would move a row per query and document from each task.
        """
        rows = replace(self, dealt=True).hits(wanted)
        return rows.groupBy("query_id", "block", *more, "doc_id").agg(F.sum(value).alias("score")).drop("block")

    def look_up(self, wanted: DataFrame, terms: DataFrame) -> DataFrame:
        """``wanted`` (key, doc_id [, segment], ...) with tf where the document has the term.

        ``terms`` has the keys that occur in ``wanted``; other blocks are not moved.

        A block is found by an equality join and the document in it by its place in the list: no postings
        are opened. The segment of a candidate is that of its live version, so removed ones are not met.
        """
        blocks = lookup_join(self.blocks.select(*self.place, "offsets", "tfs"), terms, self.key, "left_semi", spread=F.xxhash64("block"), small=self.small)
        found = wanted.withColumn("block", block_of()).join(blocks, self.place)
        at = F.array_position("offsets", offset_of())
        found = found.withColumn("_at", at.cast("int") - 1).where("_at >= 0")
        return found.select(*wanted.columns, F.get("tfs", F.col("_at")).alias("tf"))

    def only(self, known: DataFrame) -> Matching:
        return replace(self, known=known)


def match_terms(view: IndexView, clauses: DataFrame | QueryTerms, small: bool | None = None) -> Matching:
    """Look the clause terms up in the vocabulary."""
    listed = phrases = None
    if isinstance(clauses, QueryTerms):
        listed, phrases, small = clauses.terms, clauses.phrases, True
        clauses = clauses.frame
    key = ["term"]
    if view.buckets:
        clauses = clauses.withColumn("bucket", term_bucket("term", view.buckets))
        key = ["bucket", "term"]
    small = fits_broadcast(clauses) if small is None else small
    if small:
        blocks, terms = _restrict(view, clauses, listed)
        # Terms are unique, so the result is no longer than the clause list.
        known = lookup_join(terms, clauses, key, small=True)
    else:
        blocks, terms = view.blocks, view.terms
        vocabulary = lookup_join(terms, clauses, key, "left_semi")
        known = lookup_join(clauses, vocabulary, key, spread=F.xxhash64("query_id", "clause"))
    known = known.select(
        *key, *OF_CLAUSE, "offset", "n_terms", "df", "max_tf", "min_dl", idf(view.n_docs, F.col("df")).alias("idf")
    )
    if phrases is None:
        phrases = not clauses.where("n_terms > 1").isEmpty()
    return Matching(view, blocks, known, key, small, phrases)


OF_CLAUSE = ["query_id", "clause", "occur", "n_must"]
HIT = [*OF_CLAUSE, "doc_id", "tf", "dl", "idf"]


def clause_hits(view: IndexView, clauses: DataFrame | QueryTerms, small: bool | None = None) -> DataFrame:
    """One row per matching clause and document, with tf, dl and idf.

    Term clauses take postings as they are. For a phrase, ``tf`` is the number of places
    where its terms stand in order, and its idf is the sum over them.
    """
    return _all_hits(match_terms(view, clauses, small))


def _all_hits(m: Matching, more: tuple[str, ...] = ()) -> DataFrame:
    singles = m.hits(m.known.where("n_terms = 1").select(*m.key, *OF_CLAUSE, "idf")).select(*HIT, *more)
    return singles.unionByName(phrase_hits(m).select(*HIT, *more)) if m.phrases else singles


def phrase_hits(m: Matching) -> DataFrame:
    """Documents where the terms of a phrase stand in order.

    The rarest term of each phrase proposes (document, start) candidates, as whole blocks; every other
    term of the phrase is then looked up in just those blocks, by (term, block of documents),
    which no frequent word can skew. Blocks are opened where they met, for documents that have both.
    """
    # Sized like the queries and used below several times: written once. Of equal phrases one is matched.
    of_term = F.struct("offset", *m.key, "df", "idf")
    phrases = m.known.where("n_terms > 1").groupBy(*OF_CLAUSE, "n_terms").agg(F.sort_array(F.collect_list(of_term)).alias("terms"))
    phrases = cut_lineage(phrases.where(F.size("terms") == F.col("n_terms")).withColumn("phrase", F.to_json("terms.term")))
    rarest = F.array_min(F.transform("terms", lambda t: F.struct(t["df"], t["offset"])))["offset"]
    ranked = phrases.select("phrase", "n_terms", "terms").dropDuplicates(["phrase"]).select(
        "phrase", "n_terms", rarest.alias("first"), F.inline("terms")
    )
    ranked = cut_lineage(ranked)
    segment = [c for c in m.place if c == "segment"]
    # Positions travel as one list beside their counts, which takes a quarter of the room of a list of lists.
    starts = F.transform(F.flatten("positions"), lambda p: p - F.col("offset"))
    lead = replace(m, folded=True).hits(ranked.where("offset = first"), positions=True).select(
        "phrase", *segment, "block", "n_terms", F.col("offsets").alias("lead_offsets"), "dls", F.col("tfs").alias("lead_tfs"), starts.alias("starts")
    )
    others = ranked.where("offset <> first").select(*m.key, "phrase", "offset")
    # A block of the rarest term is one row, whatever documents of it have the term.
    wanted = lookup_join(lead, others, "phrase", spread=F.xxhash64("block"), small=m.small)
    stored = m.blocks.select(*m.place, "offsets", "tfs", F.flatten("positions").alias("positions"))
    theirs = lookup_join(stored, others, m.key, "left_semi", spread=F.xxhash64("block"), small=m.small)
    both = wanted.join(theirs, m.place).select("*", F.posexplode("lead_offsets").alias("_i", "_offset"))
    both = both.withColumn("_at", F.array_position("offsets", F.col("_offset")).cast("int") - 1).where("_at >= 0")
    rows = both.select(
        "phrase", *segment, id_of("block", "_offset").alias("doc_id"), F.get("dls", "_i").alias("dl"), "n_terms", "offset",
        _own("starts", "lead_tfs", "_i"), _own("positions", "tfs", "_at"),
    )
    # One row per start where a term agrees with the rarest one: few, and counted before
    # the shuffle. A start that all other terms agree on is an occurrence of the phrase.
    # The short list is shifted and hashed, the long one only walked.
    expected = F.transform("starts", lambda p: p + F.col("offset"))
    met = m.view.alive(rows).withColumn("met", F.array_intersect("positions", expected))
    of_hit = ["phrase", *segment, "doc_id", "dl"]
    # With two terms each meeting place is an occurrence; more terms have to agree on the start.
    pairs = met.where("n_terms = 2").select(*of_hit, F.size("met").alias("tf")).where("tf > 0")
    agreed = met.where("n_terms > 2").select(*of_hit, "n_terms", "offset", F.explode("met").alias("met"))
    agreed = agreed.withColumn("start", F.col("met") - F.col("offset"))
    longer = (
        agreed.groupBy(*of_hit, "n_terms", "start").agg(F.count("*").alias("agreeing"))
        .where("agreeing = n_terms - 1")
        .groupBy(*of_hit).agg(F.count("*").cast("int").alias("tf"))
    )
    found = pairs.unionByName(longer) if _any_longer(phrases) else pairs
    idfs = F.aggregate("terms", F.lit(0.0), lambda total, t: total + t["idf"]).alias("idf")
    askers = phrases.select("phrase", *OF_CLAUSE, idfs)
    return lookup_join(found, askers, "phrase", spread=F.xxhash64("doc_id"), small=m.small)


def _own(flat: str, counts: str, at: str) -> Column:
    """The entries of the ``at``-th of the lists that were flattened, by their lengths."""
    # Also read for rows that a later filter drops, where ``at`` is -1.
    before = F.aggregate(F.slice(counts, F.lit(1), F.greatest(F.col(at), F.lit(0))), F.lit(0), lambda total, n: total + n)
    return F.slice(flat, before + 1, F.get(counts, at)).alias(flat)


def _any_longer(phrases: DataFrame) -> bool:
    return not phrases.where("n_terms > 2").isEmpty()


def score_hits(view: IndexView, hits: DataFrame) -> DataFrame:
    """``(query_id, doc_id, score)`` for documents that satisfy the clauses of their query.

    Every ``must`` clause has to match, no ``must_not`` may, and a query without
    ``must`` needs one ``should``. Scores of matching clauses add up.
    """
    value = bm25(F.col("idf"), F.col("tf"), F.col("dl"), view.avg_len)
    scored = hits.groupBy("query_id", "doc_id").agg(
        F.sum(F.when(F.col("occur") != "must_not", value)).alias("score"),
        F.count_if(F.col("occur") == "must").alias("musts"),
        F.count_if(F.col("occur") == "must_not").alias("forbidden"),
        F.max("n_must").alias("n_must"),
    )
    return scored.where("forbidden = 0 AND musts = n_must AND score IS NOT NULL").select(
        "query_id", "doc_id", "score"
    )


def any_term_scores(view: IndexView, hits: DataFrame, clauses_per_query: int | None = None) -> DataFrame:
    """Scores when every clause is optional. One clause needs no aggregation at all."""
    value = bm25(F.col("idf"), F.col("tf"), F.col("dl"), view.avg_len)
    if clauses_per_query == 1:
        return hits.select("query_id", "doc_id", value.alias("score"))
    return hits.groupBy("query_id", "doc_id").agg(F.sum(value).alias("score"))


def bool_scores(view: IndexView, clauses: DataFrame, small: bool | None = None) -> DataFrame:
    """:func:`score_hits` of :func:`clause_hits`, clause by clause.

    The rarest required clause of a query proposes documents. Other required terms are looked
    up in these only, the rest in those that had them all. Phrases are matched by their own rarest term. Queries that
    require nothing take all their hits.
    """
    m = match_terms(view, clauses, small)
    of_query = Window.partitionBy("query_id")
    rarest = F.min("df").over(Window.partitionBy(*OF_CLAUSE))
    # A clause of which a term is unknown has no documents; a required one then ends its query.
    whole = F.count("*").over(Window.partitionBy(*OF_CLAUSE)) == F.col("n_terms")
    place = F.min(F.when(F.col("occur") == "must", F.struct("rarest", "clause"))).over(of_query)
    known = m.known.withColumn("rarest", rarest).withColumn("whole", whole).where("whole")
    known = cut_lineage(known.withColumn("lead", F.coalesce(place["clause"] == F.col("clause"), F.lit(False))).drop("rarest", "whole"))
    value = bm25(F.col("idf"), F.col("tf"), F.col("dl"), view.avg_len)
    segment = [c for c in m.place if c == "segment"]
    seen = ["query_id", "n_must", *segment, "doc_id", "dl"]

    free = _all_hits(m.only(known.where("n_must = 0")))
    led = m.only(known.where("n_must > 0"))
    proposed = _all_hits(led.only(led.known.where("lead")), tuple(segment)).select(*seen, value.alias("score"))
    rest = led.known.where("NOT lead")

    def add(found: DataFrame, occurs: list[str]) -> DataFrame:
        """(seen, score, musts, forbidden) of ``found`` rows and the clauses that they match."""
        asked = rest.where(F.col("occur").isin(occurs))
        singles = asked.where("n_terms = 1").select(*m.key, "query_id", "clause", "occur", "idf")
        wanted = lookup_join(found.select(*seen), singles, "query_id", spread=F.xxhash64("doc_id"), small=m.small)
        matched = m.look_up(wanted, singles).select(*seen, "clause", "occur", value.alias("w"))
        if m.phrases:
            places = phrase_hits(led.only(asked)).select("query_id", *segment, "doc_id", "clause", "occur", "tf", "idf")
            matched = matched.unionByName(
                found.select(*seen).join(places, ["query_id", *segment, "doc_id"]).select(*seen, "clause", "occur", value.alias("w"))
            )
        own = found.select(*seen, F.col("score").alias("w"), F.lit("own").alias("occur"))
        both = own.unionByName(matched.select(*seen, "w", "occur"))
        return both.groupBy(*seen).agg(
            F.sum(F.when(F.col("occur") != "must_not", F.col("w"))).alias("score"),
            F.count_if(F.col("occur") == "must").alias("musts"),
            F.count_if(F.col("occur") == "must_not").alias("forbidden"),
        )

    required = cut_lineage(add(proposed, ["must"]).where("musts = n_must - 1"))
    scored = add(required, ["should", "must_not"]).where("forbidden = 0")
    return score_hits(view, free).unionByName(scored.select("query_id", "doc_id", "score"))


def best_hits(view: IndexView, clauses: DataFrame, k: int = TOP_K, most: int | None = None) -> DataFrame:
    """:func:`top_k` of all optional clauses, by score bounds where they save more than their extra steps cost.

    Up to ``most`` postings all of them are scored in one pass; the document counts of the terms tell how many
    there are before any posting is read. Rows are the same.
    """
    m = match_terms(view, clauses)
    m = m.only(cut_lineage(m.known))
    postings = m.known.agg(F.sum("df")).first()[0] or 0
    if postings <= (PLAIN_POSTINGS if most is None else most):
        value = bm25(F.col("idf"), F.col("tf"), F.col("dl"), view.avg_len)
        scored = m.sums(m.known.where("n_terms = 1").select(*m.key, "query_id", "idf"), value)
        if m.phrases:
            more = phrase_hits(m).select("query_id", "doc_id", value.alias("score"))
            scored = scored.unionByName(more).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))
        return top_k(scored, k)
    return bounded_top_k(m, k)


#: Postings of a batch of requests that are scored whole: some seconds of eight cores.
PLAIN_POSTINGS = 100_000_000


def bounded_top_k(m: Matching, k: int = TOP_K) -> DataFrame:
    """:func:`top_k` of all optional clauses, without the postings that cannot matter.

    Each term has a bound: the weight of its largest ``tf`` in its shortest document, whatever the mean length
    is now. The rarest terms of a query give a score that ``k`` documents reach. The terms of least bound
    whose bounds do not add up to that score cannot bring a document onto the page by themselves, so
    only documents with another term are candidates, and of those only the ones whose score so far plus
    these bounds reaches the score of the ``k``-th. The weak terms are looked up in what is left. Phrases always
    propose. Rows are those of :func:`top_k`.
    """
    view = m.view
    segment = [c for c in m.place if c == "segment"]
    bound = bm25(F.col("idf"), F.col("max_tf"), F.col("min_dl"), view.avg_len)
    # A word that stands twice in a query is one term of double weight.
    single = m.known.where("n_terms = 1").groupBy(*m.key, "query_id").agg(
        F.first("df").alias("df"), F.first("idf").alias("idf"), F.first(bound).alias("bound"), F.count("*").alias("times")
    ).withColumn("bound", F.col("bound") * F.col("times"))
    by_rarity = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    by_bound = Window.partitionBy("query_id").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    single = cut_lineage(
        single.withColumn("rarer", F.coalesce(F.sum("df").over(by_rarity), F.lit(0))).withColumn("weak_sum", F.sum("bound").over(by_bound))
    )
    value = bm25(F.col("idf"), F.col("tf"), F.col("dl"), view.avg_len) * F.col("times")
    asked = [*m.key, "query_id", "idf", "times"]

    def sums(terms: DataFrame) -> DataFrame:
        return m.sums(terms.select(*asked), value, *segment, "dl")

    def reached(rows: DataFrame) -> DataFrame:
        """(query_id, least): the score of the k-th document so far; less a little for rounding."""
        kth = top_k(rows.select("query_id", "doc_id", "score"), k).where(F.col("rank") == k)
        return kth.select("query_id", (F.col("score") - 1e-5).alias("least"))

    first = cut_lineage(reached(sums(single.where(F.col("rarer") < LEADING * k))))
    levels = lookup_join(single, first, "query_id", "left", spread=F.xxhash64("term"), small=m.small or None)
    levels = cut_lineage(levels.withColumn("weak", F.coalesce(F.col("weak_sum") < F.col("least"), F.lit(False))))
    strong = sums(levels.where("NOT weak"))
    if m.phrases:
        weight = bm25(F.col("idf"), F.col("tf"), F.col("dl"), view.avg_len)
        strong = strong.unionByName(phrase_hits(m).select("query_id", *segment, "doc_id", "dl", weight.alias("score")))
        strong = strong.groupBy("query_id", *segment, "doc_id", "dl").agg(F.sum("score").alias("score"))
    strong = cut_lineage(strong)
    weak = levels.where("weak")
    slack = weak.groupBy("query_id").agg(F.sum("bound").alias("slack"))
    limits = lookup_join(
        slack, reached(strong), "query_id", "left", small=m.small or None
    ).select("query_id", (F.col("least") - F.col("slack")).alias("least"))
    limited = lookup_join(strong, cut_lineage(limits), "query_id", "left", spread=F.xxhash64("doc_id"), small=m.small or None)
    kept = limited.where("least IS NULL OR score >= least").drop("least")
    wanted = lookup_join(kept.drop("score"), weak.select(*asked), "query_id", spread=F.xxhash64("doc_id"), small=m.small or None)
    more = m.look_up(wanted, weak).select("query_id", "doc_id", value.alias("w"))
    scored = kept.select("query_id", "doc_id", F.col("score").alias("w")).unionByName(more)
    return top_k(scored.groupBy("query_id", "doc_id").agg(F.sum("w").alias("score")), k)


#: The first estimate scores a query's rarest terms until they have about so many postings per wanted row.
LEADING = 20


# ---------------------------------------------------------------- top k


def top_k(scored: DataFrame, k: int = TOP_K) -> DataFrame:
    """Best ``k`` per query with their ``rank``, by rounded score, then document id.

    Up to the window-group-limit threshold Spark keeps k rows per query in each map
    task before the shuffle. Above it a first ranking per (query, slice of documents)
    does the same, so no task ever receives all hits of a frequent query.
    """
    spark = scored.sparkSession
    scored = scored.withColumn("score", F.round("score", 6))
    order = [F.desc("score"), F.asc("doc_id")]
    limit = int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > limit:
        slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
        part = F.pmod(F.xxhash64("doc_id"), F.lit(slices))
        local = Window.partitionBy("query_id", part).orderBy(*order)
        scored = scored.withColumn("rank", F.row_number().over(local)).where(F.col("rank") <= k).drop("rank")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k_single(scored: DataFrame, k: int = TOP_K) -> DataFrame:
    """Best ``k`` of one query (a bounded heap per task, merged once)."""
    best = scored.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "doc_id").limit(k)
    # k rows at most, all of one query.
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
