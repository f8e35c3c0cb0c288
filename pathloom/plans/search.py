"""A whole search: text to clauses, matching, ranking, stored path, metadata, page."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.values import normalize_query
from ..operators.joins import fits_broadcast, lookup_join, restrict_scan
from ..operators.ranking import (
    TOP_K, IndexView, any_term_scores, best_hits, bool_scores, clause_hits, clause_terms, query_terms, top_k,
    top_k_single, word_clauses,
)
from ..operators.results import enrich, fetch_stored, project_result
from ..session import cut_lineage


def search_hits(view: IndexView, q: str, tokenizer: str = "mixed", k: int = TOP_K) -> DataFrame:
    """``(query_id, doc_id, score, rank)`` of one query text."""
    asked = query_terms(view.docs.sparkSession, q, tokenizer)
    return top_k_single(any_term_scores(view, clause_hits(view, asked), max(asked.clauses, 1)), k)


def search(
    view: IndexView, files: DataFrame, q: str, as_of: dt.date, tokenizer: str = "mixed", k: int = TOP_K
) -> DataFrame:
    """The result page of one query, with its ``rank``."""
    hits = search_hits(view, q, tokenizer, k)
    if k <= PAGE_ROWS:
        # A page of bounded size: its rows, then its paths, become literals of the next scan, and nothing is written.
        hits = _literal(hits)
        stored = _literal(fetch_stored(hits, _equal_to(view.docs, "doc_id", hits), small=True))
        known = _equal_to(files, "path", stored)
        return project_result(enrich(stored, known, as_of, small=True), keep=("rank",))
    # Each frame is counted before it is broadcast, as ``k`` is the caller's.
    hits = cut_lineage(hits)
    docs = restrict_scan(view.docs, "doc_id", hits)
    stored = cut_lineage(fetch_stored(hits, docs, small=fits_broadcast(hits)))
    known = restrict_scan(files, "path", stored)
    return project_result(enrich(stored, known, as_of, small=fits_broadcast(stored)), keep=("rank",))


#: Rows of a page that pass through the driver, as the page of one request does anyway.
PAGE_ROWS = 128


def _literal(page: DataFrame) -> DataFrame:
    """The rows of a bounded page as a literal frame."""
    return page.sparkSession.createDataFrame(page.toArrow())


def _equal_to(df: DataFrame, key: str, page: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key is on the page, by equalities that the scan can use."""
    values = sorted({r[0] for r in page.select(key).collect()} - {None})
    if not values:
        return df.where(F.lit(False))
    return df.where(reduce(lambda a, b: a | b, [F.col(key) == v for v in values]))


def clause_search(view: IndexView, clauses: DataFrame, tokenizer: str = "mixed", k: int = TOP_K) -> DataFrame:
    """Best hits for structured clauses ``(query_id, clause, occur, text)``."""
    terms = clause_terms(clauses, tokenizer)
    return top_k(bool_scores(view, cut_lineage(terms)), k)


def batch_hits(view: IndexView, queries: DataFrame, tokenizer: str = "mixed", k: int = TOP_K) -> DataFrame:
    """``(query_id, doc_id, score, rank)`` for many queries.

    Requests with the same text are answered once and the answer is handed to each of
    them, however many there are.
    """
    trimmed = queries.select("query_id", normalize_query("q").alias("q")).where("q != ''")
    asked = trimmed.groupBy("q").agg(F.min("query_id").alias("asked_id"))
    distinct = asked.select(F.col("asked_id").alias("query_id"), "q")
    # Used for sizing, pruning and matching; written once instead of tokenized each time.
    terms = cut_lineage(clause_terms(word_clauses(distinct), tokenizer, optional=True))
    best = cut_lineage(best_hits(view, terms, k))
    # A text may be asked by a third of all requests; its answer is k rows at most. So the
    # requests are the side that is spread, and the answers the side that is looked up.
    owners = lookup_join(trimmed, asked, "q", spread=F.xxhash64("query_id")).select("query_id", "asked_id")
    answers = best.withColumnRenamed("query_id", "asked_id")
    return lookup_join(owners, answers, "asked_id", spread=F.xxhash64("query_id")).select(
        "query_id", "doc_id", "score", "rank"
    )


def search_batch(
    view: IndexView, files: DataFrame, queries: DataFrame, as_of: dt.date, tokenizer: str = "mixed", k: int = TOP_K
) -> DataFrame:
    """Result pages of many queries, keyed by ``query_id``."""
    hits = cut_lineage(batch_hits(view, queries, tokenizer, k))
    stored = cut_lineage(fetch_stored(hits, view.docs, small=fits_broadcast(hits)))
    return project_result(enrich(stored, files, as_of, small=fits_broadcast(stored)), keep=("query_id", "rank"))
