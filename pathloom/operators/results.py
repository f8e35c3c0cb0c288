"""From ranked hits to the result page: stored path, metadata, order, columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from ..functions.paths import derive_class, derive_name, mtime_date, size_double
from ..schemas import RESULT_COLUMNS, SORTABLE_COLUMNS
from .joins import lookup_join


def fetch_stored(hits: DataFrame, docs: DataFrame, small: bool | None = None) -> DataFrame:
    """Adds the stored path to hits, after the top-k has cut them down."""
    return lookup_join(docs.select("doc_id", "path"), hits, "doc_id", small=small)


def read_metadata(paths: DataFrame, files: DataFrame, small: bool | None = None) -> DataFrame:
    """``(path, is_dir, size, mtime)`` of the wanted paths that exist, one row per path.

    The catalogue is only filtered by the wanted paths, never moved for them. Of several
    entries of a path (a merged catalogue, or one that was crawled twice) the newest counts.
    """
    found = lookup_join(files.select("path", "is_dir", "size", "mtime"), paths, "path", "left_semi", small=small)
    newest = found.groupBy("path").agg(F.max(F.struct("mtime", "size", "is_dir")).alias("entry"))
    return newest.select("path", "entry.is_dir", "entry.size", "entry.mtime")


def enrich(hits: DataFrame, files: DataFrame, as_of: dt.date, small: bool | None = None) -> DataFrame:
    """Adds name, class, size and date. A path without metadata gets size 0 and ``as_of``.

    ``small`` says that the distinct paths of ``hits`` are known to fit a broadcast; what is found
    has at most one row for each, of a few numbers, so it fits as well.
    """
    found = read_metadata(hits, files, small)
    named = lookup_join(hits, found, "path", "left", spread=F.xxhash64("doc_id"), small=small).withColumn(
        "name", derive_name("path")
    )
    return (
        named.withColumn("class", derive_class("name", "is_dir"))
        .withColumn("last_modified_date", mtime_date("mtime", as_of))
        .withColumn("size", size_double("size"))
        .drop("is_dir", "mtime")
    )


def project_result(rows: DataFrame, columns: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The page columns in their fixed or a chosen order."""
    columns = list(columns or RESULT_COLUMNS)
    unknown = set(columns) - set(RESULT_COLUMNS)
    if unknown:
        raise ValueError(f"unknown result columns: {sorted(unknown)}")
    return rows.select(*keep, *columns)


def move_column(columns: list[str], start: int, to: int) -> list[str]:
    """Column order after dragging one column to another place."""
    moved = list(columns)
    moved.insert(to, moved.pop(start))
    return moved


def sort_keys(column: str, direction: str = "default") -> list:
    """Sort keys of the result page.

    Only size and date sort; other columns leave the relevance order. ``default``
    means ascending. Relevance rank breaks ties, which makes the sort stable.
    """
    if column not in SORTABLE_COLUMNS:
        return [F.asc("rank")]
    key = F.desc(column) if direction == "descending" else F.asc(column)
    return [key, F.asc("rank")]


def sort_results(rows: DataFrame, column: str, direction: str = "default") -> DataFrame:
    return rows.orderBy(*sort_keys(column, direction))
