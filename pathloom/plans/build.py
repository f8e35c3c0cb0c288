"""Building the index from a catalogue, gated by its recorded state."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.paths import root_of
from ..functions.values import parse_prefix_list
from ..operators.filters import partition_roots, prune_subtrees, remaining_excludes
from ..operators.joins import lookup_join
from ..session import cut_lineage
from ..sources.catalog import list_roots, split_errors
from ..sources.index_table import IndexTable
from ..sources.settings import RESET_STATE, append_log, index_staleness, latest, next_version, pairs, read_log


def plan_roots(files: DataFrame, excludes: DataFrame, root: str = "/") -> tuple[DataFrame, DataFrame]:
    """(roots to crawl, excludes still to apply inside them).

    Both are a few rows that later steps use repeatedly, so they are written once.
    """
    excluded, remaining = partition_roots(list_roots(files, root), excludes)
    return cut_lineage(remaining), cut_lineage(remaining_excludes(excludes, excluded))


def crawl_entries(
    files: DataFrame, roots: DataFrame, excludes: DataFrame | list[str], root: str = "/"
) -> DataFrame:
    """Catalogue rows of all roots that a crawl with these excludes reports, with their ``root``.

    ``root`` is the crawl root whose children the roots are.
    """
    below = files.withColumn("root", root_of("path", root))
    listed = lookup_join(below, roots.select(F.col("path").alias("root")), "root", "left_semi")
    return prune_subtrees(listed, F.col("root"), excludes)


def index_files(table: IndexTable, entries: DataFrame, snapshot_seq: int | None = None) -> tuple[IndexTable, DataFrame]:
    """Index all usable entries in one commit; returns the index and the error rows."""
    usable, errors = split_errors(entries)
    return table.commit(adds=usable.select("path"), snapshot_seq=snapshot_seq), errors


def exclude_rows(settings: DataFrame, key: str = "default_exclude_path") -> DataFrame:
    """The exclude list kept as JSON text under one key, as rows."""
    value = settings.where(F.col("key") == key)
    return value.select(F.explode(parse_prefix_list("value")).alias("prefix"))


def index_status(settings: DataFrame, now: int, version: str) -> tuple[bool, str | None]:
    """(stale, reason) of one index, read from its four state keys."""
    keys = ["last_indexed", "version", "refresh", "indexed"]
    state = settings.where(F.col("key").isin(keys)).groupBy().pivot("key", keys).agg(F.first("value"))
    row = index_staleness(state, now, version).select("stale", "reason").first()
    return (row["stale"], row["reason"]) if row else (True, "missing")


def init_index(
    table: IndexTable, files: DataFrame, log_path: str, now: int, version: str, snapshot_seq: int | None = None
) -> IndexTable:
    """Rebuild the index if its state asks for it, and record the outcome.

    Roots are not crawled one after the other: all of them are one job, so progress
    goes from the reset value to 100. ``indexed_files`` counts documents, ``entries`` what the
    crawl saw and ``errors`` those of it that could not be indexed.
    """
    spark = table.spark
    settings = latest(read_log(spark, log_path))
    stale, reason = index_status(settings, now, version)
    if not stale:
        return table
    reset = list(RESET_STATE)
    if reason == "version":
        reset = [("version", version), *reset]
    append_log(pairs(spark, reset, version=next_version(spark, log_path)), log_path)
    roots, excludes = plan_roots(files, exclude_rows(settings))
    built, errors = index_files(table.reset(), crawl_entries(files, roots, excludes), snapshot_seq)
    n_errors = errors.count()
    outcome = [
        ("indexed", "true"),
        ("last_indexed", str(now)),
        ("indexed_files", str(built.num_docs())),
        ("entries", str(built.num_docs() + n_errors)),
        ("errors", str(n_errors)),
    ]
    if not roots.isEmpty():
        outcome.append(("indexed_progress", "100"))
    append_log(pairs(spark, outcome, version=next_version(spark, log_path)), log_path)
    return built
