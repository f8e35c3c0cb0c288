"""Routing file events and reducing an ordered add / delete log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .filters import exclude_prefix
from .joins import fits_broadcast, lookup_join
from .numbering import range_of

# Changes of one path are gathered per range of this many sequence numbers.
CHUNK = 1 << 16


def explode_events(events: DataFrame) -> DataFrame:
    """One row per affected path: ``(seq, op, pos, path, exists_after)``."""
    return events.select(
        "seq", "op",
        F.posexplode("paths").alias("pos", "path"),
        "exists_after",
    ).withColumn("exists_after", F.get("exists_after", F.col("pos")))


def action_of(op: Column | str = "op", exists_after: Column | str = "exists_after") -> Column:
    """``add`` / ``delete``, NULL for events that change nothing.

    A rename is an add where the path is there afterwards, else a delete.
    """
    op = F.col(op) if isinstance(op, str) else op
    exists = F.col(exists_after) if isinstance(exists_after, str) else exists_after
    return (
        F.when(op == "create", F.lit("add"))
        .when((op == "rename") & F.coalesce(exists, F.lit(False)), F.lit("add"))
        .when(op == "rename", F.lit("delete"))
        .when(op == "remove", F.lit("delete"))
    )


def resolve_rename(changes: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Fills a missing ``exists_after`` of renames from a catalogue snapshot."""
    if files is None:
        return changes
    # Only renames without the flag look at the catalogue, each path once.
    open_paths = changes.where("op = 'rename' AND exists_after IS NULL").select("path").distinct()
    small = fits_broadcast(open_paths)
    present = lookup_join(files.select("path"), open_paths, "path", "left_semi", small=small).distinct()
    known = present.withColumn("_present", F.lit(True))
    return (
        lookup_join(changes, known, "path", "left", spread=F.xxhash64("seq", "pos"), small=small)
        .withColumn("exists_after", F.coalesce("exists_after", "_present", F.lit(False)))
        .drop("_present")
    )


def route_events(
    events: DataFrame, excludes: list[str] | DataFrame = (), files: DataFrame | None = None
) -> DataFrame:
    """``(seq, pos, path, action)`` of the events that reach the index."""
    changes = explode_events(events).where(F.col("op").isin("create", "rename", "remove"))
    if isinstance(excludes, DataFrame) or excludes:
        changes = exclude_prefix(changes, excludes if isinstance(excludes, DataFrame) else list(excludes))
    changes = resolve_rename(changes, files)
    return changes.select("seq", "pos", "path", action_of().alias("action"))


def net_changes(actions: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(path, chunk, last_del, copies)``: what an ordered log does to each path.

    ``last_del`` is the last delete of the path (NULL without one), ``copies`` the adds of
    one sequence range that come after it; sums over ``chunk`` give the copies of a path.

    The log is read and shuffled once, by (path, range). A path may own a third of the
    log, yet a group holds at most the events of one range, and only one row per range
    goes on to the second step, where ranges before the last delete are cleared.
    """
    is_del = F.col("action") == "delete"
    ranges = (
        actions.where("action IS NOT NULL")
        .groupBy("path", range_of("seq", chunk).alias("chunk"))
        .agg(
            F.max(F.when(is_del, F.col("seq"))).alias("del"),
            F.collect_list(F.when(~is_del, F.col("seq"))).alias("adds"),
        )
        .select(
            "path", "chunk", "del",
            F.size(F.filter("adds", lambda s: F.col("del").isNull() | (s > F.col("del")))).cast("long").alias("n"),
        )
    )
    of_path = Window.partitionBy("path")
    known = ranges.withColumn("last_del", F.max("del").over(of_path))
    cleared = F.coalesce(F.col("chunk") < range_of("last_del", chunk), F.lit(False))
    return known.select(
        "path", "chunk", "last_del", F.when(cleared, F.lit(0)).otherwise(F.col("n")).alias("copies")
    )


def batch_summary(actions: DataFrame) -> DataFrame:
    """``(path, last_del, adds_after)``, all a batch does to a path."""
    return net_changes(actions).groupBy("path").agg(
        F.max("last_del").alias("last_del"), F.sum("copies").alias("adds_after")
    )


def replay_log(actions: DataFrame) -> DataFrame:
    """``(path, copies)`` left by a whole ordered log."""
    left = batch_summary(actions).select("path", F.col("adds_after").alias("copies"))
    return left.where("copies > 0")


def combine_summaries(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """Summary of two consecutive batches; associative, so batches may be pre-combined."""
    e, l = earlier.alias("e"), later.alias("l")
    return e.join(l, "path", "full_outer").select(
        "path",
        F.coalesce("l.last_del", "e.last_del").alias("last_del"),
        (
            F.coalesce("l.adds_after", F.lit(0))
            + F.when(F.col("l.last_del").isNull(), F.coalesce("e.adds_after", F.lit(0))).otherwise(0)
        ).alias("adds_after"),
    )


def merge_batch(state: DataFrame, summary: DataFrame) -> DataFrame:
    """``(path, copies)`` after applying one batch to committed state; empty paths drop out."""
    s, b = state.alias("s"), summary.alias("b")
    copies = F.coalesce("b.adds_after", F.lit(0)) + F.when(
        F.col("b.last_del").isNull(), F.coalesce("s.copies", F.lit(0))
    ).otherwise(0)
    merged = s.join(b, "path", "full_outer").select("path", copies.cast("long").alias("copies"))
    return merged.where("copies > 0")


# ---------------------------------------------------------------- plain frames


def apply_adds(docs: DataFrame, new_docs: DataFrame) -> DataFrame:
    """Adds never replace: a path that is there already gets another copy."""
    return docs.unionByName(new_docs)


def apply_deletes(docs: DataFrame, paths: DataFrame) -> DataFrame:
    """Drops every document with exactly one of these paths, not their descendants."""
    return lookup_join(docs, paths, "path", "left_anti")


def num_docs(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("num_docs"))


def path_copies(docs: DataFrame) -> DataFrame:
    return docs.groupBy("path").agg(F.count("*").alias("copies"))


def list_docs(docs: DataFrame, raw: str = "path") -> DataFrame:
    """Every live document; a path that is not valid UTF-8 shows a placeholder."""
    text = F.try_validate_utf8(F.col(raw).cast("string"))
    return docs.select("doc_id", F.coalesce(text, F.lit("Invalid UTF-8")).alias("path"))
