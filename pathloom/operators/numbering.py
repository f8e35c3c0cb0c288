"""Global row numbers without one global sort, and what is counted with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

PROGRESS_MARK = 20_000
COMMIT_BATCH = 1_000


def range_of(key: str, width: int) -> Column:
    """Number of the key range of ``width`` values; exact for every ``bigint``, also negative."""
    return F.expr(f"(`{key}` - pmod(`{key}`, {width}L)) div {width}L")


def _in_order(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` sorted over all tasks, with ``_part`` and ``_place``, its place within the part.

    Spark cuts the parts by sampled bounds on all keys, so neither sparse keys nor one that
    holds a third of the rows make a large part, as long as later keys tell its rows apart.
    The sorted rows are written once: what follows reads those, whatever a repeated sample
    would say.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id()
    written = cut_lineage(rows.withColumn("_id", place))
    return written.select(*df.columns, F.expr("shiftright(_id, 33)").alias("_part"), F.expr("_id & 8589934591L").alias("_place"))


def _before(parts: DataFrame, *sums: str) -> DataFrame:
    """Sums over the parts before each part; there is one row per task of the sort."""
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("_part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in sums])


def number_rows(df: DataFrame, key: str, tie: list[str] | None = None) -> DataFrame:
    """Adds ``n`` = 1, 2, ... in the order of a key (then ``tie``).

    Rows are sorted over all tasks and shifted by the row counts of earlier parts; no task
    has more than its part, and one row per part meets in one.
    """
    rows = _in_order(df, key, *(tie or []))
    starts = _before(rows.groupBy("_part").agg(F.count("*").alias("_rows")), "_rows")
    numbered = rows.join(F.broadcast(starts), "_part")
    return numbered.select(*df.columns, (F.col("_rows_before") + F.col("_place") + 1).cast("long").alias("n"))


def progress_marks(entries: DataFrame, key: str, tie: list[str] | None = None, every: int = PROGRESS_MARK) -> DataFrame:
    """Every ``every``-th entry of a build, errors included."""
    return number_rows(entries, key, tie).where(F.col("n") % every == 0)


def commit_batches(changes: DataFrame, key: str, tie: list[str] | None = None, size: int = COMMIT_BATCH) -> DataFrame:
    """Adds ``batch``: changes fall into commits of ``size`` in feed order."""
    numbered = number_rows(changes, key, tie)
    return numbered.withColumn("batch", F.expr(f"(n - 1) div {size}L"))


def crawl_count(files: DataFrame, root: str = "root") -> DataFrame:
    """Entries and errors seen per root, with the running total over roots."""
    per_root = files.groupBy(root).agg(
        F.count("*").alias("entries"), F.count_if(F.col("error").isNotNull()).alias("errors")
    )
    rows = _in_order(per_root, root)
    starts = _before(rows.groupBy("_part").agg(F.sum("entries").alias("_sum")), "_sum")
    so_far = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn("_own", F.sum("entries").over(so_far)).join(F.broadcast(starts), "_part")
    return summed.select(*per_root.columns, (F.col("_own") + F.col("_sum_before")).cast("long").alias("total"))


def progress(roots: DataFrame, root: str = "root") -> DataFrame:
    """Percent of roots done after each root, in root order; no roots, no rows."""
    numbered = number_rows(roots, root)
    total = roots.agg(F.count("*").alias("_total"))
    return numbered.join(F.broadcast(total)).select(*roots.columns, (F.col("n") / F.col("_total") * 100.0).alias("percent"))
