"""Reading the change feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..schemas import FS_EVENTS

BAD = "_corrupt_record"
FS_EVENTS_CHECKED = T.StructType([*FS_EVENTS.fields, T.StructField(BAD, T.StringType(), True)])


def read_events(spark: SparkSession, path: str, fmt: str = "json", **options: str) -> DataFrame:
    """The feed as a stream. Malformed JSON lines are kept aside, not fatal.

    Any other Structured Streaming source with these columns can take its place.
    """
    reader = spark.readStream.options(**options)
    if fmt == "json":
        reader = reader.schema(FS_EVENTS_CHECKED).option("mode", "PERMISSIVE").option(
            "columnNameOfCorruptRecord", BAD
        )
        return reader.json(path)
    return reader.schema(FS_EVENTS).format(fmt).load(path)


def distinct_events(events: DataFrame, within: str, key: list[str] | None = None) -> DataFrame:
    """The stream without events that come again within ``within`` (event time, such as ``10 minutes``).

    Events are the same if they agree in ``key``: by default in all columns but ``ts``, so an event that its source
    delivers twice counts once; ``["op", "paths"]`` also takes reports of one change under several
    numbers for one. Keys are kept until the watermark, the latest ``ts`` less ``within``, has passed
    them, so the state is as large as the events of that time; events that are older than the watermark are dropped.
    Lines that could not be read have no ``ts``; they differ by their text.
    """
    key = key or [c for c in events.columns if c != "ts"]
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(key)


def unknown_renames() -> Column:
    """Renames that do not say of each path whether it exists afterwards."""
    unknown = F.exists(F.sequence(F.lit(0), F.size("paths") - 1), lambda i: F.get("exists_after", i).isNull())
    return (F.col("op") == "rename") & (F.size("paths") > 0) & F.coalesce(unknown, F.lit(True))


def split_bad_events(events: DataFrame, also: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(good events, bad events with the raw line).

    An event without sequence number, kind or paths cannot be applied and is bad too, and so
    are those for which ``also`` holds.
    """
    raw = F.col(BAD) if BAD in events.columns else F.lit(None).cast("string")
    complete = F.col("seq").isNotNull() & F.col("op").isNotNull() & F.col("paths").isNotNull()
    good = raw.isNull() & complete
    if also is not None:
        good = good & ~F.coalesce(also, F.lit(False))
    bad = events.where(~good).select("seq", F.coalesce(raw, F.to_json(F.struct("seq", "op", "paths"))).alias("raw"))
    return events.where(good).drop(BAD), bad
