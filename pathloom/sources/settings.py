"""Settings and build state as an append-only log of key / value rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.joins import lookup_join
from ..schemas import KV_LOG
from .storage import list_names

# Default settings and the state a reset writes. Folder-dependent
# settings are arguments of ``default_settings``.
SYSTEM_EXCLUDES = ("/System", "/bin", "/dev", "/sbin", "/lib", "/private", "/.VolumeIcon.icns")
RESET_STATE = (
    ("indexed", "false"),
    ("refresh", "false"),
    ("indexed_files", "0"),
    ("indexed_progress", "0.0"),
)
MARKER_KEY = "config_file"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(KV_LOG).parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Append ``(key, value, version, ord)`` rows; a Spark write commits all of them or none."""
    rows.select(*[F.col(f.name).cast(f.dataType) for f in KV_LOG]).write.mode("append").parquet(path)


def next_version(spark: SparkSession, path: str) -> int:
    """One above the newest version in the log, 0 for a log that is not there yet.

    All writers of build state take their version here, so the last one to write counts.
    """
    if not list_names(spark, path):
        return 0
    newest = read_log(spark, path).agg(F.max("version")).first()[0]
    return 0 if newest is None else newest + 1


def pairs(spark: SparkSession, values: list[tuple[str, str]], version: int) -> DataFrame:
    """Log rows of one batch; the ordinal lets the last duplicate key win."""
    return spark.createDataFrame([(k, v, version, i) for i, (k, v) in enumerate(values)], KV_LOG)


def pair_column(values: list[tuple[str, str]]) -> Column:
    """The same pairs as a literal array, to be exploded next to other columns."""
    return F.array(*[
        F.struct(F.lit(k).alias("key"), F.lit(v).alias("value"), F.lit(i).cast("long").alias("ord"))
        for i, (k, v) in enumerate(values)
    ])


def latest(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Current value per key: highest version, then highest ordinal.

    ``by`` names further key columns, such as the index a state belongs to.
    """
    newest = F.struct("version", "ord") if "ord" in log.columns else F.col("version")
    return log.groupBy(*(by or []), "key").agg(F.max_by("value", newest).alias("value"))


def lookup_settings(current: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found rows, missing keys); a missing key is an error to the caller."""
    return (
        lookup_join(current, wanted, "key", "left_semi"),
        lookup_join(wanted.select("key").distinct(), current, "key", "left_anti"),
    )


def list_settings(log: DataFrame) -> DataFrame:
    return latest(log).orderBy("key")


def default_settings(
    home_dir: str, config_file: str, index_dir: str, version: str, now: int, excludes: list[str] | None = None
) -> list[tuple[str, str]]:
    """All settings a new installation starts with."""
    import json

    # Keys and defaults.
    return [
        ("home_dir", home_dir),
        ("config_file", config_file),
        ("index_path", index_dir),
        ("indexed", "false"),
        ("last_indexed", str(now)),
        ("refresh", "false"),
        ("default_include_path", "/"),
        ("indexed_files", "0"),
        ("indexed_progress", "0.0"),
        ("version", version),
        ("default_exclude_path", json.dumps([*SYSTEM_EXCLUDES, *(excludes or [])])),
    ]


def defaults_for(
    log: DataFrame, defaults: list[tuple[str, str]], scopes: DataFrame, by: list[str], marker: str = MARKER_KEY
) -> DataFrame:
    """Default rows for every scope whose log lacks the marker key; others get nothing."""
    marked = log.where(F.col("key") == marker).select(*by).distinct()
    fresh = lookup_join(scopes.select(*by).distinct(), marked, by, "left_anti")
    return fresh.select(*by, F.inline(pair_column(defaults)))


def reset_rows(states: DataFrame, by: list[str]) -> DataFrame:
    """The four state rows a reset writes, for each given index."""
    return states.select(*by, F.inline(pair_column(list(RESET_STATE))))


def index_staleness(states: DataFrame, now: int, version: str, max_age: int = 15 * 24 * 60 * 60) -> DataFrame:
    """Adds ``stale`` and ``reason`` to one row per index.

    Checked in order: no usable time stamp, older than 15 days, version differs,
    refresh requested, not indexed. Times in the future count as fresh.
    """
    last = F.expr("try_cast(last_indexed AS bigint)")
    reason = (
        F.when(last.isNull(), F.lit("missing"))
        .when(F.lit(now) - last > max_age, F.lit("age"))
        .when(~F.col("version").eqNullSafe(F.lit(version)), F.lit("version"))
        .when(F.col("refresh") == "true", F.lit("refresh"))
        .when(F.col("indexed") == "false", F.lit("not indexed"))
    )
    return states.withColumn("reason", reason).withColumn("stale", F.col("reason").isNotNull())


def state_rows(log: DataFrame, by: list[str]) -> DataFrame:
    """One row per index with the four state keys as columns."""
    keys = ["last_indexed", "version", "refresh", "indexed"]
    wanted = log.where(F.col("key").isin(keys))
    current = latest(wanted, by)
    return current.groupBy(*by).pivot("key", keys).agg(F.first("value"))
