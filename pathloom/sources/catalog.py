"""The file catalogue: manifest scan, live crawl, roots."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.paths import derive_name, parent
from ..operators.filters import starts_with_any
from ..schemas import FILES
from ..session import work_dir

LISTING_BATCH = 10_000


def scan_files(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A catalogue stored as a manifest; directories, hidden names and error rows included."""
    return spark.read.schema(FILES).format(fmt).load(path)


def split_errors(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable entries, error rows). The root has no name and cannot be indexed."""
    bad = F.col("error").isNotNull() | (derive_name("path") == "")
    reason = F.coalesce("error", F.lit("no name"))
    return files.where(~bad).drop("error"), files.where(bad).withColumn("error", reason)


def list_roots(files: DataFrame, root: str = "/") -> DataFrame:
    """Immediate children of a directory; no rows where it is absent."""
    return files.where(parent("path") == root.rstrip("/") if root != "/" else parent("path") == "/").select("path")


def _stat_row(path: str) -> tuple:
    try:
        info = os.lstat(path)
        is_dir = os.path.isdir(path) and not os.path.islink(path)
        return (path, is_dir, info.st_size, pd.Timestamp(int(info.st_mtime), unit="s"), None)
    except OSError as error:
        return (path, None, None, None, f"{type(error).__name__}: {error.strerror}")


def _children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Directory paths in, rows of their entries out, in bounded batches."""
    columns = FILES.names

    def rows(directory: str) -> Iterator[tuple]:
        try:
            with os.scandir(directory) as entries:
                for entry in entries:
                    yield _stat_row(entry.path)
        except OSError as error:
            yield (directory, None, None, None, f"{type(error).__name__}: {error.strerror}")

    held: list[tuple] = []
    for batch in batches:
        for directory in batch["path"]:
            for row in rows(directory):
                held.append(row)
                if len(held) >= LISTING_BATCH:
                    yield pd.DataFrame(held, columns=columns)
                    held = []
    if held:
        yield pd.DataFrame(held, columns=columns)


def crawl(spark: SparkSession, root: str, excludes: list[str] | None = None) -> DataFrame:
    """List a live tree that every executor can see, root included.

    Works level by level: the directories of one level are spread over the tasks, each
    task lists its share, and each level is written before the next one starts, so a
    lost executor never repeats finished levels. Excluded entries are reported but not
    entered. The loop is as long as the tree is deep.
    """
    out = work_dir(spark, "crawl")
    top = spark.createDataFrame(pd.DataFrame([_stat_row(root)], columns=FILES.names), FILES)
    top.write.parquet(f"{out}/depth=0")
    depth = 0
    while True:
        level = spark.read.schema(FILES).parquet(f"{out}/depth={depth}")
        enter = F.col("is_dir") & F.col("error").isNull()
        if excludes and depth > 0:
            enter = enter & ~starts_with_any("path", excludes)
        frontier = level.where(enter).select("path")
        if frontier.isEmpty():
            break
        depth += 1
        spread = frontier.repartition(spark.sparkContext.defaultParallelism, "path")
        spread.mapInPandas(_children, FILES).write.parquet(f"{out}/depth={depth}")
    levels = [f"{out}/depth={d}" for d in range(depth + 1)]
    return spark.read.schema(FILES).parquet(*levels)
