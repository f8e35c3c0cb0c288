"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pathloom.session import work_dir

#: A-Z to a-z, all other bytes unchanged.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, safe from lost executors.

    Its shuffle files are not needed after that, so Spark is told to remove them with the
    write; else they would stay until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = work_dir(spark, f"llm-{label}")
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, after as many underscores as it takes to be no column of ``df`` in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def give_back() -> None:
    """Return this process's freed memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, after which the worker gives its freed memory back.

    Python workers stay for later tasks, several beside one JVM, and would keep what their
    largest task took.
    """

    @wraps(run)
    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(frames: Iterator[pd.DataFrame], text: str, most: int = 4 << 20) -> Iterator[pd.DataFrame]:
    """The same rows in pieces of about ``most`` characters of ``text``, at least one row each.

    A batch of very long texts then needs no more scratch memory than one of short texts.
    """
    for frame in frames:
        sizes = frame[text].str.len().fillna(0).to_numpy(np.int64)
        piece = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1), len(frame)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield frame.iloc[a:b]


def by_key(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Rows sorted by ``key`` in pieces that hold whole keys only, carried across batches.

    The piece of one key is as large as that key, so keys must be small or bounded.
    """
    rest: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        keys = frame[key].to_numpy()
        if rest and keys[-1] == rest[0][key].iloc[-1]:
            rest.append(frame)
            continue
        start = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        whole = pd.concat([*rest, frame.iloc[:start]], ignore_index=True)
        if len(whole):
            yield whole
        rest = [frame.iloc[start:]]
    if rest:
        yield pd.concat(rest, ignore_index=True)
