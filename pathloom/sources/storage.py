"""Small files on whatever file system the cluster uses (HDFS, object store, local)."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """File names directly below a folder; empty when it does not exist."""
    _, target, fs = _fs(spark, folder)
    if not fs.exists(target):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(target))


def read_text(spark: SparkSession, path: str) -> str:
    jvm, target, fs = _fs(spark, path)
    stream = fs.open(target)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a new small file that readers see whole or not at all.

    Fails if the file exists, which is how a second writer is noticed. Each writer has a draft
    of its own.
    """
    _, final, fs = _fs(spark, path)
    _, draft, _ = _fs(spark, f"{path}.{uuid.uuid4().hex}.draft")
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    if fs.exists(final) or not fs.rename(draft, final):
        raise FileExistsError(f"{path} was published by another writer")
