"""Answering a stream of query texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..schemas import QUERIES


def read_queries(spark: SparkSession, path: str, fmt: str = "json", **options: str) -> DataFrame:
    return spark.readStream.schema(QUERIES).options(**options).format(fmt).load(path)


def answer_stream(
    queries: DataFrame,
    answer: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    name: str = "requests",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write ``answer(queries)`` of every micro-batch; rows carry their ``query_id``.

    ``answer`` is called per batch, so it may open the newest index generation. Each
    batch has its own folder, which a repeated batch overwrites.
    """

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        queries.writeStream.queryName(name)
        .foreachBatch(run_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
