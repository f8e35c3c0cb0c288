"""Headline timings: ``BENCH_SF_DIR`` tables on ``local[BENCH_CPUS]``, one JSON line.

``index_build`` builds and commits the stored index of the whole ``documents`` table;
the searches read that index.
"""

from __future__ import annotations

import json
import os
import sys
import time

from registry import catalog_queries, change_queries, search_queries  # noqa: F401
from registry.tables import QUERIES, index_of
from pathloom.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "build_postings doc_frequency term_query any_term_query rank_bm25 top_k phrase_query bool_query search_batch "
    "search crawl_entries exclude_prefix checkpoints commit_batches replay_log merge_batch kv_latest index_staleness "
    "stream_apply"
).split()


def run(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session("bench", CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    run(spark.read.parquet(f"{SF_DIR}/nation.parquet"))  # start the executors
    only = sys.argv[1:]
    timings: dict[str, float] = {}

    def timed(name, action) -> None:
        started = time.perf_counter()
        action()
        timings[name] = round(time.perf_counter() - started, 3)

    if not only or "index_build" in only:
        timed("index_build", lambda: index_of(spark, SF_DIR, "corpus"))
    index_of(spark, SF_DIR, "corpus")
    index_of(spark, SF_DIR, "docs")
    for name in only or HEADLINE:
        if name != "index_build":
            timed(name, lambda: run(QUERIES[name](spark, SF_DIR)))
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    total = round(sum(timings.values()), 3)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": timings, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
