"""Keeping the index current from the change feed."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import net_changes, route_events
from ..session import cut_lineage
from ..sources.events import distinct_events, split_bad_events, unknown_renames
from ..sources.index_table import IndexTable
from ..sources.settings import append_log, next_version, pairs
from ..sources.storage import read_text

MERGE_AFTER = 8


def apply_actions(
    table: IndexTable, actions: DataFrame, stream: tuple[str, int] | None = None, feed: str | None = None
) -> IndexTable:
    """Commit the net effect of one batch of routed events ``(seq, path, action)``."""
    # Far fewer rows than the batch on a busy path; read for the adds and the deletes.
    changes = cut_lineage(net_changes(actions))
    deletes = changes.where("last_del IS NOT NULL").select("path").distinct()
    # One document per surviving add; a row here stands for at most one sequence range.
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    adds = changes.where("copies > 0").select("path", copies).select("path")
    return table.commit(
        adds=None if adds.isEmpty() else adds,
        deletes=None if deletes.isEmpty() else deletes,
        stream=stream,
        feed=feed,
    )


def within(path: str, include: str) -> F.Column:
    """Whether a path is the folder ``include`` or below it."""
    folder = include.rstrip("/")
    return (F.col(path) == folder) | F.col(path).startswith(f"{folder}/")


def follow(
    events: DataFrame,
    index_root: str,
    checkpoint: str,
    bad_path: str,
    excludes: list[str] | DataFrame = (),
    files: DataFrame | None = None,
    log_path: str | None = None,
    include: str = "/",
    name: str = "feed",
    trigger: dict | None = None,
    merge_after: int | None = MERGE_AFTER,
    distinct_within: str | None = None,
) -> StreamingQuery:
    """Apply a feed to the index, one commit per micro-batch.

    The size of a commit is the source's business (``maxFilesPerTrigger``,
    ``maxOffsetsPerTrigger``). Changes outside ``include`` are left out. Events that the bulk
    build already covers (sequence up to the index's ``snapshot_seq``) are skipped, so a
    backlog that queued up during the build is applied once.

    A micro-batch that is repeated after a failure is recognised by the stream's own id, kept
    in its checkpoint, and its number. A new checkpoint is a new stream, whose numbers start
    again, and takes a new ``name``: a name that another stream of this index has used fails.

    After ``merge_after`` commits of about one size, those are folded into one, and so on by
    tiers; ``IndexTable.compact`` folds everything and is for quiet hours. With ``None`` the stream
    does not merge, and ``IndexTable.merge_tail`` is run between its starts.

    ``distinct_within`` drops events that come again within that time (see ``distinct_events``). It is
    off by default: then every event counts, and events may be of any age.

    Bad events go to ``bad_path`` and do not stop the stream. A rename of which neither the
    event nor a catalogue says what exists afterwards is one of them.
    """

    def apply_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        table = IndexTable.open(spark, index_root)
        stream = json.loads(read_text(spark, f"{checkpoint}/metadata"))["id"]
        if table.generation.feeds.get(name, stream) != stream:
            raise ValueError(f"another stream of this index is called {name!r}; a new checkpoint needs a new name")
        if table.generation.streams.get(stream, -1) >= batch_id:
            return
        batch = batch.persist()
        good, bad = split_bad_events(batch, None if files is not None else unknown_renames())
        bad.write.mode("overwrite").json(f"{bad_path}/stream={stream}/batch={batch_id}")
        fresh = good.where(F.col("seq") > table.generation.snapshot_seq)
        actions = route_events(fresh, excludes, files).where(within("path", include))
        table = apply_actions(table, actions, (stream, batch_id), name)
        if log_path:
            count = [("indexed_files", str(table.num_docs()))]
            append_log(pairs(spark, count, version=next_version(spark, log_path)), log_path)
        batch.unpersist()
        if merge_after is not None:
            table.merge_tail(merge_after)

    if distinct_within is not None:
        events = distinct_events(events, distinct_within)
    return (
        events.writeStream.queryName(name)
        .foreachBatch(apply_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
