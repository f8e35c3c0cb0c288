"""The inverted index as Parquet folders, changed one committed generation at a time.

A generation is a list of segment folders named in one small JSON file. A commit writes
a new segment (documents, postings, term counts, ids of documents it removed) and then
publishes the next generation file, so readers see whole commits only and a commit costs
about the size of its batch. ``compact`` folds the segments into one.

Folders:

* ``postings/segment=S/bucket=N/`` sorted by term; ``bucket`` is a hash of the term. A row is a term
  in a block of document ids. A term is in one file, but for frequent ones: they are
  dealt by block, so a term found in a third of all documents is neither written nor read by a
  single task;
* ``terms/segment=S/bucket=N/``: signed document counts, added up over segments, and bounds of weights;
* ``docs/segment=S/`` in id order; ``paths/segment=S/slot=N/`` the same by hash of the path, which
  finds paths without reading other slots, and without the names, which are texts of any length;
  ``dead/segment=S/`` removed documents.
"""

from __future__ import annotations

import itertools
import json
import math
import re
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.paths import derive_name
from ..functions.text import tokenize
from ..operators.joins import lookup_join, restrict_scan
from ..operators.postings import GATHERED, block_rows, gather_blocks, packed_rows, packed_tokens, term_bounds, term_bucket
from ..operators.ranking import IndexView
from ..schemas import BLOCKS, DEAD, DOCS, PATHS, TERMS
from ..session import cut_lineage, drop_shuffles
from .storage import list_names, publish_text, read_text

MAX_ID = 1 << 62
#: Documents per slot of the path table, most slots, bytes a token takes about, documents that show frequent terms.
SLOT_ROWS, MOST_SLOTS, TOKEN_BYTES, SAMPLE_DOCS = 65_536, 16_384, 16, 20_000


@dataclass(frozen=True)
class Generation:
    """What one published index state consists of."""

    number: int = 0
    buckets: int = 64
    tokenizer: str = "mixed"
    docs: list[str] = field(default_factory=list)
    dead: list[str] = field(default_factory=list)
    n_docs: int = 0
    n_tokens: int = 0
    next_id: int = 0
    snapshot_seq: int = -1
    streams: dict[str, int] = field(default_factory=dict)
    feeds: dict[str, str] = field(default_factory=dict)
    tiers: dict[str, int] = field(default_factory=dict)
    slots: dict[str, int] = field(default_factory=dict)


class IndexTable:
    """A snapshot of the index at ``root``; every change returns the next snapshot."""

    def __init__(self, spark: SparkSession, root: str, generation: Generation):
        self.spark, self.root, self.generation = spark, root.rstrip("/"), generation

    # ------------------------------------------------------------ open

    @classmethod
    def create(
        cls, spark: SparkSession, root: str, buckets: int = 64, tokenizer: str = "mixed"
    ) -> IndexTable:
        """An empty index. Size ``buckets`` by the vocabulary."""
        return cls(spark, root, Generation(buckets=buckets, tokenizer=tokenizer))._publish()

    @classmethod
    def open(cls, spark: SparkSession, root: str, number: int | None = None) -> IndexTable:
        """The newest (or a given) committed generation."""
        names = [n for n in list_names(spark, f"{root}/generations") if n.endswith(".json")]
        if not names:
            raise FileNotFoundError(f"no committed index below {root}")
        name = names[-1] if number is None else f"{number:012d}.json"
        return cls(spark, root, Generation(**json.loads(read_text(spark, f"{root}/generations/{name}"))))

    @classmethod
    def open_or_create(cls, spark: SparkSession, root: str, **options) -> IndexTable:
        try:
            return cls.open(spark, root)
        except FileNotFoundError:
            return cls.create(spark, root, **options)

    def _publish(self) -> IndexTable:
        name = f"{self.root}/generations/{self.generation.number:012d}.json"
        publish_text(self.spark, name, json.dumps(asdict(self.generation)))
        return self

    # ------------------------------------------------------------ read

    def _folder(self, kind: str, segment: str) -> str:
        return f"{self.root}/{kind}/segment={segment}"

    def _read(self, schema, kind: str, segments: list[str]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("basePath", f"{self.root}/{kind}")
        return reader.parquet(*[self._folder(kind, s) for s in segments])

    def _alive(self, rows: DataFrame) -> DataFrame:
        """Rows of live documents. Catalyst sizes the removed ids from their files.

        A removal concerns segments older than its own: an id that is added again in the same
        or a later commit is a live document.
        """
        if not self.generation.dead:
            return rows
        dead = self._read(DEAD, "dead", self.generation.dead)
        dead = dead.groupBy(F.col("doc_id").alias("_gone")).agg(F.max("segment").alias("_by"))
        removed = (F.col("doc_id") == F.col("_gone")) & (F.col("segment") < F.col("_by"))
        return rows.join(dead, removed, "left_anti")

    def docs(self) -> DataFrame:
        return self._alive(self._read(DOCS, "docs", self.generation.docs))

    def blocks(self) -> DataFrame:
        """Posting blocks as stored, removed documents included."""
        return self._read(BLOCKS, "postings", self.generation.docs)

    def postings(self) -> DataFrame:
        return self._alive(block_rows(self.blocks()))

    def terms(self) -> DataFrame:
        """Live document frequency per term, and the bounds of its weights (removals do not tighten them)."""
        segments = sorted({*self.generation.docs, *self.generation.dead})
        counts = self._read(TERMS, "terms", segments)
        if len(segments) > 1:
            counts = counts.groupBy("bucket", "term").agg(*summed())
        return counts.where("df > 0").select("term", "df", "max_tf", "min_dl", "bucket")

    def num_docs(self) -> int:
        return self.generation.n_docs

    def view(self) -> IndexView:
        g = self.generation
        mean = g.n_tokens / g.n_docs if g.n_docs else 1.0
        return IndexView(
            docs=self.docs(), postings=self.postings(), terms=self.terms(),
            n_docs=F.lit(g.n_docs), avg_len=F.lit(float(mean)), buckets=g.buckets, blocks=self.blocks(), alive=self._alive,
        )

    # ------------------------------------------------------------ change

    def commit(
        self,
        adds: DataFrame | None = None,
        deletes: DataFrame | None = None,
        snapshot_seq: int | None = None,
        stream: tuple[str, int] | None = None,
        feed: str | None = None,
    ) -> IndexTable:
        """Delete the documents of ``deletes(path)``, then append ``adds``, and publish.

        ``adds`` has ``path`` and may bring its own ``doc_id`` and ``name`` (the indexed
        text, else the last path component). Adds never replace older documents. ``stream``
        is (stream id, batch number): a batch that was committed before is left alone. ``feed`` is
        the name under which that stream is known.
        ``snapshot_seq`` records the last feed event that a bulk build already covers.
        """
        g = self.generation
        if stream and g.streams.get(stream[0], -1) >= stream[1]:
            return self
        segment = f"{g.number + 1:012d}-{uuid.uuid4().hex[:8]}"
        gone = self._write_dead(segment, deletes) if deletes is not None else None
        new = None
        if adds is not None:
            # The ids are fixed by this write; all later steps read it.
            write_docs(self._named(adds), self._folder("docs", segment))
            new = self._read(DOCS, "docs", [segment])
        added, added_tokens, last_id = _totals(new)
        removed, removed_tokens, _ = _totals(gone)

        changed, slots = [], slots_of(added)
        if new is not None:
            write_paths(new.drop("segment"), self._folder("paths", segment), slots)
            frequent = self._frequent(new, added, added_tokens)
            write_postings(packed_tokens(self._cut(new), frequent), self._folder("postings", segment), g.buckets, added_tokens, frequent)
            changed.append(term_bounds(self._read(BLOCKS, "postings", [segment])))
        if gone is not None:
            words = gone.select(F.explode(F.array_distinct(tokenize("name", g.tokenizer))).alias("term"))
            nothing = F.lit(None).cast("int")
            changed.append(words.groupBy("term").agg((-F.count("*")).alias("df"), nothing.alias("max_tf"), nothing.alias("min_dl")))
        if changed:
            write_terms(changed, self._folder("terms", segment), g.buckets)
        return IndexTable(self.spark, self.root, replace(
            g,
            number=g.number + 1,
            docs=[*g.docs, segment] if new is not None else g.docs,
            dead=[*g.dead, segment] if gone is not None else g.dead,
            tiers={**g.tiers, segment: tier_of(added + removed)},
            slots={**g.slots, segment: slots} if new is not None else g.slots,
            n_docs=g.n_docs + added - removed,
            n_tokens=g.n_tokens + added_tokens - removed_tokens,
            next_id=max(g.next_id, last_id + 1),
            snapshot_seq=g.snapshot_seq if snapshot_seq is None else snapshot_seq,
            streams={**g.streams, stream[0]: stream[1]} if stream else g.streams,
            feeds={**g.feeds, feed: stream[0]} if stream and feed else g.feeds,
        ))._publish()

    def _named(self, adds: DataFrame) -> DataFrame:
        """``adds`` with ids, names and lengths."""
        name = F.col("name") if "name" in adds.columns else derive_name("path")
        if "doc_id" in adds.columns:
            doc_id = F.col("doc_id")
        else:
            if self.generation.next_id > MAX_ID:
                raise OverflowError("document ids are used up; rebuild the index")
            # Unique without a global order; fixed by the write of the documents.
            doc_id = F.lit(self.generation.next_id) + F.monotonically_increasing_id()
        rows = adds.select(doc_id.cast("long").alias("doc_id"), "path", name.alias("name"))
        return rows.withColumn("dl", F.size(tokenize("name", self.generation.tokenizer)))

    def _cut(self, docs: DataFrame) -> DataFrame:
        """(doc_id, tokens): cut again from the written names, as tokens take several times their room."""
        return docs.select("doc_id", tokenize("name", self.generation.tokenizer).alias("tokens"))

    def _frequent(self, new: DataFrame, docs: int, tokens: int) -> list[str]:
        """Terms that a part of the postings would not hold, as a sample of about ``SAMPLE_DOCS`` documents shows.

        The list only steers how rows are dealt. A part has so many rows that few terms are on it.
        """
        parts = parts_of(self.spark, tokens)
        if docs <= tokens / parts / 4:
            return []
        share = min(1.0, SAMPLE_DOCS / docs)
        seen = self._cut(new.select("doc_id", "name").sample(share, seed=7) if share < 1 else new)
        counts = seen.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").count()
        least = max(2.0, tokens / parts / 4 * share)
        return [r["term"] for r in counts.where(F.col("count") > least).orderBy(F.desc("count"), "term").limit(4 * parts).collect()]

    def stored_paths(self, paths: DataFrame) -> DataFrame:
        """Stored documents, removed ones included, in the slots of the path table that ``paths`` fall into.

        However many paths there are, the slots are partition filters: of a large segment only those
        are read. There are as many slot numbers as slots at most. ``own`` tells that the name of a document does not
        follow from its path.
        """
        g = self.generation
        out = None
        for slots in sorted(set(g.slots.values())):
            stored = self._read(PATHS, "paths", [s for s in g.docs if g.slots[s] == slots])
            if slots > 1:
                wanted = [r[0] for r in paths.select(slot_of("path", slots)).distinct().collect()]
                stored = stored.where(F.col("slot").isin(wanted))
            out = stored if out is None else out.unionByName(stored)
        return (self._read(PATHS, "paths", []) if out is None else out).drop("slot")

    def _write_dead(self, segment: str, deletes: DataFrame) -> DataFrame:
        paths = cut_lineage(deletes.select("path").distinct())
        found = lookup_join(self._alive(self.stored_paths(paths)), paths, "path", "left_semi", spread=F.xxhash64("doc_id"))
        found = cut_lineage(found.withColumn("own", F.coalesce("own", F.lit(True))))
        dead, key = found.select("doc_id", "path", derive_name("path").alias("name"), "dl"), ["segment", "doc_id", "path"]
        named = found.where("own").select(*key).distinct()
        if not named.isEmpty():
            # All documents of these keys from where their names are, in the place of the rows found.
            rest = lookup_join(found, named, key, "left_anti", spread=F.xxhash64("doc_id"))
            docs = restrict_scan(self._read(DOCS, "docs", self.generation.docs), "doc_id", named)
            docs = lookup_join(docs, named, key, "left_semi", spread=F.xxhash64("doc_id"))
            dead = rest.select("doc_id", "path", derive_name("path").alias("name"), "dl").unionByName(docs.select("doc_id", "path", "name", "dl"))
        dead.write.parquet(self._folder("dead", segment))
        return self._read(DEAD, "dead", [segment])

    def reset(self) -> IndexTable:
        """An empty next generation; older folders are no longer referenced."""
        g = self.generation
        fresh = Generation(number=g.number + 1, buckets=g.buckets, tokenizer=g.tokenizer)
        return IndexTable(self.spark, self.root, fresh)._publish()

    def compact(self) -> IndexTable:
        """The same live documents in a single segment, ids kept."""
        g = self.generation
        if len({*g.docs, *g.dead}) <= 1 or not g.docs:
            return self
        segment = f"{g.number + 1:012d}-{uuid.uuid4().hex[:8]}"
        docs = self.docs().drop("segment")
        write_docs(docs, self._folder("docs", segment))
        write_paths(self._read(DOCS, "docs", [segment]).drop("segment"), self._folder("paths", segment), slots_of(g.n_docs))
        self._write_merged(segment, g.docs, g.n_tokens)
        write_terms([self.terms().drop("bucket")], self._folder("terms", segment), g.buckets)
        return IndexTable(self.spark, self.root, replace(
            g, number=g.number + 1, docs=[segment], dead=[], tiers={segment: tier_of(g.n_docs)}, slots={segment: slots_of(g.n_docs)},
        ))._publish()

    def _write_merged(self, segment: str, older: list[str], tokens: int) -> None:
        """Live postings of older segments as one; their own counts tell the frequent terms."""
        parts = parts_of(self.spark, tokens)
        frequent: list[str] = []
        if parts > 1:
            counts = self._read(TERMS, "terms", older).groupBy("term").agg(F.sum("df").alias("df"))
            wide = counts.where(F.col("df") > tokens / parts / 4).orderBy(F.desc("df"), "term").limit(4 * parts)
            frequent = [r["term"] for r in wide.collect()]
        postings = self._alive(block_rows(self._read(BLOCKS, "postings", older))).drop("segment", "bucket")
        write_postings(packed_rows(postings, frequent), self._folder("postings", segment), self.generation.buckets, tokens, frequent)

    def merge_tail(self, fanout: int = 8) -> IndexTable:
        """Fold the newest commits into a segment of the next tier, once they weigh as much as ``fanout`` of theirs.

        A tier is a power of 8 of the rows. A row is rewritten once per tier, and a large old
        segment is not touched by small new ones. The folded segment keeps the ids that its
        commits removed, for older segments.
        """
        g = self.generation
        segments = sorted({*g.docs, *g.dead}, reverse=True)
        tail: list[str] = []
        for tier in sorted(set(g.tiers.values()) | {0}):
            tail = list(itertools.takewhile(lambda s: g.tiers.get(s, 0) <= tier, segments))
            # As much as ``fanout`` segments of this tier; smaller ones count by their size.
            if len(tail) > 1 and sum(8.0 ** (g.tiers.get(s, 0) - tier) for s in tail) >= fanout:
                break
        else:
            return self
        segment = f"{g.number + 1:012d}-{uuid.uuid4().hex[:8]}"
        docs, dead = [s for s in tail if s in g.docs], [s for s in tail if s in g.dead]
        slots = 1
        if docs:
            write_docs(self._alive(self._read(DOCS, "docs", docs)).drop("segment"), self._folder("docs", segment))
            live = self._read(DOCS, "docs", [segment]).drop("segment")
            rows, tokens, _ = _totals(live)
            slots = slots_of(rows)
            write_paths(live, self._folder("paths", segment), slots)
            self._write_merged(segment, docs, tokens)
        if dead:
            gone = self._read(DEAD, "dead", dead).drop("segment").dropDuplicates(["doc_id"])
            gone.write.parquet(self._folder("dead", segment))
        write_terms([self._read(TERMS, "terms", tail).groupBy("term").agg(*summed())], self._folder("terms", segment), g.buckets)
        older = set(tail)
        return IndexTable(self.spark, self.root, replace(
            g, number=g.number + 1,
            docs=[s for s in g.docs if s not in older] + ([segment] if docs else []),
            dead=[s for s in g.dead if s not in older] + ([segment] if dead else []),
            tiers={**{s: t for s, t in g.tiers.items() if s not in older}, segment: tier + 1},
            slots={**{s: n for s, n in g.slots.items() if s not in older}, **({segment: slots} if docs else {})},
        ))._publish().merge_tail(fanout)


def _totals(docs: DataFrame | None) -> tuple[int, int, int]:
    """(documents, tokens, highest id) of a written frame."""
    if docs is None:
        return 0, 0, -1
    row = docs.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0)), F.coalesce(F.max("doc_id"), F.lit(-1))).first()
    return tuple(row)


def tier_of(rows: int) -> int:
    return int(math.log(rows + 1, 8))


def summed() -> list[F.Column]:
    """How the counts of a term in several segments become one row."""
    return [F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl")]


def slots_of(docs: int) -> int:
    """Slots of a segment's path table: a power of two that grows with its documents."""
    return min(MOST_SLOTS, 1 << max(0, math.ceil(math.log2(max(docs, 1) / SLOT_ROWS))))


def slot_of(path: str, slots: int) -> F.Column:
    return F.pmod(F.xxhash64(path), F.lit(slots)).cast("int").alias("slot")


def parts_of(spark: SparkSession, tokens: int) -> int:
    """Tasks that write the postings: each about an advisory partition, but all cores for a middling table."""
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes").strip().lower()
    digits, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", size).groups()
    advisory = max(int(digits) << 10 * " kmgt".index(unit or " "), 1)
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(math.ceil(tokens * TOKEN_BYTES / advisory), min(shuffle, math.ceil(tokens / 50_000)), 1)


def store(rows: DataFrame, path: str, *folders: str) -> None:
    """Write a part of the index; shuffle files go with the write instead of staying until the driver collects its garbage."""
    writer = rows.write.option("compression", "zstd")
    with drop_shuffles(rows.sparkSession):
        (writer.partitionBy(*folders) if folders else writer).parquet(path)


def write_docs(docs: DataFrame, path: str) -> None:
    """Documents in id order per file."""
    store(docs.sortWithinPartitions("doc_id"), path)


def write_paths(docs: DataFrame, path: str, slots: int) -> None:
    """Documents by slot of their path, sorted by path within a slot.

    A path that very many documents share is split with its slot at the advisory partition size.
    """
    own = ~F.col("name").eqNullSafe(derive_name("path"))
    placed = docs.select("doc_id", "path", own.alias("own"), "dl", slot_of("path", slots))
    placed = placed.hint("rebalance", "slot") if slots > 1 else placed.hint("rebalance")
    store(placed.sortWithinPartitions("slot", "path"), path, "slot")


def write_postings(packed: DataFrame, path: str, buckets: int, tokens: int, frequent: list[str]) -> None:
    """Posting blocks in term buckets as folders, each file sorted by term and block.

    One shuffle deals packed postings, and blocks are gathered from sorted rows. All rows of a term go to one task, so a term is in one
    file; those of the listed frequent terms are dealt by block. A bucket that is larger than a part
    is divided by a second hash of the term.
    """
    parts = parts_of(packed.sparkSession, tokens)
    divisions = math.ceil(parts / buckets)
    division = F.pmod(F.xxhash64("term", F.lit(1)), F.lit(divisions)).cast("int")
    if frequent:
        # Blocks that lie together stay together, four to a file at least.
        of_span = F.pmod(F.xxhash64("span"), F.lit(parts)).cast("int")
        division = F.when(F.col("term").isin(frequent), F.lit(divisions) + of_span).otherwise(division)
    # One number tells bucket and division, as there are very many short rows.
    place = term_bucket("term", buckets) + F.lit(buckets).cast("long") * division
    rows = packed.select(place.alias("place"), "term", "first", "packed").repartition(parts, "place")
    rows = rows.select(F.pmod("place", F.lit(buckets)).cast("int").alias("bucket"), "term", "first", "packed")
    placed = rows.sortWithinPartitions("bucket", "term", "first")
    # The rows of a task are in the order of the folders, so the writer need not sort them again.
    blocks = placed.mapInArrow(gather_blocks, GATHERED)
    store(blocks.sortWithinPartitions("bucket"), path, "bucket")


def write_terms(counts: list[DataFrame], path: str, buckets: int) -> None:
    """Signed document counts and bounds per term, one row per term and segment."""
    merged = counts[0]
    for more in counts[1:]:
        merged = merged.unionByName(more)
    if len(counts) > 1:
        merged = merged.groupBy("term").agg(*summed())
    placed = merged.where("df <> 0").withColumn("bucket", term_bucket("term", buckets)).hint("rebalance", "bucket")
    store(placed.sortWithinPartitions("bucket", "term"), path, "bucket")
