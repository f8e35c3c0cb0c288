"""WARC archives: records written in segments, read back by reassembly."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from pathloom.llm.common import CLEANUP, saved, slices, utf8
from pathloom.operators.joins import lookup_join
from pathloom.session import work_dir

MARK = b"WARC/1.1"
VERSION = MARK + b"\r\n"
END = b"\r\n\r\n"
SEGMENT = 32 << 10  # bytes of a record's block before it is continued in another record
CHUNK = 16 << 10
REVISIT_FROM = 100  # bytes of payload
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ------------------------------------------------------------------ bytes of one record

def before_mark(data: bytes, at: int, end: int) -> int:
    """Where to cut data that a line end will follow: not behind what that would make a record's first line."""
    return end - 1 if end - at > 1 and data.endswith(MARK, at, end) else end


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing. No chunk, with its line end, has a record's first line in it: that marks records only."""
    out, at = [], 0
    while at < len(payload):
        end = min(at + size, len(payload))
        found = payload.find(VERSION, at, end)
        if found >= 0:
            end = found + len(VERSION) - 1
        end = before_mark(payload, at, end)
        out += [b"%x\r\n" % (end - at), payload[at:end], b"\r\n"]
        at = end
    return b"".join(out) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The payload of chunked framing; None if the framing is broken."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            return None
        try:
            size = int(body[at:line].split(b";")[0], 16)
        except ValueError:
            return None
        at = line + 2
        if size == 0:
            return b"".join(out)
        if size < 0 or body[at + size : at + size + 2] != b"\r\n":
            return None
        out.append(body[at : at + size])
        at += size + 2


def record(fields: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    """One record without its first line and without the two line ends after the block."""
    head = b"".join(k + b": " + v + b"\r\n" for k, v in fields)
    return head + b"Content-Length: %d\r\n\r\n" % len(block) + block


def identifier(page: int, digest: str, number: int = 1) -> bytes:
    """Of a page's record, and of its continuations; pages that share an id differ by digest."""
    return b"<urn:pages:%d:%s:%d>" % (page, digest[:16].encode(), number)


def page_id_of(uri: bytes) -> int | None:
    """The page number in a record's identifier."""
    parts = uri.split(b":")
    try:
        return int(parts[2])
    except (IndexError, ValueError):
        return None


def page_records(page: int, url: str | None, payload: bytes, first: int | None, segment: int) -> list[bytes]:
    """The records of a page: a revisit of page ``first``, or a response in one or more segments."""
    digest = hashlib.sha256(payload).hexdigest()
    target = utf8(url).replace(b"\r", b"%0D").replace(b"\n", b"%0A").replace(MARK, b"WARC%2F1.1")
    fields = [(b"WARC-Record-ID", identifier(page, digest)), (b"WARC-Target-URI", target)]
    fields.append((b"WARC-Payload-Digest", b"sha256:" + digest.encode()))
    if first is not None:
        fields += [(b"WARC-Type", b"revisit"), (b"WARC-Profile", PROFILE), (b"WARC-Refers-To", identifier(first, digest))]
        return [record(fields, b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n")]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts, at = [], 0
    while at < len(block):
        end = before_mark(block, at, min(at + segment, len(block)))
        parts.append(block[at:end])
        at = end
    if len(parts) == 1:
        return [record([*fields, (b"WARC-Type", b"response")], block)]
    out = [record([*fields, (b"WARC-Type", b"response"), (b"WARC-Segment-Number", b"1")], parts[0])]
    for number, part in enumerate(parts[1:], 2):
        own = [(b"WARC-Record-ID", identifier(page, digest, number)), (b"WARC-Type", b"continuation")]
        own += [(b"WARC-Segment-Origin-ID", identifier(page, digest)), (b"WARC-Segment-Number", b"%d" % number)]
        if number == len(parts):
            own.append((b"WARC-Segment-Total-Length", b"%d" % len(block)))
        out.append(record(own, part))
    return out


def parsed(raw: bytes) -> tuple[dict[bytes, bytes], bytes | None]:
    """Fields (names in lower case) and block of a record; the block is None if it is cut short."""
    head, _, rest = raw.partition(END)
    fields = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    try:
        length = int(fields.get(b"content-length", b"-1"))
    except ValueError:
        length = -1
    return fields, rest[:length] if 0 <= length <= len(rest) else None


# ------------------------------------------------------------------ jobs

def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT, records_per_file: int = 20_000) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) as gzip-compressed WARC files.

    Of pages with equal payloads of at least ``REVISIT_FROM`` bytes, the one with the smallest
    id is a response and the others revisit it; smaller payloads are responses. A payload is
    the html in UTF-8; a null html is empty. A block above ``segment`` bytes goes on in
    continuation records. Rows without a page_id cannot be referred to and are left out;
    rows that repeat a page_id with other html are records of their own. Other columns are
    ignored.

    Only digests that occur twice are joined back, by a lookup that is broadcast if it is
    counted small and salted else; html is read twice and not shuffled in the first case.
    """
    rows = pages.where("page_id IS NOT NULL").select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.when(F.octet_length("html") >= REVISIT_FROM, F.sha2("html", 256)))
    again = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = saved(again.select("digest", "first"), "warc-repeated")
    rows = lookup_join(rows, again, "digest", "left", spread=F.xxhash64("page_id"))
    rows = rows.select("page_id", "url", "html", F.least("first", "page_id").alias("first"))

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, "html"):
            out: list[bytes] = []
            for page, url, html, first in zip(frame["page_id"], frame["url"], frame["html"], frame["first"]):
                out += page_records(int(page), url, utf8(html), None if first == page else int(first), segment)
            yield pd.DataFrame({"record": out})

    records = rows.mapInPandas(build, "record binary")
    lines = records.select(F.concat(F.lit(VERSION.decode()), F.col("record").cast("string")).alias("value"))
    spark = pages.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        # A line end of the text writer is the end of a record.
        writer = lines.write.option("lineSep", END.decode()).option("compression", "gzip")
        writer.option("maxRecordsPerFile", records_per_file).text(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


RECORD = (
    "type string, record_id string, origin_id string, segment int, total long, page_id long, refers_to long, "
    "digest string, block binary"
)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives. Files are cut at the first line of a record, as lines are."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def number(value: bytes | None) -> int | None:
            try:
                return int(value) if value is not None else None
            except ValueError:
                return None

        for frame in frames:
            for at in range(0, len(frame), 256):
                out = []
                for raw in frame["raw"].iloc[at : at + 256]:
                    fields, block = parsed(bytes(raw))
                    get = fields.get
                    refers = get(b"warc-refers-to")
                    row_id = get(b"warc-segment-origin-id", get(b"warc-record-id", b""))
                    out.append(
                        (
                            get(b"warc-type", b"").decode("latin-1"), get(b"warc-record-id", b"").decode("latin-1"), row_id.decode("latin-1"),
                            number(get(b"warc-segment-number")), number(get(b"warc-segment-total-length")), page_id_of(row_id),
                            page_id_of(refers) if refers is not None else None,
                            get(b"warc-payload-digest", b"").decode("latin-1").rpartition(":")[2] or None, block,
                        )
                    )
                names = ["type", "record_id", "origin_id", "segment", "total", "page_id", "refers_to", "digest", "block"]
                frame_out = pd.DataFrame(out, columns=names)
                for name in ("segment", "total", "page_id", "refers_to"):
                    frame_out[name] = frame_out[name].astype("Int64")
                yield frame_out.astype({"segment": "Int32"})

    lines = spark.read.option("lineSep", VERSION.decode()).text(path).select(F.col("value").cast("binary").alias("raw"))
    return lines.where(F.length("raw") > 0).mapInPandas(split, RECORD)


def reassembled(records: DataFrame) -> DataFrame:
    """One row per response or revisit: page_id, type, refers_to, digest, payload, status.

    Records in one piece are decoded where they are. Segments are grouped by the identifier
    of their first record, ordered by number, and joined; ``status`` is ``ok``, or says what is
    wrong: ``short block``, ``missing segment`` (numbers are not 1 to n, or no segment states
    the total), ``wrong length`` (the total differs), ``broken framing``, ``wrong digest``. The
    payload is null unless all is well. A segment that is there twice counts once.
    """

    @F.pandas_udf("payload binary, status string")
    def decode(blocks: pd.Series, digests: pd.Series) -> pd.DataFrame:
        out = []
        for pieces, digest in zip(blocks, digests):
            block = None if pieces is None or any(p is None for p in pieces) else b"".join(map(bytes, pieces))
            head, _, body = (block or b"").partition(END)
            framed = b"transfer-encoding: chunked" in head.lower()
            payload = unchunked(body) if framed else body
            if block is None:
                out.append((None, "short block"))
            elif payload is None:
                out.append((None, "broken framing"))
            elif digest is not None and hashlib.sha256(payload).hexdigest() != digest.lower():
                out.append((None, "wrong digest"))
            else:
                out.append((payload, "ok"))
        return pd.DataFrame(out, columns=["payload", "status"])

    fields = ["page_id", "type", "refers_to", "digest"]
    whole = records.where("segment IS NULL AND type = 'response'").select(*fields, F.array("block").alias("blocks"), F.lit(None).cast("string").alias("wrong"))
    parts = records.where("segment IS NOT NULL").dropDuplicates(["origin_id", "segment"])
    joined = parts.groupBy("origin_id").agg(
        F.first("page_id", True).alias("page_id"),
        F.max(F.when(F.col("segment") == 1, F.struct("type", "refers_to", "digest"))).alias("head"),
        F.max("total").alias("total"), F.count("*").alias("n"), F.min("segment").alias("least"), F.max("segment").alias("most"),
        F.sum(F.length("block")).alias("length"), F.max(F.col("block").isNull()).alias("short"),
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("blocks"),
    )
    wrong = (
        F.when(F.col("short"), "short block")
        .when((F.col("least") != 1) | (F.col("most") != F.col("n")) | F.col("total").isNull(), "missing segment")
        .when(F.col("length") != F.col("total"), "wrong length")
    )
    segmented = joined.select(
        "page_id", F.coalesce("head.type", F.lit("response")).alias("type"), "head.refers_to", "head.digest",
        F.when(wrong.isNull(), F.col("blocks.block")).alias("blocks"), wrong.alias("wrong"),
    )
    decoded = whole.unionByName(segmented).withColumn("d", decode("blocks", "digest"))
    responses = decoded.select(
        *fields, "d.payload", F.coalesce("wrong", "d.status").alias("status"),
    )
    revisits = records.where("type = 'revisit'").select(
        *fields, F.lit(None).cast("binary").alias("payload"), F.when(F.col("block").isNull(), "short block").otherwise("ok").alias("status")
    )
    return responses.unionByName(revisits)


def archive_report(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the archives, read them back, and report each page from what was read.

    A revisit has the length and digest of the response that it refers to; its own stated
    digest must be the same. Rows that repeat both page_id and html are one page; rows without a
    page_id are not archived and not reported.
    """
    spark = pages.sparkSession
    path = path or work_dir(spark, "llm-warc")
    write_archives(pages, path)
    read = reassembled(read_records(spark, path)).select(
        "page_id", "type", "refers_to", "digest", "status",
        F.length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("found"),
    )
    read = saved(read, "warc-read")
    wrong = read.where("status <> 'ok'").select("page_id", "status").limit(5).collect()
    if wrong:
        raise ValueError(f"archives could not be read back: {wrong}")
    own = read.where("type = 'response'").select("page_id", "bytes", "found", "type", "refers_to").distinct()
    revisits = read.where("type = 'revisit'").select("page_id", "refers_to", "digest", "type").distinct()
    # A page id that repeats with several htmls has several responses: the digest tells them apart.
    origins = own.select(F.col("page_id").alias("refers_to"), F.col("found").alias("digest"), "bytes").distinct()
    needed = lookup_join(origins, revisits.select("refers_to", "digest").distinct(), ["refers_to", "digest"], "left_semi")
    resolved = lookup_join(revisits, needed, ["refers_to", "digest"], spread=F.xxhash64("page_id"))
    resolved = resolved.select("page_id", "bytes", F.col("digest").alias("found"), "type", "refers_to")
    return own.unionByName(resolved).select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("found").alias("payload_digest"),
        F.col("type").alias("record_type"), "refers_to",
    )
