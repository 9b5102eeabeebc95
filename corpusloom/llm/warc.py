"""WARC archives: writing pages as records, and reading them back with segment reassembly.

Writing: each page becomes an HTTP response in chunked transfer framing. A response that is
longer than ``SEGMENT_BYTES`` is cut into a first record and continuation records. Of pages
with equal payloads of at least ``MIN_REVISIT_BYTES`` one is a response, the others are revisit
records that name it. A record ends with two line ends, which is also the separator that Spark's
text writer puts behind each value, so archives are written through any file system that Spark
knows, without Python in the way.

Reading: archive files are parsed record by record, once; continuation records are grouped by the
identifier of their origin, ordered by segment number, their total length is verified, then the
chunked framing is decoded and the payload's digest verified.

Defined results: a null html is an empty payload. A null page_id is greater than any other, and is no
payload's smallest. Repeated rows of one page_id with equal payloads count as several records, of which the first is
the response. Payloads of any length are taken whole; an empty table makes an empty archive. Only ``page_id``, ``url``
and ``html`` are read; ``url`` may be absent.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import sliced
from corpusloom.runtime import discard, fresh_path, release_shuffles, stash

SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
MIN_REVISIT_BYTES = 100
#: With the segment length this bounds an archive file, and so the memory of the task that parses it.
RECORDS_PER_FILE = 512
#: Places that the pages of one payload are dealt to.
SALTS = 128
VERSION = b"WARC/1.1\r\n"
END = "\r\n\r\n"

RECORD_SCHEMA = (
    "record_id string, record_type string, page_id long, origin_id string, segment int, total_length long, "
    "refers_to long, payload_bytes long, payload_digest string, block binary"
)
PAGE_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, html string, verified boolean"
#: What parsing gives: whole pages, and with ``origin_id`` segments of others.
PARSED_SCHEMA = PAGE_SCHEMA + ", origin_id string, segment int, total_length long, block binary"


def framed(payload: bytes) -> bytes:
    """``payload`` in chunked transfer framing."""
    parts = []
    for start in range(0, len(payload), CHUNK_BYTES):
        piece = payload[start : start + CHUNK_BYTES]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unframed(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing; chunk extensions and trailers are passed over."""
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where its size says")
        parts.append(body[at : at + size])
        at += size + 2


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A WARC record without the two line ends that close it."""
    head = "".join(f"{name}: {value}\r\n" for name, value in headers if value is not None)
    return VERSION + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def page_records(page_id: int | None, url: str | None, copy: int, digest: str, payload: bytes, refers_to: int | None, revisit: bool) -> Iterator[bytes]:
    """The records of one page: a response with its continuations, or a revisit."""
    name = f"<urn:sha256:{hashlib.sha256(f'{page_id}/{copy}/{digest}/{url}'.encode()).hexdigest()}"
    target = "".join(c for c in (url or "") if c > " ") or None
    about = [("WARC-Record-ID", name + ">"), ("WARC-Target-URI", target), ("X-Page-Id", page_id), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", len(payload))]
    kind = ("Content-Type", "application/http;msgtype=response")
    if revisit:
        yield record([("WARC-Type", "revisit"), *about, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-Id", refers_to), kind], b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n")
        return
    whole = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + framed(payload)
    several = len(whole) > SEGMENT_BYTES
    yield record([("WARC-Type", "response"), *about, ("WARC-Segment-Number", 1 if several else None), kind], whole[:SEGMENT_BYTES])
    last = (len(whole) - 1) // SEGMENT_BYTES
    for k in range(1, last + 1):
        yield record(
            [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name}/{k + 1}>"), ("WARC-Segment-Origin-ID", name + ">"), ("WARC-Segment-Number", k + 1), ("WARC-Segment-Total-Length", len(whole) if k == last else None)],
            whole[k * SEGMENT_BYTES : (k + 1) * SEGMENT_BYTES],
        )


def parsed(archive: bytes) -> Iterator[tuple]:
    """The records of an archive file as rows of RECORD_SCHEMA."""
    at = 0
    while at < len(archive):
        head_end = archive.index(b"\r\n\r\n", at)
        lines = archive[at:head_end].split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {}
        for line in lines[1:]:
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode()] = value.strip().decode()
        size = int(headers["content-length"])
        start = head_end + 4
        if archive[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where its length says")
        number = lambda key: int(headers[key]) if key in headers else None
        name = headers["warc-record-id"]
        yield (
            name, headers["warc-type"], number("x-page-id"), headers.get("warc-segment-origin-id", name), number("warc-segment-number"), number("warc-segment-total-length"),
            number("x-refers-to-page-id"), number("x-payload-length"), headers.get("warc-payload-digest", "").removeprefix("sha256:") or None, archive[start : start + size],
        )
        at = start + size + 4


def assembled(segments: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of a record from its (number, total length, block) segments, verified."""
    segments = sorted(segments)
    if [s[0] for s in segments] != list(range(1, len(segments) + 1)):
        raise ValueError("a segment is missing or repeated")
    whole = b"".join(s[2] for s in segments)
    totals = {s[1] for s in segments if s[1] is not None}
    if totals != ({len(whole)} if len(segments) > 1 else totals & {len(whole)}):
        raise ValueError("the segments don't have the total length that the last one gives")
    return whole


def decoded(block: bytes) -> bytes:
    """The payload of an HTTP response message."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unframed(body) if b"transfer-encoding: chunked" in head.lower() else body


def roles(rows: DataFrame) -> DataFrame:
    """(digest, salt, first): for payloads that several rows have, the smallest page_id, once for each place that the payload's rows go to."""
    thin = rows.where(F.length("payload") >= MIN_REVISIT_BYTES).select("page_id", "digest", "salt")
    found = thin.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("rows"), F.collect_set("salt").alias("salts")).where("rows > 1 AND first IS NOT NULL")
    return found.select("digest", F.explode("salts").alias("salt"), "first")


def write_archives(pages: DataFrame, path: str) -> None:
    """Write one record (with its continuations) for each row of ``pages`` to gzip files below ``path``.

    The thin (page_id, digest) rows decide who revisits whom. The payloads move once, dealt by payload and SALTS
    places of each by page_id (by URL where that is null), so neither copies nor rows without id gather; what was decided
    goes ahead of them in sorted partitions.
    """
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"))
    place = F.xxhash64(F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("url "), F.col("url")), F.lit("")))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("salt", F.pmod(place, F.lit(SALTS)).cast("int"))
    both = rows.withColumn("kind", F.lit(1)).unionByName(roles(rows).withColumn("kind", F.lit(0)), allowMissingColumns=True)
    dealt = both.select("digest", "salt", "kind", "page_id", "url", "payload", "first").repartition("digest", "salt").sortWithinPartitions("digest", "salt", "kind", "page_id", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, first, answered, last, copy = None, None, False, None, 0
        for batch in sliced(batches, 128):
            out = []
            for digest, salt, kind, page_id, url, payload, named in zip(*(c.to_pylist() for c in batch.columns)):
                if (digest, salt) != group:
                    group, first, answered, last = (digest, salt), None, False, None
                if not kind:
                    first = named
                    continue
                copy = copy + 1 if last == (page_id, url) else 0
                last = page_id, url
                revisit = first is not None and (page_id != first or answered)
                answered = answered or page_id == first
                out += page_records(page_id, url, copy, digest, payload, first if revisit else None, revisit)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    records = dealt.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    records.write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def unpacked(content: bytes) -> bytes:
    """The bytes of an archive file, gzip members joined."""
    if content[:2] != b"\x1f\x8b":
        return content
    parts = []
    while content:
        member = zlib.decompressobj(31)
        parts.append(member.decompress(content))
        content = member.unused_data
    return b"".join(parts)


def mapped(rows: DataFrame, make: Callable[[pa.RecordBatch], Iterator[tuple]], schema: str) -> DataFrame:
    """``make`` gives tuples for an Arrow batch; they go on in small batches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_ = make(batch)
            while held := list(itertools.islice(rows_, 128)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

    return rows.mapInArrow(run, schema)


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("content")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archive files below ``path`` as rows of RECORD_SCHEMA."""

    def make(batch: pa.RecordBatch) -> Iterator[tuple]:
        for content in batch.column(0):
            yield from parsed(unpacked(content.as_py()))

    return mapped(archive_files(spark, path), make, RECORD_SCHEMA)


def page_row(record_type: str, page_id: int | None, refers_to: int | None, length: int | None, digest: str | None, block: bytes) -> tuple:
    """A row of PAGE_SCHEMA from a whole record."""
    if record_type == "revisit":
        return page_id, length, digest, "revisit", refers_to, None, None
    payload = decoded(block)
    found = hashlib.sha256(payload).hexdigest()
    return page_id, len(payload), found, record_type, None, payload.decode("utf-8", "replace"), found == digest


def read_archives(spark: SparkSession, path: str, texts: bool = True) -> DataFrame:
    """The pages of the archives below ``path``: rows of PAGE_SCHEMA, ``html`` null for revisits (and, without ``texts``, for all).

    Each file is parsed once and the result written. Records that are whole become pages where they are read. Only
    segments are shuffled, and only those of one record meet in a group, so a group is as large as one page.
    """
    names = [f.split()[0] for f in PARSED_SCHEMA.split(", ")]

    def shown(page: tuple) -> tuple:
        return page if texts else (*page[:5], None, page[6])

    def parse(batch: pa.RecordBatch) -> Iterator[tuple]:
        for content in batch.column(0):
            for r in parsed(unpacked(content.as_py())):
                if r[4] is None:
                    yield (*shown(page_row(r[1], r[2], r[6], r[7], r[8], r[9])), None, None, None, None)
                else:
                    yield (r[2], r[7], r[8], r[1], r[6], None, None, r[3], r[4], r[5], r[9])

    records = stash(mapped(archive_files(spark, path), parse, PARSED_SCHEMA), "records")
    first = ("record_type", "page_id", "refers_to", "payload_bytes", "payload_digest")
    grouped = records.where("segment IS NOT NULL").groupBy("origin_id").agg(
        *(F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in first), F.collect_list(F.struct("segment", "total_length", "block")).alias("segments")
    )

    def join(batch: pa.RecordBatch) -> Iterator[tuple]:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            block = assembled([(s["segment"], s["total_length"], s["block"]) for s in row["segments"]])
            yield shown(page_row(row["record_type"], row["page_id"], row["refers_to"], row["payload_bytes"], row["payload_digest"], block))

    return records.where("segment IS NULL").select(*names[:7]).unionByName(mapped(grouped, join, PAGE_SCHEMA))


def round_trip(pages: DataFrame, texts: bool = True) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    release_shuffles(pages.sparkSession)
    found = read_archives(pages.sparkSession, path, texts)
    # What was read is a table of its own.
    discard(pages.sparkSession, path)
    return found


ORACLE = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n,
         row_number() OVER (PARTITION BY page_id, coalesce(html, '') ORDER BY url) AS nth
  FROM pages),
m AS (SELECT h, min(page_id) AS first FROM p WHERE n >= {MIN_REVISIT_BYTES} GROUP BY h HAVING count(*) > 1 AND min(page_id) IS NOT NULL)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, sha256(p.h) AS payload_digest,
       CASE WHEN m.first IS NULL OR (p.page_id = m.first AND p.nth = 1) THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN m.first IS NULL OR (p.page_id = m.first AND p.nth = 1) THEN NULL ELSE m.first END AS refers_to
FROM p LEFT JOIN m ON p.h = m.h
"""
