"""Line dedup by a sharded minimal perfect hash over the hashes of frequent lines.

A line's key is the line without white space at its ends, A to Z lower-cased; its hash has 128 bits. Hashes are counted within each batch
of documents before they are shuffled, so a line of every document costs a row for each batch. The hashes of lines in ``min_docs``
documents or more are dealt to shards of some ``SHARD_KEYS``; a shard numbers its keys without gaps by cascaded bit arrays (each
level holds the keys that are alone in their bit, the others go on to the next), and the number indexes three arrays: a fingerprint of 64
bits, the count of documents, and the last document.

Documents don't meet lines: each sends its hashes to the shards (one row for each shard), which look them up in their arrays. A shard that
many documents ask (because a line of a third of them is in it) is copied to as many slices as its counts call for. What comes back is a row for each
document that loses lines. A task holds one shard's arrays, one batch of hashes, or the lines of one text. To the driver come two counts
and, for each shard of 65,536 frequent lines, one number.

Defined results: a null or empty text is one empty line; a document is a row, so rows that repeat a text count each; rows that share the largest
doc_id that holds a line all keep it, also several times within a text; a null doc_id is smaller than all others; texts of any length
are taken whole; an empty table gives an empty one; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import SPACE, map_rows, sliced
from corpusloom.runtime import drop, stash

MIN_CHARS = 40
MIN_DOCS = 5
SHARD_KEYS = 1 << 16
#: Hashes looked up by one copy of a shard.
SLICE_PROBES = 1 << 16
#: Bits of a level for each key that comes to it.
SPARSE = 2
#: The place of a null doc_id, below all others.
NO_ID = -(1 << 63)
#: Bytes that don't begin a code point.
CONTINUED = bytes(range(0x80, 0xC0))
PAIR = np.dtype([("h1", "<i8"), ("h2", "<i8")])
SCHEMA = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"


def line_hash(line: bytes, min_chars: int) -> bytes | None:
    """The hash of a line's key; None where the key is shorter than ``min_chars`` code points."""
    key = line.strip(SPACE)
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.translate(None, CONTINUED)) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.lower())


def document_hashes(documents: DataFrame, min_chars: int) -> DataFrame:
    """(doc, text_hash, hashes): the distinct hashes of each text that has any, 16 bytes each."""

    def make():
        def work(rows: list) -> list:
            out = []
            for doc, text_hash, text in rows:
                found = {h for line in text.split(b"\n") if (h := line_hash(line, min_chars))}
                if found:
                    out.append((doc, text_hash, b"".join(found)))
            return out

        return work

    return map_rows(documents.where(F.length("text") >= min_chars), make, "doc long, text_hash long, hashes binary")


def pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All hashes of a column, and of which row each is."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), PAIR), np.repeat(np.arange(len(values)), [len(v) // PAIR.itemsize for v in values])


def frequent_lines(hashes: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, docs, last): hashes of at least ``min_docs`` documents, how many those are, and the largest id among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1 << 14, 8_000_000):
            found, row = pairs(batch.column("hashes"))
            doc = batch.column("doc").to_numpy()[row]
            order = np.lexsort((doc, found["h2"], found["h1"]))
            found, doc = found[order], doc[order]
            ends = np.flatnonzero(np.append(found[1:] != found[:-1], True))
            n = np.diff(ends, prepend=-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (found["h1"][ends], found["h2"][ends], n, doc[ends])], names=["h1", "h2", "n", "last"])

    parts = hashes.select("doc", "hashes").mapInArrow(run, "h1 long, h2 long, n long, last long")
    return parts.groupBy("h1", "h2").agg(F.sum("n").alias("docs"), F.max("last").alias("last")).where(F.col("docs") >= min_docs)


def mixed(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    """A hash of both for each level, unsigned."""
    with np.errstate(over="ignore"):
        x = h2.astype(np.uint64) ^ (h1.astype(np.uint64) + np.uint64(level)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct pairs of longs -> 0 .. n-1 without gaps or collisions; other pairs -> any of these, or -1."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.before = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])

    @classmethod
    def over(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(h1):
            size = SPARSE * len(h1)
            at = (mixed(h1, h2, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            rest = ~alone[at]
            h1, h2 = h1[rest], h2[rest]
        return cls(sizes, np.concatenate([*levels, np.zeros(0, bool)]))

    def of(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out, left, base = np.full(len(h1), -1, np.int64), np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes):
            at = base + (mixed(h1[left], h2[left], level) % np.uint64(size)).astype(np.int64)
            found = self.bits[at]
            out[left[found]] = self.before[at[found]]
            left, base = left[~found], base + size
        return out


SHARD = "shard int, sizes array<int>, bits binary, fingerprints binary, counts binary, lasts binary"


def make_shards(frequent: DataFrame) -> DataFrame:
    """One row of arrays for each shard."""

    def build(rows: pa.Table) -> pa.Table:
        h1, h2, docs, last = (rows[c].to_numpy() for c in ("h1", "h2", "docs", "last"))
        found = PerfectHash.over(h1, h2)
        place = np.argsort(found.of(h1, h2))
        arrays = [np.packbits(found.bits), h1[place], docs[place], last[place]]
        return pa.table([pa.array([rows["shard"][0].as_py()], pa.int32()), pa.array([found.sizes], pa.list_(pa.int32())), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)], names=["shard", "sizes", "bits", "fingerprints", "counts", "lasts"])

    return frequent.groupBy("shard").applyInArrow(build, SHARD)


class Shard:
    """The arrays of a row of SHARD, for look-ups."""

    def __init__(self, row: dict):
        size = sum(row["sizes"])
        self.index = PerfectHash(row["sizes"], np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=size).astype(bool))
        self.fingerprints, self.counts, self.lasts = (np.frombuffer(row[c], np.int64) for c in ("fingerprints", "counts", "lasts"))

    def last_of(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is one of a frequent line, and its last document."""
        at = self.index.of(h1, h2)
        known = (at >= 0) & (self.fingerprints[at] == h1)
        return known, self.lasts[at]


def probes(hashes: DataFrame, shards: int, slices: list[int]) -> DataFrame:
    """(shard, slice, doc, text_hash, hashes): what each document asks of each shard."""
    count = np.array(slices, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1 << 12, 2_000_000):
            found, row = pairs(batch.column("hashes"))
            shard = found["h1"] % shards
            order = np.lexsort((shard, row))
            found, row, shard = found[order], row[order], shard[order]
            starts = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (shard[1:] != shard[:-1])))
            doc, text_hash = (batch.column(c).to_numpy()[row[starts]] for c in ("doc", "text_hash"))
            part = mixed(doc, text_hash, 0) % count[shard[starts]].astype(np.uint64)
            data = found.tobytes()
            edges = [*(starts * PAIR.itemsize).tolist(), len(data)]
            asked = pa.array([data[i:j] for i, j in zip(edges[:-1], edges[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(shard[starts].astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(doc), pa.array(text_hash), asked], names=["shard", "slice", "doc", "text_hash", "hashes"])

    return hashes.mapInArrow(run, "shard int, slice int, doc long, text_hash long, hashes binary")


def answers(shards: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc, text_hash, lost): for each row of ``asked`` the hashes that the document loses, where there are any. ``shards`` have a ``slice``."""
    columns = ["shard", "slice", "kind", *(c for c in shards.columns if c not in ("shard", "slice")), "doc", "text_hash", "hashes"]
    rows = shards.withColumn("kind", F.lit(0)).unionByName(asked.withColumn("kind", F.lit(1)), allowMissingColumns=True).select(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in sliced(batches, 1 << 12, 8_000_000):
            kinds = batch.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1).tolist(), len(kinds)]
            for start, stop in zip(edges[:-1], edges[1:]):
                if kinds[start] == 0:  # A shard without questions is followed by another.
                    shard = Shard(batch.slice(stop - 1, 1).to_pylist()[0])
                    continue
                if shard is None:
                    continue
                part = batch.slice(start, stop - start)
                found, row = pairs(part.column("hashes"))
                doc = part.column("doc").to_numpy()
                known, last = shard.last_of(found["h1"], found["h2"])
                lost = np.flatnonzero(known & (last != doc[row]))
                if len(lost):
                    rows_of, starts = np.unique(row[lost], return_index=True)
                    data = found["h1"][lost].tobytes()
                    ends = [*(starts * 8).tolist(), len(data)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc[rows_of]), part.column("text_hash").take(pa.array(rows_of)), pa.array([data[i:j] for i, j in zip(ends[:-1], ends[1:])], pa.binary())], names=["doc", "text_hash", "lost"]
                    )

    return rows.repartition("shard", "slice").sortWithinPartitions("shard", "slice", "kind").mapInArrow(run, "doc long, text_hash long, lost binary")


def lost_lines(rows: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(doc, text_hash, lost): the first halves of the hashes whose lines a text loses, for each text that loses any."""
    hashes = stash(document_hashes(rows.select("doc", "text_hash", "text"), min_chars), "line-hashes")
    frequent = stash(frequent_lines(hashes, min_docs), "frequent-lines")
    shards = max(1, math.ceil(frequent.count() / SHARD_KEYS))
    keys = frequent.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    asked = hashes.agg(F.sum(F.octet_length("hashes") / PAIR.itemsize)).first()[0] or 0
    slices = [1 + math.ceil(asked / shards / SLICE_PROBES)] * shards
    for shard, docs in keys.groupBy("shard").agg(F.sum("docs")).collect():
        slices[shard] += math.ceil(docs / SLICE_PROBES)
    copies = F.sequence(F.lit(0), F.element_at(F.lit(slices), F.col("shard") + 1).cast("int") - 1)
    arrays = make_shards(keys).withColumn("slice", F.explode(copies))
    lost = stash(answers(arrays, probes(hashes, shards, slices)).groupBy("doc", "text_hash").agg(F.collect_set("lost").alias("lost")), "lost-lines")
    drop(hashes, frequent)
    return lost


def dedup_lines(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, texts: bool = True) -> DataFrame:
    """SCHEMA and, with ``texts``, the text that is left, as ``text``."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("text_hash"), "text")
    lost = lost_lines(rows, min_chars, min_docs)

    def make():
        def work(found: list) -> list:
            out = []
            for doc_id, text, gone in found:
                text = text or b""
                n, dropped = text.count(b"\n") + 1, 0
                if gone:
                    gone = {part[i : i + 8] for part in gone for i in range(0, len(part), 8)}
                    lines = text.split(b"\n")
                    kept = [line for line in lines if (h := line_hash(line, min_chars)) is None or h[:8] not in gone]
                    text, dropped = b"\n".join(kept), len(lines) - len(kept)
                row = (doc_id, n, dropped, hashlib.sha256(text).hexdigest())
                out.append((*row, text.decode("utf-8", "surrogatepass")) if texts else row)
            return out

        return work

    joined = rows.join(lost, ["doc", "text_hash"], "left").select("doc_id", "text", "lost")
    return map_rows(joined, make, SCHEMA + ", text string" * texts)


ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents
), keyed AS (
  SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), frequent AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.doc_id, k.line, k.place, coalesce(k.doc_id <> f.last, false) AS gone FROM keyed k LEFT JOIN frequent f USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
