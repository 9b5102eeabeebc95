"""Repeated passages by suffix arrays: longest-previous-factor arrays over candidate segments.

A corpus-wide suffix array doesn't fit a task, so equal passages are first brought together.
Every string of ``LENGTH`` bytes has an anchor: its ``GRAM``-byte substring of smallest hash, the
leftmost of ties. Consecutive strings with one anchor form a segment. Equal strings have
equal anchors at equal places in them, so a string can only repeat among the segments whose anchor
has the same hash:

* an anchor that occurs once has no repeats;
* where all segments of an anchor are the same (anchor hash and 128 bits of the segment's), each string of one
  has its previous factor at the same place of another: all of them repeat;
* the other anchors are where repeats begin and end. Of each distinct segment one representative
  gets its bytes. A task lays the segments of its anchors end to end, builds their suffix array
  (to depth LENGTH) and from the previous and next smaller positions in suffix order the
  longest previous factor of each string, which tells whether an earlier equal one exists.

An anchor with more than ``HOT_SEGMENTS`` distinct segments would be too large for a task and is split by a second,
longer anchor: its strings by how many bytes they have before the anchor, in ``SPLIT`` parts. All strings of a part share
the bytes from its least place before the anchor to its least end behind it, so equal strings share them too, and these
bytes are the new anchor. Parts that are still too large are split again; a part of one place holds equal strings
alone, so the splitting ends, after 4 levels at most.

``keep="first"`` removes later copies and keeps the first by (doc_id, text hash, place). ``keep="none"``
removes every copy. Strings are judged on the input; removed bytes are the union of the repeated
strings' bytes.

Texts and what is to be cut from or out of them meet in sorted partitions and are gone through as a stream, so a task
holds one text and one Arrow batch at a time, however many segments a text has.

Defined results: a null text is empty; texts shorter than LENGTH bytes have no repeats; texts of any length are
taken whole; rows that are equal in doc_id and text get the same result (they repeat each other, and with
``keep="first"`` they count as one document); an empty table gives an empty one. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import sliced, text_bytes
from corpusloom.runtime import drop, release_shuffles, stash

LENGTH = 200
GRAM = 48
#: Texts are laid end to end for hashing up to about this many bytes; longer texts are cut into overlapping pieces.
PIECE_BYTES = 1 << 19
_PLACE_BITS = 22
#: Distinct segments of an anchor (at most 350 bytes each) from which it is split.
HOT_SEGMENTS = 1024
#: Bytes of segments that a task puts into one suffix array, before those of the last anchor; some 100 bytes of memory for each.
ARRAY_BYTES = 1 << 19
#: Parts of a split anchor.
SPLIT = 4
#: Split anchors (8 bytes each) up to which they are broadcast.
BROADCAST_ANCHORS = 200_000

SEGMENT_SCHEMA = "doc_id long, text_hash long, start long, strings int, lead int, anchor long, segment long, check long"
#: What tells segments apart.
SAME = ("anchor", "segment", "check")

_BASE = 0x100000001B3
_SECOND = 0x9E3779B97F4A7C15 | 5
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n (or more) of an odd base and of its inverse modulo 2 ** 64."""
    if base not in _POWERS or len(_POWERS[base][0]) <= n:
        size = 1 << int(n).bit_length()
        made = []
        with np.errstate(over="ignore"):
            for factor in (base, pow(base, -1, 1 << 64)):
                steps = np.full(size + 1, factor, np.uint64)
                steps[0] = 1
                made.append(np.multiply.accumulate(steps))
        _POWERS[base] = made[0], made[1]
    return _POWERS[base]


def mixed(codes: np.ndarray) -> np.ndarray:
    """Codes whose bits all depend on all bits of the input."""
    with np.errstate(over="ignore"):
        codes = (codes ^ (codes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        codes = (codes ^ (codes >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return codes ^ (codes >> np.uint64(31))


def prefix_sums(data: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Sums by which the hash of any substring is one difference, see :func:`hashed`."""
    up, _ = powers(base, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64, out=sums[1:])
    return sums


def hashed(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Hashes of the substrings [start, end)."""
    _, down = powers(base, len(sums))
    with np.errstate(over="ignore"):
        return mixed((sums[ends] - sums[starts]) * down[starts])


def segments(data: np.ndarray, text_ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Segments of texts laid end to end: (start, number of strings, place of the anchor in the first string, anchor hash, two segment hashes)."""
    n = len(data)
    count = n - length + 1
    if count <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    sums = prefix_sums(data)
    _, down = powers(_BASE, n)
    with np.errstate(over="ignore"):
        grams = mixed((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    # The smallest (hash, place) of each string's grams, by doubling.
    least = (grams & np.uint64(((1 << 64) - 1) ^ ((1 << _PLACE_BITS) - 1))) | np.arange(len(grams), dtype=np.uint64)
    width, window = 1, length - gram + 1
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < window:
        least = np.minimum(least[: len(least) - (window - width)], least[window - width :])
    anchors = (least & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    # Strings lie within one text.
    text_starts = np.concatenate([[0], text_ends[:-1]])
    edge = np.zeros(n + 1, np.int32)
    long_enough = text_ends - text_starts >= length
    np.add.at(edge, text_starts[long_enough], 1)
    np.add.at(edge, text_ends[long_enough] - length + 1, -1)
    valid = np.cumsum(edge[:count]) > 0
    begins = valid.copy()
    begins[1:] &= (anchors[1:] != anchors[:-1]) | ~valid[:-1]
    begins[text_starts[long_enough]] = True
    starts = np.flatnonzero(begins)
    stops = begins.copy()
    stops[:] = False
    stops[:-1] = valid[:-1] & (begins[1:] | ~valid[1:])
    stops[-1] = valid[-1]
    strings = np.flatnonzero(stops) - starts + 1
    lead = anchors[starts] - starts
    with np.errstate(over="ignore"):
        shape = mixed((strings.astype(np.uint64) << np.uint64(32)) + lead.astype(np.uint64) + np.uint64(1))
    stops = starts + strings + length - 1
    whole = hashed(sums, starts, stops) ^ shape
    anchor = grams[anchors[starts]]
    del sums, grams, least, anchors
    return starts, strings, lead, anchor, whole, hashed(prefix_sums(data, _SECOND), starts, stops, _SECOND)


def pieces(texts: list[bytes], length: int) -> list[tuple[int, int, bytes]]:
    """(text number, offset, bytes): long texts cut so that every string of ``length`` lies in exactly one piece."""
    out = []
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), PIECE_BYTES):
            out.append((i, at, text if len(text) <= PIECE_BYTES else text[at : at + PIECE_BYTES + length - 1]))
    return out


def grouped(cut: list[tuple[int, int, bytes]]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Pieces in groups that stay well below the places that an anchor's number has room for."""
    held, size = [], 0
    for piece in cut:
        if held and size + len(piece[2]) > 2 * PIECE_BYTES:
            yield held
            held, size = [], 0
        held.append(piece)
        size += len(piece[2])
    if held:
        yield held


def segment_table(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The segments of all texts as rows of SEGMENT_SCHEMA."""

    def run(batches):
        for part in sliced(batches, 512, PIECE_BYTES):
            texts = [t or b"" for t in text_bytes(part.column(1))]
            ids, hashes = (part.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i in (0, 2))
            id_null = part.column(0).is_null().to_numpy(zero_copy_only=False)
            for cut in grouped(pieces(texts, length)):
                owner = np.array([p[0] for p in cut], np.int64)
                offset = np.array([p[1] for p in cut], np.int64)
                ends = np.cumsum([len(p[2]) for p in cut])
                data = np.frombuffer(b"".join(p[2] for p in cut), np.uint8)
                start, strings, lead, anchor, whole, check = segments(data, ends, length, gram)
                piece = np.searchsorted(ends, start, "right")
                at = owner[piece]
                place = start - np.concatenate([[0], ends[:-1]])[piece] + offset[piece]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at], pa.int64(), mask=id_null[at]), pa.array(hashes[at], pa.int64()), pa.array(place, pa.int64()), pa.array(strings, pa.int32()), pa.array(lead, pa.int32()), pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(check.view(np.int64))],
                    ["doc_id", "text_hash", "start", "strings", "lead", "anchor", "segment", "check"],
                )

    return keyed(documents).mapInArrow(run, SEGMENT_SCHEMA)


def keyed(documents: DataFrame) -> DataFrame:
    """(doc_id, text, text_hash)"""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def dense_ranks(keys: np.ndarray) -> np.ndarray:
    """For each key the number of smaller distinct keys."""
    order = np.argsort(keys)
    ordered = keys[order]
    step = np.empty(len(keys), np.int32)
    step[:1] = 0
    step[1:] = ordered[1:] != ordered[:-1]
    ranks = np.empty(len(keys), np.int32)
    ranks[order] = np.cumsum(step, dtype=np.int32)
    return ranks


class SuffixOrder:
    """The suffixes of ``data`` that begin at ``starts`` (ascending), ordered by their first ``depth`` bytes, ties by place.

    Built by prefix doubling: ranks by 8, 16, 32 ... bytes, the last step overlapping to reach
    ``depth`` exactly. The ranks of all steps stay, as they also give common-prefix lengths.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, depth: int):
        self.data = np.concatenate([data, np.zeros(2 * depth + 16, np.uint8)])
        self.starts, self.depth = starts, depth
        n = len(data) + depth
        key = np.zeros(n, np.uint64)
        for i in range(8):
            key = (key << np.uint64(8)) | self.data[i : i + n].astype(np.uint64)
        self.levels = [(8, dense_ranks(key))]
        while 2 * self.levels[-1][0] <= depth:
            width, ranks = self.levels[-1]
            joined = ranks.astype(np.int64) * n
            joined[: n - width] += ranks[width:]
            self.levels.append((2 * width, dense_ranks(joined)))
        width, ranks = self.levels[-1]
        self.order = np.argsort(ranks[starts].astype(np.int64) * n + ranks[starts + depth - width], kind="stable")

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common-prefix lengths, up to the depth, of the suffixes at ``a`` and ``b``."""
        length = np.zeros(len(a), np.int64)
        for width, ranks in reversed(self.levels):
            at_a, at_b = a + length, b + length
            length += width * ((length + width <= self.depth) & (ranks[at_a] == ranks[at_b]))
        open_ = np.ones(len(a), bool)
        for _ in range(7):
            open_ &= (length < self.depth) & (self.data[a + length] == self.data[b + length])
            length += open_
        return length

    def factors(self) -> tuple[np.ndarray, np.ndarray]:
        """For each start the longest previous and the longest next factor: the greatest common prefix with an earlier and with a later start."""
        n = len(self.order)
        places = self.starts[self.order]
        neighbour = np.zeros(n + 1, np.int64)  # [k]: common prefix of order k - 1 and k
        if n > 1:
            neighbour[1:n] = self.common(places[:-1], places[1:])
        previous = np.maximum(*(nearest(places, neighbour, side, -1) for side in (-1, 1)))
        later = np.maximum(*(nearest(places, neighbour, side, 1) for side in (-1, 1)))
        out = np.empty((2, n), np.int64)
        out[0, self.order], out[1, self.order] = previous, later
        return out[0], out[1]


def nearest(places: np.ndarray, neighbour: np.ndarray, side: int, sign: int) -> np.ndarray:
    """Common prefix with the nearest smaller place (``sign`` -1; 1: greater) on one ``side`` in suffix order; 0 where there is none.

    All starts jump at once along what their present neighbours have found, and keep the least common prefix on the way.
    """
    n = len(places)
    # One place before and one behind end every search.
    value = np.concatenate([[0], places, [0]]).astype(np.int64) * -sign
    value[[0, -1]] = np.iinfo(np.int64).min
    at = np.arange(n + 2)
    to = np.clip(at + side, 0, n + 1)
    least = np.zeros(n + 2, np.int64)
    least[1 : n + 1] = neighbour[:n] if side < 0 else neighbour[1:]
    active = np.arange(1, n + 1)
    while len(active):
        active = active[value[to[active]] > value[active]]
        here = to[active]
        jumped, low = to[here], np.minimum(least[active], least[here])
        to[active], least[active] = jumped, low
    least[(to == 0) | (to == n + 1)] = 0
    return least[1 : n + 1]


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """The [start, stop) runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist()))


_RANGES = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
#: Ranges of strings of a segment: those that repeat anywhere, and those of its first occurrence that have an earlier copy.
MARK_SCHEMA = "anchor long, segment long, check long, every array<struct<a:int,b:int>>, later array<struct<a:int,b:int>>"
#: A distinct segment with the bytes of its first occurrence; its strings begin ``low`` to ``high`` bytes before their anchor.
PART_SCHEMA = "anchor long, segment long, check long, strings int, lead int, copies long, doc_id long, text_hash long, start long, low int, high int, bytes binary"


def place(start: str = "start") -> Column:
    """Where a segment is, for comparisons."""
    return F.struct(F.col("doc_id").isNull().alias("null_id"), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash"), F.col(start).alias("start"))


def marked(rows: list[dict], length: int) -> pa.RecordBatch:
    """Rows of MARK_SCHEMA for those of the representatives, whose anchors are all here, that repeat: which of their strings do, and which have an earlier copy."""
    rows = sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text_hash"], r["start"]))
    data = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8)
    strings = np.array([r["strings"] for r in rows], np.int64)
    offset = np.concatenate([[0], np.cumsum([len(r["bytes"]) for r in rows])[:-1]]).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(strings)[:-1]])
    starts = np.arange(strings.sum()) - np.repeat(first, strings) + np.repeat(offset, strings)
    previous, later = SuffixOrder(data, starts, length).factors()
    earlier = previous >= length
    every = earlier | (later >= length)
    out = []
    for r, s, n in zip(rows, first, strings):
        pair = lambda flags: [{"a": a, "b": b} for a, b in runs(flags)]
        if r["copies"] > 1 or every[s : s + n].any():
            out.append((*(r[c] for c in SAME), [{"a": 0, "b": int(n)}] if r["copies"] > 1 else pair(every[s : s + n]), pair(earlier[s : s + n])))
    columns = list(zip(*out)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), _RANGES, _RANGES))], [*SAME, "every", "later"])


def by_arrays(representatives: DataFrame, length: int) -> DataFrame:
    """Marks of representatives by suffix arrays; the anchors of a partition are taken as many at a time as ARRAY_BYTES allows."""

    def run(batches):
        held, own, size = [], [], 0
        for row in itertools.chain((r for part in sliced(batches, 1024, ARRAY_BYTES) for r in part.to_pylist()), [None]):
            if own and (row is None or row["anchor"] != own[0]["anchor"]):
                # Strings of one segment have the anchor at different places, so a segment that is alone has no repeats.
                if len(own) > 1 or own[0]["copies"] > 1:
                    held += own
                    size += sum(len(r["bytes"]) for r in own)
                own = []
                if size > ARRAY_BYTES:
                    yield marked(held, length)
                    held, size = [], 0
            own.append(row)
        if held:
            yield marked(held, length)

    return representatives.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, MARK_SCHEMA)


def shares(hot: DataFrame, length: int) -> DataFrame:
    """The segments of large anchors in SPLIT parts each, rows of PART_SCHEMA with what they are part of (``o_`` columns) and from which string on (``a``)."""
    fields = [f.strip().split() for f in PART_SCHEMA.split(",")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([*((f"o_{c}", pa.int64()) for c in SAME), ("a", pa.int32()), *((name, kinds[kind]) for name, kind in fields)])

    def run(batches):
        for part in sliced(batches, 1024, ARRAY_BYTES):
            out = []
            for r in part.to_pylist():
                edges = [r["low"] + (r["high"] + 1 - r["low"]) * k // SPLIT for k in range(SPLIT + 1)]
                for low, high in ((x, y - 1) for x, y in zip(edges[:-1], edges[1:])):
                    # String i begins lead - i bytes before the anchor.
                    first, last = max(0, r["lead"] - high), min(r["strings"] - 1, r["lead"] - low)
                    if low > high or first > last:
                        continue
                    own = r["bytes"][first : last + length]
                    shape = struct.pack("<qiiii", r["anchor"], low, high, last - first, r["lead"] - first)
                    key = xxhash.xxh64_intdigest(shape[:16] + r["bytes"][r["lead"] - low : r["lead"] + length - high])
                    same = xxhash.xxh128_digest(shape + own)
                    out.append((*(r[c] for c in SAME), first, key - (1 << 64 if key >> 63 else 0), *struct.unpack("<qq", same), last - first + 1, r["lead"] - first, r["copies"], r["doc_id"], r["text_hash"], r["start"] + first, low, high, own))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return hot.mapInArrow(run, ", ".join(f"o_{c} long" for c in SAME) + ", a int, " + PART_SCHEMA)


def decided(representatives: DataFrame, length: int, hot_segments: int) -> DataFrame:
    """Rows of MARK_SCHEMA for distinct segments with bytes, rows of PART_SCHEMA: none, one or several of a segment."""
    spark = representatives.sparkSession
    hot = representatives.where("low < high").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_segments).select("anchor")
    named = hot.limit(BROADCAST_ANCHORS + 1).collect()
    if not named:
        return by_arrays(representatives, length)
    hot = stash(hot, "hot") if len(named) > BROADCAST_ANCHORS else F.broadcast(spark.createDataFrame(named, "anchor long"))
    rest = by_arrays(representatives.join(hot, "anchor", "left_anti"), length)
    parts = stash(shares(representatives.join(hot, "anchor", "left_semi"), length), "shares")
    release_shuffles(spark)
    names = ("doc_id", "text_hash", "start")
    taken = F.min(F.struct(place().alias("place"), "strings", "lead", "low", "high", "bytes")).alias("r")
    distinct = parts.groupBy(*SAME).agg(F.sum("copies").alias("copies"), taken)
    distinct = stash(distinct.select(*SAME, "r.strings", "r.lead", "copies", *(f"r.place.{c}" for c in names), "r.low", "r.high", "r.bytes"), "parts")
    marks = stash(decided(distinct, length, hot_segments), "part_marks")
    # Back to what the parts are part of: a part that isn't the first of its kind is a later copy as a whole.
    first = distinct.select(*SAME, *(F.col(c).alias(f"r_{c}") for c in names))
    moved = lambda ranges: F.transform(ranges, lambda r: F.struct((r["a"] + F.col("a")).alias("a"), (r["b"] + F.col("a")).alias("b")))
    is_first = F.col("doc_id").eqNullSafe(F.col("r_doc_id")) & (F.col("text_hash") == F.col("r_text_hash")) & (F.col("start") == F.col("r_start"))
    owned = parts.drop("bytes", "low", "high", "lead").join(marks, [*SAME]).join(first, [*SAME])
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("strings").alias("b")))
    return rest.unionByName(owned.select(*(F.col(f"o_{c}").alias(c) for c in SAME), moved(F.col("every")).alias("every"), moved(F.when(is_first, F.col("later")).otherwise(whole)).alias("later")))


def repeated_spans(documents: DataFrame, keep: str = "none", length: int = LENGTH, gram: int = GRAM, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """(doc_id, text_hash, a, b): byte ranges, possibly overlapping, of the strings to remove."""
    if keep not in ("none", "first"):
        raise ValueError(f"keep must be 'none' or 'first', not {keep!r}")
    spark: SparkSession = documents.sparkSession
    every = stash(segment_table(documents, length, gram), "segments")
    same = (F.min("segment") == F.max("segment")) & (F.min("check") == F.max("check"))
    counts = [F.count(F.lit(1)).alias("n"), same.alias("equal")] + ([F.min(place()).alias("earliest")] if keep == "first" else [])
    # Written, so that the join reads plain shuffles on both sides and Spark can split a hot anchor's.
    anchors = stash(every.groupBy("anchor").agg(*counts).where("n > 1").drop("n"), "anchors")
    shared = stash(every.join(anchors, "anchor"), "shared")
    release_shuffles(spark)

    names = ("doc_id", "text_hash", "start")
    occurrences = shared.where("NOT equal").groupBy(*SAME)
    if keep == "first":
        distinct = occurrences.agg(F.first("strings").alias("strings"), F.first("lead").alias("lead"), F.count(F.lit(1)).alias("copies"), F.min(place()).alias("place")).select(*SAME, "strings", "lead", "copies", *(f"place.{c}" for c in names))
    else:
        # Any occurrence does; plain numbers aggregate by hash.
        distinct = occurrences.agg(F.first("strings").alias("strings"), F.first("lead").alias("lead"), F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in names))
    distinct = stash(distinct, "distinct")
    representatives = stash(with_bytes(documents, distinct, length, gram), "representatives")
    release_shuffles(spark)
    marks = stash(decided(representatives, length, hot_segments), "marks")
    drop(every, anchors, representatives)
    release_shuffles(spark)

    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("strings").alias("b")))
    equal, mixed_rows = shared.where("equal"), shared.where("NOT equal")
    if keep == "none":
        ranges = F.col("every")
    else:
        equal = equal.where(place() != F.col("earliest"))
        # The earliest occurrence of a segment is its representative; the others are later copies as a whole.
        marks = marks.join(distinct.select(*SAME, *(F.col(c).alias(f"r_{c}") for c in names)), [*SAME])
        is_first = F.col("doc_id").eqNullSafe(F.col("r_doc_id")) & (F.col("text_hash") == F.col("r_text_hash")) & (F.col("start") == F.col("r_start"))
        ranges = F.when(is_first, F.col("later")).otherwise(whole)
    found = mixed_rows.join(marks, [*SAME]).select("doc_id", "text_hash", "start", F.explode(ranges).alias("r"))
    found = found.select("doc_id", "text_hash", "start", F.col("r.a").alias("a"), F.col("r.b").alias("b"))
    spans = equal.select("doc_id", "text_hash", "start", F.lit(0).alias("a"), F.col("strings").alias("b")).unionByName(found)
    return spans.select("doc_id", "text_hash", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b") + (length - 1)).alias("b"))


def streamed(documents: DataFrame, rows: DataFrame, texts_first: bool) -> DataFrame:
    """Texts and rows that name them by (doc_id, text_hash), together in sorted partitions.

    ``kind`` is 0 for what comes first for each (doc_id, text_hash); the columns of the other kind are null.
    """
    docs = keyed(documents).withColumn("kind", F.lit(0 if texts_first else 1)).select("doc_id", "text_hash", "kind", "text")
    other = rows.withColumn("kind", F.lit(1 if texts_first else 0))
    both = docs.unionByName(other, allowMissingColumns=True)
    return both.repartition("text_hash", "doc_id").sortWithinPartitions("text_hash", "doc_id", "kind")


def with_bytes(documents: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """The wanted segments with their bytes, rows of PART_SCHEMA, cut from the texts on the executors."""
    names = [f.strip().split()[0] for f in PART_SCHEMA.split(",")][:-3]

    def run(batches):
        text = None
        for part in sliced(batches, 4096, ARRAY_BYTES):
            kinds = part.column("kind").to_numpy()
            texts, strings, starts = part.column("text"), part.column("strings").to_pylist(), part.column("start").to_pylist()
            out, at = [], []
            size = 0
            for i in range(len(kinds)):
                if not kinds[i]:
                    text = texts[i].cast(pa.binary()).as_py()
                    continue
                at.append(i)
                out.append(text[starts[i] : starts[i] + strings[i] + length - 1])
                size += len(out[-1])
                if size > ARRAY_BYTES:
                    yield cut(part, at, out)
                    out, at, size = [], [], 0
            if out:
                yield cut(part, at, out)

    def cut(part, at, out):
        own = part.take(pa.array(at, pa.int64()))
        n = len(out)
        return pa.RecordBatch.from_arrays([*(own.column(c) for c in names), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, length - gram, np.int32)), pa.array(out, pa.binary())], [*names, "low", "high", "bytes"])

    return streamed(documents, wanted, True).mapInArrow(run, PART_SCHEMA)


def remove_repeats(documents: DataFrame, keep: str = "none", length: int = LENGTH, gram: int = GRAM, hot_segments: int = HOT_SEGMENTS, texts: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``texts`` kept: the bytes that stay) for each document."""
    spans = repeated_spans(documents, keep, length, gram, hot_segments)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + texts]
    types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * texts

    def run(batches):
        key, held = None, []
        for part in sliced(batches, 4096, 8 * ARRAY_BYTES):
            kinds = part.column("kind").to_numpy()
            ids, hashes = part.column("doc_id").to_pylist(), part.column("text_hash").to_pylist()
            a, b = (part.column(c).fill_null(0).to_numpy() for c in ("a", "b"))
            docs = np.flatnonzero(kinds)
            out, at, size = [], 0, 0
            for i in [*docs.tolist(), len(kinds)]:
                # Ranges between two texts are those of the second, or begin further keys that have no text here yet.
                if i > at:
                    own = hashes[i - 1], ids[i - 1]
                    if own != key:
                        key, held = own, []
                    held.append((a[at:i], b[at:i]))
                at = i + 1
                if i == len(kinds):
                    break
                if (hashes[i], ids[i]) != key:
                    key, held = (hashes[i], ids[i]), []
                held = [merged(held)]
                text = part.column("text")[i].cast(pa.binary()).as_py()
                kept, last = [], 0
                for x, y in zip(*(v.tolist() for v in held[0])):
                    kept.append(text[last:x])
                    last = y
                kept = b"".join([*kept, text[last:]])
                out.append((ids[i], len(text), len(text) - len(kept), len(held[0][0]), hashlib.sha256(kept).hexdigest()) + (kept,) * texts)
                size += len(kept)
                if size > 8 * ARRAY_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return streamed(documents, spans, False).mapInArrow(run, schema)


def merged(ranges: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The union of byte ranges as maximal ranges in order; ranges that touch are one."""
    if not ranges:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*ranges))
    if not len(a):
        return a, b
    order = np.argsort(a, kind="stable")
    a, reach = a[order], np.maximum.accumulate(b[order])
    new = np.flatnonzero(np.concatenate([[True], a[1:] > reach[:-1]]))
    return a[new], reach[np.concatenate([new[1:] - 1, [len(a) - 1]])]
