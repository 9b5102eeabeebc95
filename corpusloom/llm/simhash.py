"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint's bit is the majority of its shingles' hash bits. Two fingerprints that differ in at
most ``RADIUS`` bits have a common variant that differs from each in at most half of that, so every
fingerprint emits all variants within half the radius, and fingerprints meet where a variant is
the same. What meets is linked to the smallest of its place (a star, not all pairs), each such
pair is verified by its differing bits, and as two that share a variant are always within the
radius, stars lose no connection.

Variants are shuffled by their leading bits: a fingerprint goes to each place that its variants'
leading bits can have, once, and emits the variants with those leading bits there. A place with
too many variants for a task is split: each part takes the variants of its own hash.
Exact copies of a fingerprint are one from the start, so a group of copies costs one row for a task.

Defined results: a null text and one without words have fingerprint zero and are linked like any
other; a text of fewer words than a shingle is one shingle. Rows that repeat a doc_id keep a row each;
a null doc_id counts for no component's smallest. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import map_rows
from corpusloom.llm.components import connected_components
from corpusloom.runtime import stash

SHINGLE = 4
SEED = 42
RADIUS = 4
HALF = RADIUS // 2
BITS = 64
LEAST_PREFIX = 8
#: Variants that a task holds at once (16 bytes each, some times over).
TASK_VARIANTS = 3_000_000


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a text."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = [0, *(ends[: n - shingle] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)
    set_bits = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 1 << 14):
        part = hashes[start : start + (1 << 14)]
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view(np.uint64)[0])


def text_hash() -> Column:
    """Tells rows with one doc_id and different texts apart."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp) with the fingerprint as a signed long."""

    def make():
        def work(rows: list) -> list:
            found = np.array([fingerprint(row[2], shingle) for row in rows], np.uint64).view(np.int64).tolist()
            return [(*row[:2], fp) for row, fp in zip(rows, found)]

        return work

    return map_rows(documents.select(F.col("doc_id").cast("long"), text_hash(), F.col("text")), make, "doc_id long, text_hash long, fp long")


def masks(width: int, flips: int) -> list[int]:
    """All numbers of ``width`` bits with at most ``flips`` ones."""
    return [sum(1 << i for i in chosen) for k in range(flips + 1) for chosen in itertools.combinations(range(width), k)]


def balls(width: int, flips: int) -> int:
    return sum(math.comb(width, k) for k in range(flips + 1))


def prefix_bits(count: int) -> int:
    """Leading bits by which ``count`` fingerprints are dealt so that an even place is a small part of a task."""
    need = count * balls(BITS, HALF) / (TASK_VARIANTS / 2)
    return min(BITS // 2, max(LEAST_PREFIX, math.ceil(math.log2(max(need, 1)))))


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For vertices 0 to n - 1 with edges (a, b) the smallest vertex of each one's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == root).all():
            return root
        root = new


def meetings(fps: np.ndarray, place: int, prefix: int, part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links (fingerprint, smaller fingerprint) of those that meet in a part of a place.

    ``fps`` are distinct unsigned fingerprints whose leading ``prefix`` bits are within HALF of ``place``.
    """
    rest = BITS - prefix
    fps = np.sort(fps)
    lead = fps >> np.uint64(rest)
    used = np.bitwise_count(lead ^ np.uint64(place))
    tail = fps & np.uint64((1 << rest) - 1)
    found, owner = [], []
    for flips in range(HALF + 1):
        at = np.flatnonzero(used == HALF - flips)
        if not len(at):
            continue
        every = np.array(masks(rest, flips), np.uint64)
        step = max(1, (1 << 20) // len(at))
        for start in range(0, len(every), step):
            variants = (tail[at][:, None] ^ every[None, start : start + step]).ravel()
            owners = np.repeat(at.astype(np.int32), min(step, len(every) - start))
            if parts > 1:
                with np.errstate(over="ignore"):
                    own = ((variants * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(parts) == part
                variants, owners = variants[own], owners[own]
            found.append(variants)
            owner.append(owners)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    variants, owners = np.concatenate(found), np.concatenate(owner)
    del found, owner
    ordered = np.sort(variants)
    shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(shared):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    at = np.searchsorted(shared, variants)
    at[at == len(shared)] = 0
    hit = np.flatnonzero(shared[at] == variants)
    group, member = at[hit], owners[hit].astype(np.int64)
    least = np.full(len(shared), len(fps), np.int64)
    np.minimum.at(least, group, member)
    first = least[group]
    close = np.bitwise_count(fps[member] ^ fps[first]) <= RADIUS
    member, first = member[close], first[close]
    root = local_roots(member, first, len(fps))
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return fps[moved], fps[root[moved]]


def links(distinct: DataFrame, count: int) -> DataFrame:
    """(u, v) links that connect the distinct fingerprints ``fp`` exactly as all pairs within the radius would."""
    prefix = prefix_bits(count)
    rest = BITS - prefix
    lead = F.shiftrightunsigned("fp", rest)
    dealt = distinct.select("fp", F.explode(F.transform(F.array(*(F.lit(m).cast("long") for m in masks(prefix, HALF))), lambda m: F.struct(lead.bitwiseXOR(m).alias("place"), F.bit_count(m).alias("flips")))).alias("to"))
    dealt = dealt.select("fp", "to.place", "to.flips")
    weight = F.element_at(F.array(*(F.lit(balls(rest, HALF - k)).cast("long") for k in range(HALF + 1))), F.col("flips") + 1)
    large = dealt.groupBy("place").agg(F.sum(weight).alias("variants")).where(F.col("variants") > TASK_VARIANTS)
    large = large.select("place", F.ceil(F.col("variants") / TASK_VARIANTS).cast("int").alias("parts"))
    rows = dealt.join(large, "place", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.select("place", "fp", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def meet(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        u, v = meetings(group["fp"].to_numpy().view(np.uint64), key[0].as_py(), prefix, key[1].as_py(), group["parts"][0].as_py())
        return pa.table({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

    return rows.groupBy("place", "part").applyInArrow(meet, "u long, v long")


def classes(documents: DataFrame, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, fp), and for each fingerprint (fp, component, least): its component and the smallest doc_id it has."""
    rows = stash(fingerprints(documents, shingle), "fingerprints")
    distinct = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = connected_components(links(distinct.select("fp"), distinct.count()))
    return rows, distinct.join(found.withColumnRenamed("vertex", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id): 16 hex digits and the smallest doc_id that links lead to."""
    rows, reached = classes(documents, shingle)
    smallest = reached.groupBy("component").agg(F.min("least").alias("component_id"))
    named = reached.select("fp", "component").join(smallest, "component").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
