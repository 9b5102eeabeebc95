"""SimHash near-dedup for a similarity: ball hashing over parts of a wide fingerprint, verified by Jaccard similarity.

Two documents are near copies when the sets of their five-word shingles have a Jaccard similarity of ``LEAST`` or
more. At 0.8 their fingerprints differ in about 15 % of the bits. A ball of that radius around 64 bits is too large to
hash (half of it has 8 million fingerprints), and too wide: random fingerprints meet in it. So the fingerprint has
``BITS`` bits here and small balls are hashed in several places of it. A place takes its own ``exact`` + ``BALL`` bits:
fingerprints go where their exact bits are, and there each emits all variants of its ball bits within half of
``RADIUS``. Which share a variant and differ in few of ``CHECK_WORDS`` x 64 bits are candidates. The number of exact
bits follows the number of documents, so that a place keeps about 4096 of them, and the number of places is such that a pair whose
bits differ at ``RATE`` is missed by all of them with probability ``MISS``: 28 places for 50,000 documents, 42 for
250,000, 134 for 15 million, 416 for a billion, growing as the number to the power 0.27.

Candidates that hang together are a cluster, and only within clusters is the exact similarity of the sets computed:
first of each member with the cluster's leader, then of the members that aren't similar to it with all of the cluster, in
blocks. Members that are similar to the leader are linked through it, so they needn't be compared with
each other, and a large group of near copies costs one comparison a member. Links lead to the groups of which one document stays.

Documents with equal sets are one vertex from the start. A place with more than ``PLACE_ROWS`` rows is dealt into parts by a hash
of its own, and some rows of it (leaders) go to all parts. Rows that the first leader doesn't reach then meet all rows of the place, in
blocks, so no pair that one task would find is lost.

Defined results: a null text and one without words have the empty set and are copies of each other; a text of
fewer words than a shingle is one shingle; texts of any length are taken whole; rows that are equal in doc_id and text are copies
too; an empty table stays empty. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import by_group, map_rows
from corpusloom.llm.components import connected_components
from corpusloom.llm.simhash import local_roots, masks, text_hash
from corpusloom.runtime import drop, release_shuffles, stash

SHINGLE = 5
#: Least similarity of near copies, as a fraction of whole numbers.
LEAST = (4, 5)
SEED = 42
BITS = 512
CHECK_WORDS = 4
#: Differing bits of the check words up to which a pair is a candidate; at similarity 0.8 there are 39 +- 6, at random 128 +- 8.
CHECK_BITS = 66
BALL, RADIUS = 16, 2
#: Rate of differing bits that the places are made for (0.15 at similarity 0.8, up to 0.19 where sets have few shingles), and its share of misses.
RATE, MISS = 0.17, 1e-3
LEAST_EXACT, MOST_EXACT = 2, 36
#: Documents that a place keeps, as a power of 2.
PLACE_POWER = 12
#: Rows of a place from which it is dealt into parts, and rows that go to all of them.
PLACE_ROWS = 100_000
LEADERS = 64
#: Neighbours in a run of equal variants that are compared at once.
SHIFTS = 8
#: Vertices, and shingles of them, in a block of a cluster.
BLOCK = 512
BLOCK_SHINGLES = 1 << 21
#: Rows (id and hash, some 50 bytes) up to which a list of documents is broadcast instead of shuffling texts to it.
BROADCAST_ROWS = 400_000

_VARIANTS = np.array(masks(BALL, RADIUS // 2), np.uint16)
_SALTS = np.random.default_rng(SEED).integers(1, 1 << 63, BITS // 64, np.uint64) | np.uint64(1)


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= SHINGLE:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = [0, *(ends[: n - SHINGLE] + 1).tolist()]
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :].tolist())), np.uint64, n - SHINGLE + 1))


def vertex(found: np.ndarray) -> int:
    """The number of a set of shingles, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).astype(np.int64))


def wide_fingerprint(found: np.ndarray) -> list[int]:
    """The SimHash of a set of shingles, BITS bits as signed longs: a bit is 1 if set in over half of the shingles' hashes."""
    counts = np.zeros(BITS, np.int64)
    for start in range(0, len(found), 255):
        part = found[start : start + 255, None]
        with np.errstate(over="ignore"):
            words = (part ^ (part >> np.uint64(31))) * _SALTS
            words = (words ^ (words >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            words ^= words >> np.uint64(32)
        # 255 rows of bits add up within bytes.
        counts += np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * counts > len(found), bitorder="little").view(np.int64).tolist()


def signatures(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, vertex, size, bits)"""

    def make():
        def work(rows: list) -> list:
            out = []
            for doc_id, hashed, text in rows:
                found = shingles(text)
                out.append((doc_id, hashed, vertex(found), len(found), wide_fingerprint(found)))
            return out

        return work

    return map_rows(documents.select(F.col("doc_id").cast("long"), text_hash(), F.col("text")), make, "doc_id long, text_hash long, vertex long, size long, bits array<long>")


def sets(documents: DataFrame) -> DataFrame:
    """(vertex, shingles)"""

    def make():
        def work(rows: list) -> list:
            found = [shingles(text) for (text,) in rows]
            return [(vertex(f), f.view(np.int64).tolist()) for f in found]

        return work

    return map_rows(documents.select("text"), make, "vertex long, shingles array<long>")


def places(count: int) -> tuple[int, np.ndarray]:
    """The number of exact bits for so many documents, and which bits of the fingerprint each place takes: exact ones, then the ball's."""
    exact = min(MOST_EXACT, max(LEAST_EXACT, math.ceil(math.log2(max(count, 1))) - PLACE_POWER))
    met = (1 - RATE) ** exact * sum(math.comb(BALL, k) * RATE**k * (1 - RATE) ** (BALL - k) for k in range(RADIUS + 1))
    number = math.ceil(math.log(MISS) / math.log(1 - met))
    rng = np.random.default_rng(SEED)
    return exact, np.array([rng.permutation(BITS)[: exact + BALL] for _ in range(number)])


def keys(bits: np.ndarray, exact: int, taken: np.ndarray) -> np.ndarray:
    """(places, rows): for each fingerprint (row of words) and place the place's number, its exact bits and, as the last 16 bits, its ball bits."""
    flags = np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little")
    weights = 1 << np.arange(exact + BALL, dtype=np.int64)[::-1]
    return np.stack([flags[:, own].astype(np.int64) @ weights + (np.int64(k) << (exact + BALL)) for k, own in enumerate(taken)])


def words_of(column: pa.Array) -> np.ndarray:
    """A column of fingerprints as rows of words."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def met(tails: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """For the rows of a place the smallest row of each one's candidates' component: they share a variant and differ in few check bits."""
    n = len(tails)
    variants = (tails[:, None] ^ _VARIANTS).ravel()
    order = np.argsort(variants, kind="stable")
    ordered, owner = variants[order], order // len(_VARIANTS)
    close = lambda a, b: np.bitwise_count(checks[a] ^ checks[b]).sum(1, dtype=np.int64) <= CHECK_BITS
    links = []
    for shift in range(1, min(SHIFTS, len(ordered) - 1) + 1):
        at = np.flatnonzero(ordered[shift:] == ordered[:-shift])
        if not len(at):
            break
        a, b = owner[at], owner[at + shift]
        near = close(a, b)
        links.append((a[near], b[near]))
    if not links:
        return np.arange(n)
    root = local_roots(*(np.concatenate(x) for x in zip(*links)), n)
    # Longer runs whose members don't hang together yet: each member not reached is compared with all that aren't.
    edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
    for start, stop in zip(edges[:-1], edges[1:]):
        if stop - start <= SHIFTS + 1:
            continue
        members = owner[start:stop]
        if (root[members] == root[members[0]]).all():
            continue
        left, more = members, []
        while len(left):
            stack, left = [left[0]], left[1:]
            while stack and len(left):
                own = stack.pop()
                near = close(np.full(len(left), own), left)
                more += [(own, x) for x in left[near]]
                stack += left[near].tolist()
                left = left[~near]
        if more:
            links.append(tuple(np.array(x) for x in zip(*more)))
    return local_roots(*(np.concatenate(x) for x in zip(*links)), n)


def candidates(vertices: DataFrame) -> DataFrame:
    """(u, v) links that connect candidates, from distinct (vertex, bits)."""
    exact, taken = places(vertices.count())
    columns = ["key", "vertex", *(f"check_{k}" for k in range(CHECK_WORDS))]
    schema = ", ".join(f"{c} long" for c in columns)

    def dealt(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                bits = words_of(part.column(1))
                found = keys(bits, exact, taken)
                number = part.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (found.ravel(), np.tile(number, len(taken)), *(np.tile(bits[:, k], len(taken)) for k in range(CHECK_WORDS)))], columns)

    def counted(batches):
        for batch in batches:
            if batch.num_rows:
                found, n = np.unique(keys(words_of(batch.column(1)), exact, taken) >> BALL, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["place", "n"])

    source = vertices.select("vertex", "bits")
    rows = source.mapInArrow(dealt, schema).withColumn("place", F.shiftright("key", BALL))
    large = stash(source.mapInArrow(counted, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).where(F.col("n") > PLACE_ROWS), "large")
    number = large.count()
    mark, parts_of = F.xxhash64("vertex", "place"), lambda n: F.ceil(n / PLACE_ROWS).cast("int")
    every, own = (lambda c: F.sequence(F.lit(0), F.col(c) - 1)), (lambda c: F.pmod(mark, F.col(c)).cast("int"))

    def meet(group: pa.Table) -> list[np.ndarray]:
        number = group["vertex"].to_numpy()
        checks = np.stack([group[f"check_{k}"].to_numpy() for k in range(CHECK_WORDS)], 1).view(np.uint64)
        root = met((group["key"].to_numpy() & ((1 << BALL) - 1)).astype(np.uint16), checks)
        moved, reached = np.flatnonzero(root != np.arange(len(root))), np.zeros(0, np.int64)
        lead = group["lead"].to_numpy(zero_copy_only=False)
        if (leaders := np.flatnonzero(lead >= 0)).size:
            reached = np.flatnonzero(root == root[leaders[lead[leaders].argmin()]])
        place = np.full(len(reached), group["place"][0].as_py(), np.int64)
        return [np.append(number[moved], number[reached]), np.append(number[root[moved]], number[reached]), np.append(np.full(len(moved), -1), place)]

    def meeting(rows: DataFrame) -> DataFrame:
        """(u, v, own) links, and with a place as ``own`` the vertices u that hang together with its first leader."""
        return by_group(rows.select("place", "part", "lead", *columns), ["place", "part"], meet, "u long, v long, own long")

    if not number:
        return meeting(rows.withColumns({"part": F.lit(0), "lead": F.lit(-1).cast("long")})).select("u", "v")
    parted = rows.join(F.broadcast(large) if number <= BROADCAST_ROWS else large, "place", "left").withColumn("parts", parts_of(F.coalesce(F.col("n"), F.lit(1))))
    nth = F.shiftright(mark, 7).bitwiseAND((1 << 56) - 1)
    leads = (F.col("parts") > 1) & (F.pmod(nth, F.col("n")) < LEADERS)
    first = parted.withColumn("lead", F.when(leads, nth).otherwise(-1)).withColumn("part", F.explode(F.when(leads, every("parts")).otherwise(F.array(own("parts")))))
    found = stash(meeting(first), "met")
    # Who hangs together with a place's first leader, in whatever part, needn't meet there. All others of the place meet all of it, in blocks.
    whole = parted.where("parts > 1")
    reached = found.where("own >= 0").select(F.col("own").alias("place"), F.col("u").alias("vertex")).distinct()
    rest = whole.join(reached, ["place", "vertex"], "left_anti")
    rests = stash(rest.groupBy("place").agg(parts_of(F.count(F.lit(1))).alias("rests")), "rests")
    links = found.where("own < 0").select("u", "v")
    if rests.isEmpty():
        return links
    ask = rest.join(rests, "place").withColumns({"row": own("rests"), "col": F.explode(every("parts"))})
    answer = whole.join(rests, "place").withColumns({"row": F.explode(every("rests")), "col": own("parts")})
    block = ask.unionByName(answer).withColumns({"part": F.col("row") * F.col("parts") + F.col("col"), "lead": F.lit(-1).cast("long")})
    return links.unionByName(meeting(block.dropDuplicates(["place", "part", "vertex"])).select("u", "v"))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets of shingles are near copies."""
    if min(len(a), len(b)) * LEAST[1] < max(len(a), len(b)) * LEAST[0]:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * LEAST[1] >= (len(a) + len(b) - both) * LEAST[0]


def joined(contents: list[np.ndarray], asking: np.ndarray) -> np.ndarray:
    """For sets of shingles the smallest index of each one's component, by the exact similarity of all pairs of which one is ``asking``."""
    n = len(contents)
    size = np.fromiter(map(len, contents), np.int64, n)
    ids = np.unique(np.concatenate(contents), return_inverse=True)[1] if size.any() else np.zeros(0, np.int64)
    ends = np.cumsum(size)
    mark = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
    root = np.arange(n)
    for i in np.flatnonzero(asking):
        rest = np.flatnonzero((root != root[i]) & ~(asking & (np.arange(n) < i)) & (np.minimum(size, size[i]) * LEAST[1] >= np.maximum(size, size[i]) * LEAST[0]))
        if not len(rest):
            continue
        own = ids[ends[i] - size[i] : ends[i]]
        mark[own] = True
        both = np.fromiter((np.count_nonzero(mark[ids[ends[j] - size[j] : ends[j]]]) for j in rest), np.int64, len(rest))
        mark[own] = False
        for j in rest[both * LEAST[1] >= (size[rest] + size[i] - both) * LEAST[0]]:
            low, high = sorted((root[i], root[j]))
            root[root == high] = low
    return root


def verified(clusters: DataFrame) -> DataFrame:
    """(u, v) links that connect the vertices of each cluster as all its similar pairs would, from (cluster, vertex, size, shingles)."""
    first = clusters.groupBy("cluster").agg(F.min_by("vertex", F.xxhash64("vertex")).alias("leader"))
    leaders = clusters.select("vertex", "shingles").join(first.select("cluster", F.col("leader").alias("vertex")), "vertex")
    leaders = stash(leaders.select("cluster", F.col("vertex").alias("leader"), F.col("shingles").alias("leader_shingles")), "leaders")

    def compare(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                near = [similar(np.asarray(a.values), np.asarray(b.values)) for a, b in zip(part.column(4), part.column(5))]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(near, pa.bool_())], ["cluster", "vertex", "size", "leader", "near"])

    both = clusters.join(leaders, "cluster").select("cluster", "vertex", "size", "leader", "shingles", "leader_shingles")
    compared = stash(both.mapInArrow(compare, "cluster long, vertex long, size long, leader long, near boolean"), "compared")
    near = compared.where("near AND vertex <> leader").select(F.col("vertex").alias("u"), F.col("leader").alias("v"))

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        number = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int")
        return rows.groupBy("cluster").agg(number.alias(name))

    rest = compared.where("NOT near")
    number = blocks(rest, "rests").join(blocks(compared, "alls"), "cluster")
    place = lambda c: F.pmod(F.xxhash64("vertex"), c).cast("int")
    up_to = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    number = stash(number, "blocks")
    ask = rest.select("cluster", "vertex").join(number, "cluster").select("cluster", "vertex", place("rests").alias("row"), up_to("alls").alias("col"), F.lit(True).alias("asking"))
    answer = compared.select("cluster", "vertex").join(number, "cluster").select("cluster", "vertex", up_to("rests").alias("row"), place("alls").alias("col"), F.lit(False).alias("asking"))
    # Who asks in a block doesn't answer there too.
    dealt = ask.unionByName(answer).groupBy("cluster", "row", "col", "vertex").agg(F.max("asking").alias("asking")).join(clusters.select("vertex", "shingles"), "vertex")

    def meet(group: pa.Table) -> list[np.ndarray]:
        number = group["vertex"].to_numpy()
        root = joined([np.asarray(x.values) for x in group["shingles"]], group["asking"].to_numpy())
        moved = np.flatnonzero(root != np.arange(len(root)))
        return [number[moved], number[root[moved]]]

    return near.unionByName(by_group(dealt.select("cluster", "row", "col", "vertex", "asking", "shingles"), ["cluster", "row", "col"], meet, "u long, v long"))


def few(rows: DataFrame) -> DataFrame:
    """``rows``, broadcast where they are few enough."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def keep_one(documents: DataFrame) -> DataFrame:
    """The documents, unchanged, with one of each component: that with the smallest doc_id (null last), then text hash."""
    spark, columns = documents.sparkSession, documents.columns
    place = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "text_hash")
    named = lambda rows: rows.select(F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash"))
    same = (F.col("_hash") == F.col("_text_hash")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_doc_id"))
    rows = stash(signatures(documents), "signatures")
    distinct = stash(rows.groupBy("vertex").agg(F.min(place).alias("place"), F.first("size").alias("size"), F.first("bits").alias("bits")), "vertices")
    loose = connected_components(candidates(distinct.select("vertex", "bits")))
    clusters = stash(loose.select("vertex", F.col("component").alias("cluster")).join(distinct.select("vertex", "size", "place.doc_id", "place.text_hash"), "vertex"), "clusters")
    release_shuffles(spark)

    marked = documents.withColumn("_hash", text_hash())
    repeated = stash(named(rows.groupBy("doc_id", "text_hash").count().where("count > 1")), "repeated")
    if not repeated.isEmpty():
        # Of rows that are equal in doc_id and text one stays; the limit holds before the shuffle too.
        nth = F.row_number().over(Window.partitionBy("_hash", "doc_id").orderBy(F.xxhash64(*columns)))
        once = marked.join(few(repeated), same, "left_semi").withColumn("_nth", nth).where("_nth = 1").drop("_nth")
        marked = marked.join(few(repeated), same, "left_anti").unionByName(once)
    contents = sets(marked.join(few(named(clusters)), same, "left_semi").select("text"))
    full = stash(clusters.select("cluster", "vertex", "size").join(contents, "vertex"), "sets")
    reached = connected_components(verified(full)).withColumnRenamed("vertex", "_vertex")
    drop(full)
    release_shuffles(spark)

    grouped = distinct.select("vertex", "place").join(reached, F.col("vertex") == F.col("_vertex"), "left").select("vertex", "place", F.coalesce("component", "vertex").alias("component"))
    grouped = stash(grouped, "components")
    kept = grouped.groupBy("component").agg(F.min("place").alias("kept")).select("component", "kept")
    staying = grouped.join(kept, "component").select("vertex", "kept")
    gone = rows.select("doc_id", "text_hash", "vertex").join(staying, "vertex").where(place != F.col("kept"))
    gone = stash(named(gone).distinct(), "gone")
    drop(rows, distinct, clusters, grouped)
    return marked.join(few(gone), same, "left_anti").select(*columns)
