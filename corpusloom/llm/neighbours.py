"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``TABLES`` tables hashes a vector to the bucket of cells that Gaussian projections, cut into
intervals, put it in; the number of projections grows with the logarithm of the vectors, without end. A query visits its own
bucket and perturbed buckets (some projections' intervals replaced by one next to it) in the order of estimated
success: its intervals' edges are put in order of distance, the edge of each place has an expected squared distance, and a bucket's
estimate is the sum over the edges crossed to it. The order is cut at one sum for all queries, which is calibrated: of a bounded sample of
queries the true neighbours among all vectors are found, and the sum is the least at which ``TARGET`` of them are in a visited bucket of some table.
Whether a bucket comes before the cut follows from its cells and the query's alone, so no list of buckets is made or sent, and none has a length to bound. The candidates of all
tables are merged and ranked by exact distance.

Buckets whose leading intervals are the same are in one block, so a query, most of whose buckets cross few of
those, goes to the few blocks that its cut reaches. A block larger than ``BLOCK_ROWS`` is split by the vector's hash and its
queries go to each part, so a bucket of any size is searched whole. Equal vectors are one entry with
the few smallest ids that a result can hold. Within a block, distances come from one matrix product,
of which only visited buckets count, and those near the cut are computed exactly again.
Queries that visited fewer candidates than they should return are searched exactly. So are all, where too many of the sample's neighbours are
more than one interval away in every table: no perturbation reaches them then.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor do
those whose length isn't the most frequent one, nor rows without id. Ties fall to the smaller id. An id with
several vectors is as near as its nearest. An empty table gives no rows. Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.runtime import drop, stash

TABLES = 4
LEAST_HASHES = 4
#: Interval width in standard deviations of the sample's projections.
WIDTH = 2.0
#: Bounded samples: vectors for the width, and queries whose true neighbours say where the order is cut.
SAMPLE = 4096
SAMPLE_QUERIES = 128
TARGET = 0.95
BLOCK_ROWS = 32_768
#: Blocks (12 bytes each, a block for 8,192 vectors and table) up to which their parts are broadcast.
BROADCAST_BLOCKS = 1_000_000
SEED = 2024


def hash_count(count: int) -> int:
    """Projections of a table for so many vectors: a bucket's share falls as they grow in number."""
    return max(LEAST_HASHES, round(0.75 * np.log2(max(count, 2))) - 1)


def expected(m: int) -> np.ndarray:
    """Expected squared distances, in interval widths, from a random place in ``m`` intervals to their 2 m edges, in order of distance."""
    j = np.arange(1, 2 * m + 1)
    low = j * (j + 1) / (4 * (m + 1) * (m + 2))
    rest = 2 * m + 1 - j
    return np.where(j <= m, low, 1 - rest / (m + 1) + rest * (rest + 1) / (4 * (m + 1) * (m + 2)))


class Hashes:
    """Projections and interval widths of all tables, and the probes."""

    def __init__(self, sample: np.ndarray, count: int, blocks: int):
        dim = sample.shape[1]
        self.m = hash_count(count)
        rng = np.random.default_rng(SEED)
        self.lines = rng.normal(size=(TABLES, self.m, dim))
        projected = np.einsum("tmd,nd->tnm", self.lines, sample)
        self.width = max(1e-12, WIDTH * float(projected.std()))
        self.shift = rng.uniform(0, self.width, (TABLES, 1, self.m))
        self.blocks = blocks
        # Leading intervals that name a block: about four values of each occur.
        lead = int(np.clip(round(np.log(blocks) / np.log(4)), 1, self.m))
        self.lead = lead
        self.salts = rng.integers(1, 1 << 62, lead).astype(np.uint64) | np.uint64(1)
        #: The greatest sum of expected squared distances that is visited; without end where perturbed buckets don't hold the neighbours.
        self.limit = np.inf

    def cells(self, vectors: np.ndarray, tables: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """(tables, n, m) intervals, and where in them (0 to 1) the projections are."""
        place = (np.einsum("tmd,nd->tnm", self.lines[tables], vectors) + self.shift[tables]) / self.width
        cell = np.floor(place)
        return cell.astype(np.int64), place - cell

    def sums(self, cells: np.ndarray) -> np.ndarray:
        """For rows of intervals the sums over the leading ones that name a block."""
        with np.errstate(over="ignore"):
            return (cells[..., : self.lead].astype(np.uint64) * self.salts).sum(-1, dtype=np.uint64)

    def named(self, sums: np.ndarray) -> np.ndarray:
        """Block numbers from sums."""
        with np.errstate(over="ignore"):
            mixed = (sums ^ (sums >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(20)) % np.uint64(self.blocks)).astype(np.int32)

    def worth(self, inside: np.ndarray) -> np.ndarray:
        """For rows of places inside intervals the expected squared distances of their 2 m edges (first the lower ones), by the place of each in the order of distance."""
        place = np.argsort(np.argsort(np.concatenate([inside, 1 - inside], -1), axis=-1, kind="stable"), axis=-1)
        return expected(self.m)[place]

    def reached(self, cells: np.ndarray, worth: np.ndarray) -> np.ndarray:
        """The blocks that one query's visited buckets can be in: every change of the leading intervals up to the cut."""
        sums, cost = self.sums(cells)[None], np.zeros(1)
        with np.errstate(over="ignore"):
            for j, salt in enumerate(self.salts):
                sums = np.concatenate([sums, sums - salt, sums + salt])
                cost = np.concatenate([cost, cost + worth[j], cost + worth[self.m + j]])
                sums, cost = sums[cost <= self.limit], cost[cost <= self.limit]
        return np.unique(self.named(sums))

    def visited(self, cells: np.ndarray, worth: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Whether one query visits the buckets of other cells (a row each) in its table."""
        step = others - cells
        near = np.flatnonzero((np.abs(step) <= 1).all(-1))
        step = step[near]
        out = np.zeros(len(others), bool)
        out[near] = np.where(step == -1, worth[: self.m], np.where(step == 1, worth[self.m :], 0)).sum(-1) <= self.limit
        return out

    def calibrate(self, queries: np.ndarray, neighbours: np.ndarray, owner: np.ndarray) -> None:
        """Cut the order where TARGET of the pairs (query ``owner[i]``, ``neighbours[i]``) have met."""
        cells, inside = self.cells(queries)
        theirs, _ = self.cells(neighbours)
        worth = self.worth(inside)[:, owner]
        step = theirs - cells[:, owner]
        needed = np.where(step == -1, worth[..., : self.m], np.where(step == 1, worth[..., self.m :], 0)).sum(-1)
        needed = np.where((np.abs(step) <= 1).all(-1), needed, np.inf).min(0)
        self.limit = float(np.sort(needed)[min(len(needed) - 1, int(np.ceil(TARGET * len(needed))) - 1)]) + 1e-9


def squares(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Squared distances in double precision, from one matrix product."""
    return np.maximum(0, (queries**2).sum(1)[:, None] + (vectors**2).sum(1)[None, :] - 2 * queries @ vectors.T)


def true_neighbours(entries: DataFrame, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the ``k`` nearest other entries of each of a bounded number of queries, and whose they are: one pass over all entries."""

    def run(batches):
        for batch in batches:
            own = matrix(batch.column(0))
            if not len(own):
                continue
            near = squares(queries, own)
            # The query itself isn't its neighbour.
            near[near <= 1e-12 * (1 + (queries**2).sum(1))[:, None]] = np.inf
            picked = np.argsort(near, axis=1, kind="stable")[:, :k]
            who = np.repeat(np.arange(len(queries)), picked.shape[1])
            score = near[who, picked.ravel()]
            real = np.isfinite(score)
            yield pa.RecordBatch.from_arrays([pa.array(who[real], pa.int32()), pa.array(score[real]), batch.column(0).take(pa.array(picked.ravel()[real]))], ["query", "score", "vec"])

    found = entries.select("vec").mapInArrow(run, f"query int, score double, vec {dict(entries.dtypes)['vec']}")
    place = F.row_number().over(Window.partitionBy("query").orderBy("score"))
    got = found.withColumn("place", place).where(F.col("place") <= k).select("query", "vec").toArrow()
    return matrix(got["vec"]), got["query"].to_numpy()


def valid_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vec): the vectors that take part, as floats where they are and else as doubles; all arithmetic is in double precision."""
    kind = "array<float>" if dict(embeddings.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("vec"))
    v = F.col("vec")
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0))
    size = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("vec") == (size[0]["n"] if size else -1))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long lists of numbers as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


NEAR_SCHEMA = "query_id long, score double, ids array<long>"


def block_search(queries: pa.Table, index: pa.Table, k: int, hashes: Hashes) -> pa.Table:
    """For each query its nearest visited entries of a block (all entries, where it says so): rows of NEAR_SCHEMA."""
    entries = matrix(index["vec"])
    ids = index["ids"].combine_chunks()
    least = ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets.to_numpy()[0]] if len(ids) else np.zeros(0, np.int64)
    out = ([], [], [])
    if not queries.num_rows or not len(entries):
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.list_(pa.int64()))], names=["query_id", "score", "ids"])
    t = queries["table"][0].as_py()
    theirs = hashes.cells(entries, slice(t, t + 1))[0][0]
    step = max(1, 4_000_000 // max(1, len(entries)))
    for start in range(0, queries.num_rows, step):
        part = queries.slice(start, step)
        vectors = matrix(part["vec"])
        near = squares(vectors, entries)
        cells, inside = hashes.cells(vectors, slice(t, t + 1))
        worth = hashes.worth(inside[0])
        for i, (query, whole) in enumerate(zip(part["query_id"].to_pylist(), part["whole"].to_pylist())):
            row = near[i]
            if not whole:
                row[~hashes.visited(cells[0, i], worth[i], theirs)] = np.inf
            count = int(np.isfinite(row).sum())
            if not count:
                continue
            # One more than asked for: the query's own entry may be among them. The margin covers the product's rounding.
            cut = np.partition(row, k)[k] if count > k + 1 else np.inf
            close = np.flatnonzero(row <= cut + 1e-9 * (1 + cut)) if np.isfinite(cut) else np.flatnonzero(np.isfinite(row))
            exact = np.sqrt(((entries[close] - vectors[i]) ** 2).sum(1))
            order = np.lexsort((least[close], exact))[: k + 1]
            out[0].extend([query] * len(order))
            out[1].extend(exact[order].tolist())
            out[2].extend(ids[int(j)].as_py() for j in close[order])
    return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.list_(pa.int64()))], names=["query_id", "score", "ids"])


def nearest(embeddings: DataFrame, is_query, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row for which the column ``is_query`` holds."""
    rows = stash(valid_vectors(embeddings), "vectors")
    # Only the k + 1 smallest ids of equal vectors can be in a result; the limit holds before the shuffle too.
    place = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    few = rows.distinct().withColumn("place", place).where(F.col("place") <= k + 1)
    entries = stash(few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    queries = rows.where(is_query).distinct()
    count = entries.count()
    share = min(1.0, SAMPLE / max(count, 1))
    place = F.pmod(F.xxhash64(F.col("ids")[0], F.lit(SEED)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    got = entries.where(place < share).select("vec").toArrow()
    if not got.num_rows:
        got = entries.limit(SAMPLE).select("vec").toArrow()
    if not got.num_rows:
        return entries.selectExpr("ids[0] AS query_id", "1 AS rank", "ids[0] AS vec_id", "CAST(0 AS DOUBLE) AS score")
    sample = matrix(got["vec"])
    blocks = max(2, -(-count // (BLOCK_ROWS // 4)))
    hashes = Hashes(sample, count, blocks)
    near, owner = true_neighbours(entries, sample[:SAMPLE_QUERIES], k)
    if len(near):
        hashes.calibrate(sample[:SAMPLE_QUERIES], near, owner)

    def index_rows(batches):
        for batch in batches:
            cells, _ = hashes.cells(matrix(batch.column(0)))
            for t in range(TABLES):
                block = hashes.named(hashes.sums(cells[t]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(block), t, np.int32)), pa.array(block), *batch.columns], ["table", "block", "vec", "ids"])

    def query_rows(batches):
        for batch in batches:
            cells, inside = hashes.cells(matrix(batch.column(1)))
            for t in range(TABLES):
                worth = hashes.worth(inside[t])
                blocks = [hashes.reached(cells[t, i], worth[i]) for i in range(batch.num_rows)]
                for start in range(0, batch.num_rows, 256):
                    own = blocks[start : start + 256]
                    row = pa.array(np.repeat(np.arange(start, start + len(own)), [len(b) for b in own]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(row), t, np.int32)), pa.array(np.concatenate(own)), *(c.take(row) for c in batch.columns), pa.array(np.zeros(len(row), bool))], ["table", "block", "query_id", "vec", "whole"]
                    )

    def block_rows(batches):
        for batch in batches:
            cells, _ = hashes.cells(matrix(batch.column(0)))
            for t in range(TABLES):
                block, n = np.unique(hashes.named(hashes.sums(cells[t])), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), t, np.int32)), pa.array(block), pa.array(n)], ["table", "block", "n"])

    kind = dict(entries.dtypes)["vec"]
    # The index isn't written: hashing again costs less than reading TABLES copies of the vectors.
    index = entries.select("vec", "ids").mapInArrow(index_rows, f"table int, block int, vec {kind}, ids array<long>")
    probes = queries.select("vec_id", "vec").mapInArrow(query_rows, f"table int, block int, query_id long, vec {kind}, whole boolean")
    parts = entries.select("vec").mapInArrow(block_rows, "table int, block int, n long").groupBy("table", "block").agg(F.ceil(F.sum("n") / BLOCK_ROWS).cast("int").alias("parts"))
    parts = stash(parts, "parts")
    if not np.isfinite(hashes.limit):
        probes = probes.limit(0)
    result = ranked(searched(probes, index, parts, k, hashes), k)
    return completed(result, queries, index, parts, blocks, k, hashes, (rows, entries, parts))


def searched(probes: DataFrame, index: DataFrame, parts: DataFrame, k: int, hashes: Hashes) -> DataFrame:
    """Rows of NEAR_SCHEMA from all blocks, their large ones in parts. Vectors are shuffled once, as the few numbers of blocks are broadcast."""
    if parts.count() <= BROADCAST_BLOCKS:
        parts = F.broadcast(parts)
    spread = probes.join(parts, ["table", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = index.join(parts, ["table", "block"]).withColumn("part", F.pmod(F.xxhash64("ids"), F.col("parts")).cast("int"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        return block_search(left, right, k, hashes)

    keys = ("table", "block", "part")
    return spread.select(*keys, "query_id", "vec", "whole").groupBy(*keys).cogroup(dealt.select(*keys, "vec", "ids").groupBy(*keys)).applyInArrow(search, NEAR_SCHEMA)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k nearest ids of each query, each id once, the query's own left out."""
    ids = found.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    once = ids.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def completed(result: DataFrame, queries: DataFrame, index: DataFrame, parts: DataFrame, blocks: int, k: int, hashes: Hashes, written: tuple[DataFrame, ...]) -> DataFrame:
    """``result`` with an exact search, over all blocks of one table, for queries that found fewer than ``k``; without such ones what was ``written`` goes."""
    result = stash(result, "nearest")
    have = result.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    short = stash(queries.join(have, queries["vec_id"] == have["query_id"], "left").where(F.coalesce("n", F.lit(0)) < k).select("vec_id", "vec"), "short")
    if short.isEmpty():
        drop(*written, short)
        return result
    # Each entry is in every table once, so the blocks of the first table are all entries.
    every = short.select(F.lit(0).alias("table"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.col("vec_id").alias("query_id"), "vec", F.lit(True).alias("whole"))
    exact = ranked(searched(every, index.where("table = 0"), parts.where("table = 0"), k, hashes), k)
    return result.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(exact)
