"""Embeddings and exact inner-product search for a table of queries."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from corpusloom.operators.bm25 import split_words, top
from corpusloom.runtime import stash

SCORE_DIGITS = 6
HASH_DIM = 64
#: Words whose places an encoder remembers: the first that come, among which are the frequent ones.
KNOWN_WORDS = 250_000
#: Queries that are sent to where vectors are read, and of a block where there are more.
QUERY_BLOCK = 4096


def l2_normalize(vector: Column) -> Column:
    """The vector over its Euclidean length, in double precision; a zero vector stays."""
    v = vector.cast("array<double>")
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(size > 0, F.transform(v, lambda x: x / size)).otherwise(v)


def hash_bucket(term: str, dim: int = HASH_DIM) -> int:
    """The place of a term in a hashed bag of words."""
    return int(hashlib.md5(term.encode()).hexdigest()[:4], 16) % dim


def hashing_encoder(dim: int = HASH_DIM) -> Callable[[list[str]], np.ndarray]:
    """An encoder without a model: counts of hashed lower-case words, unit length."""
    known: dict[bytes, int] = {}

    def encode(texts: list[str]) -> np.ndarray:
        words, lengths = split_words(pa.array([t.lower() for t in texts], pa.large_string()))
        found = words.dictionary_encode()
        # As in :func:`hash_bucket`, for each distinct word of the texts.
        distinct = found.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        place = np.array([known.get(w, -1) for w in distinct], np.int64)
        new = np.flatnonzero(place < 0)
        hashes = b"".join([hashlib.md5(distinct[i], usedforsecurity=False).digest()[:2] for i in new.tolist()])
        place[new] = np.frombuffer(hashes, ">u2").astype(np.int64) % dim
        known.update((distinct[i], p) for i, p in zip(new[: KNOWN_WORDS - len(known)].tolist(), place[new].tolist()))
        places = place[found.indices.to_numpy()]
        out = np.bincount(np.repeat(np.arange(len(texts)), lengths) * dim + places, minlength=len(texts) * dim).reshape(-1, dim).astype(float)
        length = np.sqrt((out * out).sum(1, keepdims=True))
        return out / np.where(length > 0, length, 1)

    encode.batch = 1024
    return encode


def embed(rows: DataFrame, id_col: str, text_col: str, make_encoder: Callable[[], Callable[[list[str]], np.ndarray]] = hashing_encoder, prefix: str = "", batch: int = 32, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, embedding and the columns to ``keep``): ``make_encoder`` runs once for a task, its result on ``batch`` prefixed texts at a time, or as many as its attribute ``batch`` says."""
    id_type = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        size = getattr(encode, "batch", batch)
        for part in batches:
            vectors = []
            for start in range(0, part.num_rows, size):
                vectors.append(pa.array(list(encode([prefix + (t or "") for t in part.column(1).slice(start, size).to_pylist()])), pa.list_(pa.float64())))
            if vectors:
                yield pa.RecordBatch.from_arrays([part.column(0), pa.concat_arrays(vectors), *part.columns[2:]], ["id", "embedding", *keep])

    more = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(F.col(id_col).alias("id"), F.col(text_col), *keep).mapInArrow(run, f"id {id_type}, embedding array<double>{more}")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "id", query_id: str = "query_id", by: str | None = None) -> DataFrame:
    """(query_id, id, score, rank0): the ``k`` greatest inner products of each query, exactly; with ``by`` (a column of ``vectors``) of each of its values.

    Up to ``QUERY_BLOCK`` queries go to where the vectors are read. More stay tables: queries are cut into blocks, vectors dealt to tiles, and a
    block meets a tile in one task. Either way queries meet a batch of vectors in one matrix product, and a task gives on at most ``k`` rows
    of each query (and value of ``by``), once. Vectors of another length than the queries' are an error.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    id_type, query_type = vectors.schema[id_col].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    schema = f"query_id {query_type}, id {id_type}, score double" + (f", {by} string" if by else "")
    value = F.col(by).cast("string") if by else F.lit(None).cast("string")
    source = vectors.select(F.col(id_col).alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), value.alias("value")).where("embedding IS NOT NULL")
    few = asked.limit(QUERY_BLOCK + 1).collect()
    if not few:
        return asked.sparkSession.createDataFrame([], schema + ", rank0 int")
    if len(few) <= QUERY_BLOCK:
        ids, matrix = [r["query_id"] for r in few], np.array([r["embedding"] for r in few], float)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(ids, matrix, k)
            for batch in batches:
                best.add(batch)
            yield from best.rows(arrow)

        rows = source
    else:
        rows, run = tiled(asked, source), lambda batches: _tiles(batches, k, arrow)
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return top(rows.mapInArrow(run, schema), k, ("query_id", by) if by else ("query_id",))


def tiled(asked: DataFrame, source: DataFrame) -> DataFrame:
    """Queries and vectors by (block, tile), the queries of each first."""
    spark, place = asked.sparkSession, lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    asked = stash(asked, "queries")
    blocks, tiles = -(-asked.count() // QUERY_BLOCK), max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(place("query_id", blocks).alias("block"), each(tiles).alias("tile"), F.lit(0).alias("kind"), "query_id", "embedding")
    right = source.select(each(blocks).alias("block"), place("id", tiles).alias("tile"), F.lit(1).alias("kind"), "id", "embedding", "value")
    rows = left.unionByName(right, allowMissingColumns=True)
    return rows.repartition("block", "tile").sortWithinPartitions("block", "tile", "kind")


class Best:
    """The ``k`` best vectors of each of some queries, by value, equal scores by the smaller id."""

    def __init__(self, ids: list, matrix: np.ndarray, k: int):
        self.ids, self.matrix, self.k = ids, matrix, k
        #: value -> the least score that counts, and the (-score, id) held, for each query.
        self.held: dict = {}

    def add(self, batch: pa.RecordBatch) -> None:
        if not batch.num_rows:
            return
        column, names = batch.column("embedding"), batch.column("id").to_pylist()
        own = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        if own.shape[1] != self.matrix.shape[1]:
            raise ValueError(f"vectors have {own.shape[1]} numbers, queries {self.matrix.shape[1]}")
        values = batch.column("value")
        for value in values.unique():
            at = np.flatnonzero((pc.equal(values, value) if value.is_valid else pc.is_null(values)).to_numpy(zero_copy_only=False))
            floors, held = self.held.setdefault(value.as_py(), (np.full(len(self.ids), -np.inf), [[] for _ in self.ids]))
            for start in range(0, len(self.ids), 256):
                scores = np.round(self.matrix[start : start + 256] @ own[at].T, SCORE_DIGITS)
                if len(at) > self.k:
                    # No row below a batch's own k best counts.
                    cut = np.partition(scores, len(at) - self.k, axis=1)[:, len(at) - self.k]
                    counts = scores >= np.maximum(cut, floors[start : start + 256])[:, None]
                else:
                    counts = scores >= floors[start : start + 256][:, None]
                for i in np.flatnonzero(counts.any(1)).tolist():
                    new = np.flatnonzero(counts[i])
                    kept = heapq.nsmallest(self.k, held[start + i] + [(-s, names[j]) for s, j in zip(scores[i, new].tolist(), at[new].tolist())])
                    held[start + i] = kept
                    if len(kept) == self.k:
                        floors[start + i] = -kept[-1][0]

    def rows(self, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
        for value, (_, held) in self.held.items():
            for start in range(0, len(self.ids), 1024):
                found = [(self.ids[start + i], name, -score, value) for i, rows in enumerate(held[start : start + 1024]) for score, name in rows]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), arrow)], schema=arrow)


def _tiles(batches: Iterator[pa.RecordBatch], k: int, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of :func:`tiled`: of each block and tile the queries are held, then its vectors pass by."""
    key, best, queries = None, None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        block, tile, kind = (batch.column(c).to_numpy() for c in ("block", "tile", "kind"))
        edges = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(tile) != 0) | (np.diff(kind) != 0)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(edges[:-1], edges[1:]):
            part = batch.slice(start, stop - start)
            if (block[start], tile[start]) != key:
                if best is not None:
                    yield from best.rows(arrow)
                key, best, queries = (block[start], tile[start]), None, []
            if kind[start] == 0:
                queries.append(part)
            elif queries or best is not None:
                if best is None:
                    table = pa.Table.from_batches(queries).combine_chunks()
                    best = Best(table["query_id"].to_pylist(), np.array(table["embedding"].to_pylist(), float), k)
                    queries = []
                best.add(part)
    if best is not None:
        yield from best.rows(arrow)
