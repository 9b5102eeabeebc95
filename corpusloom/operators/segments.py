"""An index as written segments and numbered snapshots of them.

A segment is written once and never changed: inverted lists of its chunks, vectors, texts with their metadata, what it adds to (or takes from)
document frequencies and sizes, and the ids of earlier chunks that it replaces or deletes (found by ids alone, and read from the texts by id). A snapshot is a small record that names segments;
it is created only if its number isn't there yet, so a reader has one snapshot whole whatever builds meanwhile, of two builders on
the same snapshot one is told, and what is broken off before its record is as if it hadn't begun.

Segments of like size are merged when there are ``FANOUT`` of them, so there are few however many batches came, and a chunk is
written anew a number of times that grows with the logarithm of the index. Merging encodes no text and counts no words.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.operators import bm25, dense, texts
from corpusloom.operators.fingerprints import row_hash
from corpusloom.runtime import create_once, discard, list_names, read_text, size_batches, stash

#: Segments of one size class that are merged; also the ratio of sizes between classes.
FANOUT = 4
#: Chunks up to which segments are of the lowest class.
SMALL = 1000
#: Seconds that a segment no snapshot names is left alone, as its builder may be about to name it.
GRACE_S = 24 * 3600


class ConcurrentBuildError(RuntimeError):
    """Another builder has made the next snapshot meanwhile."""


@dataclass(frozen=True)
class Segment:
    name: str
    chunks: int
    folders: int
    #: How many ids of earlier segments it makes void.
    gone: int
    #: (category, chunks, words) that it adds; less than none where it makes more void.
    sizes: tuple[tuple[str, int, int], ...]
    #: Table -> its columns, so that opening an index reads no file.
    schemas: dict[str, str]


@dataclass(frozen=True)
class Snapshot:
    number: int
    segments: tuple[Segment, ...]
    #: What the index is of (see :class:`corpusloom.operators.lifecycle.Manifest`).
    manifest: dict
    #: Name of the folder of document frequencies, or of the only segment, which has them; the corpus statistics (namespace, chunks, average length), and (namespace, mean idf).
    statistics: str
    corpus: tuple[tuple[str, int, float], ...]
    means: tuple[tuple[str, float], ...]
    #: Exclusive-or (as text), sum (as text) and number of the row hashes.
    rows: tuple[str, str, int]
    #: Batches of a stream that are in it.
    batch: int = -1
    #: Name of the folder that says what is known of each input file.
    files: str | None = None


def latest(spark: SparkSession, path: str) -> Snapshot | None:
    """The newest snapshot below ``path``."""
    numbers = [name for name, _ in list_names(spark, f"{path}/snapshots") if name.endswith(".json")]
    return read_snapshot(spark, path, int(max(numbers)[:-5])) if numbers else None


def read_snapshot(spark: SparkSession, path: str, number: int) -> Snapshot:
    got = json.loads(read_text(spark, f"{path}/snapshots/{number:010d}.json"))
    if "means" not in got:
        raise ValueError(f"the index at {path} was written in an older form; build it anew at another place")
    pairs = lambda rows: tuple(tuple(r) for r in rows)
    parts = tuple(Segment(**s | {"sizes": pairs(s["sizes"])}) for s in got["segments"])
    return Snapshot(**got | {"segments": parts, "rows": tuple(got["rows"]), "corpus": pairs(got["corpus"]), "means": pairs(got["means"])})


def commit(spark: SparkSession, path: str, snapshot: Snapshot) -> Snapshot:
    if not create_once(spark, f"{path}/snapshots/{snapshot.number:010d}.json", json.dumps(asdict(snapshot), sort_keys=True)):
        raise ConcurrentBuildError(f"snapshot {snapshot.number} of {path} has been made by another builder")
    return snapshot


@dataclass
class Opened:
    """The tables of a snapshot. ``chunks`` (segment, slice, category, id, dl, h) and ``vectors`` (segment, id, embedding, category, key) are without void rows."""

    snapshot: Snapshot
    chunks: DataFrame
    vectors: DataFrame
    texts: texts.TextStore
    sparse: bm25.SparseIndex


def _at(path: str, segment: Segment | str) -> str:
    return f"{path}/segments/{segment if isinstance(segment, str) else segment.name}"


def _union(parts: list[DataFrame]) -> DataFrame:
    rows = parts[0]
    for other in parts[1:]:
        rows = rows.unionByName(other, allowMissingColumns=True)
    return rows


def _table(spark: SparkSession, path: str, segment: Segment, name: str) -> DataFrame:
    return spark.read.schema(StructType.fromJson(json.loads(segment.schemas[name]))).parquet(f"{_at(path, segment)}/{name}")


def _read(spark: SparkSession, path: str, segments: tuple[Segment, ...], name: str) -> DataFrame:
    """A table of all segments with its number in ``segment``."""
    return _union([_table(spark, path, s, name).withColumn("segment", F.lit(i)) for i, s in enumerate(segments)])


def gone_ids(spark: SparkSession, path: str, segments: tuple[Segment, ...]) -> DataFrame | None:
    """(id, upto): chunks that count no more in segments before number ``upto``."""
    found = [spark.read.schema(bm25.listed_chunks(_table(spark, path, s, "blocks")).select("id").schema).parquet(f"{_at(path, s)}/gone").select("id", F.lit(i).alias("upto")) for i, s in enumerate(segments) if s.gone]
    return _union(found) if found else None


def text_store(spark: SparkSession, path: str, segments: tuple[Segment, ...], gone: DataFrame | None) -> texts.TextStore:
    return texts.TextStore([(i, s.folders, _table(spark, path, s, "texts")) for i, s in enumerate(segments)], gone)


def open_snapshot(spark: SparkSession, path: str, snapshot: Snapshot) -> Opened:
    segments = snapshot.segments
    gone = gone_ids(spark, path, segments)
    corpus = bm25.corpus_table(spark, snapshot.corpus)
    terms = bm25.term_table(_statistics(spark, path, segments, snapshot.statistics), corpus, snapshot.means)
    blocks = _read(spark, path, segments, "blocks")
    chunks, vectors = (bm25.living(rows, gone) for rows in (bm25.listed_chunks(blocks), _read(spark, path, segments, "vectors")))
    return Opened(snapshot, chunks, vectors, text_store(spark, path, segments, gone), bm25.SparseIndex(blocks, terms, corpus, gone))


def content_key(model: str, prefix: str, text: Column | str) -> Column:
    """What a vector depends on: model, prefix and text, as 128 bits."""
    return F.md5(F.concat_ws("\x1f", F.lit(model), F.lit(prefix), F.coalesce(text, F.lit(""))).cast("binary"))


def embed_new(rows: DataFrame, known: DataFrame | None, model: str, prefix: str, make_encoder: Callable) -> DataFrame:
    """(id, embedding, category, key) of chunks; texts whose vector ``known`` (key, embedding) has are not encoded again."""
    keyed = rows.select("chunk_id", "text", "category", content_key(model, prefix, F.col("text")).alias("key"))
    if known is None:
        return dense.embed(keyed, "chunk_id", "text", make_encoder, prefix, keep=("category", "key"))
    # Keys alone first: vectors are read only where there are some to take.
    hits = stash(known.select("key").join(keyed.select("key"), "key", "left_semi").distinct(), "known-keys")
    if hits.isEmpty():
        return embed_new(rows, None, model, prefix, make_encoder)
    taken = known.select("key", "embedding").join(hits, "key").dropDuplicates(["key"])
    new = dense.embed(keyed.join(hits, "key", "left_anti"), "chunk_id", "text", make_encoder, prefix, keep=("category", "key"))
    return new.unionByName(keyed.join(taken, "key").select(F.col("chunk_id").alias("id"), "embedding", "category", "key"))


def hash_sums(chunks: DataFrame) -> tuple[int, int, int]:
    got = chunks.agg(F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).first()
    return got["x"] or 0, int(got["s"] or 0), got["n"]


def write_blocks(blocks: DataFrame, at: str) -> tuple[DataFrame, dict[str, str]]:
    """Blocks written and read back, and their columns."""
    rows = blocks.drop("segment")
    bm25.write_blocks(rows, f"{at}/blocks")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{at}/blocks"), {"blocks": rows.schema.json()}


def write_vectors(vectors: DataFrame, at: str) -> dict[str, str]:
    vectors.write.partitionBy("category").parquet(f"{at}/vectors")
    return {"vectors": vectors.schema.json()}


def write_segment(chunks: DataFrame, path: str, model: str, prefix: str, make_encoder: Callable, base: Opened | None = None, deleted: DataFrame | None = None, known: DataFrame | None = None, count: int | None = None) -> tuple[Segment, tuple[int, int, int]]:
    """A segment of ``chunks``, and what it changes of the snapshot's row hashes: exclusive-or, sum, number.

    Over ``base`` it makes void the base's chunks of the same ids, and those of the ids in ``deleted`` (id). Vectors that ``known``
    (key, embedding) has for a text are taken from there. ``count`` is how many chunks there are about, if that is known.
    """
    spark, name = chunks.sparkSession, uuid.uuid4().hex
    # Tasks hold a batch of whole texts, whatever the session has read before.
    size_batches(spark)
    at = _at(path, name)
    filled = F.coalesce(F.when(F.col("category") != "", F.col("category")), F.lit("unknown"))
    # The hash is of the row as it came, before its category is filled.
    hashed = chunks.withColumn(texts.HASH, row_hash(chunks)).withColumn("category", filled)
    # The source is read once; all else is made of the texts as they were written, in an order that a repeated task finds again.
    folders = texts.folders_for(hashed.count() if count is None else count)
    schemas = {"texts": texts.write_texts(hashed, f"{at}/texts", folders)}
    rows = spark.read.schema(StructType.fromJson(json.loads(schemas["texts"]))).parquet(f"{at}/texts")
    count_of = lambda frame: bm25.make_blocks(frame, category_col="category", hash_col=texts.HASH)
    blocks, columns = write_blocks(count_of(rows), at)
    chunks_of = bm25.listed_chunks(blocks)
    x, s, n = hash_sums(chunks_of)
    count, df, sizes, void = n, bm25.frequencies(blocks), bm25.sizes(blocks), 0
    if base is not None:
        ids = chunks_of.select("id")
        if deleted is not None:
            ids = ids.unionByName(deleted.select(F.col("id").cast(dict(chunks_of.dtypes)["id"]).alias("id")))
        # Ids alone first; the chunks that are made void are then looked up.
        gone = base.chunks.select("id").join(ids, "id", "left_semi")
        gone.write.parquet(f"{at}/gone")
        found = base.texts.lookup(spark.read.schema(gone.schema).parquet(f"{at}/gone"), hashes=True)
        old = stash(count_of(found), "void-chunks")
        old_x, old_s, void = hash_sums(bm25.listed_chunks(old))
        x, s, n = x ^ old_x, s - old_s, n - void
        df = df.unionByName(bm25.frequencies(old).withColumn("df", -F.col("df")))
        sizes = [*sizes, *((name, -m, -words) for name, m, words in bm25.sizes(old))]
    bm25.totals(df).where("df <> 0").write.parquet(f"{at}/frequencies")
    schemas |= columns | write_vectors(embed_new(rows, known, model, prefix, make_encoder), at)
    return Segment(name, count, folders, void, added(sizes), schemas), (x, s, n)


def added(sizes: list[tuple[str, int, int]]) -> tuple[tuple[str, int, int], ...]:
    out: dict[str, tuple[int, int]] = {}
    for name, n, words in sizes:
        old = out.get(name, (0, 0))
        out[name] = (old[0] + n, old[1] + words)
    return tuple((name, n, words) for name, (n, words) in sorted(out.items()))


FREQUENCIES = "namespace string, term string, df long"


def _frequencies(spark: SparkSession, path: str, segments: tuple[Segment, ...]) -> DataFrame:
    return _union([spark.read.schema(FREQUENCIES).parquet(f"{_at(path, s)}/frequencies") for s in segments])


def write_statistics(spark: SparkSession, path: str, segments: tuple[Segment, ...]) -> dict:
    """Statistics over all segments, from what each adds and takes, as a snapshot names them. The frequencies of a single segment are those of the index, as it makes nothing void."""
    corpus = bm25.corpus_statistics([size for s in segments for size in s.sizes])
    if len(segments) == 1:
        name = segments[0].name
    else:
        name, df = uuid.uuid4().hex, _frequencies(spark, path, segments)
        df.groupBy("namespace", "term").agg(F.sum("df").alias("df")).where("df > 0").write.parquet(f"{path}/statistics/{name}")
    means = bm25.mean_idf(_statistics(spark, path, segments, name), bm25.corpus_table(spark, corpus))
    return {"statistics": name, "corpus": tuple(corpus), "means": tuple(means)}


def _statistics(spark: SparkSession, path: str, segments: tuple[Segment, ...], name: str) -> DataFrame:
    """(namespace, term, df) of a snapshot."""
    return _frequencies(spark, path, segments) if len(segments) == 1 else spark.read.schema(FREQUENCIES).parquet(f"{path}/statistics/{name}")


def size_class(segment: Segment) -> int:
    return max(0, math.ceil(math.log(max(segment.chunks, 1) / SMALL, FANOUT)))


def to_merge(segments: tuple[Segment, ...]) -> int | None:
    """From which segment on all are merged: the latest ``FANOUT`` or more of a class, with smaller ones among them."""
    for start in range(len(segments)):
        if len(segments) - start >= FANOUT and size_class(segments[start]) >= max(map(size_class, segments[start:])) and sum(size_class(s) == size_class(segments[start]) for s in segments[start:]) >= FANOUT:
            return start
    return None


def merge(spark: SparkSession, path: str, segments: tuple[Segment, ...], start: int) -> tuple[Segment, ...]:
    """The segments from ``start`` on as one, without their void chunks."""
    name, run = uuid.uuid4().hex, segments[start:]
    at, gone = _at(path, name), gone_ids(spark, path, segments[start:])
    blocks = _read(spark, path, run, "blocks")
    if gone is not None:
        chunks = bm25.listed_chunks(blocks).select("segment", "slice", "id")
        void = chunks.join(gone.withColumnRenamed("id", "_id"), (F.col("id") == F.col("_id")) & (F.col("segment") < F.col("upto")), "left_semi")
        blocks = bm25.without(blocks, void)
    # Slices stay as they are; two that got one number would only share a bound.
    written, schemas = write_blocks(blocks.withColumn("slice", F.xxhash64("segment", "slice", F.lit(name))), at)
    _frequencies(spark, path, run).groupBy("namespace", "term").agg(F.sum("df").alias("df")).where("df <> 0").write.parquet(f"{at}/frequencies")
    schemas |= write_vectors(bm25.living(_read(spark, path, run, "vectors"), gone).drop("segment"), at)
    count = bm25.listed_chunks(written).count()
    folders = texts.folders_for(count)
    schemas["texts"] = texts.write_texts(text_store(spark, path, run, gone).rows(hashes=True), f"{at}/texts", folders)
    void = 0
    if gone is not None and start:
        # Ids that a segment before the merged ones may have.
        gone.select("id").distinct().write.parquet(f"{at}/gone")
        void = sum(s.gone for s in run)
    return (*segments[:start], Segment(name, count, folders, void, added([size for s in run for size in s.sizes]), schemas))


def vacuum(spark: SparkSession, path: str, keep: int = 1, grace_s: float = GRACE_S) -> list[str]:
    """Delete all but the ``keep`` newest snapshots, and what none of these names and is older than ``grace_s`` seconds. Returns the names deleted."""
    records = [name for name, _ in list_names(spark, f"{path}/snapshots") if name.endswith(".json")]
    kept = [read_snapshot(spark, path, int(name[:-5])) for name in records[-keep:]]
    used = {s.name for snapshot in kept for s in snapshot.segments} | {x for snapshot in kept for x in (snapshot.statistics, snapshot.files)}
    old, gone = (time.time() - grace_s) * 1000, []
    for name in records[:-keep]:
        discard(spark, f"{path}/snapshots/{name}")
    for folder in ("segments", "statistics", "files"):
        for name, changed in list_names(spark, f"{path}/{folder}"):
            if name not in used and changed <= old:
                discard(spark, f"{path}/{folder}/{name}")
                gone.append(name)
    return gone
