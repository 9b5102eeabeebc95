"""Index builds: manifests, freshness, verification and resuming."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import fixed
from corpusloom.operators import bm25, dense, fingerprints, segments
from corpusloom.operators.texts import TextStore
from corpusloom.runtime import path_exists, stash

INDEX_VERSION = "1"
LEAST_CHUNKS = 10


class IndexStaleError(RuntimeError):
    """A stored index doesn't belong to the corpus or configuration at hand."""


class ResumeMismatchError(RuntimeError):
    """Stored rows aren't a prefix of the corpus."""


@dataclass(frozen=True)
class Manifest:
    corpus_fingerprint: str
    config_fingerprint: str
    embedding_model: str
    sac_enabled: bool
    document_prefix: str
    index_version: str
    chunk_count: int


def corpus_fingerprint(chunks: DataFrame) -> str:
    """A fingerprint of the rows, whatever their order: exclusive-or and sum of row hashes, and the count."""
    return fingerprints.of_rows(chunks)[0]


def config_fingerprint(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()


def manifest_of(chunks: DataFrame | None, model: str, with_summary: bool, known: tuple[str, int] | None = None) -> Manifest:
    """The manifest of an index of ``chunks``; where fingerprint and number of the rows are ``known``, no row is read."""
    prefix = fixed.DOCUMENT_PREFIX if "nomic" in model else ""
    config = {"embedding_model": model, "sac_enabled": with_summary, "document_prefix": prefix, "index_version": INDEX_VERSION}
    found, count = known or fingerprints.of_rows(chunks)
    return Manifest(found, config_fingerprint(config), model, with_summary, prefix, INDEX_VERSION, count)


def read_manifest(spark: SparkSession, path: str) -> Manifest | None:
    """The manifest of the index below ``path``, None where there is none."""
    snapshot = segments.latest(spark, path)
    return Manifest(**snapshot.manifest) if snapshot else None


def is_fresh(stored: Manifest | None, wanted: Manifest) -> bool:
    return stored == wanted


def require_fresh(stored: Manifest | None, wanted: Manifest) -> None:
    if stored is None:
        raise IndexStaleError("there is no index")
    wrong = [k for k, v in asdict(wanted).items() if getattr(stored, k) != v]
    if wrong:
        raise IndexStaleError("the index differs in " + ", ".join(wrong))


def store_projection(chunks: DataFrame) -> DataFrame:
    """Chunks without their texts, one row for each id."""
    return chunks.drop("text", "original_text").dropDuplicates(["chunk_id"])


@dataclass
class StoredIndex:
    """A built index read back: vectors (id, embedding, category), sparse index, texts by id, manifest."""

    vectors: DataFrame
    sparse: bm25.SparseIndex
    texts: TextStore
    manifest: Manifest
    snapshot: segments.Snapshot

    @property
    def store(self) -> DataFrame:
        """The chunks without their texts, one row for each id; of the files with the texts, the other columns alone are read."""
        return self.texts.rows().drop("text", "original_text")


def build_index(
    chunks: DataFrame, path: str, model: str = "hashing", with_summary: bool = False, make_encoder=dense.hashing_encoder, force: bool = False, known: tuple[str, int] | None = None, files: str | None = None,
) -> Manifest:
    """A snapshot below ``path`` with all ``chunks`` in one segment: store, vectors, texts, terms and statistics of each category and of all together.

    An index that is fresh is left alone, and texts that the last snapshot has vectors of, under the same model and prefix, are not
    encoded again, whatever else changed. Who reads the last snapshot goes on reading it; if another builder makes a snapshot
    meanwhile, :class:`segments.ConcurrentBuildError` says so. ``known`` is as in :func:`manifest_of`.
    """
    spark = chunks.sparkSession
    wanted = manifest_of(chunks, model, with_summary, known)
    if wanted.chunk_count < LEAST_CHUNKS:
        raise ValueError(f"{wanted.chunk_count} chunks are fewer than {LEAST_CHUNKS}")
    last = segments.latest(spark, path)
    if not force and last is not None and is_fresh(Manifest(**last.manifest), wanted):
        return wanted
    have = None if force or last is None else segments.open_snapshot(spark, path, last).vectors
    made, (x, s, n) = segments.write_segment(chunks, path, model, wanted.document_prefix, make_encoder, known=have, count=wanted.chunk_count)
    statistics = segments.write_statistics(spark, path, (made,))
    segments.commit(spark, path, segments.Snapshot(last.number + 1 if last else 1, (made,), asdict(wanted), rows=(str(x), str(s), n), files=files, **statistics))
    return wanted


def build_from_files(spark: SparkSession, source: str, read: Callable[[list[str]], DataFrame], path: str, **options) -> Manifest:
    """:func:`build_index` of what ``read`` makes of the files below ``source``.

    What is known of each file is kept beside the index, so a check that finds no new file reads none.
    """
    last = segments.latest(spark, path)
    kept = spark.read.parquet(f"{path}/files/{last.files}") if last is not None and last.files else None
    parts = stash(fingerprints.of_files(spark, source, read, kept), "files")
    known = fingerprints.of_parts(parts)
    wanted = manifest_of(None, options.get("model", "hashing"), options.get("with_summary", False), known)
    if last is not None and not options.get("force") and is_fresh(Manifest(**last.manifest), wanted):
        return wanted
    name = uuid.uuid4().hex
    parts.write.parquet(f"{path}/files/{name}")
    return build_index(read([source]), path, known=known, files=name, **options)


def update_index(chunks: DataFrame, path: str, deleted: DataFrame | None = None, model: str = "hashing", with_summary: bool = False, make_encoder=dense.hashing_encoder, batch: int | None = None) -> Manifest:
    """A snapshot with ``chunks`` added to the last one, in place of its chunks of the same ids, and without the ids in ``deleted`` (id).

    What is written grows with the chunks given, not with the index (but for its statistics, and for merging). An id given twice is an error.
    ``batch`` numbers the updates of a stream: one that the snapshot has already is passed over.
    """
    spark, last = chunks.sparkSession, segments.latest(chunks.sparkSession, path)
    if last is not None and batch is not None and batch <= last.batch:
        return Manifest(**last.manifest)
    # One reading finds how many chunks there are and whether ids are wrong; which, is asked for only then.
    ids = chunks.groupBy("chunk_id").count()
    got = ids.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count_if(F.expr("count > 1 OR chunk_id IS NULL")).alias("wrong")).first()
    if got["wrong"]:
        twice = ids.where("count > 1 OR chunk_id IS NULL").select("chunk_id").limit(3).collect()
        raise ValueError("chunk ids given twice, or missing: " + ", ".join(str(r["chunk_id"]) for r in twice))
    like = manifest_of(None, model, with_summary, ("", 0))
    base = segments.open_snapshot(spark, path, last) if last is not None else None
    if last is not None and last.manifest["config_fingerprint"] != like.config_fingerprint:
        raise IndexStaleError("the index was built with another configuration")
    made, (x, s, n) = segments.write_segment(chunks, path, model, like.document_prefix, make_encoder, base, deleted, base.vectors if base else None, got["n"])
    before = last.rows if last is not None else ("0", "0", 0)
    x, s, n = int(before[0]) ^ x, int(before[1]) + s, before[2] + n
    parts = (*(last.segments if last is not None else ()), made)
    while (start := segments.to_merge(parts)) is not None:
        parts = segments.merge(spark, path, parts, start)
    wanted = manifest_of(None, model, with_summary, (fingerprints.combined(x if n else None, s if n else None, n), n))
    statistics = segments.write_statistics(spark, path, parts)
    segments.commit(spark, path, segments.Snapshot(last.number + 1 if last else 1, parts, asdict(wanted), rows=(str(x), str(s), n), batch=batch if batch is not None else last.batch if last else -1, **statistics))
    return wanted


def load_index(spark: SparkSession, path: str, wanted: Manifest | None = None) -> StoredIndex:
    """The last snapshot below ``path``; with ``wanted`` one that differs from it is an error."""
    last = segments.latest(spark, path)
    if last is None:
        raise IndexStaleError("there is no index")
    manifest = Manifest(**last.manifest)
    if wanted is not None:
        require_fresh(manifest, wanted)
    got = segments.open_snapshot(spark, path, last)
    return StoredIndex(got.vectors.select("id", "embedding", "category"), got.sparse, got.texts, manifest, last)


def build_or_keep(chunks: DataFrame, path: str, resume: bool = False, **options) -> Manifest:
    """:func:`build_index` that never overwrites a complete index of another corpus; ``resume`` needs one begun before."""
    spark = chunks.sparkSession
    stored = read_manifest(spark, path)
    if stored is not None:
        wanted = manifest_of(chunks, options.get("model", "hashing"), options.get("with_summary", False))
        require_fresh(stored, wanted)
        return stored
    if resume and not path_exists(spark, path):
        raise ResumeMismatchError("there is no begun index to resume")
    return build_index(chunks, path, **options)


def term_statistics(postings: DataFrame) -> DataFrame:
    """(category, term, df) for each category and, as ``_merged``, for all: grouping sets in one pass."""
    counted = postings.groupingSets([["category", "term"], ["term"]], "category", "term").agg(F.count(F.lit(1)).alias("df"), F.grouping("category").alias("_all"))
    return counted.select(F.when(F.col("_all") == 1, "_merged").otherwise(F.col("category")).alias("category"), "term", "df")


def category_counts(chunks: DataFrame) -> DataFrame:
    """(namespace, n): chunks of each category and of all together."""
    rows = chunks.groupingSets([["category"], []], "category").agg(F.count(F.lit(1)).alias("n"), F.grouping("category").alias("_all"))
    return rows.select(F.when(F.col("_all") == 1, "_merged").otherwise(F.col("category")).alias("namespace"), "n")


def resume_point(stored: DataFrame, corpus: DataFrame, stored_metadata: dict | None = None, metadata: dict | None = None) -> int:
    """How many rows of ``corpus`` (pos, id) are stored.

    Stored rows that aren't its prefix are an error, and so is metadata (of an embedding, a configuration) that differs in a key that both have.
    """
    if wrong := [k for k, v in (metadata or {}).items() if k in (stored_metadata or {}) and stored_metadata[k] != v]:
        raise ResumeMismatchError("the begun index differs in " + ", ".join(sorted(wrong)))
    s = stored.select("pos", F.col("id").alias("stored_id"))
    c = corpus.select("pos", F.col("id").alias("corpus_id"))
    joined = s.join(c, "pos", "left").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last"), F.sum((~F.col("stored_id").eqNullSafe(F.col("corpus_id"))).cast("int")).alias("wrong")).first()
    if joined["wrong"] or (joined["n"] and joined["last"] != joined["n"] - 1):
        raise ResumeMismatchError(f"{joined['wrong']} of {joined['n']} stored rows don't match the corpus")
    return joined["n"]


def verify(vectors: DataFrame, store: DataFrame, corpus: DataFrame, dim: int, manifest: Manifest | None = None) -> DataFrame:
    """One row of booleans on an index of ``corpus`` (pos, id): what its vectors (pos, id, embedding), store (chunk_id) and manifest say of it."""
    v = vectors.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("distinct"), F.coalesce(F.min(F.size("embedding")), F.lit(0)).alias("least"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("most"),
        F.min_by("id", "pos").alias("first"), F.max_by("id", "pos").alias("last"),
    )
    c = corpus.agg(F.count(F.lit(1)).alias("c_n"), F.min_by("id", "pos").alias("c_first"), F.max_by("id", "pos").alias("c_last"))
    s = store.agg(F.count(F.lit(1)).alias("s_n"))
    missing = vectors.select("id").join(store.select(F.col("chunk_id").alias("id")), "id", "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    # Four aggregates of one row each, put together by the driver.
    facts = {k: value for frame in (v, c, s, missing) for k, value in frame.first().asDict().items()}
    rows = vectors.sparkSession.range(1).select(*(F.lit(value).alias(k) for k, value in facts.items()))
    own = F.lit(manifest.chunk_count if manifest else None).cast("long")
    return rows.select(
        (F.col("n") == F.col("c_n")).alias("count_matches"), (F.col("n") == F.col("distinct")).alias("ids_unique"), ((F.col("least") == dim) & (F.col("most") == dim)).alias("dimension_matches"),
        F.col("first").eqNullSafe(F.col("c_first")).alias("first_matches"), F.col("last").eqNullSafe(F.col("c_last")).alias("last_matches"), (F.col("missing") == 0).alias("ids_in_store"),
        (F.col("s_n") == F.col("c_n")).alias("store_count_matches"), ((F.col("n") == F.col("distinct")) & (F.col("n") == F.col("c_n"))).alias("no_duplicate_ids"),
        F.coalesce(own == F.col("c_n"), F.lit(manifest is None)).alias("manifest_count_matches"), F.lit(manifest is None or bool(manifest.corpus_fingerprint and manifest.config_fingerprint)).alias("manifest_has_fingerprints"),
    )
