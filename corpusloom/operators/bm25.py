"""A BM25 index of inverted lists as tables, and top-k search for a table of queries.

Chunks are numbered in slices of ``SLICE``, in the order they come in. The list of a term is cut at slices: a block has the term's chunks of one
slice with counts and lengths, beside the greatest count and the least length, from which any search can bound what the block adds to a score,
whatever the average length is by then. As the blocks of all terms end at the same slices, the bounds of a query's terms add up to a bound on
each slice's chunks with an equi-join. Blocks lie in folders by a hash of the term, so a search reads those of its terms.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom import fixed
from corpusloom.functions.text import bound, tokens
from corpusloom.runtime import setting, stash

SCORE_DIGITS = 6
#: The namespace of all categories together.
MERGED = "_merged"
#: Rows (query, term, weight) of a block of queries, or (query, slice), up to which they are broadcast; beyond, both sides are shuffled.
BROADCAST_WEIGHTS = 500_000
#: Chunks of a slice, as a power of two, and bytes of texts from which it ends earlier: what a task holds, with its words, while it counts.
SLICE_BITS = 13
SLICE_BYTES = 24 << 20
#: Blocks that a task gives on at once.
OUT_ROWS = 1 << 16
#: Folders that the terms' blocks are dealt to.
BUCKETS = 16
#: Terms up to which a search names them to the reader of the blocks; with more, it reads all folders.
NAMED_TERMS = 200
#: Pairs of query and slice (as far as the index's size says) from which bounds are worth a pass of their own; the result is the same.
PRUNE_FROM = 50_000
#: The slices with the highest bounds, which are scored first.
SEEDS = 2
#: Scores are rounded, so a slice is left out only where its bound is further below.
SLACK = 1e-5


@dataclass
class SparseIndex:
    """blocks(segment, category, term, slice, n, most_tf, least_dl, ids, tfs, dls, bucket), term_stats(namespace, term, df, idf), corpus_stats(namespace, n, avgdl).

    Statistics are by namespace: each category, and all together. ``gone`` (id, upto) are chunks that count no more in segments before ``upto``.
    """

    blocks: DataFrame
    term_stats: DataFrame
    corpus_stats: DataFrame
    gone: DataFrame | None = None

    @property
    def postings(self) -> DataFrame:
        """(segment, id, category, dl, term, tf)"""
        rows = self.blocks.where(F.col("bucket") != LISTS).select("segment", "category", "term", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p"))
        return living(rows.select("segment", F.col("p.ids").alias("id"), "category", F.col("p.dls").alias("dl"), "term", F.col("p.tfs").cast("long").alias("tf")), self.gone)

    @property
    def term_totals(self) -> DataFrame:
        """(term, df, tf): chunks that have a term and how often it is there, summed by block where no chunk is void."""
        if self.gone is not None:
            return self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))
        times = F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)
        rows = self.blocks.where(F.col("bucket") != LISTS).select("term", F.size("tfs").alias("df"), times.alias("tf"))
        return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))

    def save(self, path: str, mode: str = "overwrite") -> None:
        write_blocks(self.blocks, f"{path}/blocks", mode)
        for name in ("term_stats", "corpus_stats"):
            getattr(self, name).write.mode(mode).parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SparseIndex:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("blocks", "term_stats", "corpus_stats")))


def living(rows: DataFrame, gone: DataFrame | None) -> DataFrame:
    """Rows (segment, id) without those that a later segment has replaced or deleted."""
    if gone is None:
        return rows
    later = gone.select(F.col("id").alias("_id"), "upto")
    return rows.join(later, (F.col("id") == F.col("_id")) & (F.col("segment") < F.col("upto")), "left_anti")


def term_counts(text: Column) -> Column:
    """The distinct terms of a text with their counts, an array of (term, tf): sorted words, cut where the word changes."""

    def counted(words: Column) -> Column:
        size = F.size(words)
        starts = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))
        ends = lambda at: F.concat(F.slice(at, 2, F.size(at)), F.array(size))
        return bound(starts, lambda at: F.zip_with(at, ends(at), lambda i, j: F.struct(F.get(words, i).alias("term"), (j - i).cast("long").alias("tf"))))

    none = F.array().cast("array<struct<term:string,tf:bigint>>")
    return bound(F.sort_array(tokens(F.coalesce(text, F.lit("")))), lambda words: F.when(F.size(words) > 0, counted(words)).otherwise(none))


def bucket_of(term: Column | str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def document_terms(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", category_col: str | None = None) -> DataFrame:
    """(id, category, dl, terms): one row for each chunk, counted within the row and so without a shuffle."""
    category = F.col(category_col) if category_col else F.lit(MERGED)
    rows = chunks.select(F.col(id_col).alias("id"), category.alias("category"), term_counts(F.col(text_col)).alias("terms"))
    return rows.select("id", "category", F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + t["tf"]).cast("int").alias("dl"), "terms")


#: The folder of the rows that list the chunks of a slice.
LISTS = -1


def make_blocks(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", category_col: str | None = None, hash_col: str | None = None, segment: int = 0) -> DataFrame:
    """The blocks of ``chunks``, counted slice by slice where the texts are read; rows without a term, in folder ``LISTS``, have all chunks of a slice, with their hashes.

    Slices are those of the order in which tasks read, so ``chunks`` should come from files, which a task that is repeated reads in the same order.
    """
    id_type = chunks.schema[id_col].dataType.simpleString()
    category = F.col(category_col).cast("string") if category_col else F.lit(MERGED)
    hashed = F.col(hash_col) if hash_col else F.lit(0).cast("long")
    rows = chunks.select(F.col(id_col).alias("id"), category.alias("category"), hashed.alias("h"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"), F.spark_partition_id().alias("task"))
    schema = f"category string, term string, slice long, n int, most_tf int, least_dl int, ids array<{id_type}>, tfs array<int>, dls array<int>, hs array<long>"
    found = rows.mapInArrow(partial(_gather, bits=SLICE_BITS, most=SLICE_BYTES), schema)
    bucket = F.when(F.col("term").isNull(), LISTS).otherwise(bucket_of("term")).alias("bucket")
    return found.select(F.lit(segment).alias("segment"), "*", bucket)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all lower-cased texts one after the other, and how many each has; white space is what :func:`corpusloom.functions.text.tokens` takes for it."""
    parts = pc.utf8_split_whitespace(texts)
    words, row = parts.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy())
    # White space at an end leaves an empty part there.
    full = pc.not_equal(words, "")
    return words.filter(full), np.bincount(row[full.to_numpy(zero_copy_only=False)], minlength=len(texts))


def _gather(batches: Iterator[pa.RecordBatch], bits: int, most: int) -> Iterator[pa.RecordBatch]:
    """Blocks of (id, category, h, text, task) rows. A slice goes on over batches, to its number of chunks or bytes: the longer, the fewer blocks the rare terms have."""
    held, size, place = [], 0, 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, (1 << bits) - sum(b.num_rows for b in held))
            batch = batch.slice(part.num_rows)
            held.append(part)
            size += part.column("text").nbytes
            if size >= most or sum(b.num_rows for b in held) == 1 << bits:
                yield from _slice(held, place)
                held, size, place = [], 0, place + 1
    if held:
        yield from _slice(held, place)


def _slice(held: list[pa.RecordBatch], place: int) -> Iterator[pa.RecordBatch]:
    """The blocks of one slice, then its lists."""
    batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    n, groups = batch.num_rows, batch.column("category").dictionary_encode()
    words, lengths = split_words(batch.column("text"))
    slices = np.full(n, (int(batch.column("task")[0].as_py()) << 40) + place)
    kinds = groups.indices.fill_null(-1).to_numpy().astype(np.int64) + 1
    terms = words.dictionary_encode()
    codes, row = terms.indices.to_numpy().astype(np.int64), np.repeat(np.arange(n), lengths)
    found, tf = np.unique((kinds[row] * max(1, len(terms.dictionary)) + codes) * n + row, return_counts=True)
    made = _blocks(batch, slices, found // n, found % n, tf, lengths, terms.dictionary.take(pa.array(found // n % max(1, len(terms.dictionary)))))
    for start in range(0, made.num_rows, OUT_ROWS):
        yield made.slice(start, OUT_ROWS)
    order = np.argsort(kinds, kind="stable")
    yield _blocks(batch, slices, kinds[order], order, None, lengths, None)


def _blocks(batch: pa.RecordBatch, slices: np.ndarray, key: np.ndarray, row: np.ndarray, tf: np.ndarray | None, lengths: np.ndarray, term: pa.Array | None) -> pa.RecordBatch:
    """A block for each run of equal keys over (row, tf); without ``tf`` the lists of a slice's chunks."""
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(starts, len(key)).astype(np.int32))
    listed = lambda values: pa.ListArray.from_arrays(offsets, values)
    ints = lambda values: pa.array(values.astype(np.int32))
    none = lambda kind: pa.nulls(len(starts), kind)
    dl, first = lengths[row], pa.array(row[starts])
    columns = [batch.column("category").take(first)]
    if tf is None:
        columns += [none(pa.string()), pa.array(slices[row[starts]]), none(pa.int32()), none(pa.int32())]
    else:
        columns += [term.take(pa.array(starts)), pa.array(slices[row[starts]]), *((ints(np.maximum.reduceat(tf, starts)), ints(np.minimum.reduceat(dl, starts))) if len(key) else (ints(tf), ints(dl)))]
    columns.insert(3, ints(np.diff(np.append(starts, len(key)))))
    columns += [listed(batch.column("id").take(pa.array(row))), none(pa.list_(pa.int32())) if tf is None else listed(ints(tf)), listed(ints(dl)), listed(batch.column("h").take(pa.array(row))) if tf is None else none(pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names=["category", "term", "slice", "n", "most_tf", "least_dl", "ids", "tfs", "dls", "hs"])


def listed_chunks(blocks: DataFrame) -> DataFrame:
    """(segment, slice, category, id, dl, h) of all chunks."""
    rows = blocks.where(F.col("bucket") == LISTS).select(*(["segment"] if "segment" in blocks.columns else []), "slice", "category", F.explode(F.arrays_zip("ids", "dls", "hs")).alias("c"))
    return rows.select(*rows.columns[:-1], F.col("c.ids").alias("id"), F.col("c.dls").alias("dl"), F.col("c.hs").alias("h"))


def without(blocks: DataFrame, void: DataFrame) -> DataFrame:
    """Blocks without the chunks in ``void`` (segment, slice, id), at most a slice of which are gathered for each; bounds stay, as they still hold."""
    gone = void.groupBy("segment", "slice").agg(F.collect_set("id").alias("_gone"))
    rows = blocks.join(gone, ["segment", "slice"], "left")
    kept = F.filter(F.sequence(F.lit(0), F.size("ids") - 1), lambda i: ~F.array_contains("_gone", F.get("ids", i)))
    left = rows.withColumn("_kept", F.when(F.col("_gone").isNotNull(), kept)).where("_kept IS NULL OR size(_kept) > 0")

    def taken(name: str) -> Column:
        return F.when(F.col("_kept").isNull(), F.col(name)).otherwise(F.transform("_kept", lambda i: F.get(name, i)))

    return left.withColumns({c: F.when(F.col(c).isNotNull(), taken(c)) for c in ("ids", "tfs", "dls", "hs")}).withColumn("n", F.size("ids")).select(*blocks.columns)


def write_blocks(blocks: DataFrame, path: str, mode: str = "error") -> None:
    """Blocks go to their folders from the tasks that make them: nothing is shuffled, and as a task may hold all folders open, nothing is sorted."""
    with setting(blocks.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", 2 * BUCKETS):
        blocks.write.mode(mode).option("parquet.block.size", 4 << 20).partitionBy("bucket").parquet(path)


def frequencies(blocks: DataFrame) -> DataFrame:
    """(namespace, term, df) of each block, its category as namespace; :func:`totals` adds them up."""
    return blocks.where(F.col("bucket") != LISTS).select(F.col("category").alias("namespace"), "term", F.col("n").cast("long").alias("df"))


def sizes(blocks: DataFrame) -> list[tuple[str, int, int]]:
    """(namespace, n, words) of each category."""
    words = F.aggregate("dls", F.lit(0).cast("long"), lambda a, x: a + x)
    rows = blocks.where(F.col("bucket") == LISTS).groupBy(F.col("category").alias("namespace")).agg(F.sum(F.size("ids")).cast("long").alias("n"), F.sum(words).cast("long").alias("words"))
    return [(r["namespace"], r["n"], r["words"]) for r in rows.collect()]


def totals(df: DataFrame) -> DataFrame:
    """(namespace, term, df) of each category and of all together from frequencies of categories, which are shuffled once, by term."""
    spaces = F.array_distinct(F.array("namespace", F.lit(MERGED)))
    own = df.repartition("term").groupBy("namespace", "term").agg(F.sum("df").alias("df"))
    return own.select(F.explode(spaces).alias("namespace"), "term", "df").groupBy("namespace", "term").agg(F.sum("df").alias("df"))


def corpus_statistics(counts: list[tuple[str, int, int]]) -> list[tuple[str, int, float]]:
    """(namespace, n, avgdl) from the sizes of categories, possibly of several segments; those of all together come from the categories'."""
    totals: dict[str, tuple[int, int]] = {}
    for name, n, words in counts:
        for key in {name, MERGED}:
            old = totals.get(key, (0, 0))
            totals[key] = (old[0] + n, old[1] + words)
    return [(key, n, words / n) for key, (n, words) in sorted(totals.items()) if n > 0]


def corpus_table(spark: SparkSession, corpus: Iterable[tuple[str, int, float]]) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in corpus], "namespace string, n long, avgdl double")


def raw_idf(df: DataFrame, corpus: DataFrame) -> DataFrame:
    """(namespace, term, df, raw) from written frequencies; one row for each namespace is what is broadcast."""
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    return df.join(F.broadcast(corpus.select("namespace", "n")), "namespace").select("namespace", "term", "df", raw.alias("raw"))


def mean_idf(df: DataFrame, corpus: DataFrame) -> list[tuple[str, float]]:
    """(namespace, mean) over the terms, of which only the frequencies are read."""
    return sorted(tuple(r) for r in raw_idf(df, corpus).groupBy("namespace").agg(F.avg("raw").alias("mean")).collect())


def term_table(df: DataFrame, corpus: DataFrame, means: Iterable[tuple[str, float]]) -> DataFrame:
    """term_stats, whose idf is computed where it is read."""
    mean = F.broadcast(df.sparkSession.createDataFrame([tuple(r) for r in means], "namespace string, mean double"))
    idf = F.when(F.col("raw") < 0, fixed.BM25_EPSILON * F.col("mean")).otherwise(F.col("raw"))
    return raw_idf(df, corpus).join(mean, "namespace").select("namespace", "term", "df", idf.alias("idf"))


def build(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", category_col: str | None = None) -> SparseIndex:
    """The index of ``chunks``, whose texts are read once. Without ``category_col`` all are one namespace."""
    blocks = stash(make_blocks(chunks, id_col, text_col, category_col), "blocks")
    corpus, df = corpus_table(chunks.sparkSession, corpus_statistics(sizes(blocks))), stash(totals(frequencies(blocks)), "frequencies")
    return SparseIndex(blocks, term_table(df, corpus, mean_idf(df, corpus)), corpus)


def query_weights(index: SparseIndex, wanted: DataFrame, namespace: str, each: bool) -> DataFrame:
    """(namespace, query_id, term, weight, avgdl, n) of the queries' terms that the index has."""
    own = F.col("namespace") != MERGED if each else F.col("namespace") == namespace
    average = F.coalesce(F.nullif("avgdl", F.lit(0.0)), F.lit(1.0)).alias("avgdl")
    lengths = index.corpus_stats.where(own).select("namespace", average, "n")
    return index.term_stats.where(own).join(wanted, "term").join(lengths, "namespace").select("namespace", "query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"), "avgdl", "n")


def part(weight: str, tf: str, dl: str) -> Column:
    """What a term adds to the score of a chunk; it grows with ``tf`` and shrinks with ``dl``."""
    k1, b = fixed.BM25_K1, fixed.BM25_B
    return F.col(weight) * (F.col(tf) * (k1 + 1) / (F.col(tf) + k1 * (1 - b + b * F.col(dl) / F.col("avgdl"))))


@dataclass(frozen=True)
class Asked:
    """What is known of the weights of a search: rows, folders and number of terms, and about how many pairs of query and slice there can be."""

    rows: int
    terms: int
    buckets: tuple[int, ...]
    pairs: int


def facts(weights: DataFrame) -> Asked:
    got = weights.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("term").alias("terms"), F.countDistinct("query_id").alias("queries"), F.countDistinct("namespace").alias("spaces"), F.max("n").alias("n"), F.collect_set(bucket_of("term")).alias("buckets")).first()
    slices = ((got["n"] or 0) >> SLICE_BITS) + 1
    return Asked(got["rows"], got["terms"], tuple(sorted(got["buckets"])), got["queries"] * got["spaces"] * slices)


def asked_blocks(index: SparseIndex, weights: DataFrame, asked: Asked, namespace: str, each: bool) -> DataFrame:
    """The blocks of the asked terms, named to the reader where they are few, with the namespace they count for."""
    blocks = index.blocks.where(F.col("bucket").isin(*asked.buckets)) if len(asked.buckets) < BUCKETS else index.blocks.where(F.col("bucket") != LISTS)
    if not each and namespace != MERGED:
        blocks = blocks.where(F.col("category") == namespace)
    if asked.terms <= NAMED_TERMS:
        blocks = blocks.where(F.col("term").isin(sorted(r["term"] for r in weights.select("term").distinct().collect())))
    return blocks.withColumn("namespace", F.col("category") if each else F.lit(namespace))


def within(rows: DataFrame, few: DataFrame, count: int, keys: list[str], how: str = "inner") -> DataFrame:
    return rows.join(F.broadcast(few) if count <= BROADCAST_WEIGHTS else few, keys, how)


def scored(blocks: DataFrame, weights: DataFrame, count: int, gone: DataFrame | None, pairs: DataFrame | None = None, n_pairs: int = 0) -> DataFrame:
    """(query_id, namespace, id, category, score) of the blocks, with ``pairs`` (namespace, query_id, segment, slice) of those alone.

    Blocks are shuffled once, by slice, before they meet the queries: a chunk's scores for all queries come about in one task.
    """
    if pairs is not None:
        blocks = within(blocks, pairs.select("segment", "slice").distinct(), n_pairs, ["segment", "slice"], "left_semi")
    if count <= BROADCAST_WEIGHTS:
        blocks = within(blocks, weights.select("namespace", "term").distinct(), count, ["namespace", "term"], "left_semi").repartition("segment", "slice")
    rows = within(blocks, weights, count, ["namespace", "term"])
    if pairs is not None:
        rows = within(rows, pairs, n_pairs, ["namespace", "query_id", "segment", "slice"], "left_semi")
    rows = rows.select("query_id", "namespace", "segment", "slice", "category", "weight", "avgdl", "tfs", "dls", F.posexplode("ids").alias("at", "id"))
    rows = rows.withColumns({"tf": F.get("tfs", F.col("at")), "dl": F.get("dls", F.col("at"))})
    rows = rows.select("query_id", "namespace", "segment", "slice", "category", "id", part("weight", "tf", "dl").alias("part"))
    found = rows.groupBy("query_id", "namespace", "segment", "slice", "id", "category").agg(F.round(F.sum("part"), SCORE_DIGITS).alias("score")).where("score > 0")
    return living(found, gone)


def scored_by_slice(index: SparseIndex, blocks: DataFrame, weights: DataFrame, asked: Asked, namespace: str, each: bool, k: int) -> DataFrame:
    """(query_id, id, category, score), of each task the ``k`` best of each query (and namespace) and few more.

    The queries' weights go to the tasks, the blocks of their terms are shuffled once, by slice. A slice's scores for all queries are
    products of matrices; what is below a query's ``k`` best in a task is not given on.
    """
    columns = ["namespace", "segment", "slice", "category", "term", "ids", "tfs", "dls"]
    own = within(blocks, weights.select("namespace", "term").distinct(), asked.rows, ["namespace", "term"], "left_semi").select(*columns)
    if index.gone is not None:
        # What counts no more comes to its slice as a row without a term.
        listed = index.blocks.where(F.col("bucket") == LISTS).select("segment", "slice", "category", F.explode("ids").alias("id"))
        later = index.gone.select(F.col("id").alias("_id"), "upto")
        void = listed.join(later, (F.col("id") == F.col("_id")) & (F.col("segment") < F.col("upto")), "left_semi")
        lists = void.groupBy("segment", "slice", "category").agg(F.collect_list("id").alias("ids"))
        space = F.col("category") if each else F.lit(namespace)
        own = own.unionByName(lists.withColumn("namespace", space), allowMissingColumns=True).select(*columns)
    id_type = own.schema["ids"].dataType.elementType.simpleString()
    schema = f"query_id {weights.schema['query_id'].dataType.simpleString()}, id {id_type}, category string, score double"
    rows = own.repartition("segment", "slice").sortWithinPartitions("namespace", "segment", "slice")
    table = weights.select("namespace", "query_id", "term", "weight", "avgdl").toArrow()
    return rows.mapInArrow(partial(_score, table=table, k=k), schema)


#: Queries, and terms, of a product of matrices.
QUERY_ROWS, TERM_ROWS = 256, 512


class _Weights:
    """The weights of a namespace in blocks of queries, by term, and the best scores of each query so far."""

    def __init__(self, rows: pa.Table, k: int):
        self.avgdl, queries = rows["avgdl"][0].as_py(), rows["query_id"].combine_chunks().dictionary_encode()
        self.queries, number = queries.dictionary, queries.indices.to_numpy()
        terms = rows["term"].combine_chunks().dictionary_encode()
        code, weight = terms.indices.to_numpy(), rows["weight"].to_numpy()
        self.terms = {term: i for i, term in enumerate(terms.dictionary.to_pylist())}
        self.blocks = []
        for start in range(0, len(self.queries), QUERY_ROWS):
            at = np.flatnonzero((number >= start) & (number < start + QUERY_ROWS))
            at = at[np.argsort(code[at], kind="stable")]
            edges = np.searchsorted(code[at], np.arange(len(self.terms) + 1))
            count = min(QUERY_ROWS, len(self.queries) - start)
            self.blocks.append((start, count, number[at] - start, weight[at], edges, np.zeros((count, k))))


def _score(batches: Iterator[pa.RecordBatch], table: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
    """Scores of the slices that come one after the other, by (namespace, segment, slice)."""
    keys, last, held, known = ("namespace", "segment", "slice"), None, [], {}

    def finished() -> Iterator[pa.RecordBatch]:
        if held:
            if last[0] not in known:
                known.clear()
                known[last[0]] = _Weights(table.filter(pc.equal(table["namespace"], last[0])), k)
            yield from _slice_scores(pa.Table.from_batches(held).combine_chunks(), known[last[0]], k)

    for batch in batches:
        if not batch.num_rows:
            continue
        values = [(c.dictionary_encode().indices if pa.types.is_string(c.type) else c).to_numpy() for c in map(batch.column, keys)]
        change = np.zeros(batch.num_rows - 1, bool)
        for v in values:
            change |= v[1:] != v[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for start, stop in zip(edges[:-1], edges[1:]):
            key = tuple(batch.column(c)[start].as_py() for c in keys)
            if key != last:
                yield from finished()
                last, held = key, []
            held.append(batch.slice(start, stop - start))
    yield from finished()


def _slice_scores(rows: pa.Table, weights: _Weights, k: int) -> Iterator[pa.RecordBatch]:
    """What one slice adds to the best of each query."""
    ids, sizes = rows["ids"].combine_chunks(), pc.list_value_length(rows["ids"]).to_numpy()
    found = ids.flatten().dictionary_encode()
    document, row = found.indices.to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
    term = np.fromiter((weights.terms.get(t, -1) for t in rows["term"].combine_chunks().to_numpy(zero_copy_only=False)), np.int64, len(sizes))
    void = np.zeros(len(found.dictionary), bool)
    void[document[(term < 0)[row]]] = True
    row_of = np.zeros(len(void), np.int64)
    row_of[document] = row
    counted = (term >= 0)[row]
    document, code = document[counted], term[row[counted]]
    tf, dl = (rows[c].combine_chunks().flatten().to_numpy().astype(float) for c in ("tfs", "dls"))
    part = tf * (fixed.BM25_K1 + 1) / (tf + fixed.BM25_K1 * (1 - fixed.BM25_B + fixed.BM25_B * dl / weights.avgdl))
    for start, count, queries, weight, edges, best in weights.blocks:
        score = np.zeros((count, len(void)))
        here = np.unique(code)
        here = here[edges[here + 1] > edges[here]]
        for first in range(0, len(here), TERM_ROWS):
            some = here[first : first + TERM_ROWS]
            place = np.full(len(edges), -1)
            place[some] = np.arange(len(some))
            adds, uses = np.zeros((len(some), len(void))), np.zeros((count, len(some)))
            at = np.flatnonzero(place[code] >= 0)
            np.add.at(adds, (place[code[at]], document[at]), part[at])
            length = edges[some + 1] - edges[some]
            own = np.repeat(edges[some] - np.cumsum(length) + length, length) + np.arange(length.sum())
            uses[queries[own], np.repeat(np.arange(len(some)), length)] = weight[own]
            score += uses @ adds
        score = np.where(void, 0.0, np.round(score, SCORE_DIGITS))
        both = np.concatenate([best, score], axis=1)
        best[:] = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k :]
        query, own = np.nonzero((score > 0) & (score >= best.min(1)[:, None]))
        if len(query):
            category = rows["category"].combine_chunks().take(pa.array(row_of[own]))
            yield pa.RecordBatch.from_arrays([weights.queries.take(pa.array(query + start)), found.dictionary.take(pa.array(own)), category, pa.array(score[query, own])], ["query_id", "id", "category", "score"])


def reachable(blocks: DataFrame, weights: DataFrame, count: int, gone: DataFrame | None, k: int) -> tuple[DataFrame, int]:
    """(namespace, query_id, segment, slice) of slices that can hold one of a query's ``k`` best, and how many.

    A slice's bound is the sum of its blocks' bounds. The ``k``-th best score in the slices with the highest bounds is one that the result
    can't fall below, so slices bounded by less are left out. A weight below zero (in an index of few chunks) adds nothing to a bound.
    """
    heads = within(blocks.select("segment", "namespace", "term", "slice", "most_tf", "least_dl"), weights, count, ["namespace", "term"])
    bounds = heads.groupBy("namespace", "query_id", "segment", "slice").agg(F.sum(F.greatest(part("weight", "most_tf", "least_dl"), F.lit(0.0))).alias("bound"))
    bounds = stash(bounds, "slice-bounds")
    n = bounds.count()
    place = F.row_number().over(Window.partitionBy("namespace", "query_id").orderBy(F.desc("bound"), "segment", "slice"))
    seeds = stash(bounds.withColumn("place", place).where(F.col("place") <= SEEDS).drop("place", "bound"), "seed-slices")
    first = top(scored(blocks, weights, count, gone, seeds, n), k, ("namespace", "query_id")).where(F.col("rank0") == k - 1)
    least = first.select("namespace", "query_id", F.col("score").alias("floor"))
    kept = bounds.join(least, ["namespace", "query_id"], "left").where(F.col("floor").isNull() | (F.col("bound") + SLACK >= F.col("floor")))
    kept = stash(kept.select("namespace", "query_id", "segment", "slice"), "slices")
    return kept, kept.count()


def search(index: SparseIndex, queries: DataFrame, k: int = 10, query_id: str = "query_id", text_col: str = "text", namespace: str = MERGED, each: bool = False) -> DataFrame:
    """(query_id, id, category, score, rank0): the ``k`` best of each query with a positive score. A repeated word counts each time.

    ``namespace`` searches one category by its own statistics, ``each`` every category by its own: ``k`` of each.
    Only blocks of the queries' terms are read. Weights of up to ``BROADCAST_WEIGHTS`` rows go to the slices; with more, both
    are tables, and only slices that can reach a query's result are scored.
    """
    wanted = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(text_col))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    weights = stash(query_weights(index, wanted, namespace, each), "weights")
    asked = facts(weights)
    blocks = asked_blocks(index, weights, asked, namespace, each)
    if asked.rows <= BROADCAST_WEIGHTS:
        found = scored_by_slice(index, blocks, weights, asked, namespace, each, k)
    else:
        found = scored(blocks, weights, asked.rows, index.gone, *(reachable(blocks, weights, asked.rows, index.gone, k) if asked.pairs >= PRUNE_FROM else ()))
    return top(found.select("query_id", "id", "category", "score"), k, ("query_id", "category") if each else ("query_id",))


def top(scored: DataFrame, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The ``k`` best rows of each query, ties by id; limited within partitions before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    # The plain comparison is what Spark turns into a limit of each partition's groups.
    return scored.withColumn("rank0", rank).where(F.col("rank0") <= k).withColumn("rank0", F.col("rank0") - 1)
