"""Hybrid search of a table of queries."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import fixed
from corpusloom.functions.citations import explicit_references
from corpusloom.functions.understanding import classify, rewrite, route
from corpusloom.operators import bm25, dense, fusion
from corpusloom.runtime import stash


@dataclass(frozen=True)
class Settings:
    """How a category's candidates are ranked; a boost of None is off."""

    rrf_k: int = fixed.RRF_K
    structural: float | None = fixed.STRUCTURAL_BOOST
    hierarchy: float | None = fixed.HIERARCHY_BOOST
    citation: float | None = fixed.CITATION_BOOST
    use_mmr: bool = False
    weight: float = fixed.MMR_LAMBDA


def by_category(settings: dict[str, Settings], default: Settings, name: str) -> Column:
    """A setting as a column of ``category``."""
    out = F.lit(getattr(default, name))
    for category, own in sorted(settings.items()):
        out = F.when(F.col("category") == category, F.lit(getattr(own, name))).otherwise(out)
    return out


def hybrid(
    queries: DataFrame, sparse: bm25.SparseIndex, vectors: DataFrame, query_vectors: DataFrame, k: int = 10, rrf_k: int = fixed.RRF_K,
    chunks: DataFrame | None = None, category: str | None = None, use_mmr: bool = False, weight: float = fixed.MMR_LAMBDA, boosts: dict | None = None, each: bool = False,
    settings: dict[str, Settings] | None = None,
) -> DataFrame:
    """(query_id, id, score, rank0): both channels to depth 5 k, fused; with ``chunks`` expanded and boosted; with ``use_mmr`` diversified.

    ``category`` searches one category by its own statistics (``vectors`` then has a column category). ``each`` searches every
    category by its own, all in one plan: (query_id, category, id, score, rank0), ``k`` of each. Categories in ``settings``
    (with ``each``) are ranked by theirs, others by the arguments.
    """
    if settings and not each:
        raise ValueError("settings of categories need a search of each")
    depth = fixed.FETCH_FACTOR * k
    by = ("query_id", "category") if each else ("query_id",)
    one = category not in (None, bm25.MERGED)
    own = vectors.where(F.col("category") == category) if one else vectors
    channels = [dense.search(own, query_vectors, depth, by="category" if each else None), bm25.search(sparse, queries, depth, namespace=category if one else bm25.MERGED, each=each)]
    default = Settings(rrf_k, use_mmr=use_mmr, weight=weight, **(boosts or {}))
    setting = lambda name: by_category(settings, default, name).cast("int" if name == "rrf_k" else "double") if settings else getattr(default, name)
    rows = fusion.rrf(channels, setting("rrf_k"), by)
    if chunks is None:
        rows = rows.withColumn("boosted", F.col("score"))
    else:
        asked = queries.withColumn("refs", explicit_references(F.col("text")))
        rows = fusion.boost(fusion.expand(rows, asked, chunks, category, by), asked, chunks, **{name: setting(name) for name in ("structural", "hierarchy", "citation")}, by=by)
    placed = fusion.ordered(rows, by=by)
    plain = lambda part: part.where(F.col("place") < k).select(*by, "id", F.col("boosted").alias("score"), F.col("place").alias("rank0"))
    diverse = lambda part, share: fusion.mmr(part, own, k, share, by).withColumnRenamed("boosted", "score")
    ways: dict[float | None, list[str]] = {}
    for name, found in sorted((settings or {}).items()):
        ways.setdefault(found.weight if found.use_mmr else None, []).append(name)
    rest = default.weight if default.use_mmr else None
    if not set(ways) - {rest}:
        return plain(placed) if rest is None else diverse(placed, rest)
    # The candidates are read once for each way of placing them.
    placed = stash(placed, "placed")
    others = placed.where(~F.coalesce(F.col("category").isin(sorted(settings)), F.lit(False)))
    parts = [(rest, others), *((share, placed.where(F.col("category").isin(names))) for share, names in ways.items())]
    found = [(plain(part) if share is None else diverse(part, share)).select(*by, "id", "score", "rank0") for share, part in parts]
    return reduce(DataFrame.unionByName, found)


def searched(index, queries: DataFrame, k: int = 10, make_encoder=dense.hashing_encoder, query_prefix: str = "", **options) -> DataFrame:
    """:func:`hybrid` over a stored index (:class:`corpusloom.operators.lifecycle.StoredIndex`)."""
    query_vectors = dense.embed(queries, "query_id", "text", make_encoder, query_prefix).withColumnRenamed("id", "query_id")
    return hybrid(queries, index.sparse, index.vectors, query_vectors, k, **options)


def routed(queries: DataFrame, base: str, classifier=classify, rewriter=rewrite) -> DataFrame:
    """(query_id, query_class, target, text): each query with the index and the wording it is searched with.

    ``classifier`` (text -> class) and ``rewriter`` (text, class -> text) are functions of columns that may be replaced.
    """
    rows = queries.withColumn("query_class", classifier(F.col("text")))
    return rows.select("query_id", "query_class", route(F.col("query_class"), base).alias("target"), rewriter(F.col("text"), F.col("query_class")).alias("text"))


def federated(queries: DataFrame, searches: dict[str, DataFrame], k: int = fixed.FEDERATED_TOP) -> DataFrame:
    """The lists of several categories, (query_id, id, score, rank0) each, merged by rank."""
    hits = None
    for category, found in sorted(searches.items()):
        rows = found.select("query_id", "id", "score", "rank0", F.lit(category).alias("category"))
        hits = rows if hits is None else hits.unionByName(rows)
    return fusion.federate(hits, k)
