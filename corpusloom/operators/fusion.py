"""Rank fusion, metadata expansion, boosts, diversity and merging across categories."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import fixed
from corpusloom.runtime import stash

DIGITS = 8
#: What a list of candidates belongs to: a query, or with ("query_id", "category") a query in a category.
BY = ("query_id",)
#: Candidates of a query from which diversity is sought in rounds over all tasks instead of in one frame.
MMR_FRAME = 5000


def reciprocal(rank0: Column, rrf_k: int | Column) -> Column:
    return 1.0 / (rrf_k + rank0 + 1)


def rrf(channels: list[DataFrame], rrf_k: int | Column = fixed.RRF_K, by: tuple[str, ...] = BY) -> DataFrame:
    """(query_id, id, score and the rank in each channel) from (query_id, id, rank0) lists: one aggregation of their union."""
    parts = [c.select(*by, "id", *(F.col("rank0").alias(f"rank_{j}") if i == j else F.lit(None).cast("int").alias(f"rank_{j}") for j in range(len(channels)))) for i, c in enumerate(channels)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    ranks = [F.min(f"rank_{j}").alias(f"rank_{j}") for j in range(len(channels))]
    fused = rows.groupBy(*by, "id").agg(*ranks)
    score = sum((F.coalesce(reciprocal(F.col(f"rank_{j}"), rrf_k), F.lit(0.0)) for j in range(len(channels))), F.lit(0.0))
    return fused.withColumn("score", F.round(score, DIGITS))


def rrf_outer(left: DataFrame, right: DataFrame, rrf_k: int = fixed.RRF_K) -> DataFrame:
    """The same for two lists as a full outer join."""
    a = left.select("query_id", "id", F.col("rank0").alias("rank_0"))
    b = right.select("query_id", "id", F.col("rank0").alias("rank_1"))
    both = a.join(b, ["query_id", "id"], "full_outer")
    part = lambda c: F.coalesce(reciprocal(F.col(c), rrf_k), F.lit(0.0))
    return both.withColumn("score", F.round(part("rank_0") + part("rank_1"), DIGITS))


def structural_match(section: Column, path: Column, refs: Column) -> Column:
    """Whether a chunk is itself one of the referenced units, where its hierarchy allows that."""
    place = F.lower(F.array_join(F.coalesce(path, F.array().cast("array<string>")), " "))

    def allowed(ref: Column) -> Column:
        kind = F.lower(ref["ref_type"])
        qualifier = F.regexp_replace(kind, " entry$", "")
        entry = F.contains(place, F.lit("schedule")) & ((kind == "entry") | F.contains(place, qualifier))
        article = F.contains(place, F.lit("part")) & ~F.contains(place, F.lit("schedule")) & ~F.contains(place, F.lit("appendix"))
        named = (section == ref["ref_val"]) | (section == F.concat_ws(" ", ref["ref_type"], ref["ref_val"]))
        return named & F.when(kind == "article", article).when(F.endswith(kind, F.lit("entry")), entry).otherwise(F.lit(True))

    return F.coalesce((section != "") & F.exists(refs, allowed), F.lit(False))


def hierarchy_match(parent: Column, path: Column, refs: Column) -> Column:
    """Whether a referenced unit is above a chunk."""
    units = F.concat(F.coalesce(path, F.array().cast("array<string>")), F.array_compact(F.array(F.when(parent != "", parent))))
    return F.exists(refs, lambda r: F.array_contains(units, r["ref_val"]) | F.array_contains(units, F.concat_ws(" ", r["ref_type"], r["ref_val"])))


def expand(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, category: str | None = None, by: tuple[str, ...] = BY) -> DataFrame:
    """``candidates`` (query_id, id, score, ...) and, with score 0, every chunk that a query's ``refs`` name.

    The match is an equi-join on the section under both of its spellings; the rest of the rule filters.
    """
    asked = queries.where(F.size("refs") > 0).select("query_id", "refs", F.explode("refs").alias("ref"))
    spelled = asked.select("query_id", "refs", F.explode(F.array("ref.ref_val", F.concat_ws(" ", "ref.ref_type", "ref.ref_val"))).alias("section")).distinct()
    own = chunks if category in (None, "_merged") else chunks.where(F.col("category") == category)
    named = own.join(spelled, "section").where(structural_match(F.col("section"), F.col("hierarchy_path"), F.col("refs")))
    new = named.select(*by, F.col("chunk_id").alias("id")).distinct().join(candidates.select(*by, "id"), [*by, "id"], "left_anti")
    return candidates.unionByName(new.withColumn("score", F.lit(0.0)), allowMissingColumns=True)


def cited(candidates: DataFrame, chunks: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """(query_id, id) of the candidates that another candidate of the query cites."""
    meta = chunks.select(F.col("chunk_id").alias("id"), "source_doc", "section", "cites")
    rows = candidates.select(*by, "id").join(meta, "id")
    citing = rows.select(*by, F.col("id").alias("citing"), F.explode("cites").alias("cite")).select(*by, "citing", F.col("cite.doc").alias("source_doc"), F.col("cite.section").alias("cited_section"))
    hit = rows.join(citing.distinct(), [*by, "source_doc"]).where((F.col("id") != F.col("citing")) & ((F.coalesce("cited_section", F.lit("")) == "") | (F.col("section") == F.col("cited_section"))))
    return hit.select(*by, "id").distinct()


def boost(
    candidates: DataFrame, queries: DataFrame, chunks: DataFrame,
    structural: float | Column | None = fixed.STRUCTURAL_BOOST, hierarchy: float | Column | None = fixed.HIERARCHY_BOOST, citation: float | Column | None = fixed.CITATION_BOOST, by: tuple[str, ...] = BY,
) -> DataFrame:
    """``candidates`` with ``boosted``: structural, else hierarchy, and citation boosts on top. None, or a column's null, turns one off."""
    if citation is not None:
        # They are named three times below, and have a whole search behind them.
        candidates = stash(candidates, "candidates")
    meta = chunks.select(F.col("chunk_id").alias("id"), "section", "parent", "hierarchy_path")
    rows = candidates.join(queries.select("query_id", "refs"), "query_id").join(meta, "id", "left")
    no = F.lit(False)
    value = lambda x: x if isinstance(x, Column) else F.lit(x).cast("double")
    is_unit = structural_match(F.col("section"), F.col("hierarchy_path"), F.col("refs")) & value(structural).isNotNull() if structural is not None else no
    is_below = hierarchy_match(F.col("parent"), F.col("hierarchy_path"), F.col("refs")) & value(hierarchy).isNotNull() if hierarchy is not None else no
    added = F.when(is_unit, value(structural)).when(F.coalesce(is_below, no), value(hierarchy)).otherwise(0.0)
    rows = rows.withColumn("boosted", F.col("score") + added)
    if citation is not None:
        rows = rows.join(cited(candidates, chunks, by).withColumn("is_cited", F.lit(True)), [*by, "id"], "left").withColumn("boosted", F.col("boosted") + F.coalesce(F.when(F.col("is_cited"), value(citation)), F.lit(0.0))).drop("is_cited")
    return rows.withColumn("boosted", F.round("boosted", DIGITS)).drop("refs", "section", "parent", "hierarchy_path")


def ordered(rows: DataFrame, score: str = "boosted", by: tuple[str, ...] = BY) -> DataFrame:
    """``place`` (from 0) of each candidate: score, then dense rank, sparse rank (none last), id."""
    ties = [F.col(c).asc_nulls_last() for c in rows.columns if c.startswith("rank_")]
    return rows.withColumn("place", (F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), *ties, "id")) - 1).cast("int"))


def mmr(candidates: DataFrame, vectors: DataFrame, k: int = 10, weight: float = fixed.MMR_LAMBDA, by: tuple[str, ...] = BY, frame: int = MMR_FRAME) -> DataFrame:
    """(query_id, id, boosted, rank0): candidates in the order of maximal marginal relevance; those without a vector drop out.

    ``candidates`` has query_id, id, boosted and place. Where expansions make a query's candidates more than ``frame``
    ("Section 1" names a unit of each act), each place is filled by one aggregation over all of them.
    """
    rows = candidates.select(*by, "id", "boosted", "place").join(vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding")), "id")
    rows = stash(rows, "diversity")
    large = stash(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > frame).select(*by), "large")
    if not large.isEmpty():
        return mmr(rows.join(large, [*by], "left_anti"), vectors, k, weight, by, frame).unionByName(mmr_rounds(rows.join(large, [*by], "left_semi"), k, weight, by))
    kinds = ", ".join(f"{c} {candidates.schema[c].dataType.simpleString()}" for c in (*by, "id"))

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place", ignore_index=True)
        matrix = np.array(group["embedding"].tolist(), float)
        score = group["boosted"].to_numpy()
        spread = score.max() - score.min()
        relevance = (score - score.min()) / spread if spread > 0 else np.ones(len(score))
        worth, likest, chosen = relevance.copy(), np.full(len(score), -np.inf), []
        free = np.ones(len(score), bool)
        while free.any() and len(chosen) < k:
            best = int(np.where(free, np.round(worth, DIGITS), -np.inf).argmax())
            chosen.append(best)
            free[best] = False
            likest = np.maximum(likest, matrix @ matrix[best])
            worth = weight * relevance - (1 - weight) * likest
        out = group.loc[chosen, [*by, "id", "boosted"]].reset_index(drop=True)
        out["rank0"] = np.arange(len(out), dtype=np.int32)
        return out

    return rows.groupBy(*by).applyInPandas(pick, f"{kinds}, boosted double, rank0 int")


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def mmr_rounds(rows: DataFrame, k: int, weight: float, by: tuple[str, ...] = BY) -> DataFrame:
    """:func:`mmr` for any number of candidates with vectors: a round finds the next of each query and what every other has in common with it."""
    low, high = F.col("_low"), F.col("_high")
    range_ = rows.groupBy(*by).agg(F.min("boosted").alias("_low"), F.max("boosted").alias("_high"))
    rows = rows.join(range_, [*by]).withColumn("relevance", F.when(high > low, (F.col("boosted") - low) / (high - low)).otherwise(1.0)).drop("_low", "_high").withColumn("likest", F.lit(None).cast("double"))
    worth = F.round(F.when(F.col("likest").isNull(), F.col("relevance")).otherwise(weight * F.col("relevance") - (1 - weight) * F.col("likest")), DIGITS)
    found = None
    for rank in range(k):
        rows = stash(rows, "left")
        best = rows.groupBy(*by).agg(F.max_by(F.struct("id", "boosted", "embedding"), F.struct(worth, -F.col("place"))).alias("b"))
        best = stash(best.select(*by, "b.id", "b.boosted", "b.embedding"), "picked")
        picked = best.select(*by, "id", "boosted", F.lit(rank).alias("rank0"))
        found = picked if found is None else found.unionByName(picked)
        taken = best.select(*by, F.col("id").alias("_id"), F.col("embedding").alias("_embedding"))
        like = inner_product(F.col("embedding"), F.col("_embedding"))
        rows = rows.join(taken, [*by]).where(F.col("id") != F.col("_id")).withColumn("likest", F.greatest(F.col("likest"), like)).drop("_id", "_embedding")
    return found


def mmr_expression(candidates: DataFrame, vectors: DataFrame, k: int = 10, weight: float = fixed.MMR_LAMBDA, by: tuple[str, ...] = BY) -> DataFrame:
    """:func:`mmr` by built-in expressions alone: a fold over the places to fill, on the array of a query's candidates."""
    rows = candidates.select(*by, "id", "boosted", "place").join(vectors.select("id", F.col("embedding").cast("array<double>").alias("v")), "id")
    low, high = (f(F.col("boosted")).over(Window.partitionBy(*by)) for f in (F.min, F.max))
    relevance = F.when(high > low, (F.col("boosted") - low) / (high - low)).otherwise(1.0)
    rows = rows.withColumn("relevance", relevance)
    grouped = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("place", "id", "boosted", "relevance", "v"))).alias("c"))
    kind = dict(grouped.dtypes)["c"][len("array<") : -1]

    def step(state: Column, _: Column) -> Column:
        def best(acc: Column, c: Column) -> Column:
            likest = F.array_max(F.transform(state["chosen"], lambda s: inner_product(s["v"], c["v"])))
            worth = F.round(F.when(F.size(state["chosen"]) == 0, c["relevance"]).otherwise(F.lit(weight) * c["relevance"] - F.lit(1 - weight) * likest), DIGITS)
            return F.when(acc["worth"].isNull() | (worth > acc["worth"]), F.struct(worth.alias("worth"), c.alias("c"))).otherwise(acc)

        none = F.struct(F.lit(None).cast("double").alias("worth"), F.lit(None).cast(kind).alias("c"))

        def taken(found: Column) -> Column:
            more = F.when(found["c"].isNull(), state["chosen"]).otherwise(F.concat(state["chosen"], F.array(found["c"])))
            left = F.filter(state["left"], lambda c: ~c["place"].eqNullSafe(found["c"]["place"]))
            return F.struct(more.alias("chosen"), left.alias("left"))

        return F.get(F.transform(F.array(F.aggregate(state["left"], none, best)), taken), F.lit(0))

    start = F.struct(F.array().cast(f"array<{kind}>").alias("chosen"), F.col("c").alias("left"))
    picked = grouped.select(*by, F.posexplode(F.aggregate(F.sequence(F.lit(1), F.lit(k)), start, step)["chosen"]).alias("rank0", "p"))
    return picked.select(*by, "p.id", "p.boosted", F.col("rank0").cast("int").alias("rank0"))


def federate(hits: DataFrame, k: int = fixed.FEDERATED_TOP, rrf_k: int = fixed.RRF_K) -> DataFrame:
    """(query_id, id, category, score, place) from (query_id, category, id, rank0, score) lists of several categories.

    Ranks are fused; ties go to the category whose first hit scores higher, then to the smaller category and id.
    """
    # The lists have a whole search behind them and are read once.
    strength = F.max(F.when(F.col("rank0") == 0, F.col("score"))).over(Window.partitionBy("query_id", "category"))
    fused = F.round(F.sum(reciprocal(F.col("rank0"), rrf_k)), DIGITS)
    rows = hits.withColumn("strength", strength).groupBy("query_id", "id").agg(fused.alias("fused"), F.max_by("strength", "category").alias("strength"), F.max("category").alias("category"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fused"), F.desc(F.coalesce("strength", F.lit(0.0))), "category", "id")) - 1
    return rows.select("query_id", "id", "category", F.col("fused").alias("score"), place.cast("int").alias("place")).where(F.col("place") < k)


def related(hits: DataFrame, category: str = "judgments", k: int = fixed.RELATED_TOP) -> DataFrame:
    """The first ``k`` hits of one category."""
    return hits.where((F.col("category") == category) & (F.col("rank0") < k))
