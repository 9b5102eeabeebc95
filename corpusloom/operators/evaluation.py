"""Retrieval metrics over (query_id, id, rank0) lists and (query_id, id) relevant pairs, for all cutoffs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.runtime import stash

DIGITS = 6


def judged(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """``hits`` with rank (from 1), is_relevant, is_first (its id's first place) and n_relevant of the query."""
    # Finding the pairs may take a pass over all texts, so they are written once.
    pairs = stash(relevant.select("query_id", "id").distinct(), "relevant")
    counts = pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    rows = hits.select("query_id", "id", (F.col("rank0") + 1).alias("rank")).join(pairs.withColumn("is_relevant", F.lit(True)), ["query_id", "id"], "left").join(counts, "query_id", "left")
    first = F.row_number().over(Window.partitionBy("query_id", "id").orderBy("rank")) == 1
    return rows.withColumns({"is_relevant": F.coalesce("is_relevant", F.lit(False)), "is_first": first, "n_relevant": F.coalesce("n_relevant", F.lit(0))})


def metrics(queries: DataFrame, hits: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """(query_id, k, precision, recall, rr, ap) for each query, those without hits included.

    Lists are cut at k before any metric: precision counts hits over k, recall distinct hits over the relevant,
    rr the first hit's reciprocal rank, ap the mean precision at first-seen hits over the relevant.
    """
    if not ks or min(ks) <= 0:
        raise ValueError("every k must be greater than zero")
    cuts = F.explode(F.array(*(F.lit(k) for k in sorted(set(ks)))))
    cases = queries.select("query_id").distinct().withColumn("k", cuts)
    new = F.col("is_relevant") & F.col("is_first")
    upto = F.sum(new.cast("int")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    rows = judged(hits, relevant).withColumn("gain", F.when(new, upto / F.col("rank")).otherwise(0.0))
    rows = rows.withColumn("k", cuts).where(F.col("rank") <= F.col("k"))
    per = rows.groupBy("query_id", "k").agg(
        F.sum(F.col("is_relevant").cast("int")).alias("hits"), F.sum(new.cast("int")).alias("found"), F.min(F.when(F.col("is_relevant"), F.col("rank"))).alias("first"), F.sum("gain").alias("gain"), F.max("n_relevant").alias("n_relevant"),
    )
    joined = cases.join(per, ["query_id", "k"], "left")
    over = lambda value: F.round(F.when(F.col("n_relevant") > 0, value / F.col("n_relevant")).otherwise(0.0), DIGITS)
    return joined.select(
        "query_id", "k", F.round(F.coalesce(F.col("hits") / F.col("k"), F.lit(0.0)), DIGITS).alias("precision"), F.coalesce(over(F.col("found")), F.lit(0.0)).alias("recall"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), DIGITS).alias("rr"), F.coalesce(over(F.col("gain")), F.lit(0.0)).alias("ap"),
    )


def macro(per_query: DataFrame, *by: str) -> DataFrame:
    """Means over queries for each k (and ``by``): precision, recall, mrr, map."""
    return per_query.groupBy(*by, "k").agg(*(F.round(F.avg(c), DIGITS).alias(name) for c, name in (("precision", "precision"), ("recall", "recall"), ("rr", "mrr"), ("ap", "map"))))


def overall(by_category: DataFrame) -> DataFrame:
    """Means over categories for each k."""
    return by_category.groupBy("k").agg(*(F.round(F.avg(c), DIGITS).alias(c) for c in ("precision", "recall", "mrr", "map")))


def zero_hits(queries: DataFrame, hits: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """The queries without any relevant id among the first ``k``."""
    found = hits.where(F.col("rank0") < k).join(relevant.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi")
    return queries.select("query_id").distinct().join(found, "query_id", "left_anti")
