"""Mixing sources to target weights.

Each document gets a hash-random key. Within its source, documents are sorted by the key in
ranges of the key space, token counts are summed up across ranges, and each source is cut at
exactly its budget; a budget over the source's size repeats whole epochs first. Keys are uniform,
so key ranges split a hot source evenly without sampling, and reruns agree.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share
``TOTAL_SHARE`` of all sizes; a target stops at ``MAX_EPOCHS`` times its source's size, and what is
over goes to the others by weight until none is above. That ends at one water level: every target
is the smaller of its limit and level x weight.

Defined results: a null text has size 0; sources without words get target 0; a null source is a
source of its own. Ties of the key fall to the smaller doc_id; rows repeated in every column count
one by one. Texts of any length are counted whole. An empty table gives an empty one. Columns other
than ``doc_id``, ``text`` and ``source`` aren't read by :func:`mix`.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD_PATTERN
from corpusloom.runtime import drop, stash

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2
#: Hex digits of the key that name its range: 16 ** 3 ranges for each source.
RANGE_DIGITS = 3
#: Equal rows that one array numbers.
REPEAT_BLOCK = 8192
#: Sources (some 100 bytes each) up to which their cuts are broadcast; with more, a source's documents are dealt to SALTS places.
BROADCAST_SOURCES = 20_000
SALTS = 32


def target_level(weighted: DataFrame) -> float | None:
    """The water level of (weight, source_size) rows, None where every source stops at its limit.

    With the sources full at one level, the rest of the budget gives the next; levels only rise, so the
    rounds end as soon as no further source is full. A round is one aggregate, whatever the number of sources.
    """
    limit = F.col("source_size") * MAX_EPOCHS
    level = -1.0
    while True:
        full = limit < F.col("weight") * level
        got = weighted.agg(
            F.sum("source_size").alias("size"), F.sum(F.when(full, limit).otherwise(0)).alias("full"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("open")
        ).first()
        if not got["open"]:
            return None
        found = (got["size"] * TOTAL_SHARE - got["full"]) / got["open"]
        if found <= level:
            return level
        level = found


def targets(sizes: DataFrame) -> DataFrame:
    """(skey, source_size) -> (skey, source_size, target), for any number of sources."""
    # Sorted partitions of ranges number the sources; what comes to the driver is a count for each partition.
    rows = stash(sizes.repartitionByRange("skey").sortWithinPartitions("skey").withColumn("place", F.monotonically_increasing_id()), "sources")
    part, inside = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    counts = sorted(rows.groupBy(part.alias("part")).count().collect())
    before = dict(zip((r["part"] for r in counts), itertools.accumulate((r["count"] for r in counts), initial=0)))
    offset = F.element_at(F.create_map(*(F.lit(x).cast("long") for pair in before.items() for x in pair)), part) if before else F.lit(0)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((offset + inside) % len(WEIGHTS) + 1).cast("int"))
    weighted = rows.select("skey", "source_size", weight.alias("weight"))
    limit = (F.col("source_size") * MAX_EPOCHS).cast("double")
    level = target_level(weighted)
    return weighted.select("skey", "source_size", (limit if level is None else F.least(limit, F.col("weight") * F.lit(level))).alias("target"))


def source_key() -> Column:
    """Orders sources by code point with null last."""
    return F.when(F.col("source").isNull(), F.lit("2")).otherwise(F.concat(F.lit("1"), F.col("source").cast("string")))


def word_count() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def random_key() -> Column:
    """A document's hash-random place in its source."""
    return F.md5(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).cast("binary"))


def sized(documents: DataFrame) -> DataFrame:
    """(doc_id, skey, size, key) of each document."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), source_key().alias("skey"), word_count().alias("size"), random_key().alias("key"))


def placed(rows: DataFrame) -> DataFrame:
    """Distinct rows of :func:`sized` with their number ``n``, the words of their source before them (``start``), and source_size, target, budget and epochs.

    Equal rows are counted before they are shuffled, so an id that many rows have is one row here.
    """
    groups = rows.groupBy("skey", "key", "doc_id", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("range", F.substring("key", 1, RANGE_DIGITS)).withColumn("words", F.col("size") * F.col("n"))
    ranges = groups.groupBy("skey", "range").agg(F.sum("words").alias("range_size"))
    goals = targets(ranges.groupBy("skey").agg(F.sum("range_size").alias("source_size")))
    before = F.coalesce(F.sum("range_size").over(Window.partitionBy("skey").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.select("skey", "range", before.alias("range_start")).join(goals, "skey")
    in_range = Window.partitionBy("skey", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    budget = F.floor("target")
    found = groups.withColumn("upto", F.sum("words").over(in_range)).join(starts, ["skey", "range"])
    return found.select(
        "skey", "key", "doc_id", "size", "n", (F.col("range_start") + F.col("upto") - F.col("words")).alias("start"), "source_size", "target", budget.alias("budget"),
        F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).alias("epochs"),
    )


def mix(documents: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each document."""
    rows = placed(stash(sized(documents), "mix"))
    # One row again for each of equal rows, in two steps, so that no array is long.
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(REPEAT_BLOCK).cast("long")))
    nth = F.explode(F.sequence(F.col("block"), F.least(F.col("block") + REPEAT_BLOCK, F.col("n")) - 1))
    rows = rows.withColumn("block", block).withColumn("nth", nth)
    start = F.col("start") + F.col("nth") * F.col("size")
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("budget") - F.col("epochs") * F.col("source_size") - start))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def cuts(rows: DataFrame) -> DataFrame:
    """(skey, epochs, cut, full, part): for each source the whole epochs that are taken, and the (key, size) at which the last one ends.

    Of the rows at the cut itself the mix takes ``part`` words each; ``cut`` is null where the last epoch takes nothing or all.
    """
    left = F.col("budget") - F.col("epochs") * F.col("source_size")
    at_cut = (F.col("start") < left) & (F.col("start") + F.col("n") * F.col("size") >= left)
    found = placed(rows).groupBy("skey").agg(
        F.max("epochs").alias("epochs"), F.max(F.when(at_cut, F.struct("key", "size"))).alias("cut"), F.max(F.when(at_cut, F.floor((left - F.col("start")) / F.col("n")))).alias("part")
    )
    return found


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The documents of the mix, in the columns of ``documents``.

    A document is there once for each whole time it is taken; one at its source's cut is there up
    to its last taken word. A document of which nothing is taken is not; one without words is there once.
    Rows at a cut that are equal in id, source and size share what is left there evenly, rounded down.

    A document needs no more than its source's epochs and cut, so texts aren't shuffled: the few numbers
    of each source come to them.
    """
    columns = documents.columns
    rows = stash(sized(documents), "mix")
    found = stash(cuts(rows), "cuts")
    drop(rows)
    found = found.select(F.col("skey").alias("_skey"), F.col("epochs").alias("_epochs"), F.col("cut").alias("_cut"), F.col("part").alias("_part"))
    rows = documents.withColumns({"_size": word_count(), "_key": random_key(), "_source": source_key()})
    if found.count() <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(found), F.col("_source") == F.col("_skey"))
    else:
        # So many sources are shuffled to; a hot one is dealt to SALTS places.
        salted = found.withColumn("_place", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("_salt", F.pmod(F.xxhash64("_key", "text"), F.lit(SALTS)).cast("int")).join(salted, (F.col("_source") == F.col("_skey")) & (F.col("_salt") == F.col("_place")))
    own = F.struct(F.col("_key").alias("key"), F.col("_size").alias("size"))
    last = F.when(F.col("_cut").isNull(), 0).when(own < F.col("_cut"), F.col("_size")).when(own == F.col("_cut"), F.col("_part")).otherwise(0)
    whole = F.transform(F.sequence(F.lit(1).cast("long"), F.col("_epochs")), lambda _: F.col("_size"))
    copies = F.filter(F.concat(F.when(F.col("_epochs") > 0, whole).otherwise(F.array().cast("array<bigint>")), F.array(last.cast("long"))), lambda n: n > 0)
    copies = F.when(F.col("_size") == 0, F.array(F.lit(0).cast("long"))).otherwise(copies)
    # Split behind each word: every part is a word with the white space before it.
    parts = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.when(F.col("_words") < F.col("_size"), F.array_join(F.slice(parts, F.lit(1), F.col("_words").cast("int")), "")).otherwise(F.col("text"))
    kept = joined.withColumn("_words", F.explode(copies)).withColumn("text", cut)
    if "n_chars" in columns:
        kept = kept.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(documents.schema["n_chars"].dataType))
    return kept.select(*columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '2' ELSE '1' || source END AS skey,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
s AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY skey),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY skey) - 1) % 3 + 1)::INT] AS weight, source_size * 2 AS lim FROM s),
l AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) * CAST(1.5 AS DOUBLE) AS budget,
         CAST(sum(weight) OVER () - coalesce(sum(weight) OVER r, 0) AS BIGINT) AS left_weight,
         CAST(coalesce(sum(lim) OVER r, 0) AS BIGINT) AS full_before
  FROM w WINDOW r AS (ORDER BY CAST(lim AS DOUBLE) / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, (budget - full_before) / CAST(left_weight AS DOUBLE) AS lvl FROM l),
f AS (SELECT *, CASE WHEN weight * lvl <= lim THEN lvl END AS free_level FROM v),
t AS (
  SELECT skey, source_size,
         coalesce(weight * first_value(free_level IGNORE NULLS) OVER (ORDER BY CAST(lim AS DOUBLE) / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), CAST(lim AS DOUBLE)) AS target
  FROM f),
c AS (
  SELECT d.*, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         CAST(sum(size) OVER (PARTITION BY d.skey ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS start
  FROM d JOIN t ON d.skey = t.skey),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM c)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + least(size, greatest(0, budget - epochs * source_size - start)) AS BIGINT) AS taken
FROM e
"""
