"""Corpus fingerprints: of rows, and of files with what is known of each kept, so that only new files are read."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = "file string, size long, changed timestamp, x long, s decimal(38,0), n long"


def row_hash(rows: DataFrame) -> Column:
    """60 bits of a row's MD5, its columns by name."""
    simple = lambda c, kind: F.to_json(F.col(c)) if kind.startswith(("array", "struct", "map")) else F.col(c).cast("string")
    row = F.concat_ws("\x1f", *(F.coalesce(simple(c, kind), F.lit("\x1e")) for c, kind in sorted(rows.dtypes)))
    return F.conv(F.substring(F.md5(row.cast("binary")), 1, 15), 16, 10).cast("long")


def combined(x: int | None, s, n: int) -> str:
    """Exclusive-or and sum of row hashes, and their number, as one fingerprint; the order of rows doesn't matter."""
    return hashlib.sha256(f"{x}/{s}/{n}".encode()).hexdigest()


def _sums(h: str) -> tuple[Column, ...]:
    return F.bit_xor(h).alias("x"), F.sum(F.col(h).cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")


def of_rows(rows: DataFrame) -> tuple[str, int]:
    """Fingerprint and number of the rows, in one pass."""
    got = rows.select(row_hash(rows).alias("h")).agg(*_sums("h")).first()
    return combined(got["x"], got["s"], got["n"]), got["n"]


def place(file: Column) -> Column:
    """A file's address; Spark writes local ones with one slash or three."""
    return F.regexp_replace(file, "^file:/+", "file:/")


def listing(spark: SparkSession, source: str) -> DataFrame:
    """(path, file, size, changed) of the files below ``source``, ``file`` as rows name theirs; nothing in them is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source)
    return files.select("path", place(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("changed"))


def of_files(spark: SparkSession, source: str, read: Callable[[list[str]], DataFrame], known: DataFrame | None = None) -> DataFrame:
    """PARTS of the files below ``source``, whose rows ``read`` makes of a list of them.

    Files that ``known`` has with the same size and time keep what it says; the others are read, and nothing else is. ``read`` may
    select and compute, but not shuffle, as a row has to be of one file.
    """
    now = listing(spark, source)
    if known is None:
        known = spark.createDataFrame([], PARTS)
    kept = now.drop("path").join(known, ["file", "size", "changed"])
    new = now.join(known, ["file", "size", "changed"], "left_anti").collect()
    if not new:
        return kept.select(*(c.split(" ")[0] for c in PARTS.split(", ")))
    rows = read([r["path"] for r in new])
    sums = rows.select(place(F.input_file_name()).alias("file"), row_hash(rows).alias("h")).groupBy("file").agg(*_sums("h"))
    files = spark.createDataFrame([(r["file"], r["size"], r["changed"]) for r in new], "file string, size long, changed timestamp")
    # A file without rows has no sums.
    fresh = files.join(sums, "file", "left").withColumns({"s": F.coalesce("s", F.lit(0).cast("decimal(38,0)")), "n": F.coalesce("n", F.lit(0))})
    return kept.unionByName(fresh)


def of_parts(parts: DataFrame) -> tuple[str, int]:
    """The fingerprint of all rows of the files, as :func:`of_rows` gives it, and their number."""
    got = parts.where("n > 0").agg(F.bit_xor("x").alias("x"), F.sum("s").cast("decimal(38,0)").alias("s"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    return combined(got["x"], got["s"], got["n"]), got["n"]
