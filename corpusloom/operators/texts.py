"""Texts kept for lookups of a few ids: folders by a hash of the id, rows sorted by id in small row groups, with Bloom filters.

A lookup of few ids names folders and ids to the reader. It opens the file of each id's folder and reads the row groups that its ranges and
Bloom filters don't rule out, so what it reads doesn't depend on how many texts there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts of a folder, and bytes of a row group.
FOLDER_TEXTS = 1 << 16
GROUP_BYTES = 1 << 20
#: Rows after which a row group's size is looked at again, at the latest.
GROUP_CHECK = 128
#: Ids up to which a lookup names them; more are joined.
NAMED_IDS = 1000
#: The column of a row's hash, which lookups leave out.
HASH = "_hash"
#: Values up to which Spark hands a list to the Parquet reader as it is.
NAMED_AT_ONCE = 10


def folder_of(identifier: Column | str, folders: int) -> Column:
    return F.pmod(F.xxhash64(F.col(identifier).cast("string") if isinstance(identifier, str) else identifier.cast("string")), F.lit(folders)).cast("int")


def folders_for(count: int) -> int:
    """How many folders ``count`` texts get, a power of two."""
    return 1 << max(0, -(-count // FOLDER_TEXTS) - 1).bit_length()


def write_texts(chunks: DataFrame, path: str, folders: int) -> str:
    """The rows of ``chunks`` (chunk_id, ...) below ``path``, one for each id; their columns, as JSON."""
    rows = chunks.withColumn("folder", folder_of("chunk_id", folders)).repartition("folder").dropDuplicates(["folder", "chunk_id"]).sortWithinPartitions("folder", "chunk_id")
    # One row group can't be smaller than a page of each column, so pages are small as well.
    # The writer looks at its size after as many rows as it expects to fit, else up to 10,000, whatever their length.
    writer = rows.write.option("parquet.block.size", GROUP_BYTES).option("parquet.page.size", GROUP_BYTES // 8).option("parquet.page.size.row.check.max", GROUP_CHECK).option("parquet.bloom.filter.enabled#chunk_id", "true")
    writer.option("parquet.bloom.filter.expected.ndv#chunk_id", 4096).partitionBy("folder").parquet(path)
    return rows.schema.json()


def one_of(column: str, values: list) -> Column:
    """``column`` is one of ``values``, put so that the Parquet reader gets each of them."""
    found = F.lit(False)
    for start in range(0, len(values), NAMED_AT_ONCE):
        found = found | F.col(column).isin(values[start : start + NAMED_AT_ONCE])
    return found


class TextStore:
    """Texts of one or more segments: (number, folders, rows with folder) each, and ids that count no more in earlier ones."""

    def __init__(self, parts: list[tuple[int, int, DataFrame]], gone: DataFrame | None = None):
        self.parts, self.gone = parts, gone

    def rows(self, hashes: bool = False) -> DataFrame:
        """All texts."""
        return self._living([rows.withColumn("segment", F.lit(number)) for number, _, rows in self.parts], self.gone, hashes)

    def lookup(self, ids: DataFrame, hashes: bool = False) -> DataFrame:
        """The rows of the distinct ids in the column ``id`` of ``ids``; unknown ids drop out."""
        wanted = ids.select("id").distinct()
        counts = sorted({folders for _, folders, _ in self.parts})
        few = wanted.where("id IS NOT NULL").select("id", *(folder_of("id", n).alias(str(n)) for n in counts)).limit(NAMED_IDS + 1).collect()
        gone, found = self.gone, []
        if len(few) <= NAMED_IDS:
            values = sorted(r["id"] for r in few)
            for number, folders, rows in self.parts:
                named = rows.where(F.col("folder").isin(sorted({r[str(folders)] for r in few})) & one_of("chunk_id", values))
                found.append(named.withColumn("segment", F.lit(number)))
            gone = gone.where(F.col("id").isin(values)) if gone is not None else None
        else:
            for number, folders, rows in self.parts:
                keys = wanted.select(F.col("id").alias("chunk_id"), folder_of("id", folders).alias("folder"))
                found.append(rows.join(keys, ["folder", "chunk_id"], "left_semi").withColumn("segment", F.lit(number)))
        return self._living(found, gone, hashes)

    @staticmethod
    def _living(parts: list[DataFrame], gone: DataFrame | None, hashes: bool) -> DataFrame:
        rows = parts[0]
        for other in parts[1:]:
            rows = rows.unionByName(other, allowMissingColumns=True)
        if gone is not None:
            later = gone.select(F.col("id").alias("_id"), "upto")
            rows = rows.join(later, (F.col("chunk_id") == F.col("_id")) & (F.col("segment") < F.col("upto")), "left_anti")
        return rows.drop("folder", "segment", *([] if hashes else [HASH]))
