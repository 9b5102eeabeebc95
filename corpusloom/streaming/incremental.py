"""Building an index as chunk files arrive, resumable from its checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import dense, lifecycle
from corpusloom.sources.readers import CHUNK_SCHEMA


def incremental_index(spark: SparkSession, source: str, path: str, make_encoder=dense.hashing_encoder, files_per_batch: int = 1000, schema: str = CHUNK_SCHEMA, model: str = "hashing"):
    """Bring the index below ``path`` to the chunk files in ``source`` that its checkpoint doesn't have yet, then stop.

    Every micro-batch is an update (:func:`lifecycle.update_index`): chunks whose ids the index has replace them, and where the schema has a
    boolean ``deleted``, chunks that say so are taken out. A batch that was broken off is done again, and one whose
    snapshot is there is passed over, so no row is lost or doubled. A line that isn't a chunk, or an id given twice in a batch, stops
    the stream with an error.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("mode", "FAILFAST").json(source)

    def write(batch: DataFrame, number: int) -> None:
        deleted = None
        if "deleted" in batch.columns:
            out = F.coalesce("deleted", F.lit(False))
            deleted = batch.where(out).select(F.col("chunk_id").alias("id"))
            batch = batch.where(~out).drop("deleted")
        lifecycle.update_index(batch, path, deleted, model, make_encoder=make_encoder, batch=number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
