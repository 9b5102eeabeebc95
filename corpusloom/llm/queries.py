"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import ballkmeans, compression, langid, lines, mixing, neighbours, overlaps, packing, repeats, secrets, simhash, toxicity, warc
from corpusloom.runtime import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole texts of ``documents`` scored by the classifier trained on ``labels``."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in each whole text: counts and a digest of base spans, and all spans."""
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each text without the bytes of any 200-byte string that starts twice."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), keep="none", texts=False)


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest found of each vector whose id is divisible by 100."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of four-word shingles and the components of those within 4 bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"), texts=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all tokenised documents with their places in sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each whole text."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts, base rules and the verdict of the compression bands for each text."""
    return compression.compression_bands(table(spark, sf_dir, "documents"))


def op11_session_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales and the same client's click sessions that share hours, counted by relation."""
    return overlaps.session_overlaps(table(spark, sf_dir, "sales"), table(spark, sf_dir, "sale_lines"), table(spark, sf_dir, "clicks"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each text without the lines of five documents or more."""
    return lines.dedup_lines(table(spark, sf_dir, "documents"), texts=False)


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters of ``embeddings`` after five rounds."""
    return ballkmeans.ball_kmeans(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_toxicity, op2_source_mix, op3_secret_scan, op4_repeated_passages, op5_nearest_neighbours, op6_simhash, op7_warc_round_trip, op8_packing, op9_language_id, op10_compression_bands, op11_session_overlaps, op12_line_dedup, op13_ball_kmeans)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_source_mix": mixing.ORACLE, "op7_warc_round_trip": warc.ORACLE, "op11_session_overlaps": overlaps.ORACLE, "op12_line_dedup": lines.ORACLE, "op13_ball_kmeans": ballkmeans.ORACLE}
