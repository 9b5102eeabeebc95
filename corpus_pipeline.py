"""From raw documents to packed training sequences, in five stages.

Each stage takes all that the one before it kept and returns the columns of ``documents``; the last returns
the pieces of the packed sequences. Stages are separate jobs: what a stage returns is written as Parquet
and read again as the next one's input.

Defined results of all stages: null and empty texts have no language and go in the first stage; texts of any length are taken whole;
rows that repeat an id and a text are copies, of which one stays; ties fall to the smaller id; an empty table gives an
empty one, also where no document is labelled with a language; columns beside doc_id, text, lang, source and n_chars pass through unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import langid, mixing, packing, secrets, similar
from corpusloom.runtime import release_shuffles, scratch, settle, size_batches, stash, table

#: Documents whose selected languages have a smaller share of their text together than this, or that have none at all, are rejected.
MIN_LANGUAGE_SCORE = 0.4


def begin(spark: SparkSession) -> None:
    """What a stage starts with: batches for whole texts, and executors without the heap that the stage before it needed."""
    size_batches(spark)
    settle(spark)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a determined language, or several, stay."""
    begin(spark)
    return langid.keep_identified(docs, MIN_LANGUAGE_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest doc_id; near copies share 0.8 or more of their five-word shingles.

    SimHash ball hashing as in operator 6, over parts of a wider fingerprint, as 0.8 lies beyond the radius of 4 of its query.
    """
    begin(spark)
    return similar.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark."""
    begin(spark)
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are there as often as the mix takes them, the one at its source's cut in part."""
    begin(spark)
    return mixing.mixed_documents(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the sequences."""
    begin(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("sequence_packing", sequence_packing),
]

#: SQL can't express several of the stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage has written for itself goes when its result is there."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(stash(stage(spark, docs, sf_dir), name))
        release_shuffles(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
