"""Chunking as a table function of SQL, for lateral joins.

``register(spark)`` makes it known to a session::

    SELECT d.doc_id, c.* FROM documents d, LATERAL chunks(d.text, 'acts') c
    SELECT d.doc_id, c.* FROM documents d, LATERAL chunks(d.text, 'sentence', 500) c
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from corpusloom import fixed
from corpusloom.operators.chunking import structural_chunks

#: Built from types, as calls are checked where there is no session to read DDL.
SCHEMA = StructType(
    [StructField("chunk_index", IntegerType())]
    + [StructField(name, StringType()) for name in ("section", "parent", "heading")]
    + [StructField("hierarchy_path", ArrayType(StringType())), StructField("start_offset", IntegerType()), StructField("end_offset", IntegerType()), StructField("text", StringType())]
)
SENTENCE, MAX_CHARS = "sentence", 1000


@dataclass
class Plan(AnalyzeResult):
    """What a call was checked to ask for: delimiters, or the greatest size of packed sentences."""

    delimiters: list = field(default_factory=list)
    max_chars: int = MAX_CHARS


def packed_sentences(text: str, max_chars: int) -> Iterator[tuple[int, int]]:
    """(start, end) of chunks of whole sentences that fit ``max_chars``; a longer sentence stands alone."""
    start = end = 0
    for piece in re.split(r"(?<=[.!?])(?=\s)", text):
        if end > start and end - start + len(piece) > max_chars:
            yield start, end
            start = end
        end += len(piece)
    if end > start:
        yield start, end


class Chunks:
    """``chunks(text, strategy[, max_chars])``: strategy is ``sentence`` or the name of a preset, both constants; a null or blank text has no units."""

    @staticmethod
    def analyze(text: AnalyzeArgument, strategy: AnalyzeArgument, max_chars: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not strategy.isConstantExpression or strategy.value != SENTENCE and strategy.value not in fixed.PRESETS:
            raise ValueError(f"the strategy must be one of these constants: {', '.join([SENTENCE, *fixed.PRESETS])}")
        if max_chars is not None and (not max_chars.isConstantExpression or max_chars.value is None or max_chars.value < 1):
            raise ValueError("max_chars must be a constant of at least 1")
        size = MAX_CHARS if max_chars is None else int(max_chars.value)
        return Plan(schema=SCHEMA, delimiters=list(fixed.PRESETS.get(strategy.value, ())), max_chars=size)

    def __init__(self, plan: Plan):
        self.compiled = [(re.compile(pattern, re.M), level) for pattern, level in plan.delimiters]
        self.max_chars = plan.max_chars

    def eval(self, text: str, strategy: str, max_chars: int | None = None) -> Iterator[tuple]:
        if strategy == SENTENCE:
            units = ((None, None, None, [], a, b, text[a:b]) for a, b in packed_sentences(text or "", self.max_chars))
        else:
            units = structural_chunks(text or "", self.compiled)
        for index, unit in enumerate(units):
            yield (index, *unit)


def register(spark: SparkSession, name: str = "chunks") -> None:
    """Make the table function known to the session under ``name``."""
    spark.udtf.register(name, udtf(Chunks, useArrow=True))
