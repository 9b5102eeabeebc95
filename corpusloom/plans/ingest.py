"""Documents to chunks with summaries, citations and contract metadata, as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import fixed
from corpusloom.functions.citations import citations, internal_references
from corpusloom.functions.summary import prepend_summary, summarize
from corpusloom.functions.text import blank_to_null, strip
from corpusloom.operators.chunking import chunk_documents


def by_model(model: Callable[[str], str]) -> Callable[[Column], Column]:
    """A summarizer that asks ``model`` on the executors, text by text; null where it fails."""

    @F.pandas_udf("string")
    def ask(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            try:
                out.append(model(text or ""))
            except Exception:
                out.append(None)
        return pd.Series(out, dtype=object)

    return ask


def ingest(
    documents: DataFrame, routes: dict[str, tuple[str, str | None]], use_summary: bool = True, summary_chars: int = fixed.SUMMARY_MAX_CHARS,
    citing: tuple[str, ...] = fixed.CITATION_CATEGORIES, max_chars: int = 1000, summarizer=None,
) -> DataFrame:
    """Chunks of ``documents`` (source_doc, source_path, text, category, jurisdiction and maybe parties, effective_date, governing_law).

    ``summarizer`` goes before the heuristic: a function from a text column to a summary column, such as a Pandas UDF
    (see :func:`by_model`). Where its summary is blank, the heuristic's stands.
    """
    text = F.col("text")
    summary = summarize(text, F.col("category"), summary_chars)
    if summarizer:
        summary = F.coalesce(blank_to_null(strip(summarizer(text))), summary)
    rows = documents.withColumn("_summary", summary) if use_summary else documents.withColumn("_summary", F.lit(""))
    chunks = chunk_documents(rows, routes, max_chars=max_chars).withColumn("original_text", F.col("text")).withColumn("sac_applied", F.lit(False))
    if use_summary:
        chunks = prepend_summary(chunks, F.col("_summary"))
    else:
        chunks = chunks.withColumn("doc_summary", F.lit(""))
    original = F.col("original_text")
    have = lambda c, kind: F.col(c).cast(kind) if c in documents.columns else F.lit(None).cast(kind)
    references = internal_references(original)
    contract = F.struct(
        have("parties", "array<string>").alias("parties"), have("effective_date", "string").alias("effective_date"), have("governing_law", "string").alias("governing_law"),
        F.when(F.size(references) > 0, references).alias("internal_refs"),
    )
    return chunks.withColumns({"cites": citations(original, F.col("category"), citing), "contract_meta": F.when(F.col("category") == "contracts", contract)}).drop("_summary")
