"""From hits to evidence, prompts and responses."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import fixed
from corpusloom.functions import labels
from corpusloom.functions.text import blank_to_null, excerpt, strip
from corpusloom.operators.texts import TextStore

SYSTEM_PROMPT = (
    "Answer legal questions from the supplied evidence only. Cite passages by their labels in square brackets, such as [S1]. "
    "Say what the evidence leaves open, never invent a source, and close with a note that this is information, not advice."
)
NO_MODEL = "no model gave an answer"
METADATA = ("category", "source_doc", "court", "date", "section", "heading")


def lookup(ids: DataFrame, chunks: DataFrame | TextStore, order: str | None = None) -> DataFrame:
    """The chunks of the distinct ids in ``ids``; unknown ids drop out. With ``order``, a column of ``ids``, ``place`` is an id's first place in it.

    A store of texts is read at the ids alone, a table of chunks whole.
    """
    if isinstance(chunks, TextStore):
        chunks = chunks.lookup(ids)
    if order:
        return chunks.join(ids.groupBy(F.col("id").alias("chunk_id")).agg(F.min(order).alias("place")), "chunk_id")
    return chunks.join(ids.select(F.col("id").alias("chunk_id")).distinct(), "chunk_id", "left_semi")


def filled(value: Column, other: Column, kind: str) -> Column:
    """``value`` where it isn't empty (null, '' or an empty array), else ``other``."""
    own = blank_to_null(value) if kind == "string" else F.when(F.size(value) > 0, value) if kind.startswith("array") else value
    return F.coalesce(own, other)


def gather(hits: DataFrame, chunks: DataFrame | TextStore) -> DataFrame:
    """Hits with their chunks' columns; what the chunk leaves empty comes from the hit. Hits without text drop out."""
    if isinstance(chunks, TextStore):
        chunks = chunks.lookup(hits)
    shared = [c for c in hits.columns if c in chunks.columns]
    other = chunks.select(F.col("chunk_id").alias("id"), *(F.col(c).alias(f"_{c}") if c in shared else F.col(c) for c in chunks.columns if c != "chunk_id"))
    rows = hits.join(other, "id")
    for c in shared:
        rows = rows.withColumn(c, filled(F.col(f"_{c}"), F.col(c), chunks.schema[c].dataType.simpleString())).drop(f"_{c}")
    return rows.where(evidence_text(rows) != "")


def evidence_text(rows: DataFrame) -> Column:
    """The original text, else the text, trimmed."""
    have = [F.col(c) for c in ("original_text", "text") if c in rows.columns]
    return strip(F.coalesce(*(blank_to_null(c) for c in have), F.lit("")))


def passage(label: Column, row: dict[str, Column], text: Column) -> Column:
    """A labelled passage: label, the metadata that is there, text."""
    meta = F.array_compact(F.array(*(F.when(value != "", F.concat(F.lit(f"{name}: "), value)) for name, value in row.items())))
    head = F.concat(F.lit("["), label, F.lit("]"), F.when(F.size(meta) > 0, F.concat(F.lit("\n"), F.array_join(meta, "\n"))).otherwise(""))
    return F.concat(head, F.lit("\nPassage:\n"), text)


def prompts(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, user_message): each question with its evidence (query_id, rank0, text, original_text and metadata) in order.

    Labels count all evidence, also what has no text and is left out.
    """
    have = lambda c: F.col(c) if c in evidence.columns else F.lit(None).cast("string")
    text = strip(F.coalesce(blank_to_null(have("text")), have("original_text"), F.lit("")))
    block = F.when(text != "", passage(F.concat(F.lit("S"), (F.col("rank0") + 1).cast("string")), {name: have(name) for name in METADATA}, text))
    blocks = evidence.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank0", block.alias("block")))).alias("blocks"))
    joined = questions.select("query_id", "question").join(blocks, "query_id", "left")
    shown = F.array_join(F.transform(F.filter("blocks", lambda b: b["block"].isNotNull()), lambda b: b["block"]), "\n\n")
    body = F.when(F.col("blocks").isNull(), fixed.NO_EVIDENCE_PROMPT).when(shown == "", fixed.NO_TEXT_PROMPT).otherwise(shown)
    message = F.concat(F.lit("QUESTION:\n"), strip(F.col("question")), F.lit("\n\nRETRIEVED LEGAL EVIDENCE:\n"), body, F.lit("\n\n" + fixed.ANSWER_INSTRUCTION))
    blank = strip(F.coalesce("question", F.lit(""))) == ""
    return joined.select("query_id", F.when(blank, F.raise_error(F.lit("question must not be empty")).cast("string")).otherwise(message).alias("user_message"))


def history(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, content): the turns of a conversation that go into a prompt."""
    content = strip(F.coalesce("text", F.lit("")))
    return turns.where(F.col("role").isin("user", "assistant") & (content != "")).select("conv_id", "turn", "role", content.alias("content"))


def validated(questions: DataFrame, max_chars: int = fixed.QUESTION_MAX_CHARS) -> DataFrame:
    """(query_id, question) trimmed; a blank question, or one of over ``max_chars`` characters, is an error."""
    question = strip(F.coalesce("question", F.lit("")))
    checked = F.when(question == "", F.raise_error(F.lit("question must not be empty")).cast("string")).when(
        F.length("question") > max_chars, F.raise_error(F.lit(f"question must have at most {max_chars} characters")).cast("string")
    )
    return questions.withColumn("question", checked.otherwise(question))


def answers(prompted: DataFrame, generate: Callable[..., str], fallback: Callable[..., str] | None = None, history: list[dict] | None = None) -> DataFrame:
    """``prompted`` with ``answer``: ``generate(system, user)`` on the executors; where it fails or is blank, ``fallback``.

    With ``history``, turns (role, content) of the conversation before, models are called with it as the third argument.
    """
    before = (history,) if history else ()

    @F.pandas_udf("string")
    def ask(messages: pd.Series) -> pd.Series:
        out = []
        for message in messages:
            reply, errors = "", []
            for model in filter(None, (generate, fallback)):
                try:
                    reply = model(SYSTEM_PROMPT, message, *before) or ""
                except Exception as error:
                    errors.append(str(error))
                if reply.strip():
                    break
            if not reply.strip():
                raise RuntimeError(NO_MODEL + ": " + "; ".join(errors or ["empty"]))
            out.append(reply)
        return pd.Series(out)

    return prompted.withColumn("answer", ask("user_message"))


def answered(questions: DataFrame, hits: DataFrame, chunks: DataFrame, generate: Callable[..., str], fallback: Callable[..., str] | None = None, history: list[dict] | None = None) -> tuple[DataFrame, DataFrame]:
    """(query_id, question, answer, retrieved, used) and the evidence, its places numbered anew.

    The model is asked only where there is evidence with text; the answers to the other questions say what is missing.
    """
    asked = validated(questions)
    found = gather(hits, chunks)
    found = found.withColumn("rank0", (F.row_number().over(Window.partitionBy("query_id").orderBy("rank0")) - 1).cast("int"))
    counts = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("retrieved")).join(found.groupBy("query_id").agg(F.count(F.lit(1)).alias("used")), "query_id", "left")
    rows = asked.join(counts, "query_id", "left").withColumns({"retrieved": F.coalesce("retrieved", F.lit(0)), "used": F.coalesce("used", F.lit(0))})
    with_text = rows.where("used > 0")
    told = answers(with_text.join(prompts(with_text, found), "query_id"), generate, fallback, history).drop("user_message")
    said = F.when(F.col("retrieved") == 0, fixed.NO_EVIDENCE_ANSWER).otherwise(fixed.NO_TEXT_ANSWER)
    return told.unionByName(rows.where("used = 0").withColumn("answer", said)), found


def item(rows: DataFrame, fields: tuple[str, ...], *more: Column) -> Column:
    """A passage of a response: its id, the fields that the rows have (null where empty), its score and an excerpt."""
    kinds = dict(rows.dtypes)
    shown = [(blank_to_null(F.col(c)) if kinds[c] == "string" else F.col(c)).alias(c) if c in kinds else F.lit(None).cast("string").alias(c) for c in fields]
    score = F.col("score").cast("double") if "score" in kinds else F.lit(None).cast("double")
    original, text = (F.col(c) if c in kinds else F.lit(None).cast("string") for c in ("original_text", "text"))
    return F.struct("rank0", F.col("id").alias("chunk_id"), *shown, *more, score.alias("retrieval_score"), excerpt(original, text).alias("text"))


def responses(answered: DataFrame, evidence: DataFrame, related: DataFrame | None = None) -> DataFrame:
    """(query_id, answer, evidence, related_cases, validation, limitations, retrieved_count, used_count).

    From (query_id, answer, retrieved), evidence with text, and ``related`` hits with their chunks' columns (those without text drop out).
    """
    path = F.coalesce("hierarchy_path", F.array().cast("array<string>")) if "hierarchy_path" in evidence.columns else F.array().cast("array<string>")
    shown = item(evidence, ("category", "source_doc", "section", "heading", "parent", "court", "date"), path.alias("hierarchy_path"))
    counted = evidence.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(shown)).alias("evidence"))
    rows = answered.join(counted, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rows = rows.withColumn("answer", labels.normalize_labels(F.col("answer"))).withColumn("validation", labels.validate_labels(F.col("answer"), F.col("n")))
    if related is None:
        cases = F.array()
    else:
        texts = related.where(evidence_text(related) != "")
        listed = texts.groupBy("query_id").agg(F.sort_array(F.collect_list(item(texts, ("source_doc", "section", "heading", "court", "date")))).alias("related_cases"))
        rows, cases = rows.join(listed, "query_id", "left"), F.coalesce("related_cases", F.array().cast(dict(listed.dtypes)["related_cases"]))
    shown = F.coalesce("evidence", F.array().cast(dict(counted.dtypes)["evidence"]))
    limits = labels.limitations(F.col("n"), F.col("retrieved"), F.col("validation.warnings"))
    question = [F.col("question")] if "question" in answered.columns else []
    return rows.select("query_id", *question, "answer", shown.alias("evidence"), cases.alias("related_cases"), "validation", limits.alias("limitations"), F.col("retrieved").cast("long").alias("retrieved_count"), F.col("n").alias("used_count"))
