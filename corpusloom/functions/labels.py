"""Source labels of generated answers, and the limitations that a response states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom import fixed
from corpusloom.functions.text import strip


def normalize_labels(answer: Column) -> Column:
    """``(s2)`` as ``[S2]``."""
    return F.regexp_replace(answer, r"\(\s*[Ss](\d+)\s*\)", r"[S$1]")


def used_labels(answer: Column) -> Column:
    """The distinct labels in the order of their numbers."""
    numbers = F.transform(F.regexp_extract_all(answer, F.lit(r"\[S(\d+)\]"), F.lit(1)), lambda n: F.struct(n.cast("decimal(38,0)").alias("n"), F.concat(F.lit("S"), n).alias("label")))
    return F.transform(F.array_sort(F.array_distinct(numbers)), lambda s: s["label"])


def validate_labels(answer: Column, evidence: Column) -> Column:
    """A struct that tells whether the labels of an answer are those of ``evidence`` passages, and warnings."""
    blank = answer.isNull() | (strip(answer) == "")
    none = F.array().cast("array<string>")
    used = F.when(blank, none).otherwise(used_labels(answer))
    known = F.when(evidence > 0, F.transform(F.sequence(F.lit(1), F.greatest(evidence, F.lit(1)).cast("int")), lambda i: F.concat(F.lit("S"), i.cast("string")))).otherwise(none)
    unknown = F.filter(used, lambda label: ~F.array_contains(known, label))
    warnings = F.array_compact(
        F.array(
            F.when(F.size(used) == 0, fixed.NO_CITATION_WARNING),
            F.when(F.size(unknown) > 0, F.concat(F.lit(fixed.UNKNOWN_LABEL_WARNING), F.array_join(F.transform(unknown, lambda u: F.concat(F.lit("["), u, F.lit("]"))), ", "))),
            F.when((F.size(used) > 0) & (F.size(unknown) == 0), fixed.UNVERIFIED_WARNING),
        )
    )
    return F.struct(
        ((F.size(used) > 0) & (F.size(unknown) == 0)).alias("valid"),
        (F.size(used) > 0).alias("has_citations"),
        used.alias("used_sources"),
        unknown.alias("unknown_sources"),
        F.when(~blank, F.lit(False)).alias("support_verified"),
        F.when(blank, F.array(F.lit(fixed.EMPTY_ANSWER_WARNING))).otherwise(warnings).alias("warnings"),
    )


def limitations(evidence: Column, retrieved: Column, warnings: Column) -> Column:
    """What a response says about its limits: missing evidence, the warnings once each, support, advice."""
    missing = F.when(evidence == 0, F.when(retrieved == 0, fixed.NO_EVIDENCE_LIMITATION).otherwise(fixed.NO_TEXT_LIMITATION))
    found = F.array_distinct(F.concat(F.array_compact(F.array(missing)), F.coalesce(warnings, F.array().cast("array<string>"))))
    stated = F.exists(found, lambda w: F.contains(F.lower(w), F.lit("substantive legal support")))
    return F.concat(found, F.when(stated, F.array().cast("array<string>")).otherwise(F.array(F.lit(fixed.SUPPORT_LIMITATION))), F.array(F.lit(fixed.ADVICE_LIMITATION)))
