"""What kind of question a query is, and its rewriting for retrieval."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom import fixed
from corpusloom.functions.text import strip, words

NORMAL, FACT_PATTERN = "NORMAL_LEGAL_QUERY", "FACT_PATTERN_QUERY"


def scenario_score(query: Column) -> Column:
    """Points for narrating a case: 2 each for an actor and a personal phrase, 1 each for a verb, a question and length."""
    text = strip(query)
    has = lambda pattern: text.rlike("(?i)" + pattern).cast("int")
    return 2 * has(fixed.ACTOR_PATTERN) + 2 * has(fixed.PERSONAL_PATTERN) + has(fixed.NARRATIVE_PATTERN) + has(fixed.ADVICE_PATTERN) + (F.size(words(text)) > 15).cast("int")


def classify(query: Column) -> Column:
    return F.when(scenario_score(query) >= 2, FACT_PATTERN).otherwise(NORMAL)


def rewrite(query: Column, query_class: Column) -> Column:
    """A fact pattern as its distinct content words after the concept phrases; other queries as they are."""
    text = F.lower(query)
    for phrase, concept in fixed.CONCEPTS:
        text = F.regexp_replace(text, rf"(?iU)\b{phrase}\b", concept)
    kept = F.filter(F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0)), lambda w: ~w.isin(*fixed.STOP_WORDS))
    return F.when(query_class == NORMAL, query).otherwise(F.array_join(F.array_distinct(kept), " "))


def route(query_class: Column, base: str, fact_pattern: str = "judgments") -> Column:
    """The index that a query goes to."""
    return F.when(query_class == FACT_PATTERN, fact_pattern).otherwise(base)
