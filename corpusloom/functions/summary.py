"""Deterministic document summaries, and their prepending to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import fixed
from corpusloom.functions.text import blank_to_null, bound, lines, strip, truncate


def _first(array: Column) -> Column:
    return F.coalesce(F.get(array, F.lit(0)), F.lit(""))


def _joined(array: Column, count: int) -> Column:
    return F.array_join(F.slice(array, 1, count), " ")


def _year(text: Column) -> Column:
    return F.regexp_extract(text, fixed.YEAR_PATTERN, 1)


def act_summary(rows: Column, size: int) -> Column:
    titled = F.filter(F.slice(rows, 1, 6), lambda line: line.rlike("(?i)" + fixed.TITLE_PATTERN))
    title = F.coalesce(F.get(titled, F.lit(0)), F.substring(_first(rows), 1, 80))
    year = _year(_joined(rows, 10))
    dated = F.when((year != "") & ~F.contains(title, year), F.concat(F.lit("("), year, F.lit(")")))
    return truncate(F.concat_ws(" ", blank_to_null(title), dated), size)


def judgment_summary(rows: Column, size: int) -> Column:
    head = _joined(rows, 15)
    court = F.substring(F.get(F.filter(F.slice(rows, 1, 10), lambda line: line.rlike("(?i)" + fixed.COURT_PATTERN)), F.lit(0)), 1, 60)
    sides = [strip(F.regexp_extract(head, fixed.VERSUS_PATTERN, i)) for i in (1, 2)]
    parties = F.when(head.rlike(fixed.VERSUS_PATTERN), F.concat(sides[0], F.lit(" v. "), sides[1]))
    year = F.when(_year(head) != "", F.concat(F.lit("("), _year(head), F.lit(")")))
    return truncate(F.coalesce(blank_to_null(F.concat_ws(" — ", court, parties, year)), F.substring(_first(rows), 1, size)), size)


def _type(rows: Column) -> Column:
    """The first type hint, in the order of the list, that the first lines hold; null without one."""
    head = F.lower(_joined(rows, 5))
    found = F.get(F.filter(F.array(*map(F.lit, fixed.TYPE_HINTS)), lambda hint: F.contains(head, hint)), F.lit(0))
    return F.initcap(F.replace(found, F.lit("-"), F.lit(" ")))


def contract_summary(rows: Column, size: int) -> Column:
    names = F.transform(F.regexp_extract_all(_joined(rows, 20), F.lit('"([^"]{2,60})"'), F.lit(1)), strip)
    parties = F.slice(F.filter(names, lambda n: (n != "") & ~F.lower(n).isin(*fixed.GENERIC_QUOTED)), 1, 2)
    between = F.when(F.size(parties) > 0, F.concat(F.lit("between "), F.array_join(parties, " and ")))
    return truncate(F.coalesce(blank_to_null(F.concat_ws(" ", _type(rows), between)), _first(rows)), size)


def generic_summary(rows: Column, size: int) -> Column:
    return truncate(F.coalesce(_type(rows), _first(rows)), size)


def summarize(text: Column, category: Column, size: int = fixed.SUMMARY_MAX_CHARS) -> Column:
    """The heuristic summary of a text for its category; '' for a blank text."""

    def of(rows: Column) -> Column:
        return (
            F.when(F.size(rows) == 0, "")
            .when(category == "acts", act_summary(rows, size))
            .when(category == "constitution", truncate(F.lit(fixed.CONSTITUTION_SUMMARY_TEXT), size))
            .when(category == "judgments", judgment_summary(rows, size))
            .when(category == "contracts", contract_summary(rows, size))
            .otherwise(generic_summary(rows, size))
        )

    return bound(lines(F.coalesce(text, F.lit(""))), of)


def prepend_summary(chunks: DataFrame, summary: Column) -> DataFrame:
    """Chunks whose text begins with the summary; a chunk that has one already is an error."""
    done = F.coalesce(F.col("sac_applied"), F.lit(False))
    text = F.when(done, F.raise_error(F.lit("the summary was prepended before")).cast("string")).otherwise(F.concat(summary, F.lit(fixed.SUMMARY_SEPARATOR), F.col("text")))
    return chunks.withColumns({"doc_summary": summary, "text": text, "sac_applied": F.lit(True)})
