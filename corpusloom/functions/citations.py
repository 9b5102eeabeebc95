"""Citations in texts and references in queries, as arrays of structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom import fixed
from corpusloom.functions.text import bound, strip


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _found(text: Column, pattern: str, word: str) -> Column:
    """All matches of a pattern; texts without a ``word`` that each of its matches holds aren't searched."""
    return F.when(F.contains(text, F.lit(word)), _all(text, pattern, 0)).otherwise(F.array().cast("array<string>"))


def _citation(category: str, doc: Column, section: Column) -> Column:
    return F.struct(F.lit(category).alias("category"), doc.alias("doc"), section.alias("section"))


def case_law(text: Column) -> Column:
    patterns = ((fixed.AIR_PATTERN, "AIR"), (fixed.SCC_BRACKET_PATTERN, "SCC"), (fixed.SCC_PATTERN, "SCC"), (fixed.SCR_PATTERN, "SCR"), (fixed.INSC_PATTERN, "INSC"))
    return F.concat(*(F.transform(_found(text, p, word), lambda m: _citation("case_law", strip(m), F.lit(""))) for p, word in patterns))


def statutes(text: Column) -> Column:
    # A match's parts are taken from the match, so that the text is searched once.
    def parts(pattern: str) -> Column:
        return F.transform(_found(text, pattern, "ection"), lambda m: _citation("statute", strip(F.regexp_extract(m, pattern, 2)), F.regexp_extract(m, pattern, 1)))

    return F.concat(parts(fixed.SECTION_OF_ACT_PATTERN), parts(fixed.SECTION_SHORT_PATTERN))


def articles(text: Column) -> Column:
    def cited(match: Column) -> Column:
        article, part = (F.regexp_extract(match, fixed.ARTICLE_PATTERN, i) for i in (1, 2))
        return _citation("constitutional", F.lit(fixed.CONSTITUTION_DOC), F.when(part == "", article).otherwise(F.concat(article, F.lit("("), part, F.lit(")"))))

    return F.transform(_found(text, fixed.ARTICLE_PATTERN, "rticle"), cited)


def schedules(text: Column) -> Column:
    return F.transform(_found(text, fixed.SCHEDULE_PATTERN, "chedule"), lambda m: _citation("schedule", F.lit(""), F.regexp_extract(m, fixed.SCHEDULE_PATTERN, 1)))


def clauses(text: Column) -> Column:
    return F.transform(_found(text, fixed.CLAUSE_PATTERN, "lause"), lambda m: _citation("contract_clause", F.lit(""), F.regexp_extract(m, fixed.CLAUSE_PATTERN, 1)))


def deduplicated(found: Column) -> Column:
    """The first of citations that are equal but for case, in order."""
    keys = lambda all_: F.transform(all_, lambda c: F.struct(c["category"], F.lower(c["doc"]), F.lower(c["section"])))
    return bound(found, lambda all_: bound(keys(all_), lambda k: F.filter(all_, lambda c, i: F.array_position(k, F.get(k, i)) == i + 1)))


def citations(text: Column, category: Column, enabled: tuple[str, ...] = fixed.CITATION_CATEGORIES) -> Column:
    """All citations in the order of kinds; none for a named category that isn't enabled."""
    text = F.coalesce(text, F.lit(""))
    found = deduplicated(F.concat(case_law(text), statutes(text), articles(text), schedules(text), clauses(text)))
    return F.when((F.coalesce(category, F.lit("")) == "") | category.isin(*enabled), found).otherwise(F.slice(found, 1, 0))


def internal_references(text: Column) -> Column:
    """``Exhibit A`` and the like, each once."""
    pattern = "(?i)" + fixed.INTERNAL_REF_PATTERN
    return F.array_distinct(F.zip_with(_all(text, pattern, 1), _all(text, pattern, 2), lambda kind, name: F.concat(F.initcap(kind), F.lit(" "), F.upper(name))))


def explicit_references(query: Column) -> Column:
    """(ref_type, ref_val) of the legal units that a query names, in order, repeats included."""
    ordinal = rf"(?:(?:{'|'.join(fixed.ORDINALS)})\s+Schedule\s+)?"
    pattern = rf"(?i)\b({ordinal}{fixed.REFERENCE_TYPES[0]}|{'|'.join(fixed.REFERENCE_TYPES[1:])})\s+({fixed.REFERENCE_VALUE})\b"
    tidy = lambda kind: F.initcap(F.regexp_replace(kind, r"\s+", " "))
    return F.zip_with(_all(query, pattern, 1), _all(query, pattern, 2), lambda kind, value: F.struct(tidy(kind).alias("ref_type"), F.upper(value).alias("ref_val")))
