"""Column functions on the examples that define them."""

import pytest
from pyspark.sql import functions as F

from corpusloom import fixed
from corpusloom.functions import citations as C
from corpusloom.functions import labels as L
from corpusloom.functions import summary as S
from corpusloom.functions import text as T
from corpusloom.functions import understanding as U


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: T.norm_id(F.lit("Indian Penal/Code\\1860")), "indian_penal_code_1860"),
        (lambda: T.norm_id(F.lit("§§")), "unknown"),
        (lambda: T.chunk_id(F.lit("Acts"), F.lit("IPC 1860"), F.lit(3)), "acts/ipc_1860/3"),
        (lambda: T.norm_category(F.lit("  Case-Law  old ")), "case_law_old"),
        (lambda: T.truncate(F.lit("abcdefgh"), 8), "abcdefgh"),
        (lambda: T.truncate(F.lit("abcd fghi"), 8), "abcd..."),
        (lambda: T.safe_filename(F.lit("doc/123.pdf")), "doc_123_pdf"),
        (lambda: T.safe_filename(F.lit("  test@name!  ")), "test_name_"),
        (lambda: T.case_id(F.lit("https://x.org/doc/111/"), F.lit("t")), "111"),
        (lambda: T.case_id(F.lit(None).cast("string"), F.lit("t")), "e358efa489f58062f10dd7316b65649e"),
        (lambda: T.category_of(F.lit("acts/ipc/1")), "acts"),
        (lambda: T.category_of(F.lit("acts")), None),
        (lambda: T.strip(F.lit("\u00a0 a b \x1c\n")), "a b"),
        (lambda: F.array_join(T.lines(F.lit("a\r\n\n  b \x85c\u2028d e")), "|"), "a|b|c|d e"),
        (lambda: F.array_join(T.tokens(F.lit(" A b\tC d")), "|"), "a|b|c|d"),
        (lambda: T.excerpt(F.lit(""), F.lit(" x "), 5), "x"),
        (lambda: T.excerpt(F.lit("abcdefg"), F.lit("y"), 5), "abcde…"),
        (lambda: T.first_nonempty(F.lit(""), F.lit(None).cast("string"), F.lit("z")), "z"),
    ],
)
def test_text(spark, column, want):
    assert value(spark, column()) == want


def summarize(spark, text, category, size=150):
    return value(spark, S.summarize(F.lit(text), F.lit(category), size))


def test_summaries(spark):
    assert summarize(spark, "THE INDIAN PENAL CODE\nAct No. 45 of 1860\n", "acts") == "THE INDIAN PENAL CODE (1860)"
    assert summarize(spark, "Reported 1973, IN THE SUPREME COURT OF INDIA.\nKeshava vs. State, etc.", "judgments") == "Reported 1973, IN THE SUPREME COURT OF INDIA. — Keshava v. State — (1973)"
    assert summarize(spark, 'NON-DISCLOSURE terms\n"Acme Inc" and "the party" and "Bolt"', "contracts") == "Non Disclosure between Acme Inc and Bolt"
    assert summarize(spark, "First line\nlicensed", "policies") == "Licen"
    assert summarize(spark, "Something", "constitution") == fixed.CONSTITUTION_SUMMARY_TEXT
    assert summarize(spark, " \n ", "acts") == "" and len(summarize(spark, "A" * 200, "other", 50)) == 50


def test_summary_is_prepended_once(spark):
    rows = spark.createDataFrame([("body", False)], "text string, sac_applied boolean")
    once = S.prepend_summary(rows, F.lit("sum"))
    assert once.first()["text"] == "sum" + fixed.SUMMARY_SEPARATOR + "body"
    with pytest.raises(Exception, match="before"):
        S.prepend_summary(once, F.lit("sum")).collect()


def cites(spark, text, category="judgments"):
    return [tuple(c) for c in value(spark, C.citations(F.lit(text), F.lit(category)))]


def test_citations(spark):
    assert cites(spark, "AIR 1973 SC 1461 and AIR 1973 SC 1461") == [("case_law", "AIR 1973 SC 1461", "")]
    assert cites(spark, "(2019) 5 SCC 200; 2020 SCC 15; 1985 SCR 400; 2023 INSC 350") == [("case_law", x, "") for x in ("(2019) 5 SCC 200", "2020 SCC 15", "1985 SCR 400", "2023 INSC 350")]
    assert cites(spark, "Section 300 of the Indian Penal Code, section 302 IPC") == [("statute", "Indian Penal Code", "300"), ("statute", "IPC", "302")]
    assert cites(spark, "Article 21(1) and article 14") == [("constitutional", fixed.CONSTITUTION_DOC, "21(1)"), ("constitutional", fixed.CONSTITUTION_DOC, "14")]
    assert cites(spark, "Schedule VII, Clause 3.1", "") == [("schedule", "", "VII"), ("contract_clause", "", "3.1")]
    assert cites(spark, "Article 21", "acts") == [] and cites(spark, "") == []
    assert value(spark, C.internal_references(F.lit("exhibit a, Schedule 1, EXHIBIT A, Annexure B, Appendix II"))) == ["Exhibit A", "Schedule 1", "Annexure B", "Appendix II"]


def test_explicit_references(spark):
    refs = lambda q: [tuple(r) for r in value(spark, C.explicit_references(F.lit(q)))]
    assert refs("article 21a and Section 302") == [("Article", "21A"), ("Section", "302")]
    assert refs("seventh schedule entry 4, Entry 5") == [("Seventh Schedule Entry", "4"), ("Entry", "5")]
    assert refs("nothing here") == []


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("What is Article 21?", U.NORMAL),
        ("Punishment for theft", U.NORMAL),
        ("A tenant refused to pay rent", U.FACT_PATTERN),
        ("My employer terminated me, can I sue?", U.FACT_PATTERN),
    ],
)
def test_classes(spark, query, want):
    assert value(spark, U.classify(F.lit(query))) == want


def test_rewriting(spark):
    got = value(spark, U.rewrite(F.lit("My company terminated an employee without notice and without notice"), F.lit(U.FACT_PATTERN)))
    assert got == "termination employee lack notice"
    assert value(spark, U.rewrite(F.lit("As It Is"), F.lit(U.NORMAL))) == "As It Is"


def test_labels(spark):
    assert value(spark, L.normalize_labels(F.lit("See (S1) and ( s2 ), section (5) and (SX)."))) == "See [S1] and [S2], section (5) and (SX)."
    check = lambda answer, n: value(spark, L.validate_labels(F.lit(answer).cast("string"), F.lit(n)))
    good = check("[S2] then [S1] [S2]", 2)
    assert good["valid"] and good["used_sources"] == ["S1", "S2"] and good["support_verified"] is False
    bad = check("[S3] and [S10]", 3)
    assert not bad["valid"] and bad["unknown_sources"] == ["S10"] and bad["used_sources"] == ["S3", "S10"]
    empty = check(None, 3)
    assert empty["warnings"] == [fixed.EMPTY_ANSWER_WARNING] and empty["support_verified"] is None
    assert check("none", 0)["warnings"] == [fixed.NO_CITATION_WARNING] and not check("[S1]", 0)["valid"]
    told = value(spark, L.limitations(F.lit(0), F.lit(0), F.array(F.lit("w"), F.lit("w"))))
    assert told == [fixed.NO_EVIDENCE_LIMITATION, "w", fixed.SUPPORT_LIMITATION, fixed.ADVICE_LIMITATION]
