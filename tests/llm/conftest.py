import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Make a documents table from (doc_id, text[, lang[, source]]) rows, with extra columns whose names clash with the operators' own."""

    def make(rows):
        full = [(*r, *(None,) * (4 - len(r)), None if r[1] is None else len(r[1])) for r in rows]
        frame = spark.createDataFrame(full, DOCUMENTS)
        return frame.selectExpr("*", "'x' AS row", "1 AS length", "2 AS size", "'y' AS fp", "3 AS start", "4 AS held_out", "5 AS score", "6 AS key", "7 AS rank", "8 AS text_hash")

    return make


def rows_of(frame, *columns):
    return sorted((tuple(r) for r in (frame.select(*columns) if columns else frame).collect()), key=repr)
