"""Writers: chunks, case files, reports, and a paged PDF rendering of a response."""

from __future__ import annotations

import json
import textwrap
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom import fixed
from corpusloom.runtime import discard, path_exists, stash

PAGE_WIDTH, PAGE_HEIGHT, MARGIN, LEADING, FONT = 595, 842, 50, 14, 10


def write_chunks(chunks: DataFrame, path: str, native: bool = False) -> None:
    """Chunks as JSON lines, or as Parquet by category."""
    if native:
        chunks.write.mode("overwrite").partitionBy("category").parquet(path)
    else:
        chunks.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def new_rows(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't there yet."""
    return rows.join(existing.select(key).distinct(), key, "left_anti")


def write_case_files(cases: DataFrame, folder: str, overwrite: bool = False, limit: int | None = None) -> DataFrame:
    """A text file and a ``.meta.yaml`` beside it for each case (case_id, text, title, court, date); the ids written, as a table.

    Of rows with one case id the first stands, in the order of the input. Files that are there stay unless ``overwrite``. ``limit`` counts the first
    cases looked at, not those written. A file is written under the name of its attempt and then renamed, the text last: a file is there
    whole or not at all, a repeated task writes the same again, and a case whose task failed counts as not written. The executors write
    through Arrow's file systems, so ``folder`` is a URI that they all reach.
    """
    spark = cases.sparkSession
    fields = ("text", "title", "court", "date")
    rows = cases.select("case_id", *fields, F.monotonically_increasing_id().alias("n"))
    if limit is not None:
        rows = rows.orderBy("n").limit(limit)
    rows = rows.groupBy("case_id").agg(F.min_by(F.struct(*fields), "n").alias("first")).select("case_id", "first.*")
    if not overwrite and path_exists(spark, folder):
        names = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.txt$", "").alias("case_id"))
        rows = new_rows(rows, names, "case_id")

    def run(batches):
        from pyarrow.fs import FileSystem

        files, base = FileSystem.from_uri(folder)
        # Readers pass over what begins with an underscore.
        drafts = f"{base}/_attempts/{uuid.uuid4().hex}"
        files.create_dir(drafts, recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                meta = {"category": "judgments", "jurisdiction": "India", "short_title": row["title"], "court": row["court"], "date": row["date"]}
                for ending, text in (("meta.yaml", "".join(f"{k}: {json.dumps(v, ensure_ascii=False)}\n" for k, v in meta.items() if v)), ("txt", row["text"])):
                    with files.open_output_stream(f"{drafts}/draft") as out:
                        out.write(text.encode("utf-8", "surrogatepass"))
                    files.move(f"{drafts}/draft", f"{base}/{row['case_id']}.{ending}")
            yield pa.RecordBatch.from_arrays([batch.column("case_id")], ["case_id"])
        files.delete_dir(drafts)

    try:
        return stash(rows.mapInArrow(run, "case_id string"), "written")
    finally:
        if path_exists(spark, f"{folder}/_attempts"):
            discard(spark, f"{folder}/_attempts")


def write_report(metrics: DataFrame, path: str) -> None:
    metrics.withColumn("generated_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").json(path)


def plain(text: str) -> str:
    """Printable ASCII, other characters as question marks."""
    return "".join(c if " " <= c <= "~" else "?" for c in text)


def report_lines(response: dict) -> list[str]:
    """A response as lines of at most the page's width."""
    out: list[str] = []

    def paragraph(text: str, indent: str = "") -> None:
        for line in str(text).splitlines() or [""]:
            out.extend(textwrap.wrap(plain(line), fixed.PDF_WIDTH, initial_indent=indent, subsequent_indent=indent) or [""])

    def section(title: str) -> None:
        out.extend(["", title, "-" * len(title)])

    def passages(title: str, items: list[dict] | None, fields: tuple[str, ...], mark: str, none: str) -> None:
        section(title)
        for i, entry in enumerate(items or [], 1):
            values = [f"section {entry[k]}" if k == "section" else entry[k] for k in fields if entry.get(k)]
            paragraph(" | ".join(map(str, [*([f"[{mark}{i}]"] if mark else []), *values])))
            paragraph(entry.get("text", ""), "  ")
        if not items:
            out.append(none)

    paragraph("Question: " + response.get("question", ""))
    section("Answer")
    paragraph(response.get("answer", ""))
    passages("Evidence", response.get("evidence"), ("category", "source_doc", "section", "heading", "court", "date"), "S", "No passages were cited.")
    passages("Related cases", response.get("related_cases"), ("source_doc", "section", "court", "date"), "", "No related cases were found.")
    section("Limitations")
    for entry in response.get("limitations") or ["none"]:
        paragraph("- " + entry)
    out.append("")
    paragraph(fixed.REPORT_FOOTER)
    return out


def render_pdf(lines: list[str]) -> bytes:
    """A PDF of fixed-size pages with the lines as text."""
    pages = [lines[i : i + fixed.PDF_LINES] for i in range(0, len(lines), fixed.PDF_LINES)] or [[]]
    bodies = ["<< /Type /Catalog /Pages 2 0 R >>", "", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    kids = []
    for page in pages:
        shown = "".join(f"({plain(line).replace(chr(92), chr(92) * 2).replace('(', chr(92) + '(').replace(')', chr(92) + ')')}) Tj T*\n" for line in page)
        stream = f"BT /F1 {FONT} Tf {LEADING} TL {MARGIN} {PAGE_HEIGHT - MARGIN} Td\n{shown}ET"
        bodies.append(f"<< /Length {len(stream)} >>\nstream\n{stream}\nendstream")
        bodies.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {PAGE_WIDTH} {PAGE_HEIGHT}] /Resources << /Font << /F1 3 0 R >> >> /Contents {len(bodies)} 0 R >>")
        kids.append(f"{len(bodies)} 0 R")
    bodies[1] = f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} >>"
    out, places = b"%PDF-1.4\n", []
    for number, body in enumerate(bodies, 1):
        places.append(len(out))
        out += f"{number} 0 obj\n{body}\nendobj\n".encode("ascii")
    table = "".join(f"{at:010d} 00000 n \n" for at in places)
    return out + f"xref\n0 {len(bodies) + 1}\n0000000000 65535 f \n{table}trailer\n<< /Size {len(bodies) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF".encode("ascii")
