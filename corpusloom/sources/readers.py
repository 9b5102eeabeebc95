"""Readers: raw files with sidecars, Parquet rows, chunk lines, evaluation cases, configuration."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.runtime import path_exists, stash

TEXT_FORMATS = ("txt", "md")
CHUNK_SCHEMA = (
    "chunk_id string, source_doc string, source_path string, category string, jurisdiction string, text string, original_text string, doc_summary string, "
    "section string, parent string, heading string, hierarchy_path array<string>, cites array<struct<category:string,doc:string,section:string>>, start_offset int, end_offset int, "
    "sac_applied boolean, contract_meta struct<parties:array<string>,effective_date:string,governing_law:string,internal_refs:array<string>>"
)
#: Where a line is kept that can't be read.
CORRUPT = "_corrupt_record"
DOCUMENT_SCHEMA = "source_path string, source_doc string, text string, format string, category string, jurisdiction string"
CASE_SCHEMA = "query string, relevant_ids array<string>, category string, expected_evidence string, source_doc string"
JUDGMENT_FIELDS = ("Text", "Doc_url", "Titles", "Court_Name_Normalized", "Court_Name", "Date", "date")
SIDECAR_SCHEMA = "category string, jurisdiction string, year int, short_title string, parties array<string>, effective_date string, governing_law string"


class UnsupportedFormatError(ValueError):
    """A file's ending isn't one that can be read."""


@dataclass(frozen=True)
class Config:
    """Validated settings of an ingest run."""

    raw_dir: str
    processed_dir: str
    chunks_file: str
    categories: tuple[dict, ...] = ()
    strategy: str = "pattern"
    max_chars: int = 1000
    use_summary: bool = True
    summary_chars: int = 150
    extra: dict = field(default_factory=dict)


def load_config(settings: dict) -> Config:
    """Settings with the sections ``ingest`` and ``chunking``; a missing one is an error."""
    for section, keys in (("ingest", ("raw_dir", "processed_dir", "chunks_file")), ("chunking", ())):
        if not isinstance(settings.get(section), dict):
            raise ValueError(f"section {section} is missing")
        if absent := [k for k in keys if not settings[section].get(k)]:
            raise ValueError(f"{section} lacks {', '.join(absent)}")
    ingest, chunking = settings["ingest"], settings["chunking"]
    return Config(
        ingest["raw_dir"], ingest["processed_dir"], ingest["chunks_file"], tuple(ingest.get("categories") or ()), chunking.get("strategy", "pattern"),
        (chunking.get("sentence") or {}).get("max_chars", 1000), chunking.get("use_sac", True), chunking.get("sac_summary_max_chars", 150), settings,
    )


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 where they are valid, else as Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def read_documents(spark: SparkSession, raw_dir: str, category: str = "", jurisdiction: str = "", formats: tuple[str, ...] = TEXT_FORMATS, extractors: dict[str, Callable[[bytes], str]] | None = None, ordered: bool = False) -> DataFrame:
    """(source_path, source_doc, text, format, category, jurisdiction) of the files directly in a folder; none where there is no folder.

    ``extractors`` reads other formats than text: file ending -> bytes -> text, on the executors, such as
    ``{"pdf": pdf.extract_pdf}``. ``ordered`` sorts rows by name, which otherwise have no order.
    """
    wanted = [f.lower().lstrip(".") for f in (*formats, *(extractors or {}))]
    if bad := [f for f in wanted if f not in TEXT_FORMATS and f not in (extractors or {})]:
        raise UnsupportedFormatError(", ".join(bad))
    if not path_exists(spark, raw_dir):
        return spark.createDataFrame([], DOCUMENT_SCHEMA)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").option("pathGlobFilter", "*.*").load(raw_dir)
    name = F.element_at(F.split("path", "/"), -1)
    ending = F.lower(F.element_at(F.split(name, r"\."), -1))
    rows = files.select(F.col("path").alias("source_path"), F.regexp_replace(name, r"\.[^.]*$", "").alias("source_doc"), ending.alias("format"), "content").where(F.col("format").isin(*wanted))
    if extractors:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds, contents = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                texts = [extractors[k](c) if k in extractors else None for k, c in zip(kinds, contents)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "extracted"])

        rows = rows.mapInArrow(run, "source_path string, source_doc string, format string, content binary, extracted string")
    else:
        rows = rows.withColumn("extracted", F.lit(None).cast("string"))
    plain = F.when(F.col("format").isin(*TEXT_FORMATS), decoded(F.col("content")))
    found = rows.select("source_path", "source_doc", F.coalesce("extracted", plain).alias("text"), "format", F.lit(category).alias("category"), F.lit(jurisdiction).alias("jurisdiction"))
    return found.orderBy("source_path") if ordered else found


def read_document(spark: SparkSession, path: str, category: str = "", jurisdiction: str = "", extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """One file as :func:`read_documents` gives it; an ending that can't be read is an error."""
    ending = path.rsplit("/", 1)[-1].rpartition(".")[2].lower()
    if ending not in TEXT_FORMATS and ending not in (extractors or {}):
        raise UnsupportedFormatError(ending)
    return read_documents(spark, path, category, jurisdiction, extractors=extractors)


def read_sidecars(spark: SparkSession, raw_dir: str, parse: Callable[[str], object] | None = None) -> DataFrame:
    """(source_doc, sidecar_path and the fields of SIDECAR_SCHEMA) of ``<stem>.meta.yaml`` files; a malformed one has no fields."""
    parse = parse or parse_sidecar
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.meta.yaml").load(raw_dir)
    names = [part.split()[0] for part in SIDECAR_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for content in batch.column(1).to_pylist():
                try:
                    got = parse(content.decode("utf-8"))
                except Exception:
                    got = {}
                rows.append(tidy_sidecar(got if isinstance(got, dict) else {}))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[n] for r in rows], t) for n, t in zip(names, types))], names=["sidecar_path", *names])

    rows = files.select("path", "content").mapInArrow(run, "sidecar_path string, " + SIDECAR_SCHEMA)
    return rows.withColumn("source_doc", F.regexp_replace(F.element_at(F.split("sidecar_path", "/"), -1), r"\.meta\.yaml$", ""))


def no_sidecars(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], f"sidecar_path string, {SIDECAR_SCHEMA}, source_doc string")


def parse_sidecar(text: str) -> dict:
    """The fields of a sidecar: by the YAML package where there is one, else of a flat file of names with words, numbers or lists."""
    try:
        import yaml
    except ImportError:
        return flat_fields(text)
    return yaml.safe_load(text)


def flat_fields(text: str) -> dict:
    """``name: value`` lines; a value may be quoted, a number, ``[a, b]``, or ``- item`` lines below. Anything else is malformed."""

    def value(word: str):
        word = word.strip()
        if len(word) > 1 and word[0] == word[-1] and word[0] in "\"'":
            return word[1:-1]
        return int(word) if re.fullmatch(r"-?\d+", word) else None if word in ("", "~", "null") else word

    out: dict = {}
    name = None
    for line in text.splitlines():
        bare = re.sub(r"(^|\s)#.*", "", line).rstrip()
        if not bare or bare == "---":
            continue
        if item := re.fullmatch(r"\s*-\s+(.*)", bare):
            if name is None:
                raise ValueError("an item without a name")
            out[name] = [*(out[name] or []), value(item[1])]
        elif field := re.fullmatch(r"(\w+):(?:\s+(.*))?", bare):
            name, words = field[1], (field[2] or "").strip()
            if words.startswith("["):
                if not words.endswith("]"):
                    raise ValueError("a list without its end")
                out[name] = [value(w) for w in words[1:-1].split(",") if w.strip()]
            else:
                out[name] = value(words)
        else:
            raise ValueError("no name and value: " + bare)
    return out


def tidy_sidecar(got: dict) -> dict:
    """The known fields: parties only as a list, the year only as a number, the rest as text."""
    out = {}
    for part in SIDECAR_SCHEMA.split(", "):
        name, kind = part.split()
        value = got.get(name)
        if kind == "int":
            out[name] = value if isinstance(value, int) and not isinstance(value, bool) else None
        elif kind.startswith("array"):
            out[name] = [str(v) for v in value] if isinstance(value, list) else None
        else:
            out[name] = None if value is None else str(value)
    return out


def with_metadata(documents: DataFrame, sidecars: DataFrame, categories: DataFrame) -> DataFrame:
    """Documents with category, jurisdiction and sidecar fields.

    Category: sidecar, else the folder where it is a known name, else the hint. Jurisdiction: sidecar, else the
    category's default. ``categories`` (name, jurisdiction) is configuration, a few rows.
    """
    side = sidecars.select("source_doc", "sidecar_path", *(F.col(p.split()[0]).alias("side_" + p.split()[0]) for p in SIDECAR_SCHEMA.split(", ")))
    rows = documents.join(side, "source_doc", "left")
    names = F.broadcast(categories.select(F.col("name").alias("known"), F.col("jurisdiction").alias("default_jurisdiction")))
    folder = F.element_at(F.split("source_path", "/"), -2)
    rows = rows.withColumn("folder", T.norm_category(folder)).join(names.select(F.col("known").alias("known_folder")), F.col("folder") == T.norm_category(F.col("known_folder")), "left")
    category = F.coalesce(T.blank_to_null(T.norm_category(F.col("side_category"))), F.col("known_folder"), F.col("category"))
    rows = rows.withColumn("category", category).join(names, F.col("category") == F.col("known"), "left")
    jurisdiction = F.coalesce(T.blank_to_null(F.col("side_jurisdiction")), T.blank_to_null(F.col("default_jurisdiction")), F.lit(""))
    keep = [c for c in documents.columns if c not in ("category", "jurisdiction")]
    return rows.select(
        *keep, "category", jurisdiction.alias("jurisdiction"), F.col("side_year").alias("year"), F.col("side_short_title").alias("short_title"), "sidecar_path", F.col("side_parties").alias("parties"),
        F.col("side_effective_date").alias("effective_date"), F.col("side_governing_law").alias("governing_law"),
    )


def judgment_rows(rows: DataFrame, named: dict[str, str] | None = None) -> DataFrame:
    """(case_id, text, title, court, date) of raw judgment rows; those without text drop out.

    ``named`` gives the columns that hold the fields where they go by other names (``Date`` and ``date`` can't both be
    columns where names don't depend on case). A row's text is trimmed.
    """
    names = {c: (named or {}).get(c, c) for c in JUDGMENT_FIELDS}
    col = lambda name: T.blank_to_null(T.strip(F.col(names[name]).cast("string"))) if names[name] in rows.columns else F.lit(None).cast("string")
    text = F.coalesce(col("Text"), F.lit(""))
    out = rows.select(T.case_id(col("Doc_url"), text).alias("case_id"), text.alias("text"), col("Titles").alias("title"), F.coalesce(col("Court_Name_Normalized"), col("Court_Name")).alias("court"), F.coalesce(col("Date"), col("date")).alias("date"))
    return out.where(F.col("text") != "")


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """:func:`judgment_rows` of all Parquet files in a folder, also where columns differ in case alone.

    Such files are read in a session of their own, where names depend on case, and written once under names that don't.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.caseSensitive", "true")
    rows = own.read.parquet(path)
    if len({c.lower() for c in rows.columns}) == len(rows.columns):
        return judgment_rows(spark.read.parquet(path))
    named = {c: f"{c}_{i}" for i, c in enumerate(JUDGMENT_FIELDS) if c in rows.columns}
    copied = stash(rows.select(*(F.col(c).alias(other) for c, other in named.items())), "judgments")
    return judgment_rows(spark.read.schema(copied.schema).parquet(copied._corpusloom_path), named)


def read_shards(spark: SparkSession, open_shard: Callable[[int], Iterator[dict]], shards: int, schema: str, limit: int | None = None) -> DataFrame:
    """Rows of a remote dataset: ``open_shard(i)`` gives the dicts of a shard, on the executors, streamed in batches.

    With ``limit`` shards are read one after the other on one task, and no further than needed.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = (i for batch in batches for i in batch.column(0).to_pylist())
        rows = itertools.islice((row for i in numbers for row in open_shard(i)), limit)
        while held := list(itertools.islice(rows, 256)):
            yield pa.RecordBatch.from_pylist([{f.name: row.get(f.name) for f in arrow} for row in held], schema=arrow)

    return spark.range(0, shards, 1, 1 if limit is not None else shards).mapInArrow(run, schema)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON lines, blank lines passed over.

    A line that isn't a JSON object, or has no chunk_id, stops the job that reads it with an error that has its file and its beginning.
    Ids given twice are found by :func:`require_unique`, which needs a pass over all ids.
    """
    rows = spark.read.schema(f"{CHUNK_SCHEMA}, {CORRUPT} string").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    told = F.concat(F.lit("not a chunk, in "), F.col("_metadata.file_path"), F.lit(": "), F.coalesce(F.substring(CORRUPT, 1, 200), F.lit("no chunk_id")))
    wrong = F.col(CORRUPT).isNotNull() | F.col("chunk_id").isNull() | (F.col("chunk_id") == "")
    blank = F.coalesce(T.strip(F.col(CORRUPT)) == "", F.lit(False))
    # A filter of the rows, so that no plan leaves the check out.
    return rows.where(F.when(blank & F.col("chunk_id").isNull(), False).when(wrong, F.raise_error(told).cast("boolean")).otherwise(True)).drop(CORRUPT)


def require_unique(chunks: DataFrame) -> DataFrame:
    """``chunks`` themselves, after a pass over their ids; one given twice is an error."""
    twice = chunks.groupBy("chunk_id").count().where("count > 1").select("chunk_id").limit(3).collect()
    if twice:
        raise ValueError("chunk ids given twice: " + ", ".join(str(r["chunk_id"]) for r in twice))
    return chunks


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines that aren't blank."""
    return spark.read.text(path).where(T.strip(F.col("value")) != "").count()


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CASE_SCHEMA).json(path)
