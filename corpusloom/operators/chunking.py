"""Chunking: sentence packing and the structure presets as Catalyst expressions, delimiters of the caller's as an Arrow map.

All work within a document and shuffle nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import fixed
from corpusloom.functions import text as T

SENTENCE_BREAK = rf"(?U)(?<=[.!?])(?={T.SPACE})"


def sentence_bounds(text: Column, max_chars: int) -> Column:
    """Where chunks begin, ending with the text's length: pieces are packed as long as they fit ``max_chars``."""
    lengths = F.transform(F.filter(F.split(text, SENTENCE_BREAK), lambda p: p != ""), F.length)
    state = F.struct(F.array().cast("array<int>").alias("cuts"), F.lit(0).alias("start"), F.lit(0).alias("end"))

    def pack(acc: Column, size: Column) -> Column:
        full = (acc["end"] > acc["start"]) & (acc["end"] - acc["start"] + size > max_chars)
        return F.struct(
            F.when(full, F.concat(acc["cuts"], F.array(acc["end"]))).otherwise(acc["cuts"]).alias("cuts"),
            F.when(full, acc["end"]).otherwise(acc["start"]).alias("start"),
            (acc["end"] + size).alias("end"),
        )

    return F.aggregate(lengths, state, pack, lambda acc: F.concat(F.array(F.lit(0)), acc["cuts"], F.array(acc["end"])))


def chunk_sentences(documents: DataFrame, max_chars: int = 1000, min_chars: int = 50) -> DataFrame:
    """``documents`` with a row for each chunk: chunk_index, start_offset, end_offset and its text.

    Chunks joined again are the text; an empty or null text has none. A longer piece stands alone.
    ``min_chars`` is checked and otherwise without effect.
    """
    if max_chars < 1 or min_chars < 0:
        raise ValueError("max_chars must be at least 1 and min_chars at least 0")
    bounds = sentence_bounds(F.col("text"), max_chars)
    rows = documents.where(F.length("text") > 0).withColumn("_bounds", bounds)
    rows = rows.select("*", F.posexplode(F.slice("_bounds", F.lit(1), F.size("_bounds") - 1)).alias("chunk_index", "start_offset"))
    end = F.get("_bounds", F.col("chunk_index") + 1)
    return rows.withColumn("end_offset", end).withColumn("text", F.substring("text", F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset"))).drop("_bounds")


def unit_label(matched: str) -> str:
    """What a matched delimiter is called: ``(a)`` is ``a``, ``3.`` is ``3``, others as they are, trimmed."""
    label = matched.strip()
    if m := re.fullmatch(r"\(([A-Za-z0-9]+)\)", label):
        return m[1]
    if m := re.fullmatch(r"(\d+(?:\.\d+)*[A-Za-z]?)\.?", label):
        return m[1]
    return label


_NAMED = re.compile(rf"(?:{'|'.join(fixed.NAMED_HEADINGS)})\s", re.I)


def structural_chunks(text: str, delimiters: list[tuple[re.Pattern, int]]) -> Iterator[tuple]:
    """(section, parent, heading, path, start, end, body) of a text cut at its delimiters.

    Of delimiters at one place the deepest level counts, then the earlier pattern. Units without a
    body stay in the paths of what is below them.
    """
    if not text.strip():
        return
    best: dict[int, tuple[int, int, int]] = {}
    for order, (pattern, level) in enumerate(delimiters):
        for m in pattern.finditer(text):
            rank = (-level, order, m.end())
            if m.start() not in best or rank[:2] < best[m.start()][:2]:
                best[m.start()] = rank
    places = sorted(best)
    if not places:
        yield None, None, None, [], 0, len(text), text.strip()
        return
    if before := text[: places[0]].strip():
        yield None, None, None, [], 0, places[0], before
    open_units: list[tuple[int, str]] = []
    for i, at in enumerate(places):
        level, match_end = -best[at][0], best[at][2]
        matched = text[at:match_end]
        label = unit_label(matched)
        while open_units and open_units[-1][0] >= level:
            open_units.pop()
        parent = open_units[-1][1] if open_units else None
        path = [name for _, name in open_units] + [label]
        open_units.append((level, label))
        body_end = places[i + 1] if i + 1 < len(places) else len(text)
        if _NAMED.match(matched.strip() + " "):
            line_end = text.find("\n", at)
            line_end = len(text) if line_end < 0 else line_end
            heading, body_start = text[at:line_end].strip(), min(line_end + 1, body_end)
        else:
            heading, body_start = label, match_end
        if body := text[body_start:body_end].strip():
            yield label, parent, heading, path, body_start, body_end, body


def resolve_delimiters(strategy: str = "pattern", preset: str | None = None, delimiters: Iterable[tuple[str, int]] | None = None) -> list[tuple[str, int]]:
    """The delimiters of a pattern strategy: a named preset, else given ones, else the generic preset."""
    if strategy.strip().lower() != "pattern":
        raise ValueError(f"unknown strategy: {strategy}")
    return list(fixed.PRESETS[preset] if preset else delimiters or fixed.GENERIC_PRESET)


def chunk_by_delimiters(documents: DataFrame, chosen: list[tuple[str, int]]) -> DataFrame:
    """The rows of :func:`chunk_structure` for any Python expressions, in Arrow batches."""
    columns = [c for c in documents.columns if c != "text"]
    schema = ", ".join(
        [f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in columns]
        + ["chunk_index int, section string, parent string, heading string, hierarchy_path array<string>, start_offset int, end_offset int, text string"]
    )
    types = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(re.compile(p, re.M), level) for p, level in chosen]
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                owners, out = [], []
                for row, text in enumerate(part.column(len(columns)).to_pylist()):
                    for k, (section, parent, heading, path, a, b, body) in enumerate(structural_chunks(text or "", compiled)):
                        owners.append(row)
                        out.append((k, section, parent, heading, path, a, b, body))
                kept = [part.column(i).take(pa.array(owners, pa.int64())) for i in range(len(columns))]
                made = [pa.array([o[i] for o in out], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=[*columns, "chunk_index", "section", "parent", "heading", "hierarchy_path", "start_offset", "end_offset", "text"])

    return documents.select(*columns, "text").mapInArrow(run, schema)


#: Elements that :func:`running` goes through before it begins another array.
RUN_BLOCK = 256


def running(items: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """All elements combined up to each one, itself included; ``combine`` must be associative.

    Arrays grow by copying, so runs of a block are made first and then carried on from block to block.
    """

    def run(block: Column) -> Column:
        return F.aggregate(F.slice(block, F.lit(2), F.size(block)), F.slice(block, 1, 1), lambda acc, x: F.concat(acc, F.array(combine(F.get(acc, F.size(acc) - 1), x))))

    def carried(blocks: Column) -> Column:
        ends = run(F.transform(blocks, lambda block: F.get(block, F.size(block) - 1)))
        return T.bound(ends, lambda end: F.flatten(F.transform(blocks, lambda block, j: F.when(j == 0, block).otherwise(F.transform(block, lambda x: combine(F.get(end, j - 1), x))))))

    def begun(whole: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(whole) - 1, F.lit(0)), F.lit(RUN_BLOCK))
        return T.bound(F.transform(starts, lambda at: run(F.slice(whole, at + 1, F.lit(RUN_BLOCK)))), carried)

    return T.bound(items, begun)


def java_pattern(pattern: str) -> str:
    """A preset's expression for Java: only a newline ends lines, classes are Unicode's, white space is Python's."""
    return "(?mdU)" + pattern.replace(r"\s", T.SPACE)


MARKS = "array<struct<at: int, rank: int, pattern: int, byte: int, matched: string>>"


def delimiter_marks(text: Column, delimiters: list[tuple[str, int]]) -> Column:
    """Where units begin, in order: (at, rank, pattern, byte, matched), and a last mark at the text's end.

    What an expression matches and what lies between gives the places of its matches. ``rank`` is the level below zero: of
    delimiters at one place the deepest counts, then the earlier one.
    """
    size = lambda s: F.struct(F.length(s).alias("at"), F.octet_length(s).alias("byte"))
    add = lambda a, b: F.struct((a["at"] + b["at"]).alias("at"), (a["byte"] + b["byte"]).alias("byte"))

    def mark(at: Column, rank: Column, order: Column, byte: Column, matched: Column) -> Column:
        return F.struct(at.alias("at"), rank.alias("rank"), order.alias("pattern"), byte.alias("byte"), matched.alias("matched"))

    def found(d: Column) -> Column:
        def placed(hits: Column) -> Column:
            between = F.slice(F.split(text, d["pattern"], -1), F.lit(1), F.size(hits))
            ends = running(F.zip_with(between, hits, lambda p, m: add(size(p), size(m))), add)
            return F.zip_with(ends, hits, lambda e, m: mark(e["at"] - F.length(m), d["rank"], d["order"], e["byte"] - F.octet_length(m), m))

        return T.bound(F.regexp_extract_all(text, d["pattern"], F.lit(0)), lambda hits: F.when(F.size(hits) > 0, placed(hits)).otherwise(F.array().cast(MARKS)))

    table = F.array(*(F.struct(F.lit(java_pattern(pattern)).alias("pattern"), F.lit(-level).alias("rank"), F.lit(order).alias("order")) for order, (pattern, level) in enumerate(delimiters)))
    every = F.sort_array(F.flatten(F.transform(table, found)))
    first = T.bound(every, lambda marks: F.filter(marks, lambda m, i: (i == 0) | (m["at"] != F.get(marks, i - 1)["at"])))
    return F.concat(first, F.array(mark(F.length(text), F.lit(0), F.lit(0), F.octet_length(text), F.lit(""))))


def label_of(matched: Column) -> Column:
    """:func:`unit_label` as an expression."""
    inner = F.regexp_replace(T.strip(matched), r"\A\(([A-Za-z0-9]+)\)\z", "$1")
    return F.regexp_replace(inner, r"(?U)\A(\d+(?:\.\d+)*[A-Za-z]?)\.?\z", "$1")


def open_paths(marks: Column, levels: list[int]) -> Column:
    """The labels of the units open at each mark, outermost first, its own last: at each level the last one since a unit further out."""

    def opened(m: Column) -> Column:
        labels = T.bound(label_of(m["matched"]), lambda label: F.array(*(F.when(-m["rank"] == level, label) for level in levels)))
        return F.struct((-m["rank"]).alias("level"), labels.alias("labels"))

    def later(a: Column, b: Column) -> Column:
        kept = (F.when(F.lit(level) < b["level"], F.get(a["labels"], F.lit(i))).otherwise(F.get(b["labels"], F.lit(i))) for i, level in enumerate(levels))
        return F.struct(F.least(a["level"], b["level"]).alias("level"), F.array(*kept).alias("labels"))

    return F.transform(running(F.transform(marks, opened), later), lambda state: F.filter(state["labels"], lambda label: label.isNotNull()))


def structural_units(text: Column, delimiters: list[tuple[str, int]]) -> Column:
    """:func:`structural_chunks` as an expression, for delimiters that begin at a line's start.

    Bodies are cut from the bytes: a place in characters would be counted from the text's start for each unit.
    """
    none, named = F.lit(None).cast("string"), rf"(?iU)\A(?:{'|'.join(fixed.NAMED_HEADINGS)}){T.SPACE}"

    def chunk(section: Column, parent: Column, heading: Column, path: Column, start: Column, end: Column, body: Column) -> Column:
        fields = (section, parent, heading, path, start, end, T.strip(body))
        return F.struct(*(field.alias(name) for field, name in zip(fields, ("section", "parent", "heading", "hierarchy_path", "start_offset", "end_offset", "text"))))

    def unit(m: Column, following: Column, path: Column, data: Column) -> Column:
        whole = F.substring(data, m["byte"] + 1, following["byte"] - m["byte"]).cast("string")
        label, is_named = F.get(path, F.size(path) - 1), F.concat(T.strip(m["matched"]), F.lit(" ")).rlike(named)

        def cut(piece: Column) -> Column:
            newline = F.instr(piece, "\n")
            skipped = F.when(~is_named, F.length(m["matched"])).when(newline > 0, newline).otherwise(following["at"] - m["at"])
            heading = F.when(is_named, T.strip(F.substring_index(piece, "\n", 1))).otherwise(label)
            body = T.bound(skipped, lambda n: F.substring(piece, n + 1, F.length(piece)))
            return chunk(label, F.get(path, F.size(path) - 2), heading, path, m["at"] + skipped, following["at"], body)

        return T.bound(whole, cut)

    def units(marks: Column) -> Column:
        begun = F.slice(marks, F.lit(1), F.size(marks) - 1)
        first = F.get(marks, F.lit(0))["at"]
        before = chunk(none, none, none, F.array().cast("array<string>"), F.lit(0), first, F.substring(text, F.lit(1), first))
        after = T.bound(
            open_paths(begun, sorted({level for _, level in delimiters})),
            lambda paths: T.bound(text.cast("binary"), lambda data: F.transform(begun, lambda m, i: unit(m, F.get(marks, i + 1), F.get(paths, i), data))),
        )
        return F.filter(F.concat(F.array(before), after), lambda c: c["text"] != "")

    return T.bound(delimiter_marks(text, delimiters), units)


def chunk_structure(documents: DataFrame, preset: str | None = None, delimiters: Iterable[tuple[str, int]] | None = None) -> DataFrame:
    """``documents`` with a row for each structural chunk: chunk_index, section, parent, heading, hierarchy_path, offsets, text.

    Presets are one expression within the row. Other delimiters, which may need what only Python's expressions have, go to Arrow batches.
    """
    chosen = resolve_delimiters("pattern", preset, delimiters)
    if chosen not in [list(known) for known in fixed.PRESETS.values()]:
        return chunk_by_delimiters(documents, chosen)
    columns = [F.col(f"`{c}`") for c in documents.columns if c != "text"]
    rows = documents.where(F.length("text") > 0).select(*columns, F.posexplode(structural_units(F.col("text"), chosen)).alias("chunk_index", "_unit"))
    return rows.select(*columns, "chunk_index", "_unit.*")


def chunk_documents(documents: DataFrame, routes: dict[str, tuple[str, str | None]], default: tuple[str, str | None] = ("pattern", None), max_chars: int = 1000) -> DataFrame:
    """Chunks of all documents, by (strategy, preset) of their category, with chunk ids."""
    parts = []
    names = sorted(routes)
    for category in [*names, None]:
        strategy, preset = routes.get(category, default)
        rows = documents.where(F.col("category") == category) if category else documents.where(~F.coalesce(F.col("category").isin(*names), F.lit(False)) if names else F.lit(True))
        if strategy.strip().lower() == "sentence":
            none = F.lit(None).cast("string")
            rows = chunk_sentences(rows, max_chars).withColumns({"section": none, "parent": none, "heading": none, "hierarchy_path": F.array().cast("array<string>")})
        else:
            resolve_delimiters(strategy, preset)
            rows = chunk_structure(rows, preset)
        parts.append(rows)
    out = parts[0]
    for rows in parts[1:]:
        out = out.unionByName(rows)
    return out.withColumn("chunk_id", T.chunk_id(F.col("category"), F.col("source_doc"), F.col("chunk_index")))
