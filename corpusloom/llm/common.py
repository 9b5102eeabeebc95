"""What the operators share: Arrow row mapping and the tokens that several contracts name."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Word separators of the contracts, U+0020 and U+0009 to U+000D; ``bytes.split()`` uses the same six.
SPACE = b" \t\n\x0b\x0c\r"
#: The same words as a pattern of Java and RE2.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Rows, and bytes of text, held as Python objects at once by :func:`map_rows`; a single longer text is a slice of its own.
SLICE_ROWS = 256
SLICE_BYTES = 2_000_000


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def sliced(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of at most ``rows`` and ``size`` bytes, so that few texts are Python objects at once."""
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(start, stop - start)
            start = stop
    # Workers go on to other tasks; what this one needed goes back first.
    pa.default_memory_pool().release_unused()


def map_rows(df: DataFrame, make: Callable[[], Callable[[list], list]], schema: str, rows: int = SLICE_ROWS) -> DataFrame:
    """Apply a row-list function to Arrow batches.

    ``make`` runs once for a task and returns a function from a list of input rows (tuples in
    column order, strings as bytes) to a list of output rows (tuples in the order of ``schema``).
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for part in sliced(batches, rows):
            columns = [text_bytes(c) if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else c.to_pylist() for c in part.columns]
            out = work(list(zip(*columns)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(values, type=field.type) for values, field in zip(zip(*out), arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


#: Result rows that :func:`by_group` gives on at once.
GROUP_ROWS = 1 << 16


def by_group(df: DataFrame, keys: list[str], work: Callable[[pa.Table], list[np.ndarray]], schema: str) -> DataFrame:
    """``work`` on the rows of each key (columns of whole numbers), its columns as rows of ``schema``.

    Groups lie one after the other in sorted partitions and are gone through as a stream, many to an Arrow batch; a task holds one.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last, out, size = None, [], 0

        def finished() -> None:
            nonlocal held, size
            if sum(b.num_rows for b in held) > 1:
                found = work(pa.Table.from_batches(held))
                out.append(found)
                size += len(found[0])
            held = []

        def given() -> pa.RecordBatch:
            nonlocal size
            batch = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
            out.clear()
            size = 0
            return batch

        for batch in batches:
            if not batch.num_rows:
                continue
            values = [batch.column(k).to_numpy() for k in keys]
            change = np.zeros(batch.num_rows - 1, bool)
            for v in values:
                change |= v[1:] != v[:-1]
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for start, stop in zip(edges[:-1], edges[1:]):
                key = tuple(v[start] for v in values)
                if key != last:
                    finished()
                    last = key
                held.append(batch.slice(start, stop - start))
                if size > GROUP_ROWS:
                    yield given()
        finished()
        if out:
            yield given()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id, written as text, leaves 2 when divided by 4. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def is_held_out(doc_id: int | None) -> bool:
    """:func:`held_out` for one Python value."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 4 == 2
