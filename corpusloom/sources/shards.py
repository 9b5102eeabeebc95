"""A remote hub's shards as a data source, for batches and for streams.

``spark.read.format("shards").schema(...).option("hub", "package.module:function").load()`` reads every shard in a task of its own;
``readStream`` reads the shards that have come since its checkpoint. The function gets the options and returns a hub: ``names()`` lists its shards,
new ones behind the old, and ``rows(name)`` gives a shard's records. It must be importable on the executors.
"""

from __future__ import annotations

import importlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Records of a batch.
BATCH = 256


@dataclass
class Shard(InputPartition):
    name: str


class Hub:
    """What both readers share: the hub that the options name, and its records as batches."""

    def __init__(self, options: dict, schema: StructType):
        self.options, self.columns = dict(options), schema

    def open(self):
        module, _, name = self.options["hub"].partition(":")
        return getattr(importlib.import_module(module), name)(self.options)

    def read(self, partition: Shard | None) -> Iterator[pa.RecordBatch]:
        """A shard's records. One that isn't a record of these columns is an error with its place; columns it lacks are null, others are left out."""
        if partition is None:  # A hub without shards.
            return
        arrow = to_arrow_schema(self.columns)
        rows, place = iter(self.open().rows(partition.name)), 0
        while held := list(itertools.islice(rows, BATCH)):
            for n, row in enumerate(held, place):
                if not isinstance(row, dict):
                    raise ValueError(f"shard {partition.name}, record {n}: not a record but {type(row).__name__}")
            try:
                yield pa.RecordBatch.from_pylist([{f.name: row.get(f.name) for f in arrow} for row in held], schema=arrow)
            except (pa.ArrowInvalid, pa.ArrowTypeError) as error:
                raise ValueError(f"shard {partition.name}, records {place} to {place + len(held) - 1}: {error}") from error
            place += len(held)


class ShardReader(Hub, DataSourceReader):
    def partitions(self) -> list[Shard]:
        return [Shard(name) for name in self.open().names()]


class ShardStream(Hub, DataSourceStreamReader):
    """Offsets are how many of the hub's shards have been read."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"shards": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"shards": len(self.open().names())}

    def partitions(self, start: dict, end: dict) -> list[Shard]:
        return [Shard(name) for name in self.open().names()[start["shards"] : end["shards"]]]

    def commit(self, end: dict) -> None:
        """Nothing is kept on the hub's side."""


class ShardSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shards"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ShardReader(self.options, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return ShardStream(self.options, schema)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(ShardSource)
