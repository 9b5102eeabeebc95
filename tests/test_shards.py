"""The data source of a hub's shards, over a folder of JSON lines as the hub."""

import json
import os

import pytest

from corpusloom.sources import shards


class Folder:
    def __init__(self, path):
        self.path = path

    def names(self):
        return sorted(os.listdir(self.path))

    def rows(self, name):
        with open(os.path.join(self.path, name)) as f:
            for line in f:
                yield json.loads(line)


def hub(options):
    return Folder(options["folder"])


def test_batches_and_streams(spark, tmp_path):
    shards.register(spark)
    folder = tmp_path / "hub"
    folder.mkdir()

    def arrive(name, *records):
        (folder / name).write_text("".join(json.dumps(r) + "\n" for r in records))

    def reader(how):
        return how.format("shards").schema("id long, text string").option("hub", "tests.test_shards:hub").option("folder", str(folder))

    assert reader(spark.read).load().count() == 0
    arrive("a", *({"id": i, "text": f"t{i}", "other": 1} for i in range(600)))
    arrive("b", {"id": 1000}, {"text": "no id"})
    rows = reader(spark.read).load()
    assert rows.count() == 602 and rows.rdd.getNumPartitions() == 2
    assert rows.where("id = 1000").first()["text"] is None and rows.where("text = 't599'").count() == 1

    def caught_up():
        query = reader(spark.readStream).load().writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start(f"{tmp_path}/out")
        assert query.awaitTermination(120)
        return spark.read.parquet(f"{tmp_path}/out").count()

    assert caught_up() == 602
    assert caught_up() == 602
    arrive("c", {"id": 2000, "text": "late"})
    assert caught_up() == 603
    arrive("d", {"id": 1, "text": "fine"}, ["no", "record"])
    with pytest.raises(Exception, match="shard d, record 1: not a record"):
        reader(spark.read).load().collect()
    arrive("d", {"id": "many", "text": "x"})
    with pytest.raises(Exception, match="shard d, records 0 to 0"):
        reader(spark.read).load().collect()
    arrive("d", {"id": 3, "text": "mended"})
    assert caught_up() == 604
