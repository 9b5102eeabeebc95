"""Session-level helpers: the shared scratch folder and lineage cuts written as tables."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Setting -> Spark's own value, ours.
BATCH_SIZES = {
    "spark.sql.parquet.columnarReaderBatchSize": ("4096", "1024"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m"),
}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset in local mode (tests, a
    laptop) is a folder of our own made, and remembered in the session for later calls; elsewhere an unset
    one is an error, as no folder of one machine is all executors'.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if named:
        return named.rstrip("/")
    if not is_local(spark):
        raise RuntimeError(f"{CHECKPOINT_CONF} must name a folder that the driver and all executors share")
    own = getattr(spark.sparkContext, "_corpusloom_scratch", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext._corpusloom_scratch = own
    return own


def is_local(spark: SparkSession) -> bool:
    """Whether the driver is the only executor."""
    return re.match(r"local(\[|$)", spark.sparkContext.master) is not None


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; nothing exists there yet."""
    return f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: what comes after survives the loss of any executor without
    computing ``df`` again, and several consumers share one computation.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    _written(spark).append(path)
    df.write.parquet(path)
    settle(spark)
    rows = spark.read.schema(df.schema).parquet(path)
    rows._corpusloom_path = path
    return rows


def remember(spark: SparkSession, path: str) -> None:
    """Count ``path`` among the session's scratch, for :func:`clear`."""
    if path not in _written(spark):
        _written(spark).append(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables of :func:`stash` that nothing reads any more: all that was made of them has been written."""
    for rows in tables:
        _written(rows.sparkSession).remove(rows._corpusloom_path)
        discard(rows.sparkSession, rows._corpusloom_path)


def size_batches(spark: SparkSession) -> None:
    """Make the batches smaller that Spark counts in rows, as a row here can hold a whole text.

    4,096 rows in the Parquet reader and 64 MB on the way to Python are, for each task, some 100 MB of buffers that stay
    with the executor. Settings that differ from Spark's own are left alone.
    """
    for name, (usual, smaller) in BATCH_SIZES.items():
        if spark.conf.get(name) == usual:
            spark.conf.set(name, smaller)


@contextmanager
def setting(spark: SparkSession, name: str, value: object) -> Iterator[None]:
    """A session setting for what is written inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(value))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def settle(spark: SparkSession) -> None:
    """Let the executors collect their garbage and give the heap back that a finished step needed.

    Python workers and native buffers live beside the heap, in the same container. A heap that each step
    leaves as large as its peak adds to all that the next ones need outside of it. One short task for each executor;
    nothing in local mode, where the driver's heap is the only one.
    """
    if is_local(spark):
        return
    executors = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)
    spark.range(0, executors, 1, executors).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def _written(spark: SparkSession) -> list[str]:
    """The scratch tables of this session."""
    context = spark.sparkContext
    if not hasattr(context, "_corpusloom_written"):
        context._corpusloom_written = []
    return context._corpusloom_written


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside go at the end, but for those that the given function was called on."""
    before, kept = set(_written(spark)), set()

    def keep(rows: DataFrame) -> DataFrame:
        kept.add(rows._corpusloom_path)
        return rows

    yield keep
    for path in [p for p in _written(spark) if p not in before | kept]:
        _written(spark).remove(path)
        discard(spark, path)


def clear(spark: SparkSession) -> None:
    """Delete all scratch tables of the session; results that were built on them must have been written before."""
    paths = _written(spark)
    while paths:
        discard(spark, paths.pop())


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now.

    Spark deletes them once the driver's JVM has collected what refers to them, which a long job
    with little driver work may not do for half an hour.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through the Hadoop file system that holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at ``path``, in whatever file system it names."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def list_names(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, time of change in ms) of what lies directly below ``path``; none where there is nothing."""
    files, place = _file_system(spark, path)
    return sorted((s.getPath().getName(), s.getModificationTime()) for s in files.listStatus(place)) if files.exists(place) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text."""
    files, place = _file_system(spark, path)
    stream = files.open(place)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole, unless there is one: of several who try at once only one is told True.

    The file is written under another name and renamed, which Hadoop's file system refuses where the name is taken; a local file
    is linked instead, as a local rename would replace it. Object stores whose rename isn't atomic need a file system that makes it so.
    """
    files, place = _file_system(spark, path)
    jvm = spark.sparkContext._jvm
    draft = jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    try:
        if files.getUri().getScheme() == "file":
            paths = [jvm.java.nio.file.Paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)) for p in (place, draft)]
            try:
                jvm.java.nio.file.Files.createLink(*paths)
                return True
            except Py4JJavaError as error:
                if "FileAlreadyExists" in str(error.java_exception):
                    return False
                raise
        return not files.exists(place) and files.rename(draft, place)
    finally:
        files.delete(draft, False)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    size_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
