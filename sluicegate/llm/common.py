"""Shared helpers: intermediate tables, row batches, expressions."""

from __future__ import annotations

import itertools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sluicegate.functions import batches
from sluicegate.functions.batches import BATCH_BYTES, BATCH_ROWS, give_back, tidy  # noqa: F401
from sluicegate.sources import corpora

#: Bytes of text that Python code works on at a time; longer texts are cut inside the operators.
CHUNK_BYTES = 1 << 18


#: Bytes of a row group of intermediate tables: each running task holds one while it writes.
GROUP_BYTES = 16 << 20


#: Characters of a plan that the driver keeps as text, for each of its adaptive shapes.
PLAN_CHARS = 1 << 13
#: Spark's switch for deleting a query's shuffle files when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_batches(spark: SparkSession) -> None:
    """Set the session's batch and row group sizes: they are read when a plan runs, which is after an operator returns."""
    spark.conf.set("parquet.block.size", GROUP_BYTES)
    batches.small_batches(spark)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which every executor shares; it goes when the driver ends.

    The setting is read from the session.  Where it is unset, a session on one
    machine (tests) gets a temporary folder; on a cluster, that raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sluicegate-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/sluicegate-{uuid.uuid4().hex}"
    place, system = _file_system(spark, path)
    system.deleteOnExit(place)
    return path


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def as_table(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    Nothing reads the shuffle files behind the table again, so they are deleted with the end of the write.
    """
    small_batches(df.sparkSession)
    path = shared_dir(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, None)
    conf.set(SHUFFLE_CLEANUP, "true")
    conf.set("spark.sql.maxPlanStringLength", PLAN_CHARS)  # each new shape of an adaptive plan is kept as text
    try:
        df.write.parquet(path)
    finally:
        conf.set(SHUFFLE_CLEANUP, before) if before is not None else conf.unset(SHUFFLE_CLEANUP)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables made by ``as_table`` that no later plan reads."""
    for df in tables:
        for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/sluicegate-" in f:
                place, system = _file_system(spark, f)
                system.delete(place, True)


def release(spark: SparkSession) -> None:
    """Let the driver give back what planning and collecting left behind, its JVM too: a full collection shrinks the heap and unloads spent plans' code."""
    give_back()
    spark.sparkContext._jvm.System.gc()


def map_texts(df: DataFrame, id_col: str, text_col: str, keep: list[str], fields: str, function) -> DataFrame:
    """``id_col``, the kept columns and ``fields`` (DDL) of each row, from Arrow batches.

    function: makes the arrays of ``fields`` for each batch's texts; it is called
    once per task, with an iterator of columns.  Kept columns go by position, so
    no name can clash inside; a kept column that has a field's name is dropped.
    """
    small_batches(df.sparkSession)
    added = StructType.fromDDL(fields)
    keep = [c for c in keep if c not in {id_col, *added.names}]
    sent = [id_col, *keep]
    if text_col not in sent:
        sent.append(text_col)
    source = df.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(sent)))
    at, width = sent.index(text_col), 1 + len(keep)
    schema = StructType([*source.schema.fields[:width], *added.fields])

    @tidy
    def run(batches):
        first, second = itertools.tee(batches)  # in step: the function takes one batch for each one given
        for b, arrays in zip(first, function(x.column(at) for x in second), strict=False):
            yield pa.RecordBatch.from_arrays([*b.columns[:width], *arrays], schema.names)

    out = source.mapInArrow(run, schema)
    return out.toDF(id_col, *keep, *added.names)


def fold(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (null ids fall into fold 0)."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % n, F.lit(0))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return corpora.spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
