"""Shared pieces of the corpus operators: table access, staging, distributed ranks, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows of an Arrow batch at most: long texts make batches of Spark's default (10,000 rows) hundreds of megabytes.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows an Arrow batch, which bounds what a Python worker and its executor hold at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). A local session that names none gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="pagemill-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    small_batches(spark)
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(*cols: str | Column, n: int) -> Column:
    """A bucket from 0 to n - 1 that depends on the values alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def with_rank(
    df: DataFrame,
    groups: list[str],
    order: list[str],
    buckets: int,
    rank: str = "rank",
    running: tuple[str, str] | None = None,
) -> DataFrame:
    """Number the rows of each group from 0 without gaps, however large the group.

    Rows are spread over ``buckets`` hash buckets per group; bucket totals give each bucket's first number, and a
    window numbers the rows inside one bucket only. ``running=(value, name)`` also adds the sum of ``value`` over all
    earlier rows of the group. Rows with the same order columns take any order among themselves.
    """
    df = df.withColumn("_b", spread(*order, n=buckets))
    keys = [*groups, "_b"]
    value = F.col(running[0]) if running else F.lit(0)
    before = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum(value).alias("_v"))
    starts = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_v").over(before), F.lit(0)).alias("_v0"),
    )
    met = df.join(starts, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    inside = Window.partitionBy(*keys).orderBy(*order)
    out = met.withColumn(rank, F.row_number().over(inside) - 1 + F.col("_n0"))
    if running:
        ahead = inside.rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn(running[1], F.coalesce(F.sum(value).over(ahead), F.lit(0)) + F.col("_v0"))
    return out.drop("_b", "_n0", "_v0", *[f"_k{i}" for i in range(len(keys))])


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives the memory that it has used back to the system when a task ends: Python workers outlive their tasks."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return whole


def release_memory() -> None:
    """Hand free pages of Arrow's pool and of the C library back, where the platform can."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """fn over each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(lean(run), schema)
