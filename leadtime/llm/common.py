"""Shared plumbing of the training-data operators: tables, shared work folder, distributed ranks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of the dataset folder, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a session in one process (tests, a notebook) without that setting gets a temporary folder of its own; on a cluster it is an error, since
    executors would each write to their own disk.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="leadtime-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


@contextmanager
def arrow_rows(spark: SparkSession, most: int = 2000):
    """Within it, Arrow batches to Python workers hold at most ``most`` rows, so that long texts do not add up in a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    spark.conf.set(name, str(min(before, most) if before > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(name, str(before))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` of a mapInArrow, after which the worker gives the memory that the task has freed back to the system. Workers live on
    from task to task, and what one operator's arrays took would else count beside what the next one needs."""

    def tidied(batches: Iterator) -> Iterator:
        import ctypes

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim is not None:
                trim(0)

    return tidied


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it.

    Cuts the lineage so that a lost executor costs one re-read, never a re-run of Python stages,
    and lets several consumers share one computation.
    """
    path = f"{work_dir(df.sparkSession)}/leadtime/{label}-{uuid.uuid4().hex}"
    with arrow_rows(df.sparkSession):
        df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._written = path
    return found


def drop(table: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``table``, once nothing that is still to run reads it."""
    path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._written)
    path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def scanned(df: DataFrame) -> DataFrame:
    """``df`` if it is a plain scan of files, else a scan of what it holds now, for those who read it more than once."""
    return df if df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation" else materialize(df, "rows")


def in_row_order(df: DataFrame, out: str = "place") -> DataFrame:
    """``df`` plus ``out``, the 0-based position of every row in the order in which ``df`` holds its rows.

    A scan takes files in an order of its own, but a written table keeps its order: part files by number, rows by index. A frame that
    is not a plain scan is written first. What is broadcast is a row count for each file.
    """
    df = scanned(df)
    rows = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    part = F.regexp_extract("__file", r"part-(\d+)[^/]*$", 1).try_cast("long")
    before = Window.orderBy(part, "__file").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("__file").agg(F.count(F.lit(1)).alias("__n")).select("__file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return rows.join(F.broadcast(starts), "__file").select(*df.columns, (F.col("__start") + F.col("__row")).alias(out))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; every other code point stays."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(df: DataFrame, keys: list[str], order: list[Column], spread: Column, out: str = "rank", per_bucket: int = 50_000) -> DataFrame:
    """0-based dense position of every row within ``keys`` without gathering a key in one task.

    ``spread`` is a non-null long, uniform within each key, and the leading sort key of the rank. The range of
    ``spread`` is cut in buckets of about ``per_bucket`` rows; a small count table gives every
    bucket its offset and only a (key, bucket) group is sorted, so one key may hold any share of
    the rows. Returns ``df`` plus ``out`` (bigint, gapless from 0 per key) and ``out``_n, the rows of the key.
    ``df`` is read twice: pass a materialized table. Keys must not be null.
    """
    n_rows = df.count()
    bits = max(8, (max(1, n_rows // per_bucket)).bit_length())
    bucket = F.shiftrightunsigned(spread, 64 - bits)
    b = df.withColumn("__b", bucket).withColumn("__spread", spread)
    counts = b.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "__b",
        F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"),
        F.sum("__n").over(Window.partitionBy(*keys)).alias(f"{out}_n"),
    )
    inside = Window.partitionBy(*keys, "__b").orderBy(F.col("__spread").bitwiseXOR(F.lit(-(2**63))), *order)
    return (
        b.withColumn("__r", F.row_number().over(inside))
        .join(offsets, [*keys, "__b"])
        .withColumn(out, F.col("__off") + F.col("__r") - 1)
        .drop("__b", "__spread", "__r", "__off")
    )
