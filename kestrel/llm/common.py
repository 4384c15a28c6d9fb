"""Small helpers of the operators in this folder."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (Spark ignores case)."""
    taken, name = {c.lower() for c in df.columns}, f"_{base}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


BATCH_TEXTS = 500       # whole texts in one Arrow batch, which a task holds several times (JVM, Arrow, Python strings)


def small_batches(spark: SparkSession) -> None:
    """From now on Python functions of the session get at most BATCH_TEXTS rows at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_TEXTS:
        spark.conf.set(name, str(BATCH_TEXTS))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for a written table, below ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def bucket_count(rows: int, per_bucket: int) -> int:
    return max(1, math.ceil(rows / per_bucket))


def running_offsets(df: DataFrame, by: list[str], bucket: str, value: Column, name: str) -> DataFrame:
    """Per (by, bucket), the sum of ``value`` over the earlier buckets of ``by``.
    Only one row per (by, bucket) meets in the window, whatever the data size."""
    sums = df.groupBy(*by, bucket).agg(F.sum(value).alias("_v"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    w = w.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*by, bucket, F.coalesce(F.sum("_v").over(w), F.lit(0)).alias(name))
