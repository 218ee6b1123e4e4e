"""Helpers shared by the training-data operators: tables, shared storage, sizes."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word rule here, as a regular expression class.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


#: Seconds that pass at least between two collections of the driver's garbage.
SWEEP = 5.0
_swept = 0.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and the session runs on this machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="flowlens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/flowlens/{uuid.uuid4().hex}/{name}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors, compresses."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    sweep(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Let go of what finished queries hold: Spark drops their broadcasts, shuffle files and generated classes only when the driver's garbage is collected, by itself every half an hour."""
    global _swept
    if time.monotonic() - _swept > SWEEP:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _swept = time.monotonic()


@contextmanager
def fixed_plans(spark: SparkSession):
    """Run queries by the plans that are made beforehand, each as one job: for many small steps in a row, whose joins are settled. The setting is put back."""
    key = "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Keep Arrow batches of whole texts small; a smaller setting of the user's stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blank(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
