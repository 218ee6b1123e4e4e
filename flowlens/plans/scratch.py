"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where that is unset and the session runs on this machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="flowlens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def keep(name: str, df: DataFrame) -> DataFrame:
    """Write `df` out and read it back, so that its plan ends here and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/flowlens/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
