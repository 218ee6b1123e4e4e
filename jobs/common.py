"""What the jobs share: their log, configuration files, and counts of what was written."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("flowlens.jobs")


def config(path: str | Path, known: dict[str, type | tuple[type, ...]]) -> dict:
    """The settings in a JSON file; ValueError for one that is missing, not known, or of another type."""
    found = json.loads(Path(path).read_text(encoding="utf-8"))
    if set(found) != set(known):
        raise ValueError(f"{path}: settings are {sorted(known)}, not {sorted(found)}")
    for name, kind in known.items():
        if not isinstance(found[name], kind) or isinstance(found[name], bool):
            raise ValueError(f"{path}: {name} is {found[name]!r}")
    return found


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def is_file(spark: SparkSession, path: str) -> bool:
    place, files = _place(spark, path)
    return files.exists(place) and files.getFileStatus(place).isFile()


def written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that a job wrote; partition columns are given in `schema` too. Empty if nothing is there yet."""
    place, files = _place(spark, path)
    if not files.exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def command(about: str, arguments: dict[str, str], settings: str, run: Callable[..., object]) -> None:
    """Parse plain path arguments and call `run` with a session of its own, which ends with it."""
    parser = argparse.ArgumentParser(description=about)
    for name, text in arguments.items():
        parser.add_argument(f"--{name}", required=True, help=text)
    parser.add_argument("--config", default=settings, help=f"JSON file of settings, {settings} by default")
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(about.split(":")[0]).getOrCreate()
    try:
        run(spark, **given)
    finally:
        spark.stop()
