"""Indexing as files arrive: an addition to the verbs, which read a tree only when asked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.scan import facts

SOURCE = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, checkpoint: str, on_facts: Callable[[DataFrame, int], None], repo_id: str | None = None, once: bool = True) -> StreamingQuery:
    """Hand the facts of new .py files in `folder` to `on_facts`, batch by batch, each file once.

    Progress is kept in `checkpoint`; a batch that failed is given again with the same number, so `on_facts` should
    write by it. With `once` the query ends when all files there are have been read. Spark's file streams leave out files
    whose names begin with `_`; an index of a whole tree has them.
    """
    files = spark.readStream.format("binaryFile").schema(SOURCE).option("pathGlobFilter", "*.py").option("recursiveFileLookup", "true").load(folder)
    named = files.select(F.lit(repo_id or folder).alias("repo_id"), F.regexp_replace("path", r"^file:/+", "/").alias("path"), "content")
    writer = named.writeStream.foreachBatch(lambda df, n: on_facts(facts(df), n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
