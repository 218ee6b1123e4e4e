"""From raw documents to packed training windows: quality rules, exact dedup, near-dedup, mixing, packing."""

from __future__ import annotations

from collections.abc import Callable

from flowlens.llm import mixing, naming, neardup, packing, quality
from flowlens.llm.common import settle, table
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Packing is greedy over rows as they come, and outliers and signatures run in Python: no SQL gives these rows.
ORACLE_SQL: str | None = None


_FILE, _ROW, _KEY = "__file", "__row", "__key"


def _rows(docs: DataFrame, *first: Column) -> DataFrame:
    """`docs` with _KEY, unlike for every row: `first`, then the row's file and place in it, whatever its doc_id is.

    Tables that are no files are written first.
    """
    place = [F.xxhash64("_metadata.file_path").alias(_FILE), F.col("_metadata.row_index").alias(_ROW)]
    try:
        placed = docs.select("*", *place)
    except AnalysisException:
        placed = settle(docs, "rows").select("*", *place)
    named = [c.alias(f"k{i}") for i, c in enumerate(first)]
    return placed.withColumn(_KEY, F.struct(*named, _FILE, _ROW)).drop(_FILE, _ROW)


def _kept(docs: DataFrame, rows: DataFrame, verdict: DataFrame) -> DataFrame:
    kept = verdict.where("kept").select(F.col(_KEY).alias("__kept"))
    return rows.join(kept, F.col(_KEY) == F.col("__kept"), "left_semi").select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the hard limits and the outlier estimates accept, each row by its own verdict."""
    rows = _rows(docs)
    return _kept(docs, rows, quality.judge(rows, key=_KEY))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts one: that with the largest doc_id; one without doc_id only if no other has one."""
    rows = _rows(docs, F.col("doc_id"))
    return _kept(docs, rows, naming.dedup(rows, key=_KEY))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 on five-word shingles one row: that with the least doc_id, rows without one last."""
    rows = _rows(docs, F.col("doc_id").isNull(), F.col("doc_id"))
    return _kept(docs, rows, neardup.link(rows, key=_KEY, size=5, percent=80))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each row as often as its source's budget takes it."""
    rows = _rows(docs, F.col("doc_id"))
    copies = mixing.mix(rows, key=_KEY, draw="doc_id").where("copies > 0").select(F.col(_KEY).alias("__of"), F.col("copies").alias("__copies"))
    mixed = rows.join(copies, F.col(_KEY) == F.col("__of")).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__copies")))
    return mixed.select(*docs.columns)


def window_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, window=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("window_packing", window_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
