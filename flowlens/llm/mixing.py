"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Within each source, ranges of keys are summed first and the sums of ranges
prefix-summed; then each range is sorted and prefix-summed by itself. A source's budget is a number of whole passes
over it and a cut in the last one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, blank, settle

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: No source gives more than this many times its size.
MOST = 3
#: Rows that one range of keys should hold.
RANGE_ROWS = 4096


def n_words(text: str = "text") -> Column:
    return F.regexp_count(blank(text), F.lit(WORD)).cast("long")


def random_key(key: str = "doc_id", text: str = "text") -> Column:
    """60 bits of the MD5 digest of the key as text, or of the row's text where it has none: the same in any engine."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), blank(text)).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source of `sizes` (source, source_size): target double.

    Sources by code point, null last, take the weights in turn. All share the total by weight; a source stops at
    `most` times its size and the others share the excess by weight, until none is above its limit. With sources in
    order of limit by weight, those before the first that stays within its share are the ones at their limit. Sources
    without words have target 0. The table has a row a source.
    """
    ordered = sizes.withColumn("_r", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), ((F.col("_r") - 1) % len(weights) + 1).cast("int"))
    limited = ordered.withColumn("_w", w).withColumn("_cap", F.lit(most).cast("long") * F.col("source_size"))
    limited = limited.withColumn("_o", F.row_number().over(Window.orderBy(F.col("_cap").cast("double") / F.col("_w"), "_r")))
    before, whole = Window.orderBy("_o").rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0))).cast("double") / (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    found = limited.withColumn("_level", level).withColumn("_first", F.when(level * F.col("_w") <= F.col("_cap"), F.col("_o")))
    found = found.withColumn("_level", F.min_by("_level", "_first").over(whole))
    return found.select("source", "source_size", F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level") * F.col("_w")).otherwise(F.col("_cap").cast("double")).alias("target"))


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, draw: str | None = None) -> DataFrame:
    """One row per row of `docs`: `key`, size, source, source_size, target, copies (long), taken = copies * size.

    A source takes floor(target / source_size) whole passes over its documents, and in the next pass those whose
    middle word, in order of random_key(), lies before the rest of the target: documents stay whole, and a source
    misses its target by half a document at most. Null text: size 0. Null source: a source of its own, last. Documents
    of size 0 are taken once if their source takes anything, in no pass otherwise. Rows that tie in key and size are
    ordered by either; they get equal sums in total. random_key() is that of the column `draw`, of `key` by default.
    An empty table gives no rows.
    """
    # texts are read once; four numbers a row are read again
    sized = docs.select(F.col(key).alias("_id"), F.col(source).alias("source"), n_words(text).alias("size"), random_key(draw or key, text).alias("_k"))
    sized = settle(sized, "sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    # ranges of keys grow in number with the source, by powers of two
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("_rows") / F.lit(float(RANGE_ROWS))))).cast("int")
    goal = per_source.withColumn("_shift", F.lit(60) - bits).join(targets(per_source.select("source", "source_size")).select(F.col("source").alias("_s"), "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "_rows")
    ranged = sized.alias("d").join(goal.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_range", F.expr("shiftright(_k, _shift)"))
    sums = ranged.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    starts = sums.withColumn("_start", F.sum("_sum").over(Window.partitionBy("source").orderBy("_range")) - F.col("_sum")).select(F.col("source").alias("_s"), F.col("_range").alias("_r"), "_start")
    inner = Window.partitionBy("source", "_range").orderBy("_k", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_in", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    before = F.col("_start") + F.col("_in")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - passes * F.col("source_size")
    last = ((2 * before + F.col("size")).cast("double") < 2 * rest).cast("long")
    copies = F.when(F.col("size") > 0, passes + last).otherwise((F.col("target") > 0).cast("long"))
    return placed.withColumn("copies", copies).select(F.col("_id").alias(key), "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
