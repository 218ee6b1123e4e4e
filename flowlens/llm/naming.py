"""Exact dedup by deterministic block naming.

Texts are cut into blocks of a fixed number of characters. Distinct blocks are sorted and get integer names; then
names of adjacent blocks are paired, the distinct pairs sorted and named, until one name stands for a whole text.
A name is given to one content only, so that equal identities mean equal texts: no fingerprint decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blank, settle, width

#: A key that this share of the rows or more holds is named apart, from its distinct values.
HOT_SHARE = 1 / 2048


def assign_names(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Add `name` (long): equal for rows equal in all `keys`, different for others.

    Rows go to buckets by a hash of their keys, are sorted there, and the rank of a key among the bucket's distinct
    keys, with the bucket's number, is its name. Keys on many rows (at most 1 / HOT_SHARE hash values) are reduced to
    their distinct values before they move, named in a range of their own, and joined back: a hot key is never
    gathered in one task. `rows` is read three times and should be cheap to read.
    """
    spark = rows.sparkSession
    buckets = 4 * width(spark)
    hashed = rows.withColumn("_h", F.xxhash64(*keys))
    per_hash = hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"))
    total = rows.count()
    hot = [r["_h"] for r in per_hash.where(F.col("_n") >= max(1000, int(total * HOT_SHARE))).select("_h").collect()]
    bucket = F.pmod("_h", F.lit(buckets))
    ranked = F.dense_rank().over(Window.partitionBy("_b").orderBy(*keys)).cast("long")
    cold = hashed.where(~F.col("_h").isin(hot)) if hot else hashed
    named = cold.withColumn("_b", bucket).withColumn("name", F.col("_b") * (1 << 40) + ranked)
    out = named.select(*rows.columns, "name")
    if hot:
        warm = hashed.where(F.col("_h").isin(hot))
        distinct = warm.select("_h", *keys).distinct().withColumn("_b", bucket)
        names = distinct.withColumn("name", -1 - (F.col("_b") * (1 << 40) + ranked)).select(*keys, "name")
        same = [F.col(f"r.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
        # distinct hot keys are at most 1 / HOT_SHARE hash values, each a block or a pair: a bounded broadcast
        joined = warm.alias("r").join(F.broadcast(names.alias("n")), same, "inner")
        out = out.unionByName(joined.select(*[F.col(f"r.{c}") for c in rows.columns], F.col("n.name")))
    return out


def identities(docs: DataFrame, text: str = "text", block_chars: int = 4096, **carried: Column) -> DataFrame:
    """One row per row of `docs`: what `carried` names, level (int) and name (long), equal exactly for equal texts.

    A null text counts as empty; an empty text is one empty block. level is the number of pairings that a text took.
    Texts of different lengths in blocks never meet, as their last pairings stand at different levels or have a null
    as partner. Each level is written to the shared folder before it is used. Rows are told apart by their place.
    """
    size = F.greatest(F.lit(1), F.ceil(F.length("_t") / F.lit(block_chars))).cast("int")
    row = F.struct(F.monotonically_increasing_id().alias("_row"), *[c.alias(n) for n, c in carried.items()])
    base = docs.select(row.alias("_key"), blank(text).alias("_t")).withColumn("_size", size)
    blocks = base.select("_key", "_size", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("_size") - 1), lambda i: F.substring(F.col("_t"), i * block_chars + 1, F.lit(block_chars)))).alias("_pos", "_block"))
    now = settle(assign_names(blocks, ["_block"]).select("_key", "_size", "_pos", "name"), "names0")
    done, level = [], 0
    while True:
        done.append(now.where("_size = 1").select(*[F.col(f"_key.{n}").alias(n) for n in carried], F.lit(level).alias("level"), "name"))
        left = now.where("_size > 1")
        if left.isEmpty():
            break
        level += 1
        pairs = left.groupBy("_key", "_size", (F.col("_pos") / 2).cast("int").alias("_pos")).agg(F.min(F.when(F.col("_pos") % 2 == 0, F.col("name"))).alias("_a"), F.min(F.when(F.col("_pos") % 2 == 1, F.col("name"))).alias("_b2"))
        pairs = settle(pairs.withColumn("_size", ((F.col("_size") + 1) / 2).cast("int")), f"pairs{level}")
        now = settle(assign_names(pairs, ["_a", "_b2"]).select("_key", "_size", "_pos", "name"), f"names{level}")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", block_chars: int = 4096, **carried: Column) -> DataFrame:
    """One row per row of `docs`: `key`, keep_id (the largest key among rows of equal text), group_size, kept, and what `carried` names.

    Null and empty texts are equal to each other. Rows that repeat a key count in group_size and share its verdict. Of
    rows without a key those are kept whose group has no key at all. No row is lost; an empty table gives none.
    """
    ids = identities(docs, text, block_chars, **{key: F.col(key)}, **carried)
    same = ["level", "name"]
    groups = settle(ids.groupBy(*same).agg(F.max(key).alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    # groups on many rows are few, 1 / HOT_SHARE at most, and sent to the rows; the others meet theirs by their identity
    large = F.col("group_size") >= max(1000, int(ids.count() * HOT_SHARE))
    hot = F.broadcast(groups.where(large))
    rest = ids.join(hot.select(*same), same, "left_anti").join(groups.where(~large), same)
    found = ids.join(hot, same).unionByName(rest)
    return found.select(key, "keep_id", "group_size", F.col(key).eqNullSafe(F.col("keep_id")).alias("kept"), *carried)


def digest(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """dedup() with text_sha256, the lowercase hex digest of the text's UTF-8."""
    sha = F.unhex(F.sha2(blank(text).cast("binary"), 256))
    return dedup(docs, text, key, text_sha256=sha).withColumn("text_sha256", F.lower(F.hex("text_sha256")))
