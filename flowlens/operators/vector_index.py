"""A stored index of vectors for cosine search: cells, codes of a byte a dimension, and exact vectors for a last look.

Tables of an index (Parquet, in one folder):

* `centres`: (top, cell, centre). As many cells as the square root of the rows, found in two steps: k-means of a sample
  into the square root of that many tops, then k-means of each top's rows by itself, as one task a top.
* `vectors`: (batch, top, cell, block, pos, key, vector), a row a vector, in its cell's blocks of about `BLOCK` rows.
* `blocks`: (batch, top, cell, block, codes, scales, errors), a row a block. A code is what a unit vector has beyond its
  cell's centre, rounded to a byte a dimension; error is the length of what rounding left.
* `cells`: (batch, top, cell, n, radius), the number of rows and the greatest distance from the centre.

A search has two bounds. A row's score lies within its error around the score of its code, so rows whose code cannot
reach the k-th best are left without reading their vector. No row of a cell scores above its centre's score plus the
cell's radius, so cells that cannot reach the k-th best are left unread. The k-th best is first taken from the cells
nearest to the query. What remains is scored exactly: the answer is that of a search of all rows, unless `probes` limits the
cells that are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..functions.vectors import cosine, norm, unit
from ..plans.scratch import keep

#: Rows a cell of the sample that cells are fitted on, rows of it that one top is fitted on at most, and steps of k-means.
PER_CELL, PER_TOP, STEPS = 64, 50_000, 8
#: Bytes of all centres at most, as they are sent to all tasks; with more rows cells grow in size, not in number.
CENTRE_BYTES = 64 << 20
#: Rows of a block, queries that are compared with a block at once, cells that give the first k-th best.
BLOCK, SLICE, FIRST = 512, 128, 4
#: Numbers in a matrix that a task computes at once, rows that it encodes at once, bytes of query vectors that it gives on at once.
PRODUCT, ENCODED_AT_ONCE, GIVEN_ON = 1 << 21, 1024, 8 << 20
#: What sums of products of unit vectors may be off by.
SLACK = 1e-6

CENTRES = "top int, cell int, centre array<double>"
TABLES = {
    "centres": CENTRES,
    "blocks": "cell int, block int, codes array<binary>, scales array<float>, errors array<float>, batch long, top int",
    "cells": "top int, cell int, n long, radius float, batch long",
}
#: Columns that the tables of a batch are partitioned by.
PARTED = {"vectors": ["top"], "blocks": ["top"], "cells": []}
ENCODED = "top int, cell int, code binary, scale float, error float, beyond float"
CANDIDATES = "q long, batch long, top int, cell int, block int, pos int, low double, high double"


class _Cells:
    """Centres by cell, and the cells of each top."""

    def __init__(self, rows: list[tuple[int, int, list[float]]]):
        self.top = np.array([r[0] for r in rows])
        self.cell = np.array([r[1] for r in rows])
        self.centre = np.array([r[2] for r in rows], dtype=np.float64)
        self.of = {int(t): np.flatnonzero(self.top == t) for t in np.unique(self.top)}
        self.tops = np.array([self.centre[places].mean(axis=0) for places in self.of.values()])
        self.names = list(self.of)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """Place of the cell of each vector: the nearest of its nearest top."""
        found = np.empty(len(x), np.int64)
        top = _closest(x, self.tops)
        for i in np.unique(top):
            places, rows = self.of[self.names[i]], np.flatnonzero(top == i)
            found[rows] = places[_closest(x[rows], self.centre[places])]
        return found


def _closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Place of the nearest centre of each row; products are made of so many rows at once that they stay small."""
    half, rows = (centres * centres).sum(axis=1) / 2, max(1, PRODUCT // len(centres))
    return np.concatenate([np.argmax(x[i : i + rows] @ centres.T - half, axis=1) for i in range(0, max(1, len(x)), rows)])


def _parts(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most `rows` rows."""
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Tasks that are started here get SLICE rows at once: a row of a comparison holds a slice of queries and a block of codes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, SLICE)
    try:
        yield
    finally:
        spark.conf.set(name, was)


def _lloyd(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centres of `k` cells at most of `x`; equal rows make one."""
    different = np.unique(x, axis=0)
    centres = different[np.random.default_rng(seed).permutation(len(different))[:k]].copy()
    for _ in range(STEPS):
        nearest = _closest(x, centres)
        count = np.bincount(nearest, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, nearest, x)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def _matrix(column) -> np.ndarray:
    """A list column of an Arrow batch, all of one width, as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit_rows(column) -> np.ndarray:
    x = _matrix(column)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


class VectorIndex:
    """The index in `folder`, a path that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str) -> DataFrame:
        if name == "vectors":
            row = self.spark.read.parquet(f"{self.folder}/row").schema
            schema = StructType([*StructType.fromDDL("cell int, block int, pos int").fields, *row.fields, *StructType.fromDDL("batch long, top int").fields])
        else:
            schema = StructType.fromDDL(TABLES[name])
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    # ---- writing

    def build(self, rows: DataFrame, key: str, vector: str) -> None:
        """Fit cells on a sample of `rows` and index all of them, in place of what is in the folder.

        The sample has about PER_CELL rows a cell, drawn by hash. Rows without vector, or with vectors of different
        widths, are a ValueError. Keys may repeat or be null; a zero vector scores 0. An empty frame makes an empty index.
        """
        shape = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce(F.size(vector), F.lit(-1))).alias("a"), F.max(F.coalesce(F.size(vector), F.lit(-1))).alias("b")).first()
        if shape["n"] and (shape["a"] != shape["b"] or shape["a"] < 1):
            raise ValueError(f"vectors have dimensions from {shape['a']} to {shape['b']}")
        self._fit(rows.select(unit(vector).alias("_u")), shape["n"], shape["a"] or 1).write.mode("overwrite").parquet(f"{self.folder}/centres")
        rows.select(F.col(key).alias("key"), F.col(vector).alias("vector")).where("false").write.mode("overwrite").parquet(f"{self.folder}/row")
        for name, table in self._tables(rows, key, vector).items():
            table.withColumn("batch", F.lit(0).cast("long")).write.mode("overwrite").partitionBy("batch", *PARTED[name]).parquet(f"{self.folder}/{name}")

    def _fit(self, units: DataFrame, n: int, width: int) -> DataFrame:
        cells = max(1, min(math.isqrt(n), CENTRE_BYTES // (8 * width)))
        tops = max(1, math.isqrt(cells))
        share = min(1.0, PER_CELL * cells / max(n, 1))
        # equal vectors are drawn apart, so that a sample of many copies keeps its size
        drawn = keep("drawn", units.where(F.rand(1) <= share).select("_u", F.rand(2).alias("_r")))
        if drawn.isEmpty():
            drawn = keep("drawn", units.limit(1).select("_u", F.rand(2).alias("_r")))
        if drawn.isEmpty():
            return self.spark.createDataFrame([], CENTRES)
        if tops > 1:
            fitted = KMeans(k=tops, featuresCol="_f", predictionCol="_top", seed=1, maxIter=STEPS).fit(drawn.select(array_to_vector("_u").alias("_f")))
            drawn = keep("topped", fitted.transform(drawn.withColumn("_f", array_to_vector("_u"))).drop("_f"))
        else:
            drawn = drawn.withColumn("_top", F.lit(0))
        counts = drawn.groupBy("_top").agg(F.count(F.lit(1)).alias("_n"))
        total = drawn.count()
        # one row a top, of which there are the fourth root of the rows
        part = drawn.join(F.broadcast(counts), "_top").where(F.col("_r") * F.col("_n") <= PER_TOP).withColumn("_k", F.greatest(F.lit(1), F.round(F.col("_n") * cells / total)).cast("int"))

        def split(group):
            import pandas as pd

            top = int(group["_top"].iloc[0])
            centres = _lloyd(np.array(group["_u"].tolist(), dtype=np.float64), int(group["_k"].iloc[0]), top)
            return pd.DataFrame({"top": top, "cell": range(len(centres)), "centre": list(centres)})

        found = part.groupBy("_top").applyInPandas(split, CENTRES)
        # cells are numbered through; their number is bounded by CENTRE_BYTES
        return found.withColumn("cell", (F.row_number().over(Window.orderBy("top", "cell")) - 1).cast("int"))

    def _cells(self) -> _Cells:
        """All centres, at most CENTRE_BYTES of them."""
        return _Cells([tuple(r) for r in self._read("centres").orderBy("cell").collect()])

    def _tables(self, rows: DataFrame, key: str, vector: str) -> dict[str, DataFrame]:
        schema = StructType([StructField("key", rows.schema[key].dataType), StructField("vector", rows.schema[vector].dataType), *StructType.fromDDL(ENCODED).fields])
        named = rows.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
        cells = self._cells()
        if not len(cells.cell):
            encoded = self.spark.createDataFrame([], schema)
        else:
            sent, arrow = self.spark.sparkContext.broadcast(cells), to_arrow_schema(schema)

            def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in (part for whole in batches for part in _parts(whole, ENCODED_AT_ONCE)):
                    x = _unit_rows(b.column(1))
                    place = sent.value.nearest(x)
                    beyond = x - sent.value.centre[place]
                    scale = (np.abs(beyond).max(axis=1) / 127).astype(np.float32)
                    code = np.rint(np.divide(beyond, scale[:, None], out=np.zeros_like(beyond), where=scale[:, None] > 0)).clip(-127, 127)
                    error = np.linalg.norm(beyond - code * scale[:, None].astype(np.float64), axis=1)
                    codes = [c.tobytes() for c in (code + 128).astype(np.uint8)]
                    columns = [sent.value.top[place], sent.value.cell[place], codes, scale, error.astype(np.float32), np.linalg.norm(beyond, axis=1).astype(np.float32)]
                    yield pa.RecordBatch.from_arrays([b.column(0).cast(arrow[0].type), b.column(1).cast(arrow[1].type), *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[2:], strict=True))], schema=arrow)

            encoded = named.mapInArrow(encode, schema)
        numbered = keep("encoded", encoded.withColumn("_row", F.monotonically_increasing_id()))
        sizes = numbered.groupBy("top", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("beyond").alias("radius"))
        parts = keep("sizes", sizes.withColumn("_parts", F.ceil(F.col("n") / BLOCK)))
        # a cell that holds a third of all rows is many blocks
        cut = numbered.join(F.broadcast(parts.select("cell", "_parts")), "cell").withColumn("block", F.pmod(F.xxhash64("_row"), F.col("_parts")).cast("int"))
        pos = (F.row_number().over(Window.partitionBy("cell", "block").orderBy("_row")) - 1).cast("int")
        placed = keep("placed", cut.withColumn("pos", pos))
        each = F.array_sort(F.collect_list(F.struct("pos", "code", "scale", "error")))
        blocks = placed.groupBy("top", "cell", "block").agg(each.alias("_e"))
        return {
            "vectors": placed.select("cell", "block", "pos", "key", "vector", "top"),
            "blocks": blocks.select("cell", "block", F.col("_e.code").alias("codes"), F.col("_e.scale").alias("scales"), F.col("_e.error").alias("errors"), "top"),
            "cells": parts.select("top", "cell", F.col("n").cast("long").alias("n"), "radius"),
        }

    def add(self, rows: DataFrame, key: str, vector: str, batch: int) -> None:
        """Index more rows in the cells that there are, as batch number `batch`; the batch of that number is replaced, so that a failed run can be repeated."""
        width = self._read("centres").select(F.size("centre").alias("w")).first()
        wrong = rows.where(F.coalesce(F.size(vector), F.lit(-1)) != (width["w"] if width else -1)).first()
        if wrong is not None:
            raise ValueError(f"a vector has dimension {len(wrong[vector] or [])}, the index {width['w'] if width else 0}")
        for name, table in self._tables(rows, key, vector).items():
            table.write.mode("overwrite").partitionBy(*PARTED[name]).parquet(f"{self.folder}/{name}/batch={batch}")

    # ---- reading

    def search(self, queries: DataFrame, k: int, query_key: str, query_vector: str, key: str = "key", probes: int | None = None) -> DataFrame:
        """(`query_key`, `key`, score, rank) of the `k` rows nearest to each row of `queries` by cosine, equals in order of `key`.

        Exact, unless `probes` is given: then only that many cells, those with the centres nearest to a query, are read for it. Rows of `queries` with
        one key are asked apart, but ranked together. A query of another width than the index is a ValueError.
        """
        asked = keep("asked", queries.select(F.col(query_key).alias("_key"), F.col(query_vector).alias("_v"), F.monotonically_increasing_id().alias("_q")))
        width = self._read("centres").select(F.size("centre").alias("w")).first()
        wrong = asked.where(F.coalesce(F.size("_v"), F.lit(-1)) != (width["w"] if width else -1)).first() if width else None
        if wrong is not None:
            raise ValueError(f"a query has dimension {len(wrong['_v'] or [])}, the index {width['w']}")
        found = self.candidates(asked.select("_q", "_v"), k, probes)
        exact = found.join(self._read("vectors"), ["batch", "top", "cell", "block", "pos"]).join(asked, found["q"] == asked["_q"])
        scored = exact.select(F.col("_key").alias(query_key), F.col("key").alias(key), cosine("vector", "_v").alias("score"))
        rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key))
        return scored.withColumn("rank", rank).where(F.col("rank") <= k)

    def candidates(self, asked: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """CANDIDATES for queries (_q, _v): the rows whose vectors have to be looked at, with the bounds of their scores."""
        stats = self._read("cells").groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))
        if stats.isEmpty():
            return self.spark.createDataFrame([], CANDIDATES)
        with _small_batches(self.spark):
            near = keep("first", self._compared(asked.withColumn("_t", F.lit(float("-inf"))), stats, k, probes, first=True))
        best = self._kth(near, k)
        bound = asked.join(best, asked["_q"] == best["q"], "left").select("_q", "_v", F.coalesce("t", F.lit(float("-inf"))).alias("_t"))
        with _small_batches(self.spark):
            far = keep("second", self._compared(bound, stats, k, probes, first=False))
        both = near.unionByName(far)
        last = self._kth(both, k)
        return both.join(last, "q", "left").where(F.col("high") >= F.coalesce("t", F.lit(float("-inf")))).drop("t")

    @staticmethod
    def _kth(found: DataFrame, k: int) -> DataFrame:
        """(q, t): the k-th best of what scores are at least, for queries with k rows or more."""
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("low")))
        ranked = found.select("q", "low").withColumn("_n", rank).where(F.col("_n") <= k)
        return ranked.where(F.col("_n") == k).select("q", F.col("low").alias("t"))

    def _compared(self, asked: DataFrame, stats: DataFrame, k: int, probes: int | None, first: bool) -> DataFrame:
        """CANDIDATES from the cells that give the first k-th best, or from all others that may reach _t."""
        cells = self._cells()
        known = {r["cell"]: (r["n"], r["radius"]) for r in stats.collect()}
        sizes = np.array([known.get(int(c), (0, 0.0))[0] for c in cells.cell])
        radius = np.array([known.get(int(c), (0, 0.0))[1] for c in cells.cell])
        sent = self.spark.sparkContext.broadcast((cells, sizes, radius))
        shape = "top int, cell int, ids array<long>, vectors binary, bases array<double>, bounds array<double>"
        arrow = to_arrow_schema(StructType.fromDDL(shape))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """One row a cell and slice of queries that look into it."""
            cells, sizes, radius = sent.value
            slice_of = max(1, min(SLICE, PRODUCT // len(cells.cell)))
            for b in batches:
                for part in _parts(b, slice_of):
                    ids, x, t = part.column(0).to_numpy(), _unit_rows(part.column(1)), part.column(2).to_numpy()
                    base = x @ cells.centre.T
                    order = np.argsort(-base, axis=1, kind="stable")
                    reached = np.cumsum(sizes[order], axis=1) - sizes[order]
                    number = np.arange(order.shape[1])
                    opening = (number < FIRST) | (reached < k)
                    if probes is not None:
                        opening &= number < probes
                    wanted = opening if first else ~opening & ((number < probes) if probes is not None else True)
                    look = np.zeros(base.shape, bool)
                    np.put_along_axis(look, order, wanted, axis=1)
                    look &= (sizes > 0) & (base + radius + SLACK >= t[:, None])
                    rows, size = [], 0
                    for c in np.flatnonzero(look.any(axis=0)):
                        q = np.flatnonzero(look[:, c])
                        rows.append({"top": int(cells.top[c]), "cell": int(cells.cell[c]), "ids": ids[q].tolist(), "vectors": x[q].tobytes(), "bases": base[q, c].tolist(), "bounds": t[q].tolist()})
                        size += len(rows[-1]["vectors"])
                        if size >= GIVEN_ON:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, size = [], 0
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

        found = to_arrow_schema(StructType.fromDDL(CANDIDATES))

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in (one.to_pylist()[0] for one in _parts(b, 1)):
                    ids, n = np.array(r["ids"]), len(r["codes"])
                    x = np.frombuffer(r["vectors"], np.float64).reshape(len(ids), -1)
                    code = np.frombuffer(b"".join(r["codes"]), np.uint8).reshape(n, -1).astype(np.float64) - 128
                    score = np.array(r["bases"])[:, None] + x @ (code * np.array(r["scales"])[:, None]).T
                    reach = np.array(r["errors"])[None, :] + SLACK
                    low, high = score - reach, score + reach
                    least = np.array(r["bounds"])
                    if n > k:
                        least = np.maximum(least, np.partition(low, n - k, axis=1)[:, n - k])
                    q, pos = np.nonzero(high >= least[:, None])
                    same = [np.full(len(q), r[c]) for c in ("batch", "top", "cell", "block")]
                    columns = [ids[q], *same, pos, low[q, pos], high[q, pos]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, found, strict=True)], schema=found)

        met = asked.select("_q", "_v", "_t").mapInArrow(route, shape).join(self._read("blocks"), ["top", "cell"])
        names = ["ids", "vectors", "bases", "bounds", "batch", "top", "cell", "block", "codes", "scales", "errors"]
        return met.select(*names).mapInArrow(compare, CANDIDATES)
