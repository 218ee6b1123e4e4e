"""Nearest vectors by cosine among all rows, for one query or many; `vector_index` has the search of a stored index."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine

FILTERS = frozenset({"repo_id", "graph_id"})


def check(top_k: int, filters: Mapping[str, str], query: Sequence[float], dimension: int | None) -> None:
    if isinstance(top_k, bool) or not isinstance(top_k, int) or top_k < 1:
        raise ValueError("top_k must be >= 1")
    unknown = sorted(set(filters) - FILTERS)
    if unknown:
        raise ValueError(f"Unsupported search filter: {', '.join(unknown)}")
    if dimension is not None and len(query) != dimension:
        raise ValueError(f"the query has dimension {len(query)}, the index {dimension}")


def top_k(rows: DataFrame, query: Sequence[float], k: int, key: str = "chunk_id", vector: str = "vector", filters: Mapping[str, str] | None = None, dimension: int | None = None) -> DataFrame:
    """The `k` rows nearest to `query` with score (cosine), best first, equals in order of `key`; filters hold before the choice."""
    check(k, filters or {}, query, dimension)
    for name, value in (filters or {}).items():
        rows = rows.where(F.col(name) == value)
    given = F.array(*[F.lit(float(x)) for x in query])
    return rows.withColumn("score", cosine(vector, given)).orderBy(F.desc("score"), key).limit(k)


def _block(frames, k: int, names: list[str]):
    """The `k` best of each query within each pair of blocks; a block's vectors are measured as one product."""
    import numpy as np
    import pandas as pd

    for f in frames:
        out = []
        for q_ids, q_rows, ids, rows in zip(f["q_ids"], f["q_rows"], f["ids"], f["rows"], strict=True):
            q, w = (np.array([list(v) for v in x], dtype=float) for x in (q_rows, rows))
            sizes = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(w, axis=1)[None, :]
            scores = np.divide(q @ w.T, sizes, out=np.zeros_like(sizes), where=sizes > 0)
            ids = np.asarray(ids)
            for i, s in zip(q_ids, scores, strict=True):
                best = np.lexsort((ids, -s))[:k]
                out += [(i, ids[b], float(s[b])) for b in best]
        yield pd.DataFrame(out, columns=names)


def batch_top_k(rows: DataFrame, queries: DataFrame, k: int, key: str, vector: str, query_key: str, query_vector: str, size: int = 1024) -> DataFrame:
    """(`query_key`, `key`, score, rank) of the `k` nearest rows to each row of `queries`, a stated set that may grow.

    Every block of about `size` rows meets every block of queries, each pair of blocks gives its `k` best of each
    query, and ranks are made of those. A vector of length 0 scores 0.
    """

    def blocks(df: DataFrame, i: str, v: str, ids: str, vectors: str) -> DataFrame:
        n = max(1, -(-df.count() // size))
        block = F.pmod(F.xxhash64(i), F.lit(n)).alias("_b")
        pairs = df.select(F.struct(F.col(i).alias("i"), F.col(v).alias("v")).alias("_x"), block)
        return pairs.groupBy("_b").agg(F.collect_list("_x").alias("_x")).select(F.col("_x.i").alias(ids), F.col("_x.v").alias(vectors))

    met = blocks(queries, query_key, query_vector, "q_ids", "q_rows").crossJoin(blocks(rows, key, vector, "ids", "rows").repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    kinds = f"`{query_key}` {queries.schema[query_key].dataType.simpleString()}, `{key}` {rows.schema[key].dataType.simpleString()}, score double"
    best = met.mapInPandas(lambda frames: _block(frames, k, [query_key, key, "score"]), kinds)
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)
