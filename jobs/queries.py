"""The jobs as queries over the driver's tables: each runs its job twice into a new folder and reads back what stands there."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from flowlens.plans.scratch import shared_dir
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import text_index, trace_conformance


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/flowlens-jobs/{name}-{uuid.uuid4().hex}"


def job1_text_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _folder(spark, "text-index")
    for _ in range(2):
        text_index.run(spark, f"{sf_dir}/documents.parquet", f"{place}/index", f"{place}/checkpoint")
    # the batch depends on how many files the table has
    return text_index.current(spark, f"{place}/index").drop("batch").withColumn("vector", F.array_join(F.col("vector").cast("array<string>"), ","))


def job2_trace_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _folder(spark, "trace-conformance")
    for _ in range(2):
        trace_conformance.run(spark, f"{sf_dir}/conversations.parquet", place)
    return trace_conformance.read(spark, place)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_text_index, job2_trace_conformance)}

ORACLE_SQL: dict[str, str] = {
    "job1_text_index": """
WITH d AS (SELECT doc_id, source, lang, sha256(coalesce(text, '')) AS digest, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
one AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY digest DESC, lang DESC NULLS LAST, source DESC NULLS LAST) = 1),
c AS (SELECT *, unnest(range(0, greatest(len(w), 1), 200)) AS s FROM one),
p AS (SELECT *, regexp_extract_all(lower(array_to_string(w[s + 1 : s + 200], ' ')), '[^\\x20\\x09-\\x0D._]+') AS t FROM c),
b AS (SELECT *, list_transform(t, lambda x: CAST('0x' || substr(md5(x), 1, 8) AS BIGINT) % 16) AS k FROM p)
SELECT doc_id, source, lang, digest, CAST(len(w) AS BIGINT) AS n_words, CAST(s // 200 AS INT) AS chunk, CAST(s AS BIGINT) AS first_word, CAST(len(t) AS BIGINT) AS n_tokens,
       array_to_string(CASE WHEN len(t) = 0 THEN ['1'] || list_transform(range(15), lambda i: '0') ELSE list_transform(range(16), lambda i: CAST(len(list_filter(k, lambda x: x = i)) AS VARCHAR)) END, ',') AS vector
FROM b""",
    "job2_trace_conformance": """
WITH RECURSIVE e(a, b) AS (VALUES ('__start__', 'system'), ('__start__', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user'), ('assistant', '__end__')),
r(a, b, d) AS (SELECT a, b, 1 FROM e UNION SELECT r.a, e.b, r.d + 1 FROM r JOIN e ON e.a = r.b WHERE r.d < 6),
hops AS (SELECT a, b, min(d) AS d FROM r GROUP BY a, b),
t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '<unresolved>') AS node FROM conversations),
w AS (SELECT conv_id, node AS a, lead(node, 1, '__end__') OVER o AS b, row_number() OVER o AS step FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, node)),
s AS (SELECT * FROM w UNION ALL SELECT conv_id, '__start__', a, 0 FROM w WHERE step = 1),
j AS (SELECT s.conv_id, s.step, h.d FROM s LEFT JOIN hops h ON h.a = s.a AND h.b = s.b)
SELECT conv_id, count(*) - 1 AS n_turns, count(*) AS n_steps, count(*) FILTER (WHERE d > 1) AS n_skips, count(*) FILTER (WHERE d IS NULL) AS n_undeclared,
       min(step) FILTER (WHERE d IS NULL OR d > 1) AS first_deviation, CAST(max(d) FILTER (WHERE d > 1) AS INT) AS longest_detour,
       CASE WHEN count(*) FILTER (WHERE d IS NULL) > 0 THEN 'undeclared' WHEN count(*) FILTER (WHERE d > 1) > 0 THEN 'skips' ELSE 'declared' END AS verdict
FROM j GROUP BY conv_id""",
}
