"""The subpackage's queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw, html_text, leaks, mixing, naming, neardup, packing, planes, quality, runs, secrets, toxicity
from .common import WORD, blank, scratch, table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"))


def op2_id_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "ids")
    planes.write_ids(table(spark, sf_dir, "documents"), folder, _vocabulary("word_bpe_49k.json"), end_id=2)
    return planes.read_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), end_id=1, window=2048)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.digest(table(spark, sf_dir, "documents"))


def op7_class_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op8_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(table(spark, sf_dir, "documents"), size=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def op9_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op10_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def _with_periods(docs: DataFrame) -> DataFrame:
    """The contract's texts: one in ten by hash of its doc_id repeats a stretch of its words to its end."""
    words = F.regexp_extract_all(blank("text"), F.lit(WORD), 0)
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    n, g = F.size("_w"), F.col("_g")
    a = F.pmod(g, n)
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    repeated = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at("_w", (F.when(i < a, i).otherwise(a + F.pmod(i - a, p)) + 1).cast("int")))
    chosen = docs.select("doc_id", "text", F.floor(h / 10).alias("_g"), F.when(h % 10 == 0, words).alias("_w"))
    return chosen.select("doc_id", F.when(F.size("_w") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find(_with_periods(table(spark, sf_dir, "documents")))
    # the exact order of length / period, by cross multiplication
    ratio = lambda a, b: b["length"] * a["period"] - a["length"] * b["period"]
    first = lambda a, b: F.when(ratio(a, b) != 0, ratio(a, b)).when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["period"] - b["period"])
    best = F.try_element_at(F.array_sort("runs", lambda a, b: F.signum(first(a, b)).cast("int")), F.lit(1))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    shown = found.withColumn("_b", best).select("doc_id", F.size("runs").cast("long").alias("n_runs"), "_b.start", "_b.length", "_b.period", "runs", "collapsed")
    exponent = F.floor(F.lit(1000) * F.col("length") / F.col("period"))
    return shown.select("doc_id", "n_runs", "start", "length", "period", exponent.alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_aho_corasick_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_context_tree_weighting,
        op2_id_planes,
        op3_tree_scoring,
        op4_sum_of_squares_packing,
        op5_source_mixing,
        op6_block_naming,
        op7_class_kneser_ney,
        op8_tensored_minhash,
        op9_robust_outliers,
        op10_secret_forest,
        op11_periodic_runs,
        op12_aho_corasick_leaks,
    )
}

ORACLE_SQL: dict[str, str] = {
    # every pair of equal words of a document, by their distance; the reduced lists are crc32 of the id's digits
    "op11_periodic_runs": """
WITH told AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)),
                         lambda c, d: list_reduce([xor(c, d), 1, 1, 1, 1, 1, 1, 1, 1], lambda r, one: xor(r >> 1, 3988292384 * (r & one)))), 4294967295) AS h
  FROM documents),
planted AS (SELECT *, h // 10 AS g, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM told),
texts AS (
  SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i + 1 ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1 END]) ELSE w END AS w FROM planted),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM texts),
same AS (SELECT l.doc_id, r.i - l.i AS q, l.i FROM words l JOIN words r ON l.doc_id = r.doc_id AND l.x = r.x AND l.i < r.i),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same),
stretches AS (SELECT doc_id, min(i) AS start, count(*) + q AS length, q FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
found AS (SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) AS o FROM found),
lines AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s FROM found GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM found),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS s FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
       sha256(coalesce(lines.s, '')) AS runs_sha256, sha256(coalesce(kept.s, '')) AS collapsed_sha256
FROM texts t LEFT JOIN lines USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT * FROM best WHERE o = 1) USING (doc_id)""",
    "op12_aho_corasick_leaks": """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
starts AS (SELECT item, w, least(10, len(w)) AS k, unnest(range(greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, k, array_to_string(w[i + 1 : i + k], ' ') AS s FROM starts),
sizes AS (SELECT DISTINCT k FROM windows),
places AS (SELECT doc_id, w, k, unnest(range(len(w) - k + 1)) AS i FROM d, sizes WHERE len(w) >= k),
hits AS (SELECT doc_id, i, p.k, item FROM places p JOIN windows v ON v.k = p.k AND v.s = array_to_string(w[i + 1 : i + p.k], ' ')),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op6_block_naming": """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents""",
    "op5_source_mixing": """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS k FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS w,
                   row_number() OVER (ORDER BY source NULLS LAST) AS r FROM sums),
ranked AS (SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / w, r) AS o FROM weighed),
levels AS (SELECT *, CAST(CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS DOUBLE)
                     / CAST(sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS level FROM ranked),
found AS (SELECT arg_min(level, o) AS level FROM levels WHERE level * w <= cap),
goals AS (SELECT source, source_size, CASE WHEN found.level * w <= cap THEN found.level * w ELSE CAST(cap AS DOUBLE) END AS target FROM ranked, found),
placed AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes,
         CAST(coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sized JOIN goals ON sized.source IS NOT DISTINCT FROM goals.source)
SELECT doc_id, size, source_size, target,
       CAST((passes + CASE WHEN CAST(2 * before + size AS DOUBLE) < 2 * (target - passes * source_size) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM placed""",
}
