"""Quality rules: hard limits, then robust multivariate outliers per language and source.

Each text gives a vector of transformed statistics. For every language and source a minimum-covariance-determinant
estimate is made: many robust starts are searched on up to SEARCH rows of the group, and from the best of them
concentration steps over all rows keep the nearest half, take its mean and covariance, and measure all rows anew until
the determinant no longer falls. The least determinant wins, and is reweighted once by the rows that agree with it. A
row far from its group's centre by Mahalanobis distance is rejected.
"""

from __future__ import annotations

from collections import Counter
from contextlib import nullcontext
from functools import partial
from itertools import chain, repeat
from math import log, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank, fixed_plans, settle, small_batches

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_distinct", "n_top", "n_marks")
#: Statistics and the least standard deviation that each is given: what clean text may differ by where a group shows none.
FLOORS = {"word_length": 0.05, "symbols": 0.10, "upper": 0.04, "dup_lines": 0.12, "repeats": 0.10, "variety": 0.06, "size": 0.50, "top_word": 0.04, "marks": 0.05}
#: Share of a group that a concentration step keeps, and what its covariance is less than the whole's for a normal law
#: of nine statistics: 0.5 / P(chi-square with 11 < median of that with 9).
KEEP, SHRUNK = 0.5, 1.57
#: Squared distance within which rows are taken to reweight the estimate (chi-square 0.975), and the factor for them.
AGREES, AGREES_SHRUNK = 19.02, 1.04
#: Rows of a group that starts are searched on (all of a smaller group), rows that starts are made from, starts that go
#: on over all rows, and the least fall of the determinant's logarithm that counts as one.
SEARCH, POINTS, BEST, FALL = 2000, 12, 2, 0.01
#: Groups and starts that are sent to all tasks at most, a kilobyte each; of more, joins are left to Spark.
FEW = 2000
#: Rows' worth of weight that the language's estimate has within each of its sources'.
PRIOR = 40.0
#: Squared distance beyond which a row is rejected. The chi-square law for nine statistics puts 1 row of 10^15 beyond
#: 95; counts of short clean texts have heavier tails than a normal law, hence twice that.
REACH = 200.0

_SPACE = str.maketrans("", "", " \t\n\x0b\x0c\r")
_SYMBOL, _MARK, _SPACE_BYTES, _WINDOW = b"#*$%&|<>", b"!?", b" \t\n\x0b\x0c\r", 3


def text_counts(text: str) -> tuple[int, ...]:
    """COUNTS of one text, in that order."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    lines, dups, seen = 0, 0, set()
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dups += 1
            else:
                seen.add(line)
    repeated = 0
    if n > _WINDOW:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        found = Counter(windows)
        if len(found) < len(windows):
            reach = 0
            for i, w in enumerate(windows):
                if found[w] > 1:
                    repeated += i + _WINDOW - max(reach, i)
                    reach = i + _WINDOW
    distinct = Counter(words)
    plain = raw.translate(None, _SPACE_BYTES)
    codepoints = len(text.translate(_SPACE))
    upper = sum(c.isupper() for c in text)
    return n, codepoints, len(raw) - len(raw.translate(None, _SYMBOL)), dups, repeated, lines, upper, len(distinct), max(distinct.values(), default=0), len(plain) - len(plain.translate(None, _MARK))


def statistics(c: tuple[int, ...]) -> tuple[float, ...]:
    """FLOORS' statistics from a text's counts; all 0 for a text without words."""
    n, chars, symbols, dups, repeated, lines, upper, distinct, top, marks = c
    if not n:
        return (0.0,) * len(FLOORS)
    return log(chars / n), log(1 + 100 * symbols / chars), sqrt(upper / chars), sqrt(dups / lines), sqrt(repeated / n), log(distinct / n), log(n), sqrt(top / n), sqrt(marks / n)


def _measure(batches, schema: pa.Schema):
    for batch in batches:
        found = [text_counts(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
        columns = [batch.column(i) for i in range(batch.num_columns - 1)]
        columns += [pa.array(c, type=pa.int64()) for c in (zip(*found, strict=True) if found else repeat((), len(COUNTS)))]
        columns += [pa.array(c, type=pa.float64()) for c in (zip(*map(statistics, found), strict=True) if found else repeat((), len(FLOORS)))]
        yield pa.RecordBatch.from_arrays(columns, names=schema.names)


def measure(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """key, _lang, _source, COUNTS and FLOORS' statistics of every row's whole text."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    named = docs.select(F.col(key), F.col(lang).cast("string").alias("_lang"), F.col(source).cast("string").alias("_source"), blank(text).alias("_text"))
    names = [key, "_lang", "_source", *COUNTS, *FLOORS]
    schema = f"`{key}` {kind}, _lang string, _source string, " + ", ".join(chain((f"{c} long" for c in COUNTS), (f"{c} double" for c in FLOORS)))
    return named.mapInArrow(partial(_measure, schema=pa.schema([(n, pa.null()) for n in names])), schema)


def _moments(weight: Column) -> list[Column]:
    names = list(FLOORS)
    ones = [F.sum(weight).alias("w")]
    firsts = [F.sum(weight * F.col(a)).alias(f"s_{i}") for i, a in enumerate(names)]
    return ones + firsts + [F.sum(weight * F.col(a) * F.col(b)).alias(f"s_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]


def _floored(cov: np.ndarray) -> np.ndarray:
    """`cov` with a variance of 1 at least in every direction, in units of FLOORS: a few far rows on one line make it no smaller."""
    floors = np.array(list(FLOORS.values()))
    values, axes = np.linalg.eigh(cov / np.outer(floors, floors))
    return (axes * np.maximum(values, 1.0)) @ axes.T * np.outer(floors, floors)


def concentrate(x: np.ndarray, distance: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """ln determinant, centre and covariance of the half of `x` that steps from these distances end with."""
    half, least = min(len(x), (len(x) + len(FLOORS) + 1) // 2), np.inf
    while True:
        part = x[np.argsort(distance, kind="stable")[:half]]
        centre, cov = part.mean(axis=0), _floored(SHRUNK * np.cov(part, rowvar=False, bias=True))
        det = np.linalg.slogdet(cov)[1]
        if det > least - 1e-6:
            return found
        least, found = det, (det, centre, cov)
        off = x - centre
        distance = np.einsum("ij,ij->i", off @ np.linalg.inv(cov), off)


def starts(x: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """The BEST different ends of steps on `x`, least determinant first, from its medians and from rows of it."""
    x = x[np.lexsort(x.T)]
    floors, middle = np.array(list(FLOORS.values())), np.median(x, axis=0)
    spread = np.maximum(1.4826 * np.median(np.abs(x - middle), axis=0), floors)
    rows = x[np.unique(np.linspace(0, len(x) - 1, POINTS + 2).round().astype(int)[1:-1])]
    found = sorted((concentrate(x, (((x - c) / s) ** 2).sum(axis=1)) for c, s in ((middle, spread), *((r, s) for r in rows for s in (spread, floors)))), key=lambda e: e[0])
    best = found[:1]
    for e in found[1:]:
        if len(best) < BEST and e[0] > best[-1][0] + 1e-3:
            best.append(e)
    return best


def _search(rows: pa.Table) -> pa.Table:
    x = np.column_stack([rows.column(n).to_numpy() for n in FLOORS])
    best = starts(x)
    take = lambda c: pa.array([rows.column(c)[0].as_py()] * len(best), type=pa.string())
    lists = pa.list_(pa.float64())
    return pa.table({"_lang": take("_lang"), "_source": take("_source"), "start": pa.array(range(len(best)), type=pa.int32()), "centre": pa.array([c.tolist() for _, c, _ in best], type=lists), "inverse": pa.array([np.linalg.inv(v).ravel().tolist() for *_, v in best], type=lists), "det": pa.array([np.inf] * len(best), type=pa.float64())})


def _estimates(frames, scale: float):
    """Centre, inverse covariance and ln determinant of each group and start from its sums and its language's."""
    p = len(FLOORS)

    def part(row, pre: str):
        w = max(row[f"{pre}w"] or 0.0, 1e-9)
        mean = np.array([row[f"{pre}s_{i}"] or 0.0 for i in range(p)]) / w
        second = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                second[i, j] = second[j, i] = (row[f"{pre}s_{i}_{j}"] or 0.0) / w
        return w, mean, second - np.outer(mean, mean)

    for frame in frames:
        out = []
        for row in frame.to_dict("records"):
            (w, mean, cov), (_, mean0, cov0) = part(row, ""), part(row, "l_")
            share = w / (w + PRIOR)
            off = mean - mean0
            centre = share * mean + (1 - share) * mean0
            cov = _floored(scale * (share * cov + (1 - share) * cov0 + share * (1 - share) * np.outer(off, off)))
            out.append((row["_lang"], row["_source"], row["start"], centre.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])))
        yield pd.DataFrame(out, columns=["_lang", "_source", "start", "centre", "inverse", "det"])


_GROUP = ["_lang", "_source", "start"]
_FITTED = "_lang string, _source string, start int, centre array<double>, inverse array<double>, det double"


def _fit(rows: DataFrame, weight: Column, scale: float, few: bool) -> DataFrame:
    """Estimates of each group and start; a language's sums are those of its groups' first starts. `few` groups are broadcast, and estimated by one task."""
    sums = rows.groupBy(*_GROUP).agg(*_moments(weight))
    names = [c for c in sums.columns if c not in _GROUP]
    langs = sums.where("start = 0").groupBy("_lang").agg(*[F.sum(c).alias(f"l_{c}") for c in names]).withColumnRenamed("_lang", "_l")
    both = sums.join(F.broadcast(langs) if few else langs, F.col("_lang").eqNullSafe(F.col("_l"))).drop("_l")
    both = both.repartition(1) if few else both
    return both.mapInPandas(partial(_estimates, scale=scale), _FITTED)


def _same(columns: dict[str, str]) -> Column:
    same = None
    for a, b in columns.items():
        one = F.col(a).eqNullSafe(F.col(b))
        same = one if same is None else same & one
    return same


def _near(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    f = fitted.withColumnsRenamed({"_lang": "_l", "_source": "_s"})
    return rows.join(f, _same({"_lang": "_l", "_source": "_s"})).withColumn("distance", mahalanobis()).drop("_l", "_s", "centre", "inverse", "det")


def mahalanobis() -> Column:
    names = list(FLOORS)
    off = [F.col(n) - F.get("centre", F.lit(i)) for i, n in enumerate(names)]
    terms = [(1 if i == j else 2) * F.get("inverse", F.lit(i * len(names) + j)) * off[i] * off[j] for i in range(len(names)) for j in range(i, len(names))]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def judge(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", source: str = "source", min_words: int = 50, reach: float = REACH) -> DataFrame:
    """One row per row of `docs`: `key`, COUNTS (long), base_failed, distance (double), kept.

    base_failed: fewer than `min_words` words, or over half of them in repeated three-word windows. Estimates are made
    over all rows that pass, per language and source (null: a group of its own); a small group leans on its language.
    distance is null for a row that fails, kept is false for it. A null or empty text has no words. Repeated rows are
    measured and returned each. An empty table gives no rows.
    """
    measured = settle(measure(docs, text, key, lang, source).withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))), "statistics")
    rows = measured.where(~F.col("base_failed"))
    names, group = list(FLOORS), ["_lang", "_source"]
    sizes = rows.groupBy(*group).agg(F.count("*").alias("_n")).withColumnsRenamed({"_lang": "_l", "_source": "_s"})
    # by a hash that tells repeated rows apart, so that a group of copies is thinned as any other
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.monotonically_increasing_id()), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.select(*group, *names, draw.alias("_draw")).join(sizes, _same({"_lang": "_l", "_source": "_s"})).where(F.col("_draw") * F.col("_n") < SEARCH)
    fitted = settle(drawn.select(*group, *names).groupBy(*group).applyInArrow(_search, _FITTED).withColumn("moved", F.lit(True)), "starts")
    # where both sides are known beforehand, there is nothing to plan anew after each exchange
    few = fitted.count() <= FEW
    small = F.broadcast if few else (lambda df: df)
    with fixed_plans(docs.sparkSession) if few else nullcontext():
        step = 0
        while fitted.where("moved").head(1):
            near = _near(rows, small(fitted.drop("moved")))
            limits = near.groupBy(*_GROUP).agg(F.percentile_approx("distance", KEEP, 1000).alias("_most")).withColumnsRenamed({"_lang": "_l2", "_source": "_s2", "start": "_t2"})
            inner = near.join(small(limits), _same({"_lang": "_l2", "_source": "_s2", "start": "_t2"})).drop("_l2", "_s2", "_t2")
            new = _fit(inner, (F.col("distance") <= F.col("_most")).cast("double"), SHRUNK, few)
            old = fitted.withColumnsRenamed({"_lang": "_l", "_source": "_s", "start": "_t"}).select("_l", "_s", "_t", F.struct("centre", "inverse", "det").alias("_old"), F.col("moved").alias("_moved"))
            falls = F.col("_moved") & (F.col("det") < F.col("_old.det") - FALL)
            both = new.join(small(old), _same({"_lang": "_l", "_source": "_s", "start": "_t"})).withColumn("moved", falls)
            fitted = settle(both.select(*_GROUP, *[F.when(F.col("moved"), F.col(c)).otherwise(F.col(f"_old.{c}")).alias(c) for c in ("centre", "inverse", "det")], "moved"), f"estimate{step}")
            step += 1
        least = fitted.groupBy(*group).agg(F.min_by(F.struct("centre", "inverse", "det"), F.struct("det", "start")).alias("_best")).select(*group, F.lit(0).alias("start"), "_best.*")
        agreeing = _near(rows, small(settle(least, "least")))
        fitted = settle(_fit(agreeing, (F.col("distance") <= AGREES).cast("double"), AGREES_SHRUNK, few), "estimate")
    verdict = _near(rows, small(fitted)).select(*measured.columns, "distance")
    failed = measured.where("base_failed").withColumn("distance", F.lit(None).cast("double"))
    return verdict.unionByName(failed).select(key, *COUNTS, "base_failed", "distance", (~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= reach)).alias("kept"))
