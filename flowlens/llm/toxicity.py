"""Toxicity by class-conditional Kneser-Ney models.

Each class has an interpolated Kneser-Ney model of its words. A word counts as often as different words stand before
it in the class's texts (the continuation count), so that copies add nothing. A discount is taken from each count, and
what it sets free goes to the class's model of the beginnings of words, counted in the same way; what that sets free
goes to counts that both classes share. So an expression that is rare in both classes is as likely in one as in the
other, and one that a class holds often tells how much likelier it is there.

Most words of a toxic text are ordinary ones: its model takes SHARE of the words from the toxic class's estimate and the
others from the ordinary one. Where it is the ordinary texts that have words of their own, that difference says little:
it falls by SHARE a word at most. So the ordinary model that takes SHARE from the ordinary class's estimate and the
others from the toxic one is held against the toxic one as well. Both differences, divided by the text's length, give a
probability by a logistic curve that never falls in the first nor rises in the second. It is fitted on the labelled
texts themselves, each compared by counts of the texts of other folds.
"""

from __future__ import annotations

from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank, settle, small_batches

#: Characters of the beginnings that words back off to, and the discount.
BEGINNING, DISCOUNT = 6, 1.0
#: Share of a toxic text's words that are taken to come from the toxic class's own estimate.
SHARE = 0.01
#: Labelled texts of each class that the models are fitted on, at most: those least by MD5 digest of their key.
SAMPLE = 4000
#: Folds of them for the curve.
FOLDS = 4
#: Pairs of expressions that a task holds before it gives them on, some 300 bytes each.
HELD = 250_000

_EDGES = ".,;:!?|\"'()[]{}<>*$%&#"
_KEPT = 300_000
_workers: dict[str, Ratios] = {}
WORD, START = 0, 1


def words(text: str) -> list[str]:
    """Lower-case words without marks around them; a word of marks alone is empty."""
    return [w.strip(_EDGES) for w in text.lower().split()]


def _pairs(batches):
    """Distinct (level, word before, expression) of some texts, and the folds of the texts of either class that hold them as bits.

    Before a text stands a line feed.
    """
    found: dict[tuple[int, str, str], int] = {}
    every = (1 << FOLDS) - 1

    def out():
        rows = iter(found.items())
        while part := list(islice(rows, 20_000)):
            columns = zip(*((*k, v & every, v >> FOLDS) for k, v in part), strict=True)
            types = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["level", "before", "expression", "toxic", "ordinary"])

    for batch in batches:
        for text, y, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            now, bit = words(text), 1 << (fold if y else fold + FOLDS)
            for before, w in zip(["\n", *now], now, strict=False):
                for x in ((WORD, before, w), (START, before, w[:BEGINNING])):
                    found[x] = found.get(x, 0) | bit
            if len(found) > HELD:
                yield from out()
                found.clear()
    yield from out()


class Kneser:
    """Both classes' models from continuation counts: {expression: (toxic, ordinary, both)} by level, sums by level.

    `counts` may lack expressions whose counts the discount takes whole in either class, but for `both` of beginnings.
    sums: for each class and level (all counts, what the discount frees), then for beginnings all counts of both
    classes together and the number of different ones.
    """

    def __init__(self, counts: list[dict[str, tuple]], sums: list[list[tuple[float, float]]], total: float, distinct: float, discount: float = DISCOUNT):
        self.counts, self.sums, self.total, self.distinct, self.discount = counts, sums, total, distinct, discount

    def _level(self, level: int, c: int, x: str, lower: float) -> float:
        every, free = self.sums[c][level]
        return (max(self.counts[level].get(x, (0, 0, 0))[c] - self.discount, 0.0) + free * lower) / every

    def start(self, c: int, x: str) -> float:
        """Probability of a word's beginning in class `c` (0 toxic, 1 ordinary)."""
        return self._level(START, c, x, (self.counts[START].get(x, (0, 0, 0))[2] + 1) / (self.total + self.distinct + 1))

    def ratio(self, word: str) -> float:
        """How much likelier a word is in the toxic class's estimate.

        The shared probability of a word after its beginning multiplies both sides' back-off. Where neither class holds
        the word beyond the discount it falls out; else it is taken from the shared counts.
        """
        start = word[:BEGINNING]
        after = (self.counts[WORD].get(word, (0, 0, 0))[2] + 1) / (self.counts[START].get(start, (0, 0, 0))[2] + 1)
        toxic, ordinary = (self._level(WORD, c, word, self.start(c, start) * min(1.0, after)) for c in (0, 1))
        return toxic / ordinary


class Ratios:
    """Sums over a text's words of each class's mixed log-likelihood less the other class's."""

    def __init__(self, model: Kneser, share: float = SHARE):
        self.model, self.share = model, share
        self.place: dict[str, int] = {}
        self.toxic, self.ordinary = np.zeros(_KEPT + 1), np.zeros(_KEPT + 1)

    def _add(self, word: str) -> None:
        at, ratio = len(self.place), self.model.ratio(word.strip(_EDGES))
        self.toxic[at], self.ordinary[at] = np.log1p(self.share * (ratio - 1)), np.log1p(self.share * (1 / ratio - 1))
        self.place[word] = at

    def text(self, text: str) -> tuple[float, float, int]:
        """The toxic model's difference, the ordinary one's, and the number of words."""
        found, toxic, ordinary = text.lower().split(), 0.0, 0.0
        for at in range(0, len(found), _KEPT // 2):
            part = found[at : at + _KEPT // 2]
            new = set(part).difference(self.place)
            if len(self.place) + len(new) > _KEPT:
                self.place, new = {}, set(part)
            for w in new:
                self._add(w)
            places = np.fromiter(map(self.place.__getitem__, part), dtype=np.int64, count=len(part))
            toxic, ordinary = toxic + self.toxic[places].sum(), ordinary + self.ordinary[places].sum()
        return toxic, ordinary, len(found)


def _score(batches, shared, name: str):
    if name not in _workers:
        _workers.clear()
        _workers[name] = Ratios(shared.value)
    ratios = _workers[name]
    for batch in batches:
        columns = [batch.column(i) for i in range(batch.num_columns - 1)]
        sums = [ratios.text(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
        made = [pa.array([s[i] / max(1, s[2]) for s in sums], pa.float64()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*columns, *made, pa.array([s[2] for s in sums], pa.int64())], names=[*batch.schema.names[:-1], *NAMES])


NAMES = ["ratio", "counter", "n_words"]
_MADE = "ratio double, counter double, n_words long"


def _features(ratio, counter, n, lib=np):
    """Both differences of log-likelihoods per word, on two scales each and rising with toxicity, and the text's length."""
    if lib is np:
        root = lambda x: np.sqrt(np.maximum(x, 0.0))
        return [300 * ratio, 20 * root(ratio), -300 * counter, -20 * root(counter), np.log(np.maximum(n, 1.0)) - 5.0]
    root = lambda x: F.sqrt(F.greatest(x, F.lit(0.0)))
    return [300 * ratio, 20 * root(ratio), -300 * counter, -20 * root(counter), F.log(F.greatest(n, F.lit(1.0))) - 5.0]


#: Features that a score never falls in: all but the length.
RISING = 4


def fit_curve(ratio: np.ndarray, counter: np.ndarray, n: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic weights (constant first), none of RISING's negative: the most negative one is left out until there is none."""
    x = np.column_stack([np.ones(len(toxic)), *(np.clip(f, -50, 50) for f in _features(ratio, counter, n))])
    used = list(range(x.shape[1]))
    while True:
        w = np.zeros(x.shape[1])
        w[used] = _newton(x[:, used], toxic, weight)
        least = 1 + int(w[1 : RISING + 1].argmin())
        if w[least] >= 0:
            return w
        used.remove(least)


def _newton(x: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton's method with a ridge."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [0.05] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (toxic - p)) - ridge @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(key: str = "doc_id", folds: int = 4, held: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds)) == held, F.lit(True))


def _counts(pairs: DataFrame) -> DataFrame:
    """(level, expression) with continuation counts of either class and of both together: `toxic_k` without the texts of fold k, or of all for k = FOLDS."""
    held = []
    for k in range(FOLDS + 1):
        without = lambda c, k=k: c.bitwiseAND(F.lit((1 << FOLDS) - 1 & ~(1 << k))) != 0
        toxic, ordinary = without(F.col("toxic")), without(F.col("ordinary"))
        held += [F.sum(x.cast("long")).alias(f"{n}_{k}") for n, x in (("toxic", toxic), ("ordinary", ordinary), ("both", toxic | ordinary))]
    return pairs.groupBy("level", "expression").agg(*held)


def _fit(counted: DataFrame, fold: int = FOLDS) -> Kneser | None:
    """The models without the texts of `fold`, None where a class has none left."""
    rows = counted.select("level", "expression", *[F.col(f"{n}_{fold}").alias(n) for n in ("toxic", "ordinary", "both")])
    free = lambda c: F.sum(F.least(F.col(c).cast("double"), F.lit(DISCOUNT)))
    sums = {r["level"]: r for r in rows.groupBy("level").agg(F.sum("toxic").alias("all0"), F.sum("ordinary").alias("all1"), free("toxic").alias("free0"), free("ordinary").alias("free1"), F.sum("both").alias("both"), F.count_if(F.col("both") > 0).alias("distinct")).collect()}
    if not sums or not sums[WORD]["all0"] or not sums[WORD]["all1"]:
        return None
    # of a bounded sample's expressions; others than these are equally likely in both classes
    kept = rows.where((F.greatest("toxic", "ordinary") > DISCOUNT) | (F.col("level") == START) & (F.col("both") > DISCOUNT)).toArrow()
    counts: list[dict[str, tuple]] = [{}, {}]
    for level, x, *n in zip(*(kept.column(c).to_pylist() for c in ("level", "expression", "toxic", "ordinary", "both")), strict=True):
        counts[level][x] = tuple(n)
    return Kneser(counts, [[(float(sums[k][f"all{c}"]), float(sums[k][f"free{c}"])) for k in (WORD, START)] for c in (0, 1)], float(sums[START]["both"]), float(sums[START]["distinct"]))


def score(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", threshold: float = 0.3, sample: int = SAMPLE, folds: int = 4, held: int = 2) -> DataFrame:
    """One row per row of `docs`: `key`, held_out, score (0 to 1), predicted (1 from `threshold`), ratio, counter and n_words.

    `labels` has `key` and `label`; rows that held_out() is true for are not learnt from, nor are null labels; of
    several labels of a key the largest holds. At most `sample` texts of either class are learnt from, equal ones once.
    ratio is the toxic model's log-likelihood less the ordinary one's, per word, counter the other way round. Null and empty texts have no words
    and get the curve's value for none. Where labels or their texts lack a class every score is the share of toxic
    labels. Every row of `docs` is scored over its whole text, repeated rows and those without key each; an empty table
    gives none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[key].dataType.simpleString()
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key, folds, held)).groupBy(key).agg(F.max(label).cast("int").alias("_y"))
    sizes = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.md5(F.col(key).cast("string").cast("binary"))
    chosen = [tuple(r) for y in (0, 1) for r in known.where(F.col("_y") == y).orderBy(order, key).limit(sample).select(key, "_y").collect()]
    base = docs.select(F.col(key).alias("_doc"), held_out(key, folds, held).alias("_held"), blank(text).alias("_text"))
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    names = [F.col("_doc").alias(key), F.col("_held").alias("held_out")]

    def constant() -> DataFrame:
        return base.select(*names, F.lit(float(share)).alias("score"), F.lit(int(share >= threshold)).alias("predicted"), F.lit(0.0).alias("ratio"), F.lit(0.0).alias("counter"), F.lit(0).cast("long").alias("n_words"))

    if not 0 < share < 1:
        return constant()
    # 2 * sample rows: a bounded broadcast
    picked = F.broadcast(spark.createDataFrame(chosen, f"_doc {kind}, _y int"))
    digest = F.sha2(F.col("_text").cast("binary"), 256).alias("_h")
    once = base.join(picked, "_doc").groupBy(digest, "_y").agg(F.first("_text").alias("_text"), F.count(F.lit(1)).cast("double").alias("_times"))
    # equal texts are in one fold
    once = settle(once.select("_text", "_y", F.pmod(F.crc32(F.col("_h").cast("binary")), F.lit(FOLDS)).cast("int").alias("_fold"), "_times"), "taught")
    pairs = once.select("_text", "_y", "_fold").mapInArrow(_pairs, "level int, before string, expression string, toxic int, ordinary int")
    pairs = pairs.groupBy("level", "before", "expression").agg(F.bit_or("toxic").alias("toxic"), F.bit_or("ordinary").alias("ordinary"))
    counted = settle(_counts(pairs), "expressions")
    models = [_fit(counted, k) for k in range(FOLDS + 1)]
    if models[FOLDS] is None:
        return constant()

    def work(model: Kneser):
        shared = spark.sparkContext.broadcast(model)
        return partial(_score, shared=shared, name=f"{spark.sparkContext.applicationId}-{shared._jbroadcast.id()}")

    # a bounded sample's rows
    parts = [once.where(F.col("_fold") == k).select("_y", "_times", "_text").mapInArrow(work(m), f"_y int, _times double, {_MADE}").toArrow() for k, m in enumerate(models[:FOLDS]) if m is not None]
    curve = [np.concatenate([p.column(c).to_numpy().astype(float) for p in parts] or [np.zeros(0)]) for c in ("_y", "_times", *NAMES)]
    y, times, ratio, counter, n = curve
    each = {c: sizes[c] / max(1.0, times[y == c].sum()) for c in (0, 1)}
    weight = times * np.where(y == 1, each[1], each[0]) * len(y) / sum(sizes.values())
    w = fit_curve(ratio, counter, n, y, weight)
    work = work(models[FOLDS])
    scored = base.mapInArrow(work, f"_doc {kind}, _held boolean, {_MADE}")
    line = F.lit(float(w[0]))
    for x, weight in zip(_features(F.col("ratio"), F.col("counter"), F.col("n_words").cast("double"), F), w[1:], strict=True):
        line = line + F.greatest(F.lit(-50.0), F.least(F.lit(50.0), x)) * float(weight)
    return scored.withColumn("score", 1 / (1 + F.exp(-line))).select(*names, "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *NAMES)
