"""LM scoring by context-tree weighting over bytes.

Each byte is eight binary decisions; every decision has a context tree over the bytes before it. Counts of all
(context, byte) grams are gathered over the corpus, and every node of every tree gets its Krichevsky-Trofimov estimate
and the weight that its own estimate has against its children's. A byte's probability mixes the estimates of all
depths along its context. Code length per byte is its negative base-2 logarithm.

Nothing is dropped: trees are built in partitions of the three latest bytes, where each gram that any text holds, learnt
from or not, gets its probability below the two latest bytes. The nodes above (65,536 contexts of 255 decisions at
most) are summed over all partitions and mixed in at the end. The most frequent grams' logarithms are sent to all
executors, as many as BROADCAST; texts are joined with those of the others, gram by gram.
"""

from __future__ import annotations

from functools import partial
from itertools import batched, pairwise
from math import log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytegrams import Lookup, log_gamma, merge, slices
from .common import blank, settle, small_batches, width

#: Bytes of context, and those whose nodes are summed over all partitions.
DEPTH, TOP = 6, 2
#: Grams whose logarithms are sent to all executors, at most (16 bytes each).
BROADCAST = 1 << 22
#: Words on more than one of this many tokens have their counts sent to all executors: that many words at most.
FREQUENT = 1 << 21

END = b"\n"
#: Rows of the three kinds that are joined: grams, words, and texts themselves, which meet nothing.
GRAM, WORD, TEXT = 0, 1, 2
_FLUSH, _BODY = 3_000_000, 2_000_000
_STEPS = 64  # classes of counts in a power of two
_models: dict[str, tuple] = {}


def body(text: str) -> bytes:
    """Words between white space, A-Z in lower case, with a space between two."""
    return b" ".join(text.encode().lower().split())


def _runs(texts: list[str], most: int = _BODY):
    """Bodies of texts, a bounded number of bytes at a time or one text."""
    held, size = [], 0
    for t in texts:
        held.append(body(t))
        size += len(held[-1])
        if size > most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _vocabulary(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the different words, END first; the place there of each token of the bodies, one END behind each; tokens of each body."""
    import xxhash

    s = np.frombuffer(END.join([*bodies, b""]), dtype=np.uint8)
    stop = (s == END[0]) | (s == 0x20)
    at = np.flatnonzero(stop)
    ending, lengths = s[at] == END[0], np.diff(at, prepend=-1) - 1
    ends = np.r_[0, np.cumsum(lengths[lengths > 0])]
    # one array of all words, over the bytes themselves
    words = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(s[~stop])]).dictionary_encode()
    _, cuts, found = words.dictionary.buffers()
    cuts, found = np.frombuffer(cuts, dtype=np.int64)[: len(words.dictionary) + 1].tolist(), found.to_pybytes()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in (END, *(found[a:b] for a, b in pairwise(cuts)))], dtype=np.uint64).view(np.int64)
    # a stop ends a word, but for the END of an empty body; behind a body's last word its END follows
    word = np.ones(np.count_nonzero(lengths > 0) + len(bodies), dtype=bool)
    sizes = np.diff(np.flatnonzero(ending), prepend=-1) - (lengths[ending] == 0) + 1
    word[np.cumsum(sizes) - 1] = False
    place = np.zeros(len(word), dtype=np.int64)
    place[word] = words.indices.to_numpy(zero_copy_only=False) + 1
    return hashes, place, sizes


def _counted(kind: int, learnt: bool, keys: np.ndarray, counts: np.ndarray):
    names = ["kind", "key", "learnt", "met"]
    for at in range(0, len(keys), 50_000):
        n = len(keys[at : at + 50_000])
        met = counts[at : at + n].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, dtype=np.int8)), pa.array(keys[at : at + n].view(np.int64)), pa.array(met if learnt else np.zeros(n, dtype=np.int64)), pa.array(met)], names=names)


class _Sums:
    """Counts by key, summed in parts and given out when they are many."""

    def __init__(self, kind: int, learnt: bool):
        self.kind, self.learnt, self.parts, self.held = kind, learnt, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray):
        self.parts.append((keys, counts))
        self.held += len(keys)
        if self.held > _FLUSH:
            self.parts = [merge(self.parts)]
            self.held = len(self.parts[0][0])
            if self.held > _FLUSH // 2:
                yield from self.out()

    def out(self):
        if self.parts:
            yield from _counted(self.kind, self.learnt, *merge(self.parts))
        self.parts, self.held = [], 0


def _count(batches):
    sides, words = {y: _Sums(GRAM, y) for y in (True, False)}, _Sums(WORD, True)
    for batch in batches:
        for learnt, side in sides.items():
            texts = [t for t, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if held != learnt]
            for bodies in _runs(texts):
                if learnt:
                    hashes, place, _ = _vocabulary(bodies)
                    hashes, order = hashes.view(np.uint64), np.argsort(hashes.view(np.uint64))
                    yield from words.add(hashes[order], np.bincount(place)[order])
                for some in batched(slices(bodies, DEPTH, END[0]), 8):
                    code = np.concatenate(some)
                    code.sort()
                    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
                    yield from side.add(code[starts], np.diff(np.r_[starts, len(code)]))
    for side in (*sides.values(), words):
        yield from side.out()


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of so many zeros and ones."""
    a, b = zeros.astype(float), ones.astype(float)
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - log(np.pi)


def _weighted(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln of a node's weighted probability, and its own estimate's weight, from ln of both parts."""
    mixed = np.logaddexp(own, below) + log(0.5)
    return mixed, np.exp(own + log(0.5) - mixed)


class _Level:
    """The grams of one depth: context and symbol, number learnt, and for each gram of the next depth its place here."""

    def __init__(self, key: np.ndarray, n: np.ndarray):
        self.key, self.n, self.up = key, n, None

    def above(self) -> _Level:
        key = ((self.key >> np.uint64(16)) << np.uint64(8)) | (self.key & np.uint64(255))
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.r_[True, key[1:] != key[:-1]]
        self.up = np.empty(len(key), dtype=np.int64)
        self.up[order] = np.cumsum(first) - 1
        return _Level(key[first], np.bincount(self.up, weights=self.n).astype(np.int64))

    def decide(self, bit: int) -> None:
        """Nodes of one of the eight decisions: first gram of each, node of each gram, counts of zeros and ones."""
        symbol = self.key & np.uint64(255)
        self.node = (self.key & ~np.uint64(255)) | (np.uint64(1) << np.uint64(bit)) | (symbol >> np.uint64(8 - bit))
        first = np.r_[True, self.node[1:] != self.node[:-1]]
        self.starts, self.at = np.flatnonzero(first), np.cumsum(first) - 1
        self.one = ((symbol >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
        self.ones = np.add.reduceat(np.where(self.one, self.n, 0), self.starts)
        self.zeros = np.add.reduceat(self.n, self.starts) - self.ones


def trees(code: np.ndarray, n: np.ndarray, depth: int = DEPTH, top: int = TOP):
    """Trees below depth `top` from sorted grams that share their latest bytes, more than `top`, with no gram elsewhere.

    `n` is how often a gram was learnt, 0 for one that is only met. Gives an array (grams, 8) of the probability of each
    of a byte's decisions as mixed from the nodes below depth `top` (NaN where none was visited), and for the nodes at
    depth `top` rows (node, zeros, ones, ln weighted probability below), which are to be summed over partitions.
    """
    levels = [_Level(code, n)]
    for _ in range(depth - top):
        levels.append(levels[-1].above())
    levels.reverse()
    out, tops = np.empty((len(code), 8)), []
    for bit in range(8):
        for x in levels:
            x.decide(bit)
        parents = [None, *(a.at[b.up[b.starts]] for a, b in zip(levels, levels[1:], strict=False))]
        weights: list = [None] * len(levels)
        mixed = None
        for k in range(len(levels) - 1, 0, -1):
            x = levels[k]
            own = _kt(x.zeros, x.ones)
            if mixed is None:
                mixed, weights[k] = own, np.ones(len(own))
            else:
                mixed, weights[k] = _weighted(own, np.bincount(parents[k + 1], weights=mixed, minlength=len(own)))
        x = levels[0]
        met, below = x.zeros + x.ones > 0, np.bincount(parents[1], weights=mixed, minlength=len(x.starts))
        tops.append(tuple(c[met] for c in (x.node[x.starts], x.zeros, x.ones, below)))
        total, left, last = np.zeros(len(met)), np.ones(len(met)), np.full(len(met), np.nan)
        for x, parent, weight in zip(levels[1:], parents[1:], weights[1:], strict=True):
            p = (x.ones + 0.5) / (x.zeros + x.ones + 1)
            total, left, last = _mix(x.zeros + x.ones > 0, p, weight, total[parent], left[parent], last[parent])
        one = (total + left * last)[x.at]
        out[:, bit] = np.where(x.one, one, 1 - one)
    return out, tuple(np.concatenate(c) for c in zip(*tops, strict=True))


def _mix(seen, p, weight, total, left, last):
    """One node further down: what is mixed so far, the weight that is left, the last estimate. A node not visited changes nothing."""
    return np.where(seen, total + left * weight * p, total), np.where(seen, left * (1 - weight), left), np.where(seen, p, last)


_TREE = "key long, met long, below binary, zeros long, ones long, sum double"


def _trees(batches):
    parts = [tuple(np.asarray(c) for c in b.columns) for b in batches]
    if not sum(len(p[0]) for p in parts):
        return
    code, n, met = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(code, kind="stable")
    code, n, met = code[order], n[order], met[order]
    found, (node, *sums) = trees(code.view(np.uint64), n)
    names = [c.split(" ")[0] for c in _TREE.split(", ")]
    for at in range(0, len(code), 50_000):
        k = len(code[at : at + 50_000])
        ends = np.arange(0, 32 * k + 1, 32, dtype=np.int32)
        p = found[at : at + k]
        # the smaller side of each decision, negative where it is the other symbol's, so that 32 bits are enough near 1
        raw = np.where(p > 0.5, p - 1, p).astype("<f4").tobytes()
        below = pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw)])
        yield pa.RecordBatch.from_arrays([pa.array(code[at : at + k]), pa.array(met[at : at + k]), below, pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64())], names=names)
    for at in range(0, len(node), 50_000):
        k = len(node[at : at + 50_000])
        yield pa.RecordBatch.from_arrays([pa.array(node[at : at + k].view(np.int64)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), *(pa.array(c[at : at + k]) for c in sums)], names=names)


class Top:
    """Estimates and weights of the nodes at depths 0 to 2, from the sums of those at depth 2."""

    def __init__(self, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
        self.levels = []
        for _ in range(TOP + 1):
            order = np.argsort(node, kind="stable")
            node, zeros, ones, below = node[order], zeros[order], ones[order], below[order]
            mixed, weight = _weighted(_kt(zeros, ones), below)
            self.levels.append((node, (ones + 0.5) / (zeros + ones + 1.0), weight))
            up, back = np.unique(((node >> np.uint64(16)) << np.uint64(8)) | (node & np.uint64(255)), return_inverse=True)
            node, (zeros, ones, below) = up, (np.bincount(back, weights=c, minlength=len(up)) for c in (zeros, ones, mixed))
        self.levels.reverse()

    def log2(self, code: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Base-2 logarithm of the probability of each gram's byte, from that of its decisions below depth 2."""
        out, symbol = np.zeros(len(code)), code & np.uint64(255)
        for bit in range(8):
            one = ((symbol >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
            total, left, last = np.zeros(len(code)), np.ones(len(code)), np.full(len(code), 0.5)
            for depth, (node, p, weight) in enumerate(self.levels):
                ctx = code >> np.uint64(8 * (DEPTH + 1 - depth)) if depth else np.zeros(len(code), dtype=np.uint64)
                want = (ctx << np.uint64(8)) | (np.uint64(1) << np.uint64(bit)) | (symbol >> np.uint64(8 - bit))
                at = np.minimum(np.searchsorted(node, want), max(0, len(node) - 1))
                seen = node[at] == want if len(node) else np.zeros(len(code), dtype=bool)
                mine = np.where(one, p[at], 1 - p[at]) if len(node) else np.full(len(code), 0.5)
                total, left, last = _mix(seen, mine, weight[at] if len(node) else 0.0, total, left, last)
            rest = below[:, bit]
            out += np.log2(total + left * np.where(np.isnan(rest), last, rest))
        return out


def _logs(batches, shared):
    for b in batches:
        code = np.asarray(b.column(0)).view(np.uint64)
        below = np.frombuffer(b"".join(b.column(2).to_pylist()), dtype="<f4").reshape(-1, 8).astype(float)
        below = np.where(below < 0, 1 + below, below)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared.value.log2(code, below).astype(np.float32))], names=["key", "met", "log2"])


def _firsts(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, key) and how often each occurs."""
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])]) if len(key) else np.empty(0, dtype=np.int64)
    return owner[first], key[first], np.diff(np.r_[first, len(key)])


def _score(batches, shared, name: str):
    if name not in _models:
        _models.clear()
        lookup, keys, counts, total, distinct = shared.value
        _models[name] = (lookup, keys, np.log10((np.r_[counts, 0] + 1.0) / (total + distinct + 1)))
    lookup, keys, logs = _models[name]
    names = ["row", "kind", "key", "tf", "doc", "n_tokens", "n_known", "base", "bits", "n_bytes"]
    empty = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
    for batch in batches:
        ids, docs, done = batch.column(0).to_pylist(), batch.column(1), 0
        for bodies in _runs(batch.column(2).to_pylist()):
            sizes = np.fromiter(map(len, bodies), dtype=np.int64, count=len(bodies)) + 1
            values, missing, at = np.empty(sizes.sum(), dtype=np.float32), [], 0
            for code in slices(bodies, DEPTH, END[0]):
                found = values[at : at + len(code)] = lookup(code)
                missing.append(code[np.isnan(found)].view(np.int64))
                at += len(code)
            missed = np.isnan(values)
            bits = np.add.reduceat(np.where(missed, 0.0, values.astype(np.float64)), np.r_[0, np.cumsum(sizes)[:-1]])
            hashes, place, lengths = _vocabulary(bodies)
            at = np.minimum(np.searchsorted(keys, hashes), max(0, len(keys) - 1))
            known = keys[at] == hashes if len(keys) else np.zeros(len(hashes), dtype=bool)
            starts = np.r_[0, np.cumsum(lengths)[:-1]]
            base = np.add.reduceat(np.where(known, logs[at], 0.0)[place], starts)
            n_known = np.add.reduceat(known.astype(np.int64)[place], starts)
            new, n = ~known[place], len(bodies)
            rows = np.array(ids[done : done + n], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.full(n, TEXT, dtype=np.int8)), pa.array(rows * 0x5851F42D4C957F2D + 1), pa.array(np.zeros(n, dtype=np.int64)), docs.slice(done, n), pa.array(lengths), pa.array(n_known), pa.array(base), pa.array(bits), pa.array(sizes)], names=names)
            for kind, owners, rare in ((GRAM, np.repeat(rows, sizes)[missed], np.concatenate(missing)), (WORD, np.repeat(rows, lengths)[new], hashes[place[new]])):
                owner, key, tf = _firsts(owners, rare)
                for a in range(0, len(owner), 50_000):
                    k = len(owner[a : a + 50_000])
                    yield pa.RecordBatch.from_arrays([pa.array(owner[a : a + k]), pa.array(np.full(k, kind, dtype=np.int8)), pa.array(key[a : a + k]), pa.array(tf[a : a + k]), pa.nulls(k, docs.type), *(pa.nulls(k, t) for t in empty)], names=names)
            done += n


def _class(met: Column) -> Column:
    """Counts in _STEPS classes a power of two: 4,032 at most."""
    return F.floor(F.log2(met) * _STEPS).cast("int")


def _least_class(counts: DataFrame, most: int) -> int:
    """The least class of `met` that `most` rows at most are in or above."""
    held, total = counts.groupBy(_class(F.col("met")).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect(), 0
    for r in sorted(held, key=lambda r: -r["c"]):
        total += r["n"]
        if total > most:
            return r["c"] + 1
    return 0


def held_out(key: str = "doc_id", folds: int = 7, held: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds)) == held, F.lit(True))


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", folds: int = 7, held: int = 2, broadcast: int = BROADCAST) -> DataFrame:
    """One row per row of `docs`: `key`, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits.

    Learns from the rows that held_out() is false for (a null key is held out), scores all whole
    texts as their words in lower case, a space between two and an end. base_score is the add-one unigram model's;
    words are told apart by 64-bit hashes. score is the mixture's base-10 logarithm, bits its code length; divided by
    n_bytes, that per byte. A null or empty text is its end alone. A context never learnt ends the mixture at the
    deepest one that was; without anything learnt each decision has probability 1/2. Repeated rows are learnt and
    scored each; an empty table gives no rows. `broadcast` grams at most are sent to all executors.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc"), blank(text).alias("text"), held_out(key, folds, held).alias("held"))
    counted = rows.select("text", "held").mapInArrow(_count, "kind tinyint, key long, learnt long, met long").groupBy("kind", "key")
    counted = settle(counted.agg(F.sum("learnt").alias("learnt"), F.sum("met").alias("met")), "counts")
    words = counted.where(F.col("kind") == WORD)
    total, distinct = words.agg(F.coalesce(F.sum("met"), F.lit(0)), F.count("met")).first()
    often = F.col("met") * FREQUENT > total
    frequent = words.where(often).orderBy("key").select("key", "met").toArrow()

    latest = F.shiftright("key", 8 * (DEPTH - TOP))
    dealt = counted.where(F.col("kind") == GRAM).select("key", "learnt", "met", latest.alias("_l")).repartition(width(spark), "_l")
    tree = settle(dealt.select("key", "learnt", "met").mapInArrow(_trees, _TREE), "trees")
    # 65,536 contexts of two bytes with 255 decisions each, at most
    top = tree.where("below is null").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "sum")]).toArrow()
    nodes = Top(np.asarray(top.column(0)).view(np.uint64), *(np.asarray(top.column(k)) for k in (1, 2, 3)))
    of_top = spark.sparkContext.broadcast(nodes)
    logs = settle(tree.where("below is not null").select("key", "met", "below").mapInArrow(partial(_logs, shared=of_top), "key long, met long, log2 float"), "logs")
    least = _least_class(logs, broadcast)
    sent = logs.where(_class(F.col("met")) >= least).select("key", "log2").toArrow()
    lookup = Lookup(np.asarray(sent.column(0)).view(np.uint64), np.asarray(sent.column(1)))
    shared = spark.sparkContext.broadcast((lookup, np.asarray(frequent.column(0)), np.asarray(frequent.column(1)), total, distinct))

    kind = docs.schema[key].dataType.simpleString()
    made = f"row long, kind tinyint, key long, tf long, doc {kind}, n_tokens long, n_known long, base double, bits double, n_bytes long"
    scored = rows.select("row", "doc", "text").mapInArrow(partial(_score, shared=shared, name=f"{spark.sparkContext.applicationId}-{shared._jbroadcast.id()}"), made)
    rare = words.where(~often).select("kind", "key", F.col("met").cast("double").alias("x"))
    rare = rare.unionByName(logs.where(_class(F.col("met")) < least).select(F.lit(GRAM).cast("tinyint").alias("kind"), "key", F.col("log2").cast("double").alias("x")))
    joined = scored.join(rare, ["kind", "key"], "left")
    is_word, is_gram = F.col("kind") == WORD, F.col("kind") == GRAM
    seen = F.coalesce("x", F.lit(0.0))
    base = F.when(is_word, F.col("tf") * F.log10((seen + 1) / F.lit(float(total + distinct + 1)))).otherwise(F.col("base"))
    known = F.when(is_word & (seen > 0), F.col("tf")).otherwise(F.col("n_known"))
    bits = F.when(is_gram, F.col("tf") * F.col("x")).otherwise(F.col("bits"))
    summed = joined.select("row", "doc", "n_tokens", known.alias("n_known"), base.alias("base"), bits.alias("bits"), "n_bytes").groupBy("row").agg(F.max("doc").alias(key), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), (-F.sum("bits")).alias("bits"), F.max("n_bytes").alias("n_bytes"))
    return summed.select(key, held_out(key, folds, held).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", (-F.col("bits") / log2(10)).alias("score"), "n_bytes", "bits")
