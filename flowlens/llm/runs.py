"""Periodic runs of words: stretches that repeat a period, found through the blocks of a Lempel-Ziv factorisation.

For the words of a text:

1. A suffix array by prefix doubling, whose ranks after each doubling are kept: equal ranks of a level are equal
   stretches of 2^level words, so that common extensions to either side take one look a level.
2. The longest common prefixes of neighbours in that array, and from both the longest previous factor of every place:
   the greater of those shared with the nearest suffixes before and after, in the array, that start earlier in the text.
3. Blocks: each as long as the longest previous factor at its start, or one new word.
4. Runs that touch a border of blocks, by extending both ways from it at every period that such a run can have: a run
   that ends in a block begins less than its period before the block that precedes it.
5. Runs strictly inside a block are copies of runs at its earlier occurrence; runs lie in buckets by their start, and
   blocks take them from there from left to right.

Texts are worked on by themselves, many short ones as one array; there is no shuffle. A task holds one Arrow batch of
texts and about 200 bytes a word of the longest text (or of `CHUNK` words).
"""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from .common import blank, small_batches

#: Words that texts are gathered up to before they are worked on as one array.
CHUNK = 1 << 17
FOUND = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"


class _Suffixes:
    """Suffixes of several texts laid end to end, in order; no stretch is taken to cross the end of a text."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray):
        n = self.n = len(words)
        ends = np.cumsum(lengths)
        stop = np.repeat(ends, lengths)
        key = np.repeat(np.arange(len(lengths)), lengths) * (int(words.max()) + 1) + words
        self.order = np.argsort(key, kind="stable")
        slots, key, width = np.arange(n), key[self.order], 1
        rank = np.empty(n + 1, np.int32)
        rank[n] = -1  # what lies past the end equals nothing
        members = self.order
        #: levels[l][i] is equal for i and j of one text where the 2^l words from both are.
        self.levels: list[np.ndarray] = []
        while True:
            first = np.r_[True, key[1:] != key[:-1]]
            heads = np.flatnonzero(first)
            rank[members] = np.repeat(slots[heads], np.diff(np.r_[heads, len(slots)]))
            self.levels.append(rank)
            shared = ~(first & np.r_[first[1:], True])
            if not shared.any():
                break
            # groups of more than one are ordered by the rank of what follows the words they share
            members, slots = members[shared], slots[shared]
            later = np.minimum(members + width, n)
            key = rank[members].astype(np.int64) * (n + 2) + np.where(members + width < stop[members], rank[later] + 1, 0)
            by = np.argsort(key, kind="stable")
            members, key, width, rank = members[by], key[by], 2 * width, rank.copy()
            self.order[slots] = members

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words from `a` and from `b` on, different places of one text."""
        found = np.zeros(len(a), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            ranks = self.levels[level]
            found += (ranks[np.minimum(a + found, self.n)] == ranks[np.minimum(b + found, self.n)]).astype(np.int64) << level
        return found

    def back(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words up to `a` and up to `b`, with both; `a` is before `b`."""
        found = np.zeros(len(a), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            ranks, i, j = self.levels[level], a - found - (1 << level) + 1, b - found - (1 << level) + 1
            found += ((i >= 0) & (ranks[np.maximum(i, 0)] == ranks[np.maximum(j, 0)])).astype(np.int64) << level
        return found

    def common(self) -> np.ndarray:
        """For each slot of the order the words that its suffix shares with the one before it."""
        found, first = np.zeros(self.n, np.int64), self.levels[0]
        near = np.flatnonzero(first[self.order[1:]] == first[self.order[:-1]]) + 1
        found[near] = self.ahead(self.order[near - 1], self.order[near])
        return found


def _nearest_before(place: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each slot the nearest slot before it with a smaller place, and the least of `common` between (0: no such slot, or nothing is shared).

    Least values of pairs, fours, eights ... of slots are climbed to the left until one is small enough, then descended.
    """
    places, commons = [place], [common]
    while len(places[-1]) > 1:
        for of, fill in ((places, np.iinfo(np.int64).max), (commons, np.iinfo(np.int64).max)):
            x = of[-1]
            of.append(np.minimum(x[::2], np.r_[x[1::2], fill] if len(x) % 2 else x[1::2]))
    found, at = np.zeros(len(place), np.int64), np.full(len(place), -1)
    slot = np.flatnonzero(common > 0)
    least, block = common[slot], slot.copy()
    stopped = []
    for level in range(len(places)):
        odd = (block & 1) == 1
        left = np.maximum(block - 1, 0)
        small = odd & (places[level][left] < place[slot])
        stopped.append((slot[small], least[small], left[small]))
        least = np.where(odd, np.minimum(least, commons[level][left]), least)
        go = ~small & (least > 0) & (block > 1)
        slot, least, block = slot[go], least[go], block[go] >> 1
    slot, least, block = stopped.pop()
    for level in range(len(places) - 2, -1, -1):
        right = np.minimum(2 * block + 1, len(places[level]) - 1)
        small = places[level][right] < place[slot]
        least = np.where(small, least, np.minimum(least, commons[level][right]))
        block = np.where(small, right, 2 * block)
        more = stopped.pop()
        slot, least, block = (np.r_[x, y] for x, y in zip((slot, least, block), more, strict=True))
    found[slot], at[slot] = least, block
    return found, at


def _previous_factors(suffixes: _Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """For each place the length of the longest stretch from it that also starts earlier, and where (-1: nowhere)."""
    order, common = suffixes.order, suffixes.common()
    up, up_at = _nearest_before(order, common)
    down, down_at = (x[::-1] for x in _nearest_before(order[::-1].copy(), np.r_[common[1:], 0][::-1].copy()))
    down_at = len(order) - 1 - down_at
    length, source = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    length[order] = np.maximum(up, down)
    source[order] = np.where(length[order] > 0, order[np.where(up >= down, up_at, np.minimum(down_at, len(order) - 1))], -1)
    return length, source


def _at_borders(suffixes: _Suffixes, starts: np.ndarray, lengths: np.ndarray, least: int, times: int) -> set[tuple[int, int, int]]:
    """(start, end, period) of runs of `least` words and `times` periods at least that touch a border of blocks."""
    ends = np.cumsum(lengths)
    n = suffixes.n
    text = np.searchsorted(ends, starts, side="right")
    sizes = np.diff(np.r_[starts, n])
    inner = np.r_[False, text[1:] == text[:-1]]
    before = np.r_[0, sizes[:-1]]
    # borders between two blocks of a text, and the ends of texts
    last = np.r_[text[1:] != text[:-1], True]
    border = np.r_[starts[inner], (starts + sizes)[last]]
    reach = np.r_[(before + sizes)[inner], sizes[last]]
    most = np.r_[((before + sizes - 1) // (times - 1))[inner], (sizes // times)[last]]
    fewest = np.maximum(1, least + 1 - reach)
    asked = most >= fewest
    border, most, fewest, stop = border[asked], most[asked], fewest[asked], ends[np.r_[text[inner], text[last]][asked]]
    begin = stop - lengths[np.searchsorted(ends, stop)]
    count = most - fewest + 1
    each = np.repeat(np.arange(len(border)), count)
    period = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count) + fewest[each]
    found: set[tuple[int, int, int]] = set()
    for shift in (0, 1):  # the period to the right of the border, and to the left
        a = border[each] - shift * period
        ok = (a >= begin[each]) & (a + period <= stop[each])
        a, p, lo = a[ok], period[ok], begin[each][ok]
        ahead = suffixes.ahead(a, a + p)
        back = np.where(a > lo, suffixes.back(np.maximum(a - 1, 0), a + p - 1), 0)
        size = back + p + ahead
        long = size >= np.maximum(least, times * p)
        found.update(zip((a - back)[long].tolist(), (a + p + ahead)[long].tolist(), p[long].tolist(), strict=True))
    return found


def _copied(runs: set[tuple[int, int, int]], starts: np.ndarray, sizes: np.ndarray, source: np.ndarray, least: int) -> None:
    """Add to `runs` those strictly inside a block, from the block's earlier occurrence."""
    begins = sorted({r[0] for r in runs})
    buckets: dict[int, list[tuple[int, int]]] = {}
    for i, j, p in runs:
        buckets.setdefault(i, []).append((j, p))
    for b in np.flatnonzero(sizes > least + 1):
        s, size = int(starts[b]), int(sizes[b])
        src = int(source[s])
        k = bisect_right(begins, src)
        while k < len(begins) and begins[k] < src + size:
            i = begins[k]
            for j, p in list(buckets[i]):
                run = (i + s - src, j + s - src, p)
                if j < src + size and run not in runs:
                    runs.add(run)
                    if run[0] not in buckets:
                        buckets[run[0]] = []
                        insort(begins, run[0])
                    buckets[run[0]].append(run[1:])
            k += 1


def runs_of(texts: list[list], least: int, times: int) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each list of words, by start and then period."""
    lengths = np.array([len(t) for t in texts if t], np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(lengths):
        return out
    seen = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
    words = np.fromiter((seen[w] for t in texts for w in t), np.int64, int(lengths.sum()))
    suffixes = _Suffixes(words, lengths)
    length, source = _previous_factors(suffixes)
    step, at, i = np.maximum(length, 1).tolist(), [], 0
    while i < len(step):
        at.append(i)
        i += step[i]
    starts = np.array(at)
    runs = _at_borders(suffixes, starts, lengths, least, times)
    if runs:
        _copied(runs, starts, np.diff(np.r_[starts, len(step)]), source, least)
        # a stretch is met at multiples of its period too
        periods: dict[tuple[int, int], int] = {}
        for i, j, p in runs:
            periods[i, j] = min(p, periods.get((i, j), p))
        ends = np.cumsum(lengths)
        filled = [i for i, t in enumerate(texts) if t]
        for (i, j), p in sorted(periods.items()):
            text = int(np.searchsorted(ends, i, side="right"))
            out[filled[text]].append((i - int(ends[text] - lengths[text]), j - i, p))
        for found in out:
            found.sort(key=lambda r: (r[0], r[2]))
    return out


def _without(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words with one period left of each run."""
    if runs:
        left = bytearray(b"\x01" * len(words))
        for start, length, period in runs:
            left[start + period : start + length] = bytes(length - period)
        words = [w for w, stays in zip(words, left, strict=True) if stays]
    return b" ".join(words)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 24, least_exponent: int = 3) -> DataFrame:
    """(`key`, n_words, runs, collapsed) for every row of `docs`: its runs of words, and its words with each run cut to its first period.

    A run is a stretch of consecutive words `[^\\x20\\x09-\\x0D]+` whose smallest period is q, at least `least_length` words and `least_exponent` (2 or
    more) periods long, and which no word beside it continues with that period. runs holds (start, length, period), words numbered
    from 0, by start and then period; runs may overlap. A word is left out of `collapsed` if it is past the first q words of any run.

    Null and blank texts have no words, no runs and an empty `collapsed`. Rows are judged one by one: repeated rows and
    keys give a row each, a null key stays null, other columns are not looked at. An empty table gives no rows.
    """
    if least_exponent < 2 or least_length < 1:
        raise ValueError("runs have two periods and one word at least")
    small_batches(docs.sparkSession)
    schema = StructType([StructField("_k", docs.schema[key].dataType), *StructType.fromDDL(FOUND).fields])
    arrow = to_arrow_schema(schema)

    def chunk(keys: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = runs_of(texts, least_length, least_exponent)
        columns = (
            [len(t) for t in texts],
            [[{"start": s, "length": n, "period": p} for s, n, p in rs] for rs in found],
            [_without(t, rs) for t, rs in zip(texts, found, strict=True)],
        )
        return pa.RecordBatch.from_arrays([keys.cast(arrow[0].type), *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:], strict=True))], schema=arrow)

    def work(batches):
        for batch in batches:
            begun, held, texts = 0, 0, []
            for i, value in enumerate(batch.column(1)):
                texts.append(value.as_py().split())
                held += len(texts[-1])
                if held >= CHUNK or i == batch.num_rows - 1:
                    yield chunk(batch.column(0).slice(begun, len(texts)), texts)
                    begun, held, texts = i + 1, 0, []

    found = docs.select(F.col(key).alias("_k"), blank(text).cast("binary").alias("_t")).mapInArrow(work, schema)
    return found.select(F.col("_k").alias(key), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))
