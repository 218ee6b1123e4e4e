"""Benchmark decontamination: windows of test items in texts, by an Aho-Corasick automaton.

Texts and items are normalised alike: A-Z in lower case, and words of digits, letters and characters beyond ASCII with
one space between. A window is `window` consecutive words of an item; an item of fewer words is one window. One
automaton holds all windows, and each text is scanned once with it, in the task that holds it: nothing is shuffled.
Matches begin and end at spaces, so their words are known, and with them their places in the original text.

The automaton is sent to all workers, so its size is checked: windows (with the items they belong to) of more than
`LIMIT` characters in all are dealt by hash into several automata within that bound, texts are scanned once with each,
and what they find is joined by row.
"""

from __future__ import annotations

import re
from functools import cached_property, reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from .common import blank, settle, small_batches

#: Characters of windows and names of their items that one automaton holds at most; it takes some 60 bytes a character.
LIMIT = 2_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What words are made of, once in lower case and as it stands in a text.
NORMAL_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORIGINAL_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes of UTF-8 in lower case, those outside words as spaces.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

SPAN = "struct<start: long, end: long, first_word: long, last_word: long>"
FOUND = f"n_words long, spans array<{SPAN}>, items array<string>"


def windows(items: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """Distinct (words, item) of the windows of `items`; item is null where the key is."""
    words = F.regexp_extract_all(F.translate(blank(text), UPPER, LOWER), F.lit(NORMAL_WORD), 0)
    named = items.select(F.col(key).cast("string").alias("item"), words.alias("_w")).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - (window - 1), F.lit(1)))
    each = named.select("item", "_w", F.explode(starts).alias("_i"))
    return each.select(F.array_join(F.slice("_w", F.col("_i"), window), " ").alias("words"), "item").distinct()


class _Windows:
    """Windows by their words, the items of each, and their automaton, which a worker makes when it first scans."""

    def __init__(self, pairs: list[tuple[str, str | None]]):
        self.items: dict[str, list[str]] = {}
        for words, item in pairs:
            self.items.setdefault(words, []).extend([] if item is None else [item])

    @cached_property
    def machine(self) -> ahocorasick.Automaton:
        made = ahocorasick.Automaton()
        for words in self.items:
            # bytes of UTF-8, each as one character
            pattern = f" {words} ".encode().decode("latin-1")
            made.add_word(pattern, (words, len(pattern), words.count(" ") + 1))
        made.make_automaton()
        return made

    def scan(self, text: bytes) -> tuple[int, list[dict], list[str]]:
        """Number of words, stretches of hit words, and items of the windows that occur."""
        words = text.translate(PLAIN).split()
        if not self.items or not words:
            return len(words), [], []
        plain = b" " + b" ".join(words) + b" "
        hits = [(end - size + 1, n, found) for end, (found, size, n) in self.machine.iter(plain.decode("latin-1"))]
        if not hits:
            return len(words), [], []
        spaces = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
        edge = np.zeros(len(words) + 1, np.int64)
        first = np.searchsorted(spaces, [h[0] for h in hits])
        np.add.at(edge, first, 1)
        np.add.at(edge, first + [h[1] for h in hits], -1)
        hit = np.r_[False, np.cumsum(edge)[:-1] > 0, False]
        begins, ends = np.flatnonzero(~hit[:-1] & hit[1:]), np.flatnonzero(hit[:-1] & ~hit[1:])
        place = [m.span() for m in ORIGINAL_WORD.finditer(text.decode(errors="replace"))]
        spans = [{"start": place[b][0], "end": place[e - 1][1], "first_word": int(b), "last_word": int(e) - 1} for b, e in zip(begins, ends, strict=True)]
        return len(words), spans, sorted({item for found in {h[2] for h in hits} for item in self.items[found]})


def _scan(docs: DataFrame, pairs: list[tuple[str, str | None]]) -> DataFrame:
    """The columns of `docs` but the last, its text, with FOUND from one automaton."""
    sent = docs.sparkSession.sparkContext.broadcast(_Windows(pairs))
    kept = len(docs.columns) - 1
    schema = StructType([*docs.schema.fields[:-1], *StructType.fromDDL(FOUND).fields])
    arrow = to_arrow_schema(schema)

    def work(batches):
        for batch in batches:
            rows = [sent.value.scan(t.as_py()) for t in batch.column(kept)]
            columns = [*batch.columns[:kept], *([r[i] for r in rows] for i in range(len(arrow) - kept))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.mapInArrow(work, schema)


def _together(spans: Column) -> Column:
    """Spans from several automata as the stretches of words that they cover."""

    def add(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        joined = last.withField("end", F.greatest(last["end"], span["end"])).withField("last_word", F.greatest(last["last_word"], span["last_word"]))
        touches = (F.size(done) > 0) & (span["first_word"] <= F.try_element_at(done, F.lit(-1))["last_word"] + 1)
        return F.when(touches, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(span)))

    by_word = F.array_sort(spans, lambda a, b: (a["first_word"] - b["first_word"]).cast("int"))
    return F.aggregate(by_word, F.array().cast(f"array<{SPAN}>"), add)


def find(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = 10, limit: int = LIMIT) -> DataFrame:
    """(`key`, n_words, n_hit, spans, items, contaminated) for every row of `docs`: which of its words lie in windows of `items`.

    n_hit counts words inside any occurrence of a window. spans are stretches of such words: start and end (exclusive) in
    characters of the text as it stands, and the numbers of the first and last word, from 0. items are the keys, as text and
    in order, of the items that have an occurring window. contaminated says whether a word is hit.

    Null and blank texts have no words and are not hit; such items have no windows. An item without key hits words but is
    not listed; items with equal texts are all listed, repeated rows of an item once. Rows of `docs` are judged one by one:
    repeated rows and keys give a row each, a null key stays null, other columns of both are not looked at. Empty
    tables give no rows, or rows without hits.
    """
    if window < 1:
        raise ValueError("a window has one word at least")
    spark = docs.sparkSession
    small_batches(spark)
    pairs = settle(windows(items, item_key, item_text, window), "windows")
    size = pairs.agg(F.sum(F.length("words") + 2 + F.coalesce(F.length("item"), F.lit(0)))).first()[0] or 0
    parts = max(1, -(-size // limit))
    named = docs.select(F.col(key).alias("_k"), blank(text).cast("binary").alias("_t"))
    if parts == 1:
        found = _scan(named, [tuple(r) for r in pairs.toLocalIterator()])
    else:
        rows = settle(named.select("_k", F.monotonically_increasing_id().alias("_row"), "_t"), "rows")
        dealt = pairs.withColumn("_part", F.pmod(F.xxhash64("words", "item"), F.lit(parts)))
        each = [settle(_scan(rows.select("_k", "_row", "_t"), [(r["words"], r["item"]) for r in dealt.where(F.col("_part") == i).toLocalIterator()]), "scanned") for i in range(parts)]
        some = reduce(DataFrame.unionByName, [f.where(F.size("spans") > 0).select("_row", "spans", "items") for f in each])
        met = some.groupBy("_row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        none = [F.coalesce(_together("spans"), F.array()).alias("spans"), F.coalesce("items", F.array()).alias("items")]
        found = each[0].select("_k", "_row", "n_words").join(met, "_row", "left").select("_k", "n_words", *none)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last_word"] - s["first_word"] + 1)
    return found.select(F.col("_k").alias(key), "n_words", n_hit.alias("n_hit"), "spans", "items", (F.size("spans") > 0).alias("contaminated"))
