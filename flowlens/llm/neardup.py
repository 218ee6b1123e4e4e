"""MinHash near-dedup with tensored banding.

A signature is two collections of short keys, each key made of a few minhashes. Every pair of a key of the first and
a key of the second is a table key: g keys on either side give g * g tables for the minhashes of 2 * g bands. Texts
that share a table key are candidates; their full sets of shingles decide.

Texts with the same set are one class and go through as one, and buckets with the same members as one bucket. The work
grows with the members of a group, not with its pairs:

1. Each text is compared with that of its buckets' texts that shares most half-keys with others (its hub).
2. Components that still share a bucket form a group. All its texts are compared with one of them, the pivot. Against
   a pivot a text is its difference: what it lacks and what it has besides. Two sets' symmetric difference is that of
   their differences, so texts link only if enough of their differences is common, and differences of near copies are
   small and mostly their own. Texts far from the pivot get another one; by the triangle inequality of the Jaccard
   distance, none that is left out there links with one that goes on.
3. Texts without a pivot are looked at by their whole sets.

In 2 and 3 rows whose counts rule out every partner go first; the others meet partners of other components by the
rarest elements that a link must share, and each such pair is confirmed on its full sets.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank, settle, small_batches
from .graph import components

#: Keys in each collection, and minhashes in a key: two sets of similarity 0.8 share no table key once in 2700 times.
KEYS, PER_KEY = 12, 3

#: Bits of the bitmap of texts that have candidates.
MARK_BITS = 22

#: Pivots that a group gets one after another, and the similarity in percent from which a text is seen as its difference.
PIVOTS, BESIDE = 2, 50

_MIX, _SLICE, _KEPT = np.uint64(0x9E3779B97F4A7C15), 1 << 12, 100_000
_words: dict[bytes, int] = {}


def _finish(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values, one to one (the finaliser of the splitmix64 generator; fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit values of a text's shingles of `size` words; the whole sequence as one if it is shorter."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(_words) > _KEPT:
        _words.clear()
    for w in set(words).difference(_words):
        _words[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(h) < size:
        out = np.array([len(h)], dtype=np.uint64)
        for x in h:
            out = _finish(out * _MIX + x)
        return out
    n = len(h) - size + 1
    out = h[:n].copy()
    for k in range(1, size):
        out = _finish(out * _MIX + h[k : k + n])
    return np.unique(out)


def signature(values: np.ndarray, keys: int = KEYS, per_key: int = PER_KEY) -> np.ndarray:
    """2 * keys table half-keys of a set: the first collection's, then the second's."""
    count = 2 * keys * per_key
    seeds = _finish(np.arange(1, 2 * count + 1, dtype=np.uint64) * _MIX)
    flips, factors = seeds[:count, None], seeds[count:, None] | np.uint64(1)
    least = np.full(count, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(values), _SLICE):
        np.minimum(least, ((values[None, at : at + _SLICE] ^ flips) * factors).min(axis=1), out=least)
    parts = least.reshape(2 * keys, per_key)
    out = np.arange(2 * keys, dtype=np.uint64)
    for k in range(per_key):
        out = _finish(out * _MIX + parts[:, k])
    return out


def _digest(values: np.ndarray) -> bytes | None:
    from hashlib import blake2b

    return blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None


def _sign(batches, size: int, keys: int, per_key: int):
    for batch in batches:
        n, digests, rows = [], [], []
        for text in batch.column(1).to_pylist():
            values = shingles(text, size)
            n.append(len(values))
            digests.append(_digest(values))
            rows.append(signature(values, keys, per_key).view(np.int64) if len(values) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(rows, pa.list_(pa.int64()))], names=["doc", "n_shingles", "digest", "signature"])


def _marks(docs: DataFrame) -> np.ndarray:
    """One bit for each of 2^MARK_BITS hash values: set where a row of `docs` (doc) has it. At most that many rows are gathered."""
    found = docs.select(F.pmod(F.xxhash64("doc"), F.lit(1 << MARK_BITS)).cast("int").alias("m")).distinct().toArrow()
    bits = np.zeros(1 << MARK_BITS, dtype=bool)
    bits[found.column(0).to_numpy()] = True
    return np.packbits(bits)


def _sets(batches, size: int, marks):
    bits = np.unpackbits(marks.value).view(bool)
    for batch in batches:
        batch = batch.filter(pa.array(bits[batch.column(1).to_numpy()]))
        if batch.num_rows:
            found = [shingles(t, size) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(_digest, found), pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], names=["digest", "shingles"])


def _values(column) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in column]


def _apart(batches):
    """One row an element."""
    for batch in batches:
        sets = [x.view(np.int64) for x in _values(batch.column(2))]
        at = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(np.concatenate(sets or [np.empty(0, np.int64)]))], names=["g", "node", "element"])


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For sorted distinct values: which of `x` are in `y`."""
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x if len(y) else np.zeros(len(x), dtype=bool)


def _compare(batches):
    for batch in batches:
        shared, total = [], []
        for x, y in zip(_values(batch.column(2)), _values(batch.column(3)), strict=True):
            if len(x) > len(y):
                x, y = y, x
            found = int(_common(x, y).sum())
            shared.append(found)
            total.append(len(x) + len(y) - found)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(total, pa.int64())], names=["a", "b", "shared", "total"])


def _against(batches):
    """Sizes as in _compare, and the symmetric difference of sets that are BESIDE or more alike."""
    for batch in batches:
        shared, total, apart = [], [], []
        for x, y in zip(_values(batch.column(2)), _values(batch.column(3)), strict=True):
            both = _common(x, y)
            n = int(both.sum())
            shared.append(n)
            total.append(len(x) + len(y) - n)
            apart.append(np.sort(np.concatenate([x[~both], y[~_common(y, x)]])).tobytes() if 100 * n >= BESIDE * total[-1] else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(total, pa.int64()), pa.array(apart, pa.binary())], names=["node", "pivot", "shared", "total", "apart"])


def _sided(pairs: DataFrame, sets: DataFrame, a: str, b: str) -> DataFrame:
    """`pairs` (a, b) with both full sets."""
    one, two = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s_{x}")) for x in (a, b))
    return pairs.select(a, b).join(two, b).join(one, a).select(a, b, f"s_{a}", f"s_{b}")


def _verified(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """(a, b, shared, total): sizes of the intersection and union of both full sets of each pair."""
    return settle(_sided(pairs, sets, "a", "b").mapInArrow(_compare, "a long, b long, shared long, total long"), name)


def _pairs(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _several(rows: DataFrame) -> DataFrame:
    """Rows of groups `g` that hold more than one component."""
    open_ = rows.groupBy("g").agg(F.min("component").alias("_x"), F.max("component").alias("_y")).where("_x != _y").select("g")
    return rows.join(open_, "g", "left_semi")


def _across(rows: DataFrame, percent: int, whole: bool, name: str) -> DataFrame:
    """Pairs (a, b) of nodes in one group and two components that may link, from rows (g, node, component, n, values).

    n is the size of a node's set, values the elements of its difference from the group's pivot (or of the set itself,
    `whole`), m their number. Sets link when their differences share (m_x + m_y - c (n_x + n_y)) / 2 elements or more,
    c = (100 - percent) / (100 + percent). That is one at least where not both link with the pivot. Elements that no
    other node of the group has are never shared. The rest are ordered by rarity; as many of the first as leave fewer
    than needed must hold one that both share, and behind the first shared one enough must be left.
    """
    up, down = 100 + percent, 100 - percent
    rows = settle(_several(rows), f"{name}_rows")
    apart = settle(rows.select("g", "node", "values").mapInArrow(_apart, "g long, node long, element long"), f"{name}_elements")
    # written, so that a join with an element on very many rows can be split
    common = settle(apart.groupBy("g", "element").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), f"{name}_common")
    ordered = apart.join(common, ["g", "element"]).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "element"))).alias("s"))
    held = rows.select("g", "node", "component", "n", (F.octet_length("values") / 8).cast("long").alias("m")).join(ordered, "node")
    held = settle(held.withColumn("room", up * (2 * F.size("s") - F.col("m")) + down * F.col("n")).withColumn("need", up * F.col("m") - down * F.col("n")), f"{name}_held")
    # room of one side must reach what the other needs
    ends = held.groupBy("g").agg(F.max("room").alias("most"), F.min("need").alias("least"))
    able = held.join(ends, "g").where("room >= least and need <= most")
    low = F.greatest("least", 2.0 * percent * percent / 100 * F.col("n")) if whole else F.col("least")
    must = F.greatest(F.lit(1), F.ceil((F.col("need") + low) / (2.0 * up) - 1e-9)).cast("long")
    first = (F.size("s") - must + 1).cast("int")
    prefix = able.where(first > 0).select("g", "node", "component", "n", "m", F.size("s").alias("k"), F.posexplode(F.slice("s", F.lit(1), first)).alias("_i", "_s"))
    prefix = settle(prefix.select("g", "node", "component", "n", "m", (F.col("k") - F.col("_i")).cast("long").alias("rest"), "_s.element"), f"{name}_prefix")
    on = ["g", "element"]
    held_by = prefix.groupBy(*on, "component").agg(F.count(F.lit(1)).alias("_c"))
    major = settle(held_by.groupBy(*on).agg(F.max_by("component", F.struct("_c", "component")).alias("major"), F.count(F.lit(1)).alias("_k")).where("_k > 1").drop("_k"), f"{name}_major")
    x = settle(prefix.join(major, on), f"{name}_met")  # written, so that its join with itself can be split too
    y = x.where("component != major").select(*on, *[F.col(c).alias(f"{c}_y") for c in ("node", "component", "n", "m", "rest")])
    once = (F.col("component") == F.col("major")) | (F.col("node") < F.col("node_y"))
    enough = up * (2 * F.least("rest", "rest_y") - F.col("m") - F.col("m_y")) + down * (F.col("n") + F.col("n_y")) >= 0
    sized = 100 * F.least("n", "n_y") >= percent * F.greatest("n", "n_y")
    return x.join(y, on).where((F.col("component") != F.col("component_y")) & once & enough & sized).select(*_pairs("node", "node_y"))


def _beside_pivots(left: DataFrame, sets: DataFrame, percent: int, turn: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links of a group's nodes with its pivot, pairs to confirm among those beside it, and the nodes that go on.

    `left` has rows (g, node, component, n, weight) of groups with more than one component.
    """
    heaviest = F.max(F.struct("weight", (-F.col("node")).alias("r"), "component")).alias("_p")
    pivots = left.groupBy("g").agg(heaviest).select("g", (-F.col("_p.r")).alias("pivot"), F.col("_p.component").alias("to"))
    named = settle(left.join(pivots, "g"), f"pivots{turn}")
    seen = _sided(named, sets, "node", "pivot").mapInArrow(_against, "node long, pivot long, shared long, total long, apart binary")
    seen = settle(seen, f"against{turn}")
    linked = 100 * F.col("shared") >= percent * F.col("total")
    rows = named.drop("pivot").join(seen, "node")
    # a component that links with the pivot is the pivot's own from here on
    joined = rows.where(linked).select("component").distinct().withColumn("_hit", F.lit(True))
    rows = rows.join(joined, "component", "left").withColumn("component", F.when(F.col("_hit"), F.col("to")).otherwise(F.col("component")))
    rows = settle(_several(rows).select("g", "node", "component", "n", "weight", "shared", "total", "apart"), f"beside{turn}")
    links = seen.where(linked & (F.col("node") != F.col("pivot"))).select(*_pairs("node", "pivot"))
    pairs = _across(rows.where("apart is not null").select("g", "node", "component", "n", F.col("apart").alias("values")), percent, False, f"across{turn}")
    far = rows.where(100 * F.col("shared") < (BESIDE + 100 - percent) * F.col("total"))
    return links, pairs, settle(_several(far.select("g", "node", "component", "n", "weight")), f"far{turn}")


def link(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, percent: int = 80, keys: int = KEYS, per_key: int = PER_KEY) -> DataFrame:
    """One row per row of `docs`: `key` (of any type with an order), n_shingles, class_id, component_id, kept.

    Two texts are linked when 100 * intersection >= percent * union of their sets of `size`-word shingles (words
    between white space, A-Z lower-cased). class_id is the least key with the same set, component_id the least key
    reachable by links, kept whether it is the row's own. Texts without words, null ones too, are linked with nothing;
    a null key keeps its row (component_id null, kept). Rows that repeat a key are told apart by their sets; those with
    one set share their verdict. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark, 512)
    kind = docs.schema[key].dataType.simpleString()
    texts = docs.select(F.col(key).alias("doc"), blank(text).alias("_text"))
    signed = settle(texts.mapInArrow(partial(_sign, size=size, keys=keys, per_key=per_key), f"doc {kind}, n_shingles long, digest binary, signature array<long>"), "signatures")
    usable = signed.where(F.col("digest").isNotNull() & F.col("doc").isNotNull())
    classes = usable.groupBy("digest").agg(F.min("doc").alias("rep"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    classes = settle(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    # half-keys that two classes or more hold; tables are formed of those only
    halves = classes.select("node", "n", F.posexplode("signature").alias("pos", "half"))
    active = settle(halves.groupBy("pos", "half").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1"), "halves")
    held = halves.join(active, ["pos", "half"]).groupBy("node").agg(F.first("n").alias("n"), F.sum("_c").alias("weight"), F.collect_list(F.struct("pos", "half")).alias("h"))
    side = lambda keep: F.transform(F.filter("h", keep), lambda x: F.xxhash64(x["pos"], x["half"]))
    sides = settle(held.select("node", "n", "weight", side(lambda x: x["pos"] < keys).alias("u"), side(lambda x: x["pos"] >= keys).alias("v")).where((F.size("u") > 0) & (F.size("v") > 0)), "sides")
    tables = sides.select("node", "weight", "v", F.explode("u").alias("u")).select("node", "weight", "u", F.explode("v").alias("v"))
    tables = tables.select(F.xxhash64("u", "v").alias("bucket"), "node", "weight")
    centre = F.max(F.struct("weight", (-F.col("node")).alias("r")))
    full = tables.groupBy("bucket").agg(centre.alias("centre"), F.count(F.lit(1)).alias("_c"), F.bit_xor(F.xxhash64("node")).alias("_x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("_y")).where("_c > 1")
    full = full.groupBy("_c", "_x", "_y").agg(F.min("bucket").alias("bucket"), F.first("centre").alias("centre"))
    full = full.select("bucket", "centre")
    members = settle(tables.join(full, "bucket").select("bucket", "node", "centre"), "members")
    wanted = classes.join(members.select("node").distinct(), "node", "left_semi").select("digest", "node", F.col("rep").alias("doc"))
    wanted = settle(wanted, "wanted")
    # a bitmap of fixed size keeps most other texts out, before the join that is exact
    marks = spark.sparkContext.broadcast(_marks(wanted))
    marked = texts.where("doc is not null").select("_text", F.pmod(F.xxhash64("doc"), F.lit(1 << MARK_BITS)).cast("int").alias("_m"))
    found_sets = marked.mapInArrow(partial(_sets, size=size, marks=marks), "digest binary, shingles binary")
    sets = settle(found_sets.join(wanted.select("digest", "node"), "digest").dropDuplicates(["digest"]).select("node", "shingles"), "sets")
    linked = 100 * F.col("shared") >= percent * F.col("total")

    # each text with the centre of its buckets that shares most half-keys with others
    hub = members.groupBy("node").agg(F.max("centre").alias("_c")).select("node", (-F.col("_c.r")).alias("hub"))
    tested = _verified(hub.where("node != hub").select(*_pairs("node", "hub")).distinct(), sets, "stars")
    found = components(tested.where(linked).select("a", "b"))

    # components that share a bucket, and their groups
    named = members.select("bucket", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = named.groupBy("bucket").agg(F.min("component").alias("_x"), F.max("component").alias("_y")).where("_x != _y").select("bucket", "_x")
    inner = settle(named.join(split, "bucket").select("node", "component", "_x").distinct(), "inner")
    if not inner.isEmpty():
        groups = components(inner.select("component", "_x").distinct(), "component", "_x").select(F.col("node").alias("component"), F.col("component").alias("g"))
        left = inner.select("node", "component").distinct().join(groups, "component").join(sides.select("node", "n", "weight"), "node")
        left = settle(left.select("g", "node", "component", "n", "weight"), "left")
        links, pairs = [], []
        for turn in range(PIVOTS):
            more, some, left = _beside_pivots(left, sets, percent, turn)
            links.append(more)
            pairs.append(some)
            if left.isEmpty():
                break
        else:
            pairs.append(_across(left.join(sets, "node").select("g", "node", "component", "n", F.col("shingles").alias("values")), percent, True, "plain"))
        pairs = settle(reduce(DataFrame.unionByName, pairs).distinct(), "across")
        links.append(_verified(pairs, sets, "more").where(linked).select("a", "b"))
        old = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = components(reduce(DataFrame.unionByName, links, old))
    ids = classes.select("digest", "node", F.col("rep").alias("class_id")).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = ids.groupBy("component").agg(F.min("class_id").alias("component_id"))
    reps = ids.join(least, "component").select("digest", "class_id", "component_id")
    out = signed.select("doc", "n_shingles", "digest").join(reps, "digest", "left")
    own = lambda c: F.when(F.col("doc").isNotNull(), F.coalesce(c, "doc")).alias(c)
    return out.select(F.col("doc").alias(key), "n_shingles", own("class_id"), own("component_id")).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
