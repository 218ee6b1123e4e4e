import hashlib
from collections import defaultdict

from flowlens.llm import mixing, naming
from pyspark.sql import functions as F


def test_equal_texts_share_an_identity_and_others_do_not(docs, plain):
    groups = defaultdict(list)
    for i, t in plain.items():
        groups[t].append(i)
    for block in (16, 4096):
        got = {r["doc_id"]: r for r in naming.dedup(docs, block_chars=block).collect()}
        assert len(got) == len(plain)
        for i, t in plain.items():
            assert got[i]["keep_id"] == max(groups[t]) and got[i]["group_size"] == len(groups[t])
            assert got[i]["kept"] == (i == max(groups[t]))


def test_hot_blocks_are_named_apart_and_alike(spark):
    rows = spark.createDataFrame([(i, "same" if i % 3 else f"x{i}", None) for i in range(4000)], "doc_id long, text string, lang string")
    got = naming.dedup(rows).groupBy("keep_id").count().collect()
    assert max(r["count"] for r in got) == sum(1 for i in range(4000) if i % 3)


def test_digest_is_of_the_text(docs, plain):
    for r in naming.digest(docs).collect():
        assert r["text_sha256"] == hashlib.sha256(plain[r["doc_id"]].encode()).hexdigest()


def test_empty_tables(empty):
    assert naming.digest(empty).count() == 0 and mixing.mix(empty).count() == 0


def _targets(sizes, weights):
    """Water filling by hand: excess of those above thrice their size goes to the others by weight."""
    total, capped = float(sum(sizes.values())), {}
    while True:
        free = [s for s in sizes if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return share | capped
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_each_source_meets_its_target(docs, plain):
    got = mixing.mix(docs).collect()
    assert len(got) == len(plain)
    sizes, taken, target, most = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in got:
        assert r["size"] == len(plain[r["doc_id"]].encode().split()) and r["taken"] <= 3 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        most[r["source"]] = max(most[r["source"]], r["size"])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    expected = _targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    for s in sizes:
        assert abs(target[s] - expected[s]) < 1e-6 * max(1, expected[s])
        assert abs(taken[s] - target[s]) <= most[s] / 2 + 1


def test_mixing_again_agrees(docs):
    one, two = (sorted(map(tuple, mixing.mix(d).select("doc_id", "taken").collect())) for d in (docs, docs.repartition(7, F.col("text"))))
    assert one == two


def test_rows_without_keys_and_repeated_rows(spark):
    long = "block " * 2000
    rows = [(None, "a", "s"), (None, "a", "s"), (1, "b", None), (1, "b", None), (2, long, "s"), (2, long, "s"), (None, "b", "s"), (3, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = naming.digest(docs).collect()
    assert len(got) == len(rows)
    for i, n, kept in ((1, 3, True), (2, 2, True), (3, 1, True)):
        assert {(r["group_size"], r["kept"]) for r in got if r["doc_id"] == i} == {(n, kept)}
    assert sorted((r["keep_id"] or 0, r["kept"]) for r in got if r["doc_id"] is None) == [(0, True), (0, True), (1, False)]
    assert len(mixing.mix(docs).collect()) == len(rows)
