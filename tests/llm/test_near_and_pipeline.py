import random
from itertools import combinations

import corpus_pipeline
import numpy as np
from flowlens.llm import neardup
from flowlens.llm.graph import components
from pyspark.sql import functions as F


def brute(plain, size, percent):
    sets = {i: set(neardup.shingles(t, size).tolist()) for i, t in plain.items()}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def test_links_match_brute_force(docs, plain):
    for size, percent in ((3, 85), (5, 80)):
        expected, n = brute(plain, size, percent)
        got = {r["doc_id"]: r for r in neardup.link(docs, size=size, percent=percent).collect()}
        assert {i: r["component_id"] for i, r in got.items()} == expected
        assert {i: r["n_shingles"] for i, r in got.items()} == n
        assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_chains_of_near_copies(spark):
    # each text differs a little from the one before; ends share nothing
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 100])) for i in range(60)] + [(1000 + i, " ".join(words[300:400])) for i in range(30)]
    plain = dict(rows)
    expected, _ = brute(plain, 3, 85)
    got = {r["doc_id"]: r["component_id"] for r in neardup.link(spark.createDataFrame(rows, "doc_id long, text string"), size=3, percent=85).collect()}
    assert got == expected


def test_short_texts_are_one_shingle():
    assert len(neardup.shingles("Two words", 3)) == 1 and (neardup.shingles("two WORDS", 3) == neardup.shingles("Two words", 3)).all()
    assert len(neardup.shingles(" \n", 3)) == 0
    assert not np.intersect1d(neardup.shingles("a b", 3), neardup.shingles("b a", 3)).size


def test_components_of_long_paths(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (400, 450), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 400: 400, 450: 400, 500: 400}


def test_empty_table(empty):
    assert neardup.link(empty).count() == 0


def test_stages_keep_their_promises(spark, docs, plain):
    columns, now, counts = docs.columns, docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, "").cache()
        assert out.columns == columns, name
        rows = out.collect()
        counts.append(len(rows))
        if name == "exact_dedup":
            assert len({r["text"] for r in rows}) == len(rows)
        if name == "near_dedup":
            left = {r["doc_id"]: r["text"] for r in rows}
            assert all(k == v for k, v in brute(left, 5, 80)[0].items())
        now = out
    assert counts[0] >= counts[1] >= counts[2] > 40
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, "")
    total = pieces.agg(F.sum("length")).first()[0]
    whole = pieces.groupBy("doc_id").agg(F.max("doc_tokens").alias("n")).join(now.groupBy("doc_id").count(), "doc_id").agg(F.sum(F.col("n") * F.col("count"))).first()[0]
    assert total == whole


def test_the_pipeline_takes_an_empty_table(spark, empty):
    now = empty
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "")
    assert now.count() == 0


def near_copies(rng, n, words, most):
    """Texts that each differ from one text of `words` words in 0 to `most` places, some of those common to several."""
    base = [f"w{rng.randrange(900)}" for _ in range(words)]
    common = [(rng.randrange(words), f"c{k}") for k in range(6)]
    out = []
    for i in range(n):
        now = list(base)
        for k in range(rng.randint(0, most)):
            at, w = rng.choice(common) if rng.random() < 0.3 else (rng.randrange(words), f"n{i}x{k}")
            now[at] = w
        out.append(" ".join(now))
    return out


def test_large_groups_of_near_copies_match_brute_force(spark):
    rng = random.Random(11)
    found = near_copies(rng, 250, 140, 12) + near_copies(rng, 60, 90, 6)
    # a second family that shares half of its words with the first
    half = found[0].split()[:70]
    found += [" ".join(half + t.split()[:70]) for t in near_copies(rng, 60, 70, 4)]
    plain = dict(enumerate(found))
    frame = spark.createDataFrame(list(plain.items()), "doc_id long, text string")
    for size, percent in ((3, 85), (5, 80)):
        expected, _ = brute(plain, size, percent)
        assert len(set(expected.values())) > 10
        got = {r["doc_id"]: r["component_id"] for r in neardup.link(frame, size=size, percent=percent).collect()}
        assert got == expected


def test_difference_join_finds_every_pair_that_links(spark):
    # one group: all pairs across components that link must be among the pairs to confirm, beside a pivot and without
    rng = random.Random(5)
    sets = [set(neardup.shingles(t, 3).view(np.int64).tolist()) for t in near_copies(rng, 80, 120, 9)]
    for percent in (80, 85):
        linked = lambda x, y, p=percent: 100 * len(x & y) >= p * len(x | y)
        want = {(a, b) for a, b in combinations(range(len(sets)), 2) if linked(sets[a], sets[b])}
        for whole, pivot in ((True, set()), (False, sets[7])):
            # what links with the pivot is one component, every other text one of its own
            own = {i: -1 if not whole and linked(x, pivot) else i for i, x in enumerate(sets)}
            rows = [(0, i, own[i], len(x), np.array(sorted(x ^ pivot), dtype=np.int64).tobytes()) for i, x in enumerate(sets)]
            frame = spark.createDataFrame(rows, "g long, node long, component long, n long, values binary")
            got = {(r["a"], r["b"]) for r in neardup._across(frame, percent, whole, "test").collect()}
            assert {(a, b) for a, b in want if own[a] != own[b]} <= got


def test_repeated_and_missing_keys_lose_no_link(spark):
    rng = random.Random(2)
    a, b = (" ".join(f"{x}{rng.randrange(400)}" for _ in range(300)) for x in "ab")
    near = " ".join(["changed", *a.split()[1:]])
    rows = [(5, a), (5, b), (7, near), (9, b), (None, a), (None, "alone " * 9), (3, ""), (3, None)]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    component = [5, 5, 5, 5, None, None, 3, 3]
    kept = [True, True, False, False, True, True, True, True]
    expected = [(k, len(neardup.shingles(t or "", 5)), c, y) for (k, t), c, y in zip(rows, component, kept, strict=True)]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_rows_without_or_with_repeated_keys_are_told_apart(spark, tmp_path):
    rng = random.Random(7)
    from conftest import prose

    good = [prose(rng, 120) for _ in range(60)]
    bad = "word " * 200
    near = " ".join(["changed", *good[0].split()[1:]])
    rows = [(i, t, "en", "web") for i, t in enumerate(good)]
    rows += [(None, good[1], "en", "web"), (None, good[1], "en", "web"), (None, bad, "en", "web"), (None, prose(rng, 110), "en", "web")]
    rows += [(2, good[2], "en", "web"), (2, good[2], "en", "web"), (3, bad, "en", "web"), (None, near, "en", "web")]
    copy = prose(rng, 100)
    rows += [(None, copy, "en", None), (None, copy, "en", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    frame.write.parquet(f"{tmp_path}/docs")
    for docs in (frame, spark.read.parquet(f"{tmp_path}/docs")):
        now = [docs]
        for _, stage in corpus_pipeline.STAGES[:4]:
            now.append(neardup.settle(stage(spark, now[-1], ""), "stage"))
        judged, exact, close, mixed = ([(r["doc_id"], r["text"]) for r in df.collect()] for df in now[1:])
        assert bad not in {t for _, t in judged} and len(judged) == len(rows) - 2
        assert len(exact) == len({t for _, t in exact}) == len({t for _, t in judged})
        assert {(i, t) for i, t in exact if t in good[:4]} == {(i, good[i]) for i in range(4)} and (None, copy) in exact
        assert sorted({t for _, t in exact} - {t for _, t in close}) == [near]
        assert {t for _, t in mixed} <= {t for _, t in close} and len(mixed) >= 1
