"""The stored vector index against the product with all vectors."""

import numpy as np
import pytest
from flowlens.operators import vector_index
from flowlens.operators.vector_index import BLOCK, SLICE, VectorIndex
from flowlens.plans.scratch import keep

ROWS = "id long, v array<float>"


def plain(rows, queries, k):
    """The k best (id, score) of each query, equals by id."""
    out = {}
    for q, x in queries:
        scored = []
        for i, v in rows:
            size = float(np.linalg.norm(np.float32(x).astype(float)) * np.linalg.norm(np.float32(v).astype(float)))
            score = float(np.dot(np.float32(x).astype(float), np.float32(v).astype(float))) / size if size else 0.0
            scored.append((-round(score, 9), i, round(score, 6)))
        out[q] = [(i, shown) for _, i, shown in sorted(scored)[:k]]
    return out


def answers(index, spark, queries, k, **more):
    asked = spark.createDataFrame(queries, "q long, x array<float>")
    out = {}
    for r in index.search(asked, k, "q", "x", "id", **more).orderBy("q", "rank").collect():
        out.setdefault(r["q"], []).append((r["id"], round(r["score"], 6)))
    return out


@pytest.fixture(scope="module")
def points():
    """Clusters, scattered points, one vector on a third of the rows, and zero vectors."""
    rng = np.random.default_rng(7)
    middle = rng.normal(size=(12, 24))
    near = [middle[i % 12] + 0.15 * rng.normal(size=24) for i in range(900)]
    wide = list(rng.normal(size=(300, 24)) * rng.uniform(0.1, 9, size=(300, 1)))
    found = [*near, *wide, *[middle[3]] * 600, np.zeros(24), np.zeros(24)]
    return [(int(i), np.float32(found[j]).tolist()) for i, j in enumerate(rng.permutation(len(found)))]


@pytest.fixture(scope="module")
def index(spark, points, tmp_path_factory):
    made = VectorIndex(spark, f"file://{tmp_path_factory.mktemp('index')}")
    made.build(spark.createDataFrame(points, ROWS).repartition(5), "id", "v")
    return made


def test_answers_are_those_of_all_rows(spark, index, points):
    queries = [(i, v) for i, v in points if i % 100 == 0] + [(-1, points[5][1])]
    assert answers(index, spark, queries, 7) == plain(points, queries, 7)
    assert answers(index, spark, queries[:3], 5000) == plain(points, queries[:3], 5000)  # more than there are


def test_cells_grow_with_the_rows_and_hot_ones_are_cut(index, points):
    cells = index._read("cells")
    assert 20 < index._read("centres").count() <= len(points) ** 0.5
    assert cells.agg({"n": "sum"}).first()[0] == len(points)
    sizes = [len(r["codes"]) for r in index._read("blocks").collect()]
    assert sum(sizes) == len(points) and max(sizes) < 2 * BLOCK
    assert cells.agg({"n": "max"}).first()[0] > BLOCK  # the third of all rows


def test_few_vectors_and_codes_are_read(spark, index, points):
    queries = [(i, v) for i, v in points if i % 50 == 0 and np.linalg.norm(v) > 0]
    asked = spark.createDataFrame(queries, "_q long, _v array<float>")
    looked = index.candidates(asked, 5).groupBy("q").count().collect()
    # equal scores at the end of the answer have to be told apart by key, so queries amid the copies read them all
    few = [r["count"] for r in looked if r["count"] < 600]
    assert len(few) > len(queries) / 2 and max(few) < len(points) / 5


def test_probes_trade_recall(spark, index, points):
    queries = [(i, v) for i, v in points if i % 100 == 1]
    exact = plain(points, queries, 10)
    found = []
    for probes in (1, 8, 1000):
        got = answers(index, spark, queries, 10, probes=probes)
        found.append(sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in exact[q]}) for q, _ in queries))
    assert found[0] <= found[1] <= found[2] == 10 * len(queries)


def test_rows_are_added_in_batches(spark, points, tmp_path):
    made = VectorIndex(spark, f"file://{tmp_path}")
    frame = lambda rows: spark.createDataFrame(rows, ROWS)
    made.build(frame(points[:1000]), "id", "v")
    made.add(frame(points[1000:1200]), "id", "v", 1)  # a run that failed, and its repetition
    made.add(frame(points[1000:]), "id", "v", 1)
    queries = [(i, v) for i, v in points if i % 150 == 0]
    assert answers(made, spark, queries, 6) == plain(points, queries, 6)
    with pytest.raises(ValueError, match="dimension 2, the index 24"):
        made.add(frame([(1, [1.0, 2.0])]), "id", "v", 2)
    with pytest.raises(ValueError, match="dimension"):
        answers(made, spark, [(1, [1.0, 2.0])], 3)
    # building again leaves nothing of the old batches
    made.build(frame(points[:100]), "id", "v")
    assert made._read("vectors").count() == 100 and answers(made, spark, queries, 3) == plain(points[:100], queries, 3)


def test_odd_tables(spark, tmp_path):
    made = VectorIndex(spark, f"file://{tmp_path}/i")
    made.build(spark.createDataFrame([], ROWS), "id", "v")
    assert answers(made, spark, [(1, [1.0, 0.0])], 3) == {}
    rows = spark.createDataFrame([(None, [1.0, 0.0], 5), (4, [1.0, 0.0], 5), (4, [1.0, 0.0], 5), (5, [0.0, 0.0], 5)], "id int, v array<double>, cell int")
    made.build(rows, "id", "v")
    assert answers(made, spark, [(1, [2.0, 0.0])], 9) == {1: [(None, 1.0), (4, 1.0), (4, 1.0), (5, 0.0)]}
    assert answers(made, spark, [], 9) == {}
    for bad in ([(1, None)], [(1, [1.0]), (2, [1.0, 2.0])], [(1, [])]):
        with pytest.raises(ValueError, match="dimensions"):
            made.build(spark.createDataFrame(bad, ROWS), "id", "v")


def test_batches_and_products_stay_small(spark, index, points, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", {}
    was = spark.conf.get(name)
    monkeypatch.setattr(vector_index, "keep", lambda n, df: seen.setdefault(n, spark.conf.get(name)) and keep(n, df))
    queries = points[:3]
    assert answers(index, spark, queries, 4) == plain(points, queries, 4)
    # a row of a comparison holds a slice of queries and a block of codes
    assert seen == {"asked": was, "first": str(SLICE), "second": str(SLICE)} and spark.conf.get(name) == was
    rng = np.random.default_rng(1)
    x, centres = rng.normal(size=(50, 4)), rng.normal(size=(7, 4))
    expected = np.argmin(((x[:, None] - centres[None]) ** 2).sum(axis=2), axis=1)
    for most in (1, 30, 1 << 21):
        monkeypatch.setattr(vector_index, "PRODUCT", most)
        assert vector_index._closest(x, centres).tolist() == expected.tolist()
    assert vector_index._closest(x[:0], centres).tolist() == []
