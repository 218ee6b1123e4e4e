"""Scores rank label 1 above label 0 whichever class has words of its own."""

from random import Random

import numpy as np
from flowlens.llm import toxicity


def test_scores_rank_labels_either_way_round(spark):
    rng, rows, labels = Random(5), [], []
    for i in range(400):
        now = [f"w{rng.randrange(60)}" for _ in range(40)]
        marked = rng.random() < 0.2
        if marked:
            now[rng.randrange(40)] = f"slur{rng.randrange(3)}"
        rows.append((i, " ".join(now)))
        labels.append((i, int(marked)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for flip in (0, 1):
        known = {i: y ^ flip for i, y in labels}
        taught = spark.createDataFrame(list(known.items()), "doc_id long, toxic int")
        held = [(r["score"], known[r["doc_id"]]) for r in toxicity.score(docs, taught).where("held_out").collect()]
        pairs = [(a > b) + 0.5 * (a == b) for a, y in held if y for b, z in held if not z]
        assert sum(pairs) / len(pairs) > 0.9


def test_curve_never_falls_in_toxicity():
    rng = np.random.default_rng(3)
    y = (np.arange(200) < 40).astype(float)
    ratio = np.where(y == 1, -0.002, 0.004) + rng.normal(0, 0.001, 200)
    w = toxicity.fit_curve(ratio, -ratio, np.full(200, 100.0), y, np.ones(200))
    assert (w[1 : toxicity.RISING + 1] >= 0).all()
