"""Runs of words and benchmark windows against plain loops, and their edge cases."""

import random
import re

import pytest
from flowlens.llm import leaks, runs


def plain_runs(words, least, times):
    """Every stretch of places that equal the place a period later, at every period; the least period of each stretch."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, times * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted(((i, j - i, p) for (i, j), p in found.items()), key=lambda r: (r[0], r[2]))


def repetitive(rng):
    words = [rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(rng.choice([0, 1, 5, 40, 150]))]
    for _ in range(rng.randint(0, 4) if words else 0):
        s, q = rng.randrange(len(words)), rng.randint(1, 8)
        words[s:s] = [words[(s + i % q) % len(words)] for i in range(rng.randint(0, 40))]
    if words and rng.random() < 0.4:  # blocks that hold whole runs
        s = rng.randrange(len(words))
        words += words[s : rng.randint(s, len(words))] * rng.randint(1, 3)
    return words


@pytest.mark.parametrize(("least", "times"), [(24, 3), (1, 2), (6, 2), (4, 3)])
def test_runs_are_those_of_plain_loops(least, times):
    rng = random.Random(least + times)
    for _ in range(150):
        texts = [repetitive(rng) for _ in range(rng.randint(1, 6))]
        assert runs.runs_of(texts, least, times) == [plain_runs(t, least, times) for t in texts]


def test_a_run_inside_a_copied_block_is_found():
    # both stretches lie strictly inside the second copy, one of them inside a copy that overlaps itself
    part = ["a", *["x", "y"] * 13, "b", *["k"] * 30, "c"]
    text = part + ["between"] + part * 3
    assert runs.runs_of([text], 24, 3) == [plain_runs(text, 24, 3)]
    assert len(runs.runs_of([text], 24, 3)[0]) == 9  # two a copy, and the copies themselves


def test_runs_of_rows(spark, docs, empty, plain):
    got = runs.find(docs)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows.keys() == plain.keys()
    for k, text in plain.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        expected = plain_runs(words, 24, 3)
        gone = {i for s, n, p in expected for i in range(s + p, s + n)}
        assert rows[k]["n_words"] == len(words)
        assert [tuple(r) for r in rows[k]["runs"]] == expected
        assert rows[k]["collapsed"] == " ".join(w for i, w in enumerate(words) if i not in gone)
    assert runs.find(empty).collect() == []


def test_runs_of_repeated_and_null_keys_and_a_very_long_text(spark):
    long = " ".join(f"w{i % 7919}" for i in range(200_000))
    rows = [(None, "k " * 30), (1, "k " * 30), (1, "k " * 30), (1, None), (2, long)]
    got = runs.find(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], len(r["runs"])) for r in got) == [("1", 0, 0), ("1", 30, 1), ("1", 30, 1), ("2", 200_000, 1), ("None", 30, 1)]
    (found,) = (r for r in got if r["doc_id"] == 2)
    assert [tuple(x) for x in found["runs"]] == [(0, 200_000, 7919)] and found["collapsed"].count(" ") == 7918
    with pytest.raises(ValueError):
        runs.find(spark.createDataFrame(rows, "doc_id int, text string"), least_exponent=1)


def plain_leaks(text, items, window):
    """Hit words and items by comparing every stretch of words with every window."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text))
    hit, names = set(), set()
    for name, item in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in item))
        k = min(window, len(w))
        wins = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for i in range(len(words) - k + 1):
            if k and tuple(words[i : i + k]) in wins:
                hit |= set(range(i, i + k))
                names |= {name} - {None}
    return len(words), hit, sorted(names, key=str)


@pytest.mark.parametrize("limit", [leaks.LIMIT, 900])
def test_leaks_are_those_of_plain_loops(spark, docs, empty, plain, limit):
    rng = random.Random(4)
    sources = [t for t in plain.values() if len(t.split()) > 40]
    items = []
    for i in range(25):
        words = rng.choice(sources).split()
        s = rng.randrange(len(words) - 30)
        items.append((str(i), "?! ".join(words[s : s + rng.choice([3, 9, 10, 25])]).upper()))
    items += [("empty", ""), ("null", None), ("signs", "!?"), (None, "one"), ("0", items[0][1]), ("absent", "nowhere " * 12), ("ten", items[4][1])]
    given = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id string, text string, doc_id string, n_hit int")
    got = {r["doc_id"]: r for r in leaks.find(docs, given, limit=limit).collect()}
    assert got.keys() == plain.keys()
    hits = 0
    for k, text in plain.items():
        n, hit, names = plain_leaks(text, [(i, t or "") for i, t in items], 10)
        row = got[k]
        assert (row["n_words"], row["n_hit"], row["items"], row["contaminated"]) == (n, len(hit), names, bool(hit)), k
        covered = {i for s in row["spans"] for i in range(s["first_word"], s["last_word"] + 1)}
        assert covered == hit
        for s in row["spans"]:  # offsets lead to the same words of the text as it stands
            assert len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text[s["start"] : s["end"]])) == s["last_word"] - s["first_word"] + 1
        hits += bool(hit)
    assert hits > 10
    assert leaks.find(empty, given, limit=limit).collect() == []


def test_leaks_without_items_and_with_repeated_rows(spark, docs, plain):
    none = spark.createDataFrame([], "item_id long, text string")
    got = leaks.find(docs, none).collect()
    assert len(got) == len(plain) and not any(r["contaminated"] or r["items"] for r in got)
    rows = spark.createDataFrame([(None, "Été, one two"), (1, "Été, one two"), (1, "Été, one two"), (1, None)], "doc_id int, text string")
    items = spark.createDataFrame([(7, "Été ONE"), (7, "Été ONE"), (None, "two")], "item_id long, text string")
    for limit in (leaks.LIMIT, 10):
        got = leaks.find(rows, items, limit=limit).collect()
        assert sorted((str(r["doc_id"]), r["n_hit"], r["items"], [tuple(s) for s in r["spans"]]) for r in got) == [
            ("1", 0, [], []),
            ("1", 3, ["7"], [(0, 12, 0, 2)]),
            ("1", 3, ["7"], [(0, 12, 0, 2)]),
            ("None", 3, ["7"], [(0, 12, 0, 2)]),
        ]
