"""The jobs: runs over growing input, reruns, odd rows, their command line; queries against SQL."""

import glob
import json
import os
import re
import subprocess
import sys

import duckdb
import pytest
from jobs import common, queries, text_index, trace_conformance

DATA = "/root/testdata/sf0.001"
TEXTS = "doc_id long, text string, lang string, source string, n_chars long"


def put(spark, folder, name, rows, schema=TEXTS):
    """A copy of the growing table gets one more file."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/.{name}")
    (part,) = glob.glob(f"{folder}/.{name}/part-*.parquet")
    os.rename(part, f"{folder}/{name}.parquet")


def contents(rows):
    return sorted(map(str, rows.collect()))


def files(folder):
    return sorted(glob.glob(f"{folder}/**/*.parquet", recursive=True))


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path


def index(spark, folder, out="index"):
    return text_index.run(spark, f"file://{folder}/in", f"file://{folder}/{out}", f"file://{folder}/{out}-mark")


def test_only_new_texts_are_indexed(spark, folder):
    put(spark, f"{folder}/in", "a", [(1, "one two " * 150, "en", "web", 1), (2, "x.y z", "fr", None, 1), (2, "x.y z", "fr", None, 1), (3, None, None, "web", 0)])
    first = index(spark, folder)
    assert first == {"rows": 4, "documents": 3, "chunks": 4, "batches": 1}
    before, there = contents(text_index.current(spark, f"file://{folder}/index")), files(f"{folder}/index")
    # nothing new: no batch is run and no file is written
    assert index(spark, folder) == {"rows": 0, "documents": 0, "chunks": 0, "batches": 0}
    assert contents(text_index.current(spark, f"file://{folder}/index")) == before and files(f"{folder}/index") == there
    # a file more: one text as it was, one changed, one emptied, one without key
    put(spark, f"{folder}/in", "b", [(2, "x.y z", "fr", None, 1), (3, "now there", "en", "web", 1), (1, "", "en", "web", 0), (None, "keyless", "en", None, 1)])
    assert index(spark, folder) == {"rows": 4, "documents": 3, "chunks": 3, "batches": 1}
    rows = {r["doc_id"]: r for r in text_index.current(spark, f"file://{folder}/index").collect()}
    assert {k: (r["chunk"], r["n_words"], r["n_tokens"], r["batch"], sum(r["vector"])) for k, r in rows.items()} == {1: (0, 0, 0, 1, 1), 2: (0, 2, 3, 0, 3), 3: (0, 2, 2, 1, 2), None: (0, 1, 1, 1, 1)}
    assert set(there) < set(files(f"{folder}/index"))


def test_two_runs_over_growing_input_equal_one_over_all(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").orderBy("doc_id").collect()]
    put(spark, f"{folder}/in", "a", rows[:120])
    index(spark, folder)
    put(spark, f"{folder}/in", "b", rows[120:])
    assert index(spark, folder)["documents"] == len(rows) - 120
    index(spark, folder, "whole")
    both = [contents(text_index.current(spark, f"file://{folder}/{out}").drop("batch")) for out in ("index", "whole")]
    assert both[0] == both[1] and len(both[0]) >= len(rows)


def test_a_batch_that_failed_halfway_is_written_over(spark, folder):
    put(spark, f"{folder}/in", "a", [(1, "alpha", "en", "web", 1), (2, "beta", "de", "web", 1)])
    index(spark, folder)
    good = contents(text_index.current(spark, f"file://{folder}/index"))
    # the run wrote its batch, but ended before the stream knew: it is given again
    for commit in glob.glob(f"{folder}/index-mark/commits/*"):
        os.remove(commit)
    for crc in glob.glob(f"{folder}/index-mark/commits/.*.crc"):
        os.remove(crc)
    assert index(spark, folder)["documents"] == 2
    assert contents(text_index.current(spark, f"file://{folder}/index")) == good


TURNS = "conv_id long, turn long, role string, text string"


def plain_trace(rows, edges):
    """Route, and hops of every step by search over the edges."""

    def hops(a, b):
        seen, level, n = set(), {a}, 0
        while level:
            n += 1
            level = {t for s, t in edges if s in level} - seen
            if b in level:
                return n
            seen |= level
        return None

    found = {}
    for conv in {r[0] for r in rows}:
        turns = sorted({(r[1] is not None, r[1] or 0, r[2] or "<unresolved>") for r in rows if r[0] == conv})
        route = ["__start__", *(t[2] for t in turns), "__end__"]
        found[conv] = [hops(a, b) for a, b in zip(route, route[1:], strict=False)]
    return found


@pytest.mark.parametrize("span", [3, 1000])
def test_conversations_are_judged_as_by_plain_search(spark, tmp_path, span):
    settings = {"edges": [["__start__", "user"], ["user", "assistant"], ["assistant", "tool"], ["tool", "assistant"], ["assistant", "user"], ["assistant", "__end__"]], "turns_per_bucket": span}
    (tmp_path / "c.json").write_text(json.dumps(settings))
    roles = ["user", "assistant", "tool", "user", None]
    rows = [(c, t * (1 + c % 3), roles[(t * 7 + c * 5 + t * t) % 5], "x") for c in range(6) for t in range(4 + 5 * c)]
    rows += [(9, 1, "user", "a"), (9, 1, "user", "b"), (9, 2, "assistant", None), (9, 2, "assistant", "again"), (None, None, "user", "x"), (None, 5, "user", "x"), (8, 0, "nobody", "x")]
    spark.createDataFrame(rows, TURNS).repartition(3).write.parquet(f"{tmp_path}/turns")
    trace_conformance.run(spark, f"{tmp_path}/turns", f"{tmp_path}/out", f"{tmp_path}/c.json")
    expected = plain_trace(rows, [tuple(e) for e in settings["edges"]])
    steps = {}
    for r in common.written(spark, f"{tmp_path}/out/steps", trace_conformance.STEPS).collect():
        assert r["state"] == ("undeclared" if r["hops"] is None else "skips" if r["hops"] > 1 else "declared")
        assert r["skipped"] is None if r["hops"] is None else len(r["skipped"]) == r["hops"] - 1
        steps.setdefault(r["conv_id"], {})[r["step"]] = r["hops"]
    assert {c: [s[i] for i in range(len(s))] for c, s in steps.items()} == expected
    for r in trace_conformance.read(spark, f"{tmp_path}/out").collect():
        hops = expected[r["conv_id"]]
        off = [i for i, h in enumerate(hops) if h != 1]
        assert (r["n_steps"], r["n_turns"], r["n_undeclared"], r["n_skips"]) == (len(hops), len(hops) - 1, hops.count(None), len(off) - hops.count(None))
        assert r["first_deviation"] == (off[0] if off else None)
        assert r["longest_detour"] == max((hops[i] for i in off if hops[i]), default=None)
    # a rerun gives the same
    before = contents(trace_conformance.read(spark, f"{tmp_path}/out"))
    trace_conformance.run(spark, f"{tmp_path}/turns", f"{tmp_path}/out", f"{tmp_path}/c.json")
    assert contents(trace_conformance.read(spark, f"{tmp_path}/out")) == before


def test_empty_tables(spark, folder):
    spark.createDataFrame([], TURNS).write.parquet(f"{folder}/turns")
    assert trace_conformance.run(spark, f"{folder}/turns", f"{folder}/out") == {}
    put(spark, f"{folder}/in", "a", [])
    assert index(spark, folder)["chunks"] == 0
    assert text_index.current(spark, f"file://{folder}/index").collect() == []


def test_settings_are_checked(tmp_path):
    (tmp_path / "c.json").write_text('{"edges": [], "turns_per_bucket": true}')
    with pytest.raises(ValueError, match="turns_per_bucket"):
        common.config(tmp_path / "c.json", {"edges": list, "turns_per_bucket": int})
    with pytest.raises(ValueError, match="settings are"):
        common.config(tmp_path / "c.json", {"edges": list})


def test_the_command_line_runs_and_logs(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    made = subprocess.run(
        [sys.executable, "-m", "jobs.trace_conformance", "--conversations", f"{DATA}/conversations.parquet", "--output", f"{tmp_path}/out"],
        cwd=root, capture_output=True, text=True, timeout=300, env=os.environ | {"PYSPARK_SUBMIT_ARGS": f"--master local[2] --conf spark.sql.shuffle.partitions=2 --conf spark.checkpoint.dir=file://{tmp_path}/shared pyspark-shell"},
    )
    assert made.returncode == 0, made.stderr[-2000:]
    assert re.search(r"read \d+ turns of", made.stderr) and re.search(r"wrote \d+ steps and .*declared", made.stderr)
    assert files(f"{tmp_path}/out/conversations")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    expected = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in expected.description]
    before = dict(spark.conf.getAll)
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, expected.fetchall())) == sorted(str(tuple(r)) for r in got.select(*columns).collect())
    assert dict(spark.conf.getAll) == before
