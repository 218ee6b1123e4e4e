"""What must not grow faster than the input."""

import ast
from pathlib import Path

from flowlens.api import Engine
from flowlens.functions import vectors
from flowlens.operators import embed, graphops
from flowlens.operators.assemble import assemble, import_modules, registrations
from flowlens.operators.resolve import resolve
from flowlens.plans.scratch import keep
from flowlens.sources import kernel
from flowlens.sources.scan import facts, tasks
from pyspark.sql import functions as F


def test_small_modules_share_parsing_tasks():
    assert tasks(0, 0) == 1
    # nine million modules of 180 bytes: a few seconds of parsing a task, and as few files of facts to open in each scan
    assert tasks(9_000_000, 9_000_000 * 180) <= 1200
    assert tasks(10, 10 << 20) >= 5


def test_unit_vectors_look_at_a_text_once(spark):
    rows = spark.createDataFrame([(0, "a b a"), (1, ""), (2, None)], "id int, text string")
    found = rows.select("id", vectors.unit(vectors.hashed("text", 16)).alias("v"))
    assert found._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 1
    for r in found.collect():
        assert abs(sum(x * x for x in r["v"]) - 1) < 1e-12
    edge = spark.createDataFrame([([0.0, 0.0],), ([],), (None,), ([3.0, 4.0],)], "v array<double>").select(vectors.unit(F.col("v")).alias("u"))
    assert [r["u"] for r in edge.collect()] == [[0.0, 0.0], [], None, [0.6, 0.8]]


def test_a_module_is_walked_once(monkeypatch):
    text = Path(kernel.__file__).read_text()
    tree = ast.parse(text)
    assert kernel._walk(tree) == list(ast.walk(tree))
    small, walks, walk = b"g = StateGraph(dict)\n[g.add_node(n, f) for n in names]\ng.add_node('b', f)\n", [], kernel._walk
    monkeypatch.setattr(kernel, "_walk", lambda t: walks.append(t) or walk(t))
    assert [c["in_dynamic"] for c in kernel.parse(small)["calls"]] == [True, False]
    assert sum(isinstance(t, ast.Module) for t in walks) == 1


def test_graphs_of_files_are_assembled_without_shuffles(spark):
    source = "from flowlib import StateGraph\ndef a(s):\n    return Command(goto='b')\ng = StateGraph(dict)\ng.add_node('a', a)\ng.add_node('b', b)\ng.add_edge('a', 'b')\n"
    parsed = keep("facts", facts(spark.createDataFrame([("r", f"f{i}.py", source) for i in range(3)], "repo_id string, path string, content string")))
    index = assemble(parsed)
    for name in ("graphs", "nodes", "edges", "routes", "tool_bindings"):
        assert "Exchange" not in getattr(index, name)._jdf.queryExecution().executedPlan().toString(), name
    assert {r["edge_id"] for r in index.edges.collect()} == {f"f{i}.py::g::edge::a-->b" for i in range(3)}


def test_a_route_is_searched_among_edges_of_graphs_that_hold_both_ends(spark, tmp_path, monkeypatch):
    for n in "ab":
        (tmp_path / f"{n}.py").write_text(f"from flowlib import StateGraph\ng = StateGraph(dict)\ng.add_node('{n}1', f)\ng.add_node('{n}2', f)\ng.add_edge('{n}1', '{n}2')\n")
    engine, asked, search = Engine(spark), [], graphops.shortest_routes
    engine.index_repo(tmp_path)
    monkeypatch.setattr(graphops, "shortest_routes", lambda edges, requests, cut=None: asked.append({r["graph_id"] for r in edges.collect()}) or search(edges, requests, cut=cut))
    assert engine.trace_path("a1", "a2", tmp_path)["route"] == ["a1", "a2"]
    assert asked == [{"a.py::g"}]


def test_files_are_assembled_once_for_all_tables(spark):
    source = "from flowlib import StateGraph\nfrom lib import b\ndef a(s):\n    return Command(goto='b')\ng = StateGraph(dict)\ng.add_node('a', a)\ng.add_node('b', b)\n"
    files = [("r", "f.py", source), ("r", "lib.py", "def b(s):\n    'B.'\n    return s   \n")]
    parsed = keep("facts", facts(spark.createDataFrame(files, "repo_id string, path string, content string")))
    cuts = []
    index = assemble(parsed, lambda name, df: cuts.append(name) or keep(name, df))
    plain = assemble(parsed)
    for name in ("graphs", "nodes", "edges", "routes", "tool_bindings", "pieces"):
        plan = getattr(index, name)._jdf.queryExecution().optimizedPlan().toString()
        assert "add_node" not in plan and "Join" not in plan, name
        assert sorted(map(str, getattr(index, name).collect())) == sorted(map(str, getattr(plain, name).collect())), name
    assert cuts == ["assembled"]
    # lines of nodes in their graph's file are taken from its row, others are looked for
    texts = embed.chunks(index.pieces, parsed, embed.HashingProvider())
    assert {r["node_name"]: r["text"] for r in texts.collect()} == {"a": "def a(s):\n    return Command(goto='b')", "b": "def b(s):\n    'B.'\n    return s"}
    own = embed.chunks(index.pieces.where("name = 'a'"), parsed, embed.HashingProvider())
    assert "Join" not in own._jdf.queryExecution().optimizedPlan().toString()


def test_functions_without_calls_are_not_walked(monkeypatch):
    walks, walk = [], kernel._walk
    monkeypatch.setattr(kernel, "_walk", lambda t: walks.append(t) or walk(t))
    found = kernel.parse(b"def a(s):\n    return s\n@tool(x)\ndef b(s):\n    return s\ndef c(s): return Command(goto='a')\n")
    assert [f["gotos"] for f in found["functions"]] == [[], [], [{"targets": ["a"], "ok": True}]]
    assert [t.name for t in walks if not isinstance(t, ast.Module)] == ["b", "c"]


def test_warnings_are_switched_off_once_for_a_batch(monkeypatch, recwarn):
    switched, catch = [], kernel.warnings.catch_warnings
    monkeypatch.setattr(kernel.warnings, "catch_warnings", lambda: switched.append(1) or catch())
    odd = b"x = '\\d'\nassert 1is 1\n"
    with kernel.uncollected(), kernel.unwarned():
        assert [kernel.parse(odd)["parse_status"] for _ in range(3)] == ["ok"] * 3
    assert len(switched) == 1
    # by itself a file is parsed without warnings as well, before and after a batch
    assert kernel.parse(odd)["parse_status"] == "ok" and len(switched) == 2 and not recwarn.list


def test_no_functions_are_looked_for_where_no_node_names_an_import(spark):
    own = "from flowlib import StateGraph\nfrom parts import p1\ndef a(s):\n    return s\ng = StateGraph(dict)\ng.add_node('a', a)\ng.add_node('t', ToolNode([p1]))\n"
    led = "from flowlib import StateGraph\nfrom lib import b\ng = StateGraph(dict)\ng.add_node('b', b)\n"
    for source, expected in ((own, []), (led, ["wanted", "hop0", "upgrades"])):
        rows = [("r", "f.py", source), ("r", "lib.py", "def b(s):\n    'B.'\n    return s\n")]
        parsed = keep("facts", facts(spark.createDataFrame(rows, "repo_id string, path string, content string")))
        cuts = []
        registered = registrations(F.col("calls"), F.col("functions"))
        found = resolve(parsed.select("repo_id", "path", "imports", "calls", registered.alias("registered")), parsed, import_modules, lambda name, df: cuts.append(name) or keep(name, df))
        assert [c for c in cuts if c in ("wanted", "hop0", "upgrades")] == expected
        assert (found is None) == (not expected) and (not expected or [r["source_file"] for r in found.collect()] == ["lib.py"])


def test_tools_that_are_named_once_are_not_sorted(spark):
    head = "from flowlib import StateGraph, ToolNode\nfrom parts import p1\nimport os.path as q\nfrom other import p2, p1 as p3\nfrom last import p1\ng = StateGraph(dict)\n"
    once = head + "g.add_node('t', ToolNode([p3, p1, q.join, 'p9']))\ng.add_node('t', ToolNode([x()]))\n"
    # in a body the last of a name says where it is from, and bodies of a node are taken in order
    twice = head + "g.add_node('t', ToolNode([p1, z, q.p1]))\ng.add_node('t', ToolNode([p3.z, p2.p2]))\ng.add_node('u', ToolNode([p1]))\n"
    parsed = keep("facts", facts(spark.createDataFrame([("r", "once.py", once), ("r", "twice.py", twice)], "repo_id string, path string, content string")))
    index = assemble(parsed)
    at = lambda r: (r["binding_ord"] >> 30, r["binding_ord"] & ((1 << 30) - 1))
    got = {(r["node_id"].rsplit("::", 1)[1] + r["graph_id"][0], r["tool_name"]): (r["tool_source"], *at(r)) for r in index.tool_bindings.collect()}
    assert got == {
        ("to", "p3"): ("other", 0, 0),
        ("to", "p1"): ("last", 0, 1),
        ("to", "join"): ("os.path", 0, 2),
        ("to", "p9"): (None, 0, 3),
        ("to", "x"): (None, 1, 0),
        ("tt", "p1"): ("os.path", 0, 0),
        ("tt", "z"): (None, 0, 1),
        ("tt", "p2"): ("other", 1, 1),
        ("ut", "p1"): ("last", 2, 0),
    }
    assert "array_distinct" in index.tool_bindings._jdf.queryExecution().optimizedPlan().toString()
