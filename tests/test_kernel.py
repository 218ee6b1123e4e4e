"""What the kernel reads out of source text, and what assembly makes of it."""

import pytest
from flowlens.operators.assemble import assemble
from flowlens.sources.kernel import parse
from flowlens.sources.scan import facts

HEAD = "from flowlib import StateGraph, START, END, ToolNode, Command, Send\ng = StateGraph(dict)\n"


@pytest.fixture(scope="module")
def index(spark):
    """Tables of a repository given as {path: source}, as lists of dictionaries."""

    def build(files, ignored=()):
        rows = [("r", p, s.encode() if isinstance(s, str) else s, p in ignored) for p, s in files.items()]
        parsed = facts(spark.createDataFrame(rows, "repo_id string, path string, content binary, is_ignored boolean")).persist()
        found = assemble(parsed)
        return {n: [r.asDict() for r in getattr(found, n).collect()] for n in ("graphs", "nodes", "edges", "routes", "tool_bindings")}

    return build


PIPELINE = HEAD + '''
def check(state):
    """Check."""
    return state

@first
@second(
    1)
def route(state):
    if state:
        return Command(goto="fetch")
    if not state:
        return Command(goto=END)
    return Command(goto="format")

async def fetch(state): ...
def format(state): ...
def fail(state): ...

g.add_node("check", check)
g.add_node(route)
g.add_node("fetch", fetch)
g.add_node(node="format", action=format)
g.add_node("fail", fail)
g.set_entry_point("check")
g.add_conditional_edges("check", pick, {"ok": "route", 3: "fail"})
g.add_edge("fetch", "format")
g.add_edge("format", END)
g.add_edge("fail", END)
'''


def test_a_whole_graph(index):
    got = index({"a/main.py": PIPELINE})
    assert got["graphs"] == [{"repo_id": "r", "graph_id": "a/main.py::g", "file_path": "a/main.py", "variable_name": "g", "entry_point": "check"}]
    nodes = sorted(got["nodes"], key=lambda n: n["node_ord"])
    assert [n["name"] for n in nodes] == ["check", "route", "fetch", "format", "fail"] and all(n["resolution"] == "full" for n in nodes)
    assert nodes[0]["docstring"] == "Check." and nodes[0]["node_id"] == "a/main.py::g::node::check"
    assert PIPELINE.splitlines()[nodes[1]["line_start"] - 1] == "@first"
    assert [n["routing_resolution"] for n in nodes] == ["not_applicable", "full"] + ["not_applicable"] * 3
    edges = sorted(got["edges"], key=lambda e: e["edge_ord"])
    assert len(edges) == 8 and sum(e["type"] == "normal" for e in edges) == 3
    # returns at the top of a body come before those inside its branches
    assert [e["target"] for e in edges if e["source"] == "route"] == ["format", "fetch", "__end__"]
    assert {(r["condition_value"], r["value_resolution"]) for r in got["routes"]} == {("ok", "known"), ("3", "known"), (None, "not_derivable")}
    assert {e["condition_function_name"] for e in edges if e["type"] == "conditional"} == {"pick", "route"}


@pytest.mark.parametrize(
    ("calls", "entry"),
    [
        ('g.add_edge(START, "a")', "a"),
        ("", None),
        ('g.add_edge(START, "a")\ng.add_edge(START, "b")', None),
        ('g.set_entry_point("b")\ng.add_edge(START, "a")', "b"),
        ('g.set_entry_point("b")\ng.set_entry_point("c")', "c"),
        ('g.add_conditional_edges(START, f, {"x": "a"})', None),
        ("g.add_edge(START, END)", None),
        ('g.add_edge("__start__", "a")', "a"),
    ],
)
def test_entry_points(index, calls, entry):
    assert index({"m.py": HEAD + calls})["graphs"][0]["entry_point"] == entry


def test_branches_without_written_destinations(index):
    got = index({"m.py": HEAD + 'g.add_conditional_edges("a", lambda s: s, table)\ng.add_conditional_edges("b", f, {})\ng.add_conditional_edges("c", f, path_map=["x", END])\ng.add_edge(["p", "q"], "r")\ng.add_edge("only")\n'})
    by = {(e["source"], e["target"]): e for e in got["edges"]}
    assert by["a", "<unresolved>"]["condition_function_name"] == "<lambda>" and ("b", "<unresolved>") in by
    assert by["c", "x"]["edge_id"] == "m.py::g::cedge::c--x-->x" and ("c", "__end__") in by and ("['p', 'q']", "r") in by
    assert {(r["condition_value"], r["value_resolution"]) for r in got["routes"]} == {(None, "not_derivable")} and len(got["routes"]) == 2


def test_dynamic_nodes_stay_partial(index):
    source = HEAD + "def work(s): ...\nfor n in names:\n    g.add_node(f'n{n}', work)\n    g.add_node('loop', work)\n[g.add_node('comp', work) for _ in x]\ng.add_node(make('x'))\ng.add_node(NAME, work)\n"
    nodes = {n["name"]: n for n in index({"m.py": source})["nodes"]}
    assert all(n["resolution"] == "partial" and n["routing_resolution"] == "partial" and n["function_body_hash"] == "" for n in nodes.values())
    assert "loop" in nodes and "comp" in nodes and "NAME" in nodes and sum(n.startswith("<dynamic:") for n in nodes) == 2


def test_tools(index):
    source = HEAD.replace("ToolNode", "ToolNode as TN") + """from .kit import search
import pkg.web as web
def a(s): model.bind_tools([search, web.get, make(), "text", "text"])
def b(s): model.bind_tools(tools)
def c(s): model.bind_tools([search, *more, [1], 5])
def d(s): model.bind_tools(tools=[search])
for f in ("a", "b", "c", "d"): pass
g.add_node(a); g.add_node(b); g.add_node(c); g.add_node(d); g.add_node("t", TN([search])); g.add_node("u", TN(search))
"""
    got = index({"p/m.py": source})
    assert {n["name"]: n["tool_resolution"] for n in got["nodes"]} == {"a": "full", "b": "partial", "c": "partial", "d": "not_applicable", "t": "full", "u": "partial"}
    assert {n["name"]: n["resolution"] for n in got["nodes"] if n["name"] in "tu"} == {"t": "not_applicable", "u": "not_applicable"}
    bound = {(b["node_id"].rsplit("::", 1)[1], b["tool_name"]): b["tool_source"] for b in got["tool_bindings"]}
    assert bound == {("a", "search"): ".kit", ("a", "get"): "pkg.web", ("a", "make"): None, ("a", "text"): None, ("c", "search"): ".kit", ("t", "search"): ".kit"}


@pytest.mark.parametrize(
    ("value", "state", "edges"),
    [
        ('"x"', "full", [("normal", "x")]),
        ("target", "partial", []),
        ('["x", target]', "partial", [("normal", "x")]),
        ('["x", "y", "x"]', "full", [("conditional", "x"), ("conditional", "y")]),
        ('[Send("w", i) for i in s]', "full", [("normal", "w")]),
        ("END", "full", [("normal", "__end__")]),
        ("mod.END", "partial", []),
        ("[]", "full", []),
        ('"x" if s else "y"', "partial", []),
    ],
)
def test_gotos(index, value, state, edges):
    got = index({"m.py": HEAD + f"def a(s):\n    return Command(goto={value})\ng.add_node(a)\n"})
    assert got["nodes"][0]["routing_resolution"] == state and [(e["type"], e["target"]) for e in sorted(got["edges"], key=lambda e: e["edge_ord"])] == edges


def test_resuming_is_not_routing_and_stated_edges_are_not_doubled(index):
    got = index({"m.py": HEAD + 'def a(s): return Command(resume=True)\ndef b(s): return Command(goto="a")\ng.add_node(a)\ng.add_node(b)\ng.add_edge("b", "a")\n'})
    assert {n["name"]: n["routing_resolution"] for n in got["nodes"]} == {"a": "not_applicable", "b": "full"} and len(got["edges"]) == 1


def test_first_and_last_of_repeated_names(index):
    source = HEAD + 'def f(s): ...\ndef h(s): model.bind_tools([t]); return Command(goto="z")\ng.add_node("n", f)\ng.add_node("n", h)\ndef f(s):\n    """Later."""\n'
    got = index({"m.py": source})
    assert len(got["nodes"]) == 1 and got["nodes"][0]["docstring"] == "Later." and got["nodes"][0]["tool_resolution"] == "not_applicable"
    assert [b["tool_name"] for b in got["tool_bindings"]] == ["t"] and [e["target"] for e in got["edges"]] == ["z"]


def test_functions_in_other_files(index):
    use = HEAD.replace("g =", "from .steps import work\nfrom lib.deep import far\nfrom .loop import never\nfrom ..out import gone\ng =")
    files = {
        "app/main.py": use + 'g.add_node("work", work)\ng.add_node("far", far)\ng.add_node("never", never)\ng.add_node("gone", gone)\nfor _ in x: g.add_node("again", work)\n',
        "app/steps.py": 'from flowlib import Command\nfrom .tools import search\ndef work(s):\n    """Works."""\n    model.bind_tools([search])\n    return Command(goto=["a", "b"])\n',
        "lib/deep/__init__.py": "from .x import far\n",
        "lib/deep/x.py": "from lib.deep.y import far\n",
        "lib/deep/y.py": "def far(s): ...\n",
        "app/loop.py": "from .pool import never\n",
        "app/pool.py": "from .loop import never\n",
    }
    got = index(files, ignored=["lib/deep/y.py"])
    nodes = {n["name"]: n for n in got["nodes"]}
    assert nodes["work"]["source_file"] == "app/steps.py" and nodes["work"]["docstring"] == "Works." and nodes["work"]["routing_resolution"] == "full"
    assert nodes["far"]["source_file"] == "lib/deep/y.py" and nodes["far"]["resolution"] == "full"
    assert nodes["never"]["resolution"] == nodes["gone"]["resolution"] == "partial" and nodes["again"]["resolution"] == "full"
    assert {b["tool_source"] for b in got["tool_bindings"]} == {".tools"}
    assert {(e["source"], e["target"], e["type"]) for e in got["edges"]} == {(s, t, "conditional") for s in ("work", "again") for t in "ab"}


def test_chains_longer_than_three_modules_stay_partial(index):
    for k in range(5):
        files = {"m.py": HEAD + "from h0 import f\ng.add_node(f)\n"} | {f"h{i}.py": f"from h{i + 1} import f\n" for i in range(k)} | {f"h{k}.py": "def f(s): ...\n"}
        assert index(files)["nodes"][0]["resolution"] == ("full" if k + 1 <= 3 else "partial")


def test_builders_are_told_by_name(index):
    source = "import flowlib as fl\nfrom flowlib import StateGraph as SG\na = SG(x)\nb = c = fl.StateGraph(x)\nd: object = SG(x)\nclass K:\n    def m(self):\n        self.e = SG(x)\n        h = SG(x)\nother = Graph()\nother.add_node('n', f)\n"
    got = index({"m.py": source})
    assert {g["variable_name"] for g in got["graphs"]} == {"a", "b", "c", "h"} and not got["nodes"]


def test_files_that_cannot_be_read(index):
    assert parse(b"def broken(\n")["parse_status"] == "syntax_error"
    assert parse("é = 1".encode("latin-1"))["parse_status"] == "decode_error"
    assert parse(b"x = " + b"(" * 5000 + b")" * 5000)["parse_status"] in ("error", "syntax_error")
    plain, marked = parse(PIPELINE.encode()), parse(b"\xef\xbb\xbf" + PIPELINE.encode())
    assert plain == marked and parse(b"")["parse_status"] == "ok"
    got = index({"bad.py": "def (", "good.py": PIPELINE, "none.py": ""})
    assert len(got["graphs"]) == 1


def test_hashes_leave_decorators_out(index):
    body = "def f(s):\n    return s\n"
    got = index({"a.py": HEAD + body + "g.add_node(f)\n", "b.py": HEAD + "@deco\n" + body + "g.add_node(f)\n"})
    assert len({n["function_body_hash"] for n in got["nodes"]}) == 1 and len({n["line_start"] for n in got["nodes"]}) == 1


def test_odd_literals_and_long_modules_stop_nothing(index):
    many = HEAD + "".join(f'g.add_edge("a{i}", "a{i + 1}")\n' for i in range(2100)) + 'g.add_conditional_edges("a0", f, ["x", "y"])\n'
    got = index({"odd.py": HEAD + 'g.add_node("\\ud800", f)\n', "many.py": many})
    assert [n["name"] for n in got["nodes"]] == ["\\ud800"]
    edges = sorted((e for e in got["edges"] if e["graph_id"].startswith("many")), key=lambda e: e["edge_ord"])
    assert [e["target"] for e in edges] == [f"a{i + 1}" for i in range(2100)] + ["x", "y"]


def test_facts_from_sql(spark):
    from flowlens.sources import table_function

    table_function.register(spark)
    text = "from a import b as c\ng = StateGraph(dict)\ndef f(s): ...\ng.add_node('n', f)\ng.add_edge('n', c)\ng.set_entry_point('n')\n"
    text = "from flowlib import StateGraph\n" + text
    spark.createDataFrame([("x.py", text), ("bad.py", "def ("), ("none.py", None)], "path string, content string").createOrReplaceTempView("some_files")
    got = {(r["path"], r["kind"], r["name"], r["source"], r["target"], r["line_start"]) for r in spark.sql("SELECT * FROM parse_files(TABLE(some_files))").collect()}
    assert {g for g in got if g[1] not in ("import", "status")} == {("x.py", "builder", "g", None, None, None), ("x.py", "function", "f", None, None, 4), ("x.py", "add_node", "n", None, None, 5), ("x.py", "add_edge", None, "n", "c", 6), ("x.py", "set_entry_point", "n", None, None, 7)}
    assert {(g[0], g[2]) for g in got if g[1] == "status"} == {("x.py", "ok"), ("bad.py", "syntax_error"), ("none.py", "ok")}
    assert ("x.py", "import", "c", "a", "b", None) in got
    one = spark.sql("SELECT f.path, p.name FROM some_files f, LATERAL parse_source(f.content) p WHERE p.kind = 'status'").collect()
    assert {tuple(r) for r in one} == {(g[0], g[2]) for g in got if g[1] == "status"}


def test_segments_are_those_of_the_library(tmp_path):
    import ast

    from flowlens.sources.kernel import FileFacts

    texts = ["def f():\r\n    é = 'ü'\r\n    return é\r\nclass A:\n  def g(self): return 'ß'; x = 1\n", "x = 'é'; f = lambda: 'ü'\ndef h(a='é', *, b='\x0c'): pass", "async def k():\n\x0c    await z\n\ndef l(): ...\r@d\rdef m(): ...\r"]
    for text in [*texts, open(ast.__file__, encoding="utf-8").read()]:
        facts = FileFacts(text)
        for node in facts.order:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda, ast.Call)) and len(text) < 10_000 or isinstance(node, ast.ClassDef):
                assert facts.segment(node) == ast.get_source_segment(text, node)


def test_large_files_take_time_in_proportion():
    import time

    from flowlens.sources.kernel import parse

    def seconds(n):
        text = "".join(f"def f{i}(state):\n    return state\n" for i in range(n)).encode()
        began = time.process_time()
        parse(text)
        return time.process_time() - began

    assert seconds(16_000) < 20 * seconds(2_000) + 1
