"""Search, routes, batches, the store, the verbs and the command line."""

import io
import json
import random
import time
from collections import deque
from concurrent.futures import ThreadPoolExecutor
from hashlib import md5
from threading import Event

import pytest
from flowlens.api import Engine
from flowlens.cli import main
from flowlens.functions import vectors
from flowlens.operators import embed, graphops, search
from flowlens.schemas import PARTS, TABLES, columns
from flowlens.server import serve
from flowlens.sources import database
from flowlens.sources.paths import Ignore, guard
from flowlens.sources.store import Conflict, Store
from flowlens.sources.tree import Tree, list_tree, read_tree
from pyspark.sql import functions as F

E = "repo_id string, graph_id string, source string, target string, edge_ord long, edge_id string, type string, condition_function_name string"


def _edges(spark, pairs, graph="g"):
    return spark.createDataFrame([("r", graph, a, b, i, f"{graph}{a}{b}{i}", "normal", None) for i, (a, b) in enumerate(pairs)], E)


def _queue(pairs, a, b):
    near, before, waiting = {}, {a: None}, deque([a])
    for x, y in pairs:
        near.setdefault(x, []).append(y)
    while waiting:
        at = waiting.popleft()
        if at == b:
            path = [at]
            while before[path[-1]] is not None:
                path.append(before[path[-1]])
            return path[::-1]
        for y in near.get(at, []):
            if y not in before:
                before[y] = at
                waiting.append(y)
    return None


def test_routes_equal_a_queue_search(spark):
    rng = random.Random(1)
    pairs = {f"g{k}": [(f"n{rng.randrange(7)}", f"n{rng.randrange(7)}") for _ in range(rng.randrange(4, 16))] for k in range(12)}
    edges = None
    for g, p in pairs.items():
        one = _edges(spark, p, g)
        edges = one if edges is None else edges.unionByName(one)
    asked = [("r", g, f"n{a}", f"n{b}") for g in pairs for a, b in ((0, 6), (3, 1), (2, 2))]
    requests = spark.createDataFrame(asked, "repo_id string, graph_id string, from_node string, to_node string")
    got = {(r["graph_id"], r["from_node"], r["to_node"]): list(r["route"]) for r in graphops.shortest_routes(edges.cache(), requests, cut=lambda _, df: spark.createDataFrame(df.collect(), df.schema)).collect()}
    for _, g, a, b in asked:
        assert got.get((g, a, b)) == _queue(pairs[g], a, b)
    reach = {(r["graph_id"], r["node"]): r["distance"] for r in graphops.reachable_within(edges, requests.where("from_node = 'n0'"), 20, cut=lambda _, df: spark.createDataFrame(df.collect(), df.schema)).collect()}
    for g in pairs:
        expected = _queue(pairs[g], "n0", "n6")
        assert reach.get((g, "n6")) == (len(expected) - 1 if expected else None)


def test_routes_from_both_ends_are_those_from_one(spark, tmp_path):
    # a ladder of choices: two ways a step, all equally long, and dead ends; and graphs by chance
    rng = random.Random(2)
    pairs = {"ladder": [(f"{x}{i}", f"{y}{i + 1}") for i in range(8) for x in "ab" for y in "ba"]}
    pairs["ladder"] += [("s", "a0"), ("s", "b0"), ("a8", "t"), ("b8", "t"), *((f"a{i}", f"dead{i}") for i in range(8))]
    pairs |= {f"g{k}": [(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(rng.randrange(6, 24))] for k in range(10)}
    rows = [("r", g, f"{g}|{i}", i, a, b) for g, p in pairs.items() for i, (a, b) in enumerate(p)]
    edges = spark.createDataFrame(rows, "repo_id string, graph_id string, edge_id string, edge_ord long, source string, target string").cache()
    asked = [("r", g, f"n{a}", f"n{b}") for g in pairs if g != "ladder" for a in range(9) for b in range(9)] + [("r", "ladder", "s", "t"), ("r", "ladder", "t", "s"), ("r", "ladder", "s", "dead7"), ("r", "ladder", "nowhere", "t")]
    requests = spark.createDataFrame([*asked, asked[0]], "repo_id string, graph_id string, from_node string, to_node string").cache()

    def cut(kind):
        def keep(name, df):
            path = f"file://{tmp_path}/{kind}{len(list(tmp_path.iterdir()))}"
            df.write.parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        return keep

    every = lambda df: sorted((r["graph_id"], r["from_node"], r["to_node"], r["hops"], tuple(r["route"]), tuple(r["edge_ids"])) for r in df.collect())
    got = every(graphops.meeting_routes(edges, requests, cut("both")))
    assert got == every(graphops.shortest_routes(edges, requests, cut("one")))
    assert {x[:3]: list(x[4]) for x in got} == {(g, a, b): _queue(pairs[g], a, b) for _, g, a, b in asked if _queue(pairs[g], a, b)}
    assert graphops.meeting_routes(edges.where("false"), requests, cut("none")).where("from_node != to_node").isEmpty()
    assert graphops.meeting_routes(edges, requests.where("false"), cut("none")).isEmpty()


def test_both_ends_write_fewer_rows_on_a_tree(spark, tmp_path):
    # three ways a node, seven deep: the end is reached from behind in one way
    rows = [("r", "tree", f"e{i}-{k}", 3 * i + k, f"n{i}", f"n{3 * i + k + 1}") for i in range((3**7 - 1) // 2) for k in range(3)]
    edges = spark.createDataFrame(rows, "repo_id string, graph_id string, edge_id string, edge_ord long, source string, target string").cache()
    asked = spark.createDataFrame([("r", "tree", "n0", f"n{(3**7 - 1) // 2 + 5}")], "repo_id string, graph_id string, from_node string, to_node string")
    written: dict[str, int] = {}

    def cut(kind):
        def keep(name, df):
            path = f"file://{tmp_path}/{kind}{len(list(tmp_path.iterdir()))}"
            df.write.parquet(path)
            back = spark.read.schema(df.schema).parquet(path)
            written[kind] = written.get(kind, 0) + (back.count() if name.startswith(("level", "side")) else 0)
            return back

        return keep

    one, both = graphops.shortest_routes(edges, asked, cut("one")).collect(), graphops.meeting_routes(edges, asked, cut("both")).collect()
    assert one == both and one[0]["hops"] == 7
    assert written["both"] * 20 < written["one"]


def test_search(spark):
    rows = spark.createDataFrame([("r", "g", "a", [42.0, 0.0]), ("r", "g", "b", [0.0, 1.0]), ("r", "h", "c", [1.0, 1.0])], "repo_id string, graph_id string, chunk_id string, vector array<float>")
    got = [(r["chunk_id"], round(r["score"], 5)) for r in search.top_k(rows, [2.0, 0.0], 5).collect()]
    assert got == [("a", 1.0), ("c", 0.70711), ("b", 0.0)]
    assert [r["chunk_id"] for r in search.top_k(rows, [2.0, 0.0], 5, filters={"graph_id": "h"}).collect()] == ["c"]
    for bad in (0, -1, True, 2.5, None):
        with pytest.raises(ValueError, match="top_k must be >= 1"):
            search.top_k(rows, [1.0, 0.0], bad)
    with pytest.raises(ValueError, match="Unsupported search filter"):
        search.top_k(rows, [1.0, 0.0], 1, filters={"x": "y"})
    with pytest.raises(ValueError, match="dimension"):
        search.top_k(rows, [1.0], 1, dimension=2)


def test_batches_do_not_change_vectors(spark):
    assert embed.plan_batches([5, 1, 3], 6) == [[1, 2], [0]] and embed.plan_batches([9], 4) == [[0]] and embed.plan_batches([]) == []
    texts = [f"word {'x' * (i * 7 % 50)} more.words_{i}" for i in range(40)] + [""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    hashing = embed.HashingProvider()
    own = {r["id"]: list(r["vector"]) for r in embed.embed_column(rows, "text", hashing).collect()}
    other = embed.FunctionProvider("f", 16, hashing.embed)
    assert own == {r["id"]: list(r["vector"]) for r in embed.embed_column(rows, "text", other).collect()}
    model = embed.ModelProvider("m", 16, lambda: hashing.embed, document="", query="")
    assert own == {r["id"]: list(r["vector"]) for r in embed.embed_column(rows, "text", model).collect()} and model.embed_query("a b") == hashing.embed_query("a b")
    prefixed = embed.ModelProvider("p", 16, lambda: hashing.embed)
    assert prefixed.embed(["x"]) == hashing.embed(["search_document: x"]) and prefixed.embed_query("x") == hashing.embed_query("search_query: x")
    # batches span the Arrow batches of a task, and are filled as by one plan of all texts
    many = spark.range(3000).selectExpr("id", "repeat('x', int(pow(id % 977, 1.3) / 9)) AS text").repartition(7)
    shape = embed.FunctionProvider("b", 3, lambda t: [[1.0, float(len(t)), float(max(map(len, t)))] for _ in t])
    raw = embed.embed_column(many, "text", shape, budget=900).selectExpr("length(text) AS n", "round(vector[1] / vector[0]) AS texts", "round(vector[2] / vector[0]) AS longest").collect()
    assert len(raw) == 3000 and all(r["n"] <= r["longest"] and (r["texts"] * r["longest"] <= 900 or r["texts"] == 1) for r in raw)
    padded = sum(r["longest"] for r in raw)
    lengths = [r["n"] for r in raw]
    planned = sum(len(b) * max(lengths[i] for i in b) for b in embed.plan_batches(lengths, 900))
    assert padded <= 1.03 * planned
    wide = embed.HashingProvider(300)
    assert wide.column(F.col("text")) is None
    counted = {r["id"]: list(r["v"]) for r in rows.select("id", vectors.unit(vectors.hashed("text", 300)).cast("array<float>").alias("v")).collect()}
    assert counted == {r["id"]: list(r["vector"]) for r in embed.embed_column(rows, "text", wide).collect()}
    short = embed.FunctionProvider("s", 16, lambda t: [])
    with pytest.raises(Exception, match="0 vectors"):
        embed.embed_column(rows, "text", short).collect()
    lengths = [len(t) for t in texts]
    for extra in ([], [0] * 7, [3] * 500, [900] * 5, [None]):
        sizes = [*lengths, *extra]
        planned = {r["id"]: r["batch"] for r in embed.batch_numbers(spark.createDataFrame(list(enumerate(sizes)), "id long, n long"), "n", "id", 200).collect()}
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i] or 0, md5(str(i).encode()).hexdigest()))
        assert planned == {order[j]: b for b, places in enumerate(embed.plan_batches([sizes[i] or 0 for i in order], 200)) for j in places}


@pytest.mark.parametrize("path", [None, "", "  ", "\t", "../x", "a/../b", "..", "/a/..", "a\\..\\b"])
def test_paths_that_are_refused(path):
    with pytest.raises(ValueError):
        guard(path)


@pytest.mark.parametrize("entries", [1, 3, 10_000])
def test_which_files_are_read(spark, tmp_path, entries):
    for p in ("a.py", "pkg/__init__.py", "pkg/_b.py", "_own/c.py", ".d.py", "pkg/gen/c.py", "build/d.py", ".git/e.py", "x.egg-info/f.py", "keep/g=1.py", "t.txt", "keep/skip_me.py", "pkg/deep/er/still/h [x].py"):
        (tmp_path / "r" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / p).write_text(p)
    root, outside = tmp_path / "r", tmp_path / "outside.py"
    outside.write_text("")
    (root / "link.py").symlink_to(outside)
    (root / "inner.py").symlink_to(root / "a.py")
    (root / "linked").symlink_to(root / "pkg")
    (root / "round").symlink_to(root)
    (root / ".gitignore").write_text("# note\n!a.py\n/pkg/gen/\nskip_*\n")
    expected = {"a.py": False, "pkg/__init__.py": False, "pkg/_b.py": False, "_own/c.py": False, ".d.py": False, "pkg/gen/c.py": True, "build/d.py": True, "x.egg-info/f.py": True, "keep/g=1.py": False, "keep/skip_me.py": True, "pkg/deep/er/still/h [x].py": False, "inner.py": False}
    for place in (root, f"file://{root}"):
        rows = list_tree(spark, Tree.of(place), entries).collect()
        assert {r["path"]: r["is_ignored"] for r in rows} == expected and len(rows) == len(expected)
    if entries > 3:
        read = {r["path"]: (bytes(r["content"]).decode(), r["is_ignored"], r["repo_id"]) for r in read_tree(spark, root).collect()}
        assert read == {p: ("a.py" if p == "inner.py" else p, i, root.as_posix()) for p, i in expected.items()}
        assert {r["repo_id"] for r in read_tree(spark, f"file://{root}").collect()} == {f"file://{root}"}
        (tmp_path / "none").mkdir()
        assert read_tree(spark, tmp_path / "none").collect() == []


def test_ignore_patterns():
    rules = Ignore.parse("*.tmp\n/top\nfolder/\na/*.py")
    assert rules.hides("x/y.tmp", False) and rules.hides("top", True) and rules.hides("top/z", False) and not rules.hides("x/top", True)
    assert rules.hides("x/folder", True) and not rules.hides("x/folder", False) and rules.hides("a/b/c.py", False)


MAIN = """from flowlib import StateGraph, START, END, ToolNode, Command
from kit import search
g = StateGraph(dict)
def check(state):
    '''Verify the login token.'''
    return state
def route(state):
    return Command(goto=["fetch", END])
def fetch(state):
    '''Read the database.'''
    model.bind_tools(tools)
def format(state): ...
def odd(state): return Command(goto=where)
g.add_node("check", check)
g.add_node("route", route)
g.add_node("fetch", fetch)
g.add_node("format", format)
g.add_node("odd", odd)
g.add_node("tools", ToolNode([search, kit.find]))
g.add_edge(START, "check")
g.add_conditional_edges("check", pick, {"ok": "route", "no": END})
g.add_edge("fetch", "format")
"""


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("répo [x]")
    (root / "main.py").write_text(MAIN, encoding="utf-8")
    return root


@pytest.fixture(scope="module")
def engine(spark, repo):
    found = Engine(spark)
    assert found.repository_status(repo) == {"indexed": False, "path": repo.as_posix(), "suggestion": "call index_repo first"}
    assert found.get_graph_summary(repo)["error"] == "not_indexed" and not (repo / ".flowlens").exists()
    answer = found.index_repo(repo)
    assert {k: answer[k] for k in ("graphs_found", "nodes_indexed", "edges_indexed", "partial_nodes", "backend")} == {"graphs_found": 1, "nodes_indexed": 6, "edges_indexed": 6, "partial_nodes": 0, "backend": "parquet"}
    return found


def test_summary_and_status(engine, repo):
    (one,) = engine.get_graph_summary(repo)["graphs"]
    assert one == {"variable_name": "g", "file_path": "main.py", "entry_point": "check", "node_count": 6, "edge_count": 6, "nodes": ["check", "route", "fetch", "format", "odd", "tools"]}
    status = engine.repository_status(repo)
    assert status["indexed"] and status["node_count"] == 6 and status["last_indexed_at"]


def test_trace(engine, repo):
    got = engine.trace_path("__start__", "format", repo)
    assert got["route"] == ["__start__", "check", "route", "fetch", "format"] and got["path_found"]
    assert [(b["source"], b["condition_value"], b["value_resolution"]) for b in got["conditional_branches"]] == [("check", "ok", "known"), ("route", None, "not_derivable")]
    assert engine.trace_path("odd", "odd", repo)["route"] == ["odd"]
    none = engine.trace_path("format", "check", repo)
    assert not none["path_found"] and none["unresolved_routing_nodes"] == [{"node_name": "odd", "file_path": "main.py"}]
    assert engine.trace_path("nobody", "check", repo) == {"error": "unknown_node", "node": "nobody", "valid_nodes": ["check", "fetch", "format", "odd", "route", "tools"]}


def test_tools_and_branches(engine, repo):
    got = engine.what_calls_tool(" find ", repo)
    assert got == {"callers": [{"node_name": "tools", "file_path": "main.py", "tool_name": "find", "tool_source": None}], "unenumerated_tool_nodes": [{"node_name": "fetch", "file_path": "main.py"}]}
    assert engine.what_calls_tool("search", repo)["callers"][0]["tool_source"] == "kit"
    assert engine.what_calls_tool(" ", repo) == {"error": "empty_tool_name"}
    branch = engine.explain_conditional("check", repo)
    assert branch["condition_function"] == "pick" and [d["target_node"] for d in branch["possible_destinations"]] == ["route", "__end__"] and "note" not in branch
    assert "note" in engine.explain_conditional("route", repo)
    assert engine.explain_conditional("odd", repo)["error"] == "routing_not_resolvable" and engine.explain_conditional("format", repo)["error"] == "not_conditional"
    assert engine.explain_conditional("__end__", repo)["error"] == "unknown_node"


def test_meaning(engine, repo):
    got = engine.semantic_search_nodes("verify the login token", repo, 2)["results"]
    assert len(got) == 2 and got[0]["node_name"] == "check" and got[0]["score"] >= got[1]["score"]
    assert engine.semantic_search_nodes(" ", "nowhere")["error"] == "empty_query"
    for bad in (0, -1, "five", 2.5, None, True):
        assert engine.semantic_search_nodes("x", repo, bad) == {"error": "invalid_top_k", "top_k": bad}


def test_bad_places(engine, repo):
    assert engine.index_repo(None)["error"] == engine.index_repo("a/../b")["error"] == "invalid_path"
    assert engine.index_repo("/no/such/place")["error"] == "path_not_found" and engine.index_repo(repo / "main.py")["error"] == "not_a_directory"


def test_indexing_again_replaces(spark, tmp_path):
    engine = Engine(spark)
    (tmp_path / "m.py").write_text(MAIN)
    engine.index_repo(tmp_path)
    (tmp_path / "m.py").write_text(MAIN.replace('g.add_node("format", format)\n', ""))
    assert engine.reindex(tmp_path)["nodes_indexed"] == 5 and engine.get_graph_summary(tmp_path)["graphs"][0]["edge_count"] == 6
    (tmp_path / "m.py").unlink()
    assert engine.index_repo(tmp_path)["graphs_found"] == 0 and engine.get_graph_summary(tmp_path) == {"graphs": []}
    store = Store(spark, f"file://{tmp_path}/.flowlens")
    manifest = max((tmp_path / ".flowlens").rglob("manifest-*.json"))
    manifest.write_text("{broken")
    (manifest.parent / f".{manifest.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="damaged"):
        store.get_repository(tmp_path.as_posix())
    assert engine.get_graph_summary(tmp_path)["error"] == "internal_error"
    (tmp_path / "m.py").write_text(MAIN)
    assert engine.index_repo(tmp_path)["graphs_found"] == 1 and len(engine.get_graph_summary(tmp_path)["graphs"]) == 1
    other = Engine(spark, provider=embed.HashingProvider(32))
    assert other.semantic_search_nodes("login", tmp_path)["error"] == "embedding_model_mismatch"


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    chunk = lambda i, text, v: ("r", "g", f"c{i}", "n", "n", "f", 1, 1, None, text, "m", 2, v)
    frame = lambda *rows: spark.createDataFrame(list(rows), TABLES["chunks"])
    assert not store.is_indexed("r") and store.table("r", "nodes").count() == 0 and not (tmp_path / "s").exists()
    store.replace("r", "/r", {"chunks": frame(chunk(1, "old", [1.0, 0.0]), chunk(2, "old", [0.0, 1.0]))}, "m", 2)
    store.replace("q", "/q", {}, "m", 2)
    store.upsert_chunks("r", frame(chunk(2, "new", [1.0, 0.0])))
    assert {(r["chunk_id"], r["text"]) for r in store.table("r", "chunks").collect()} == {("c1", "old"), ("c2", "new")}
    with pytest.raises(ValueError, match="dimension"):
        store.upsert_chunks("r", frame(chunk(3, "x", [1.0])))
    with pytest.raises(ValueError, match="dimension"):
        store.search([1.0], 1, {"repo_id": "r"})
    assert [r["chunk_id"] for r in store.search([1.0, 0.0], 5, {"repo_id": "r"}).collect()] == ["c1", "c2"]
    assert {r["repo_id"] for r in store.search([1.0, 0.0], 5, {}).collect()} == {"r"} and store.repositories() == ["q", "r"]
    # a reader that began before an upsert can go on
    reading = store.table("r", "chunks")
    store.upsert_chunks("r", frame(chunk(4, "later", [1.0, 0.0])))
    assert reading.count() == 2 and store.table("r", "chunks").count() == 3
    graph = lambda i, f: spark.createDataFrame([("r", i, f, "g", None)], TABLES["graphs"])
    store.upsert_graphs("r", {"graphs": graph("g", "f").unionByName(graph("h", "f"))})
    assert store.table("r", "chunks").count() == 0  # all were of graph g, which came without chunks
    store.upsert_graphs("r", {"graphs": graph("h", "new"), "chunks": frame(("r", "h", "c9", "n", "n", "f", 1, 1, None, "t", "m", 2, [0.5, 1.0]))})
    assert {(r["graph_id"], r["file_path"]) for r in store.table("r", "graphs").collect()} == {("g", "f"), ("h", "new")}
    store.delete_repo("r")
    store.delete_repo("unknown")
    assert not store.is_indexed("r") and store.is_indexed("q") and store.get_repository("q").root_path == "/q"


def test_an_index_goes_to_a_database_and_back(spark, tmp_path):
    store, url = Store(spark, f"file://{tmp_path}/s"), f"jdbc:derby:{tmp_path}/db;create=true"
    chunk = lambda repo, i: (repo, "g", f"c{i}", "n", "n", "it's", 1, 1, None, "text", "m", 2, [0.5, float(i)])
    frame = lambda repo, n: spark.createDataFrame([chunk(repo, i) for i in range(n)], TABLES["chunks"])
    graphs = lambda repo: spark.createDataFrame([(repo, "g", "f", "g", None)], TABLES["graphs"])
    for repo, n in (("it's", 20), ("other", 3)):
        store.replace(repo, f"/{repo}", {"chunks": frame(repo, n), "graphs": graphs(repo)}, "m", 2)
        database.export(store, repo, url)
    before = {n: contents(store.table("it's", n)) for n in PARTS}
    # exported again with other rows, and with a failure in between that changes nothing
    store.upsert_chunks("it's", frame("it's", 1).withColumn("text", F.lit("new")))
    with pytest.raises(Exception):  # noqa: B017
        database.export(store, "it's", url.replace("create=true", "create=false") + "x", prefix="flow_")
    assert contents(database.read(spark, url, "chunks", "it's").select(*columns("chunks"))) == before["chunks"]
    database.export(store, "it's", url)
    assert database.read(spark, url, "chunks", "it's").rdd.getNumPartitions() == 8
    back = Store(spark, f"file://{tmp_path}/t")
    for repo in ("it's", "other"):
        database.load(back, repo, url)
        assert all(contents(back.table(repo, n)) == contents(store.table(repo, n)) for n in PARTS)
        assert back.get_repository(repo).root_path == f"/{repo}"
    for call in (database.load, database.export):
        with pytest.raises(ValueError, match="no index"):
            call(back, "nowhere", url)


def contents(df):
    return sorted(map(str, df.collect()))


def test_two_writers_lose_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    frame = lambda *ids: spark.createDataFrame([("r", "g", i, "n", "n", "f", 1, 1, None, "t", "m", 2, [1.0, 0.0]) for i in ids], TABLES["chunks"])
    first = store.replace("r", "/r", {"chunks": frame("c0")}, "m", 2)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: Store(spark, store.root).upsert_chunks("r", frame(f"a{i}", "c0")), range(6)))
    assert sorted(r["chunk_id"] for r in store.table("r", "chunks").collect()) == ["a0", "a1", "a2", "a3", "a4", "a5", "c0"]
    assert store.versions("r") == [5, 6, 7]  # older ones are gone, with their folders
    assert len(list((tmp_path / "s").glob("*/v-*"))) <= 1 + 3 * 1 + 1
    # one after the other: a writer that began before the last change is told so
    with pytest.raises(Conflict):
        store.refresh(first, spark.createDataFrame([], "path string"), {"files": store.table("r", "files")})
    earlier = store.table("r", "chunks", 6)
    assert earlier.count() == 6 and store.get_repository("r", 2) is None


def test_tables_of_earlier_schemas_are_read(spark, tmp_path, monkeypatch):
    from flowlens.schemas import VERSION
    from flowlens.sources import store as stored

    store = Store(spark, f"file://{tmp_path}/s")
    node = ("r", "g", "g::n", 0, "n", "f", 1, 1, "Doc.", "", "full", "full", "full")
    tables = {"graphs": spark.createDataFrame([("r", "g", "f", "g", None)], TABLES["graphs"]), "nodes": spark.createDataFrame([node], TABLES["nodes"])}
    info = store.replace("r", "/r", tables, "m", 2)
    assert set(info.schemas.values()) == {VERSION} and set(info.schemas) == set(TABLES)
    # as the first version wrote it: no state of routing, no versions in the manifest
    folder = tmp_path / "s" / Store.key("r")
    tables["nodes"].drop("routing_resolution").write.mode("overwrite").parquet(f"file://{folder}/{info.version}/nodes")
    manifest = folder / "manifest-000000001.json"
    stated = json.loads(manifest.read_text())
    del stated["schemas"]
    manifest.write_text(json.dumps(stated))
    state = lambda: [r["routing_resolution"] for r in store.table("r", "nodes").collect()]
    assert state() == ["not_applicable"]
    # an upsert of other tables leaves the old one and its version; one of graphs writes it anew
    chunk = ("r", "g", "c", "n", "n", "f", 1, 1, None, "t", "m", 2, [1.0, 0.0])
    store.upsert_chunks("r", spark.createDataFrame([chunk], TABLES["chunks"]))
    found = store.get_repository("r")
    assert (found.schema("nodes"), found.schema("chunks")) == (1, VERSION) and state() == ["not_applicable"]
    store.replace("q", "/q", {"chunks": spark.createDataFrame([("q", *chunk[1:])], TABLES["chunks"])}, "m", 2)
    assert sorted(r["repo_id"] for r in store.search([1.0, 0.0], 5, {}).collect()) == ["q", "r"]
    store.upsert_graphs("r", {"graphs": spark.createDataFrame([("r", "h", "f", "h", None)], TABLES["graphs"])})
    assert store.get_repository("r").schema("nodes") == VERSION and state() == ["not_applicable"]
    # steps are taken one by one, each from what the one before made, and only those that a table lacks
    monkeypatch.setattr(stored, "VERSION", VERSION + 2)
    monkeypatch.setattr(stored, "ADDED", stored.ADDED | {VERSION + 1: {"nodes": {"docstring": "concat('of ', name)"}}, VERSION + 2: {"nodes": {"source_file": "upper(docstring)"}}})
    rows = spark.createDataFrame([node[:5] + (None, 1, 1, None, *node[9:])], TABLES["nodes"])
    assert [tuple(r) for r in stored.migrated(rows, "nodes", VERSION).select("docstring", "source_file").collect()] == [("of n", "OF N")]
    assert [tuple(r) for r in stored.migrated(rows, "nodes", VERSION + 1).select("docstring", "source_file").collect()] == [(None, None)]
    store.replace("late", "/late", {}, "m", 2)
    monkeypatch.undo()
    for read in (lambda: store.get_repository("late"), store.repositories):
        with pytest.raises(ValueError, match="later version"):
            read()


def test_command_line(engine, repo, tmp_path):
    out, err = io.StringIO(), io.StringIO()
    assert main(["status", str(repo), "--json"], engine, out, err) == 0 and json.loads(out.getvalue())["indexed"]
    assert main(["status", str(tmp_path)], engine, out, err) == 1 and main(["index", "a/../b"], engine, out, err) == 2
    assert main(["what"], engine, out, err) == 2 and main(["--help"], engine, out, err) == 0
    (tmp_path / "plain.py").write_text("x = 1\n")
    assert main(["index", str(tmp_path)], engine, out, err) == 1
    asked = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "get_graph_summary", "arguments": {"path": str(repo)}}}, {"id": 4, "method": "tools/call", "params": {"name": "trace_path", "arguments": {}}}, {"id": 5, "method": "what"}]
    # messages of odd forms get errors and end nothing
    odd = [{"id": 6, "method": "tools/call", "params": [1]}, {"id": 7, "method": "tools/call", "params": {"name": ["x"]}}, {"id": 8, "method": "tools/call", "params": {"name": "trace_path", "arguments": [1]}}, {"id": 9, "method": 3}, {"id": 10, "method": "tools/call", "params": {"name": "repository_status", "arguments": {"path": str(repo)}}}, {"method": "notifications/cancelled", "params": {"requestId": 99}}, {"method": "notifications/cancelled", "params": 1}]
    said = io.StringIO()
    serve(engine, [*map(json.dumps, asked + odd), "{broken", "", "7", "[]"], said)
    told = {}
    for t in map(json.loads, said.getvalue().splitlines()):
        told.setdefault(t["id"], []).append(t)
    assert set(told) == {*range(1, 11), None} and len(told[2][0]["result"]["tools"]) == 7
    assert json.loads(told[3][0]["result"]["content"][0]["text"])["graphs"]
    assert [told[i][0]["error"]["code"] for i in range(4, 11)] == [-32602, -32601, -32602, -32602, -32602, -32600, -32602]
    assert [t["error"]["code"] for t in told[None]] == [-32700, -32600, -32600]
    narrow = io.TextIOWrapper(io.BytesIO(), encoding="ascii")
    assert main(["status", str(repo)], engine, narrow, err) == 0
    narrow.seek(0)
    assert "r\\xe9po" in narrow.read()


def test_calls_from_many_threads(engine, repo):
    path = str(repo)
    calls = [
        lambda: engine.get_graph_summary(path),
        lambda: engine.semantic_search_nodes("login", path),
        lambda: engine.trace_path("check", "format", path),
        lambda: engine.explain_conditional("check", path),
        lambda: engine.what_calls_tool("search", path),
        lambda: engine.repository_status(path),
    ]
    with ThreadPoolExecutor(8) as pool:
        results = list(pool.map(lambda call: call(), calls * 8))
    assert len(results) == 48 and not [r for r in results if "error" in r]
    assert all(results[i] == results[i % 6] for i in range(48))


def test_a_call_can_be_cancelled(spark):
    class Slow:
        def __init__(self):
            self.spark, self.began = spark, Event()

        def get_graph_summary(self, path):
            self.began.set()
            return {"rows": spark.range(0, 10**6, 1, 2).selectExpr("sum(reflect('java.lang.Thread', 'sleep', 1L) is null)").collect()}

    engine, said = Slow(), io.StringIO()

    def lines():
        yield json.dumps({"id": "a", "method": "tools/call", "params": {"name": "get_graph_summary", "arguments": {"path": "x"}}})
        engine.began.wait(30)
        time.sleep(2)
        yield json.dumps({"method": "notifications/cancelled", "params": {"requestId": "a"}})

    began = time.monotonic()
    serve(engine, lines(), said)
    assert json.loads(said.getvalue())["error"]["code"] == -32603 and time.monotonic() - began < 60
