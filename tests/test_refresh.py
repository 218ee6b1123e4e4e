"""Indexing by difference gives what indexing anew gives, and parses what changed only."""

import random

from flowlens.api import Engine
from flowlens.operators.assemble import assemble
from flowlens.operators.refresh import difference
from flowlens.sources.scan import facts
from flowlens.sources.store import Store

FILES = "repo_id string, path string, content string, is_ignored boolean"
PARTS = ("graphs", "nodes", "edges", "routes", "tool_bindings")
HEAD = "from flowlib import StateGraph, START, END, ToolNode, Command\n"


def module(rng, others):
    """Imports some functions, defines some, and uses both in a graph."""
    text, names = HEAD, [f"f{i}" for i in range(5)]
    for name in names:
        if rng.random() < 0.5:
            text += f"from {rng.choice(others)} import {name}\n"
        elif rng.random() < 0.5:
            body = rng.choice(["return state", f"return Command(goto='f{rng.randrange(5)}')", "m.bind_tools([search, find])", "return Command(goto=where)"])
            text += f"def {name}(state):\n    '''Version {rng.randrange(100)}.'''\n    {body}\n"
    if rng.random() < 0.6:
        text += "g = StateGraph(dict)\n" + "".join(f'g.add_node("{n}", {n})\n' for n in names if rng.random() < 0.7) + f'g.add_edge(START, "{rng.choice(names)}")\n'
    return text


def rows(df):
    columns = sorted(df.columns)
    return sorted(str([r[c] for c in columns]) for r in df.collect())


def test_edits_give_what_a_full_index_gives(spark):
    rng = random.Random(11)
    # a package and a module of one name, relative imports, and names that no file has
    paths = [f"m{i}.py" for i in range(12)] + ["pkg/__init__.py", "pkg/a.py", "pkg/b.py", "m3/__init__.py"]
    others = [f"m{i}" for i in range(14)] + ["pkg", "pkg.a", "pkg.b", ".a", ".", "..m1", "nowhere"]
    tree = {p: (module(rng, others), False) for p in paths[:-1]}
    frame = lambda t: spark.createDataFrame([("r", p, c, i) for p, (c, i) in t.items()], FILES)
    stored = facts(frame(tree))
    held = {n: rows(getattr(assemble(stored), n)) for n in PARTS}
    index = assemble(stored)
    for step in range(2):
        old = dict(tree)
        for p in rng.sample(paths, 5):
            roll = rng.random()
            if p in tree and roll < 0.3:
                del tree[p]
            elif p in tree and roll < 0.4:
                tree[p] = (tree[p][0], not tree[p][1])
            else:
                tree[p] = (module(rng, others), False)
        if step == 1:
            tree["broken.py"] = ("def (", False)
        found = difference(stored, frame(tree))
        stale = found.stale.collect()
        assert {r["path"] for r in found.parsed.select("path").collect()} == {p for p, f in tree.items() if old.get(p) != f}
        files = {r["path"] for r in stale}
        assert files >= {p for p in {*tree, *old} if tree.get(p) != old.get(p)}
        current = spark.createDataFrame(found.files.collect(), found.files.schema)
        full = assemble(current)
        gone = [r["graph_id"] for r in index.graphs.collect() if r["file_path"] in files]
        for n in PARTS:
            kept = getattr(index, n)
            merged = rows(kept.where(~kept["graph_id"].isin(gone))) + rows(getattr(found.index, n))
            assert sorted(merged) == rows(getattr(full, n)), (step, n)
        assert {r["path"] for r in current.collect()} == set(tree)
        stored, index = current, full
    assert held["nodes"]


def test_reindex_parses_changed_files_only(spark, tmp_path, monkeypatch):
    from flowlens.operators import refresh

    parsed = []

    def counted(files):
        parsed.append(sorted(r["path"] for r in files.select("path").collect()))
        return facts(files)

    monkeypatch.setattr(refresh, "facts", counted)
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "__init__.py").write_text("from .inner import work\n")
    (tmp_path / "lib" / "inner.py").write_text("def work(state):\n    '''Before.'''\n    return state\n")
    (tmp_path / "main.py").write_text(HEAD + 'from lib import work\ng = StateGraph(dict)\ng.add_node("work", work)\ng.add_edge(START, "work")\n')
    (tmp_path / "alone.py").write_text(HEAD + 'h = StateGraph(dict)\nh.add_node("x", lambda s: s)\n')
    engine = Engine(spark)
    assert engine.reindex(tmp_path)["graphs_found"] == 2 and parsed == []  # there was none
    store = Store(spark, f"file://{tmp_path}/.flowlens")
    texts = lambda: {r["node_name"]: r["text"] for r in store.table(tmp_path.as_posix(), "chunks").collect()}
    assert "Before." in texts()["work"]
    (tmp_path / "lib" / "inner.py").write_text("def work(state):\n    '''After.'''\n    return Command(goto='x')\n")
    answer = engine.reindex(tmp_path)
    assert {k: answer[k] for k in ("graphs_found", "nodes_indexed", "partial_nodes")} == {"graphs_found": 2, "nodes_indexed": 2, "partial_nodes": 1}
    assert parsed == [["lib/inner.py"]] and "After." in texts()["work"] and set(texts()) == {"work", "x"}
    engine.reindex(tmp_path)
    assert parsed[1:] == [[]] and "After." in texts()["work"]
    (tmp_path / "alone.py").unlink()
    assert engine.reindex(tmp_path)["graphs_found"] == 1 and parsed[2:] == [[]]
    before = {n: rows(store.table(tmp_path.as_posix(), n)) for n in (*PARTS, "chunks", "files")}
    engine.index_repo(tmp_path)
    assert before == {n: rows(store.table(tmp_path.as_posix(), n)) for n in before}
