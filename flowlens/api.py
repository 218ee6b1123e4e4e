"""The verbs: index a repository, and ask about its graphs. Answers are plain dictionaries.

An answer keeps "there is none", "this is it" and "it could not be told" apart. Failures are dictionaries with an
error code; codes and texts of answers are fixed values that clients may branch on.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graphops
from .operators.assemble import Index, assemble
from .operators.embed import HashingProvider, Provider, chunks
from .operators.refresh import difference
from .plans.scratch import keep
from .schemas import END, PARTIAL, START
from .sources.paths import guard
from .sources.scan import facts
from .sources.store import Conflict, Repository, Store
from .sources.tree import read_tree

log = logging.getLogger("flowlens")
#: What an answer suggests where there is no index (a fixed value).
ADVICE = "call index_repo first"
#: Keys of a graph's summary (fixed values).
SUMMARY = ("variable_name", "file_path", "entry_point", "node_count", "edge_count", "nodes")
NOTE = "A destination without a condition_value was listed, not mapped: say that it is routed to, not what the router returns."
NOT_RESOLVABLE = "Whether this node branches is unknown: its function was not found, or it computes where to go. This is not the same as having no branch."


def _enveloped(verb: Callable[..., dict]) -> Callable[..., dict]:
    @wraps(verb)
    def call(*args, **kwargs) -> dict:
        try:
            return verb(*args, **kwargs)
        except _Answer as e:
            return e.args[0]
        except Exception as e:  # the boundary of the API: whatever fails becomes an answer
            return {"error": "internal_error", "detail": f"{type(e).__name__}: {e}"}

    return call


class _Answer(Exception):
    """An answer given from inside a verb."""


class Engine:
    """The verbs over one session. Indexes lie in `.flowlens` below each repository, or below `index_root`."""

    def __init__(self, spark: SparkSession, index_root: str | None = None, provider: Provider | None = None):
        self.spark, self.index_root = spark, index_root
        self.provider = provider or HashingProvider()

    # ---- helpers

    def _store(self, root: Path) -> Store:
        return Store(self.spark, self.index_root or f"file://{root.as_posix()}/.flowlens")

    def _root(self, path) -> Path:
        try:
            root = guard(path)
        except (ValueError, TypeError) as e:
            raise _Answer({"error": "invalid_path", "path": str(path), "reason": str(e)}) from e
        if not root.exists():
            raise _Answer({"error": "path_not_found", "path": root.as_posix()})
        if not root.is_dir():
            raise _Answer({"error": "not_a_directory", "path": root.as_posix()})
        return root

    def _open(self, path) -> tuple[Store, str, Repository]:
        root = self._root(path)
        store, repo = self._store(root), root.as_posix()
        info = store.get_repository(repo)
        if info is None:
            raise _Answer({"error": "not_indexed", "path": repo, "suggestion": ADVICE})
        return store, repo, info

    def _names(self, nodes: DataFrame) -> list[str]:
        found = graphops.node_names(nodes).first()
        return found["names"] if found else []

    def _unknown(self, name: str, nodes: DataFrame) -> dict:
        return {"error": "unknown_node", "node": name, "valid_nodes": self._names(nodes)}

    # ---- answers as frames, for as many graphs as there are

    def summary_frame(self, path) -> DataFrame:
        """What get_graph_summary() tells, a row a graph; with its graph_id."""
        store, repo, _ = self._open(path)
        return graphops.summary(*(store.table(repo, n) for n in ("graphs", "nodes", "edges"))).select("graph_id", *SUMMARY)

    def callers_frame(self, tool_name: str, path) -> DataFrame:
        """What what_calls_tool() tells: kind is caller, or unenumerated for nodes whose tools are not written out."""
        store, repo, _ = self._open(path)
        nodes, bound = store.table(repo, "nodes"), store.table(repo, "tool_bindings")
        null = F.lit(None).cast("string")
        callers = graphops.tool_callers(nodes, bound, tool_name).select(F.lit("caller").alias("kind"), "graph_id", F.col("binding_ord").alias("place"), "node_name", "file_path", "tool_name", "tool_source")
        hidden = graphops.unenumerated_tools(nodes).select(F.lit("unenumerated").alias("kind"), "graph_id", F.col("node_ord").cast("long").alias("place"), F.col("name").alias("node_name"), F.col("source_file").alias("file_path"), null.alias("tool_name"), null.alias("tool_source"))
        return callers.unionByName(hidden)

    def unstated_frame(self, from_node: str, path) -> DataFrame:
        """Nodes that may lead on from `from_node` in ways that the source does not state: those of its graphs, or of all if it is in none."""
        store, repo, _ = self._open(path)
        nodes = store.table(repo, "nodes")
        own = nodes.where(F.col("name") == from_node).select("graph_id").distinct()
        relevant = nodes if own.isEmpty() else nodes.join(own, "graph_id", "left_semi")
        files = store.table(repo, "graphs").select("graph_id", "file_path")
        return graphops.unresolved_routing(relevant).join(files, "graph_id").select("graph_id", "node_ord", F.col("name").alias("node_name"), "file_path")

    # ---- indexing

    @_enveloped
    def index_repo(self, path) -> dict:
        began, root = time.monotonic(), self._root(path)
        repo, store = root.as_posix(), self._store(root)
        parsed = facts(read_tree(self.spark, root)).persist()
        try:
            index = assemble(parsed, keep)
            tables = self._tables(index, parsed) | {"files": parsed}
            store.replace(repo, repo, tables, self.provider.name, self.provider.dimension)
        finally:
            parsed.unpersist()
        return self._indexed(store, repo, began)

    def _tables(self, index: Index, parsed: DataFrame) -> dict[str, DataFrame]:
        return {n: getattr(index, n) for n in ("graphs", "nodes", "edges", "routes", "tool_bindings")} | {"chunks": chunks(index.pieces, parsed, self.provider)}

    def _indexed(self, store: Store, repo: str, began: float) -> dict:
        counts = {n: store.table(repo, n).count() for n in ("graphs", "nodes", "edges")}
        partial = store.table(repo, "nodes").where(F.col("resolution") == PARTIAL).count()
        return {"graphs_found": counts["graphs"], "nodes_indexed": counts["nodes"], "edges_indexed": counts["edges"], "partial_nodes": partial, "backend": "parquet", "duration_ms": int(1000 * (time.monotonic() - began))}

    @_enveloped
    def reindex(self, path) -> dict:
        """index_repo() by difference: only files that changed since are parsed, and only graphs that they may touch assembled and embedded."""
        began, root = time.monotonic(), self._root(path)
        repo, store = root.as_posix(), self._store(root)
        try:
            info = store.get_repository(repo)
            known = info is not None and (info.embedding_model, info.dimension) == (self.provider.name, self.provider.dimension) and store.has_files(repo)
        except ValueError:  # a damaged index is made anew
            known = False
        if not known:
            return self.index_repo(path)
        found = difference(store.table(repo, "files", info.number), read_tree(self.spark, root))
        try:
            store.refresh(info, found.stale, self._tables(found.index, found.scope) | {"files": found.files})
        except Conflict:  # another writer came first, whose index is the one to start from
            return self.reindex(path)
        log.info("reindexed %s: %d files parsed, graphs of %d files assembled", repo, found.parsed.count(), found.stale.count())
        return self._indexed(store, repo, began)

    @_enveloped
    def repository_status(self, path) -> dict:
        root = self._root(path)
        repo, store = root.as_posix(), self._store(root)
        info = store.get_repository(repo)
        if info is None:
            return {"indexed": False, "path": repo, "suggestion": ADVICE}
        counts = {f"{n[:-1]}_count": store.table(repo, n).count() for n in ("graphs", "nodes", "edges")}
        return {"indexed": True, "path": repo, **counts, "last_indexed_at": info.last_indexed_at, "backend": info.backend_type, "embedding_model": info.embedding_model}

    # ---- questions

    @_enveloped
    def get_graph_summary(self, path) -> dict:
        return {"graphs": [{k: r[k] for k in SUMMARY} for r in self.summary_frame(path).orderBy("graph_id").collect()]}

    @_enveloped
    def semantic_search_nodes(self, query, path, top_k: int = 5) -> dict:
        if not isinstance(query, str) or not query.strip():
            return {"error": "empty_query"}
        if isinstance(top_k, bool) or not isinstance(top_k, int) or top_k < 1:
            return {"error": "invalid_top_k", "top_k": top_k}
        store, repo, info = self._open(path)
        if info.embedding_model != self.provider.name:
            return {"error": "embedding_model_mismatch", "path": repo, "index": info.embedding_model, "query": self.provider.name}
        rows = store.search(self.provider.embed_query(query), top_k, {"repo_id": repo}).collect()
        return {"results": [{k: r[k] for k in ("node_id", "node_name", "graph_id", "file_path", "line_start", "score", "docstring")} for r in rows]}

    @_enveloped
    def trace_path(self, from_node, to_node, path) -> dict:
        store, repo, _ = self._open(path)
        nodes, edges, routes = (store.table(repo, n) for n in ("nodes", "edges", "routes"))
        for name in (from_node, to_node):
            if name not in (START, END) and nodes.where(F.col("name") == name).isEmpty():
                return self._unknown(name, nodes)
        graphs = store.table(repo, "graphs")
        able = graphs.select("repo_id", "graph_id")
        for name in (from_node, to_node):
            if name not in (START, END):
                # written out, so that few graphs are sent to all others and the search looks at no edges but theirs
                holding = keep("holding", nodes.where(F.col("name") == name).select("repo_id", "graph_id").distinct())
                able = able.join(holding, ["repo_id", "graph_id"], "left_semi")
        able = keep("able", able)
        edges = keep("edges", edges.join(able, ["repo_id", "graph_id"], "left_semi"))
        requests = able.select("*", F.lit(from_node).alias("from_node"), F.lit(to_node).alias("to_node"))
        found = graphops.shortest_routes(edges, requests, cut=keep)
        best = found.orderBy("graph_id").limit(1).collect()
        if best:
            one = found.where(F.col("graph_id") == best[0]["graph_id"])
            steps = graphops.route_steps(one, edges, routes).where("type = 'conditional'").orderBy("step").collect()
            branches = [{k: s[k] for k in ("source", "target", "condition_function", "condition_value", "value_resolution")} for s in steps]
            return {"path_found": True, "graph_id": best[0]["graph_id"], "route": list(best[0]["route"]), "conditional_branches": branches}
        unresolved = [{"node_name": r["node_name"], "file_path": r["file_path"]} for r in self.unstated_frame(from_node, path).orderBy("graph_id", "node_ord").collect()]
        way = f"from {from_node!r} to {to_node!r}"
        hidden = f"; {len(unresolved)} node(s) route in ways that the source does not state, so one may exist all the same"
        detail = f"no stated edges lead {way}{hidden if unresolved else ', and all routing is stated'}"
        return {"path_found": False, "route": [], "conditional_branches": [], "unresolved_routing_nodes": unresolved, "detail": detail}

    @_enveloped
    def what_calls_tool(self, tool_name, path) -> dict:
        if not isinstance(tool_name, str) or not tool_name.strip():
            return {"error": "empty_tool_name"}
        rows = self.callers_frame(tool_name, path).orderBy("graph_id", "place", "tool_name").collect()
        callers = [{k: r[k] for k in ("node_name", "file_path", "tool_name", "tool_source")} for r in rows if r["kind"] == "caller"]
        return {"callers": callers, "unenumerated_tool_nodes": [{k: r[k] for k in ("node_name", "file_path")} for r in rows if r["kind"] == "unenumerated"]}

    @_enveloped
    def explain_conditional(self, edge_source, path) -> dict:
        store, repo, _ = self._open(path)
        nodes, edges, routes = (store.table(repo, n) for n in ("nodes", "edges", "routes"))
        own = nodes.where(F.col("name") == edge_source).orderBy("graph_id", "node_ord").collect()
        if not own:
            return self._unknown(edge_source, nodes)
        rows = graphops.branch_destinations(edges.where(F.col("source") == edge_source), routes).orderBy("graph_id", "edge_ord").collect()
        rows = [r for r in rows if r["graph_id"] == rows[0]["graph_id"]]
        if rows:
            found = [{"condition_value": r["condition_value"], "target_node": r["target"], "value_resolution": r["value_resolution"]} for r in rows]
            answer = {"condition_function": next((r["condition_function"] for r in rows if r["condition_function"]), None), "possible_destinations": found}
            return answer | ({"note": NOTE} if any(d["condition_value"] is None for d in found) else {})
        if any(r["routing_resolution"] == PARTIAL for r in own):
            return {"error": "routing_not_resolvable", "node": edge_source, "resolution": own[0]["resolution"], "routing_resolution": PARTIAL, "reason": NOT_RESOLVABLE}
        return {"error": "not_conditional", "node": edge_source}
