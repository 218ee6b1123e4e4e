"""Questions about graphs: routes, branches, tools, summaries. All work on whole tables of graphs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import CONDITIONAL, NOT_DERIVABLE, PARTIAL

G = ["repo_id", "graph_id"]


def adjacency(edges: DataFrame) -> DataFrame:
    """edges with place: their number among those out of the same source."""
    w = Window.partitionBy(*G, "source").orderBy("edge_ord")
    return edges.withColumn("place", (F.row_number().over(w) - 1).cast("int"))


def shortest_routes(edges: DataFrame, requests: DataFrame, cut=None) -> DataFrame:
    """(repo_id, graph_id, from_node, to_node, hops, route, edge_ids) for each request that has a directed route.

    Breadth-first for all requests together, a join a level: of the shortest routes that with the least sequence of
    edge places, which a queue over edges in order finds. A request to its own node has no hops. Each level is written
    out by `cut` (name, frame), or checkpointed; it stops when nothing new is reached. Edges may name nodes that no table has.
    """
    near = adjacency(edges).select(*G, F.col("source").alias("_at"), F.col("target").alias("_to"), "place", "edge_id")
    keys = [*G, "from_node", "to_node"]
    wanted = requests.select(*keys).distinct()
    empty = F.array().cast("array<string>")
    first = wanted.select(*keys, F.col("from_node").alias("_at"), F.array().cast("array<int>").alias("_key"), F.array("from_node").alias("route"), empty.alias("edge_ids"))
    keep = cut or (lambda name, df: df.checkpoint())
    results, level = [first.where("from_node = to_node")], 0
    # each level is written once and only added to what is seen
    seen, frontier = first.select(*keys, "_at"), first.where("from_node != to_node")
    while True:
        level += 1
        step = frontier.join(near, [*G, "_at"]).select(*keys, F.col("_to").alias("_at"), F.concat("_key", F.array("place")).alias("_key"), F.concat("route", F.array("_to")).alias("route"), F.concat("edge_ids", F.array("edge_id")).alias("edge_ids"))
        new = step.join(seen, [*keys, "_at"], "left_anti")
        best = new.groupBy(*keys, "_at").agg(F.min_by(F.struct("_key", "route", "edge_ids"), "_key").alias("_b")).select(*keys, "_at", "_b.*")
        frontier = keep(f"level{level}", best)
        if frontier.isEmpty():
            break
        arrived = frontier.where("_at = to_node")
        results.append(arrived)
        seen = seen.unionByName(frontier.select(*keys, "_at"))
        frontier = frontier.join(arrived.select(*keys), keys, "left_anti")
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.select(*keys, F.size("edge_ids").alias("hops"), "route", "edge_ids")


def meeting_routes(edges: DataFrame, requests: DataFrame, cut=None) -> DataFrame:
    """The rows of shortest_routes(), searched from both ends at once.

    Each request has a frontier of the nodes that lie n hops behind its start, with the least edge places that lead to
    each, and one of those n hops before its end, with the least places from there. Both go a hop a round, in one table.
    Where the new front meets the old back the route has 2n + 1 hops, where it meets the new one 2n + 2, and the route of
    the least places passes a shared node. A request leaves once it is met, or once either side has nothing new. There
    are half as many rounds as hops, and where nodes have many edges far fewer rows are written than from one end.
    A request to its own node has no hops; without edges or requests there are no other rows. Edges may name nodes that
    no table has; equal requests give one row. Frontiers are written out by `cut` (name, frame), or checkpointed.
    """
    keep = cut or (lambda name, df: df.checkpoint())
    keys = [*G, "from_node", "to_node"]
    at = [*keys, "side", "_at"]
    sided = lambda **of: F.explode(F.array(*[F.struct(F.lit(side).alias("side"), *[F.col(c[side]).alias(n) for n, c in of.items()]) for side in (AHEAD, BEHIND)]))
    ways = sided(_at=("source", "target"), _to=("target", "source"))
    near = keep("near", adjacency(edges).select(*G, "place", "edge_id", ways.alias("_w")).select(*G, "place", "edge_id", "_w.*"))
    wanted = requests.select(*keys).distinct()
    strings = F.array().cast("array<string>")
    results = [wanted.where("from_node = to_node").select(*keys, F.array("from_node").alias("route"), strings.alias("edge_ids"))]
    begun = wanted.where("from_node != to_node").select(*keys, sided(_at=("from_node", "to_node")).alias("_e")).select(*keys, "_e.*")
    frontier = keep("side0", begun.select(*at, F.array().cast("array<int>").alias("_key"), F.array("_at").alias("route"), strings.alias("edge_ids")))
    seen, level = frontier.select(*at), 0
    while not frontier.isEmpty():
        level += 1
        fresh = _both_step(frontier, near).join(seen, at, "left_anti")
        new = keep(f"side{level}", fresh.groupBy(*at).agg(F.min_by(F.struct("_key", "route", "edge_ids"), "_key").alias("_b")).select(*at, "_b.*"))
        seen = seen.unionByName(new.select(*at))
        met = keep(f"met{level}", _met(new, frontier.where(F.col("side") == BEHIND).unionByName(new.where(F.col("side") == BEHIND)), keys))
        results.append(met)
        alive = new.groupBy(*keys).agg(F.min("side").alias("_l"), F.max("side").alias("_h")).where("_l != _h").join(met.select(*keys), keys, "left_anti")
        frontier = new.join(alive.select(*keys), keys, "left_semi")
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.select(*keys, F.size("edge_ids").alias("hops"), "route", "edge_ids")


#: The side of a request that follows edges, and the one that goes against them.
AHEAD, BEHIND = 0, 1


def _both_step(frontier: DataFrame, near: DataFrame) -> DataFrame:
    """The neighbours of both sides; what led to each grows at the end that its side is at."""
    grown = lambda of, more: F.when(F.col("side") == AHEAD, F.concat(of, F.array(more))).otherwise(F.concat(F.array(more), of)).alias(of)
    return frontier.join(near, [*G, "side", "_at"]).select(*G, "from_node", "to_node", "side", F.col("_to").alias("_at"), grown("_key", "place"), grown("route", "_to"), grown("edge_ids", "edge_id"))


def _met(new: DataFrame, behind: DataFrame, keys: list[str]) -> DataFrame:
    """The least route of each request whose sides share a node: of the fewest hops, then of the least places."""
    rest = behind.select(*keys, "_at", F.col("_key").alias("_k2"), F.expr("slice(route, 2, size(route))").alias("_r2"), F.col("edge_ids").alias("_e2"))
    whole = F.struct(F.concat("_key", "_k2").alias("_key"), F.concat("route", "_r2").alias("route"), F.concat("edge_ids", "_e2").alias("edge_ids"))
    met = new.where(F.col("side") == AHEAD).join(rest, [*keys, "_at"]).select(*keys, whole.alias("_w"))
    return met.groupBy(*keys).agg(F.min_by("_w", F.struct(F.size("_w._key"), F.col("_w._key"))).alias("_b")).select(*keys, "_b.route", "_b.edge_ids")


def reachable_within(edges: DataFrame, requests: DataFrame, levels: int | None = None, cut=None) -> DataFrame:
    """(repo_id, graph_id, from_node, node, distance): least numbers of hops, of at most `levels` if that is given.

    A node is met once, at its least distance, so that cycles end by themselves.
    """
    keep = cut or (lambda name, df: df.checkpoint())
    near = edges.select(*G, F.col("source").alias("node"), F.col("target").alias("_to")).distinct()
    keys = [*G, "from_node", "node"]
    frontier = requests.select(*G, "from_node").distinct().withColumn("node", F.col("from_node"))
    found, level = frontier.withColumn("distance", F.lit(0)), 0
    while levels is None or level < levels:
        level += 1
        step = frontier.join(near, [*G, "node"]).select(*G, "from_node", F.col("_to").alias("node")).distinct()
        frontier = keep(f"reach{level}", step.join(found.select(*keys), keys, "left_anti"))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier.withColumn("distance", F.lit(level)))
    return found


def route_steps(routes_found: DataFrame, edges: DataFrame, routes: DataFrame) -> DataFrame:
    """One row a hop: step, source, target, type, and for branches the router, the value and its state."""
    keys = [*G, "from_node", "to_node"]
    hops = routes_found.select(*keys, F.posexplode("edge_ids").alias("step", "edge_id"))
    branch = F.col("type") == CONDITIONAL
    stated = edges.select(*G, "edge_id", "source", "target", "type", "condition_function_name").join(routes.select(*G, "edge_id", "condition_value", "value_resolution"), [*G, "edge_id"], "left")
    return hops.join(stated, [*G, "edge_id"]).select(*keys, "step", "source", "target", "type", F.col("condition_function_name").alias("condition_function"), "condition_value", F.when(branch, F.coalesce("value_resolution", F.lit(NOT_DERIVABLE))).alias("value_resolution"))


def branch_destinations(edges: DataFrame, routes: DataFrame) -> DataFrame:
    """Where the branches of each source lead: value, its state and the router, in edge order."""
    branches = edges.where(F.col("type") == CONDITIONAL)
    joined = branches.join(routes.select(*G, "edge_id", "condition_value", "value_resolution"), [*G, "edge_id"], "left")
    return joined.select(*G, "source", "target", "edge_ord", F.col("condition_function_name").alias("condition_function"), "condition_value", F.coalesce("value_resolution", F.lit(NOT_DERIVABLE)).alias("value_resolution"))


def routers(edges: DataFrame) -> DataFrame:
    """(repo_id, graph_id, source, condition_function): the first router named on a source's branches."""
    named = edges.where((F.col("type") == CONDITIONAL) & (F.coalesce("condition_function_name", F.lit("")) != ""))
    return named.groupBy(*G, "source").agg(F.min_by("condition_function_name", "edge_ord").alias("condition_function"))


def has_branch(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that a branch leaves."""
    return nodes.join(edges.where(F.col("type") == CONDITIONAL).select(*G, F.col("source").alias("name")), [*G, "name"], "left_semi")


def names_tool(tool: str) -> Column:
    """Whether tool_name is `tool`, or ends in it after a dot."""
    return (F.col("tool_name") == tool) | (F.element_at(F.split("tool_name", r"\."), -1) == tool)


def tool_callers(nodes: DataFrame, bindings: DataFrame, tool: str) -> DataFrame:
    """Nodes that bind `tool`; bindings without a node are left out."""
    found = bindings.where(names_tool(tool.strip())).select(*G, "node_id", "tool_name", "tool_source", "binding_ord")
    return found.join(nodes.select(*G, "node_id", F.col("name").alias("node_name"), F.col("source_file").alias("file_path")), [*G, "node_id"])


def unenumerated_tools(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("tool_resolution") == PARTIAL)


def unresolved_routing(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("routing_resolution") == PARTIAL)


def node_names(nodes: DataFrame) -> DataFrame:
    """(repo_id, names): all names of a repository's nodes, sorted, once each."""
    return nodes.groupBy("repo_id").agg(F.array_sort(F.collect_set("name")).alias("names"))


def first_node(nodes: DataFrame, name: str) -> DataFrame:
    """The node of that name in the first graph, one a repository."""
    w = Window.partitionBy("repo_id").orderBy("graph_id", "node_ord")
    return nodes.where(F.col("name") == name).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def summary(graphs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row a graph: node_count, edge_count and names in order. Both sides are counted before they meet."""
    n = nodes.groupBy(*G).agg(F.count(F.lit(1)).alias("node_count"), F.transform(F.array_sort(F.collect_list(F.struct("node_ord", "name"))), lambda x: x["name"]).alias("nodes"))
    e = edges.groupBy(*G).agg(F.count(F.lit(1)).alias("edge_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return graphs.join(n, G, "left").join(e, G, "left").select(*G, "variable_name", "file_path", "entry_point", zero("node_count"), zero("edge_count"), F.coalesce("nodes", F.array().cast("array<string>")).alias("nodes"))
