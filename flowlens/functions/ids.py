"""Identifiers as column expressions: the same text gives the same identifier on every run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Name = Column | str


def _c(x: Name) -> Column:
    return F.col(x) if isinstance(x, str) else x


def graph_id(path: Name, variable: Name) -> Column:
    return F.concat(_c(path), F.lit("::"), _c(variable))


def node_id(graph: Name, name: Name) -> Column:
    return F.concat(_c(graph), F.lit("::node::"), _c(name))


def edge_id(graph: Name, source: Name, target: Name) -> Column:
    return F.concat(_c(graph), F.lit("::edge::"), _c(source), F.lit("-->"), _c(target))


def conditional_edge_id(graph: Name, source: Name, value: Name, target: Name) -> Column:
    """`value` falls back to the target where the source states none."""
    return F.concat(_c(graph), F.lit("::cedge::"), _c(source), F.lit("--"), F.coalesce(_c(value), _c(target)), F.lit("-->"), _c(target))


def route_id(edge: Name) -> Column:
    return F.concat(_c(edge), F.lit("::route"))


def binding_id(node: Name, tool: Name) -> Column:
    return F.concat(_c(node), F.lit("::tool::"), _c(tool))


def chunk_id(node: Name) -> Column:
    return F.concat(_c(node), F.lit("::chunk"))


def node_name(graph: Name, node: Name) -> Column:
    """The name in a node's identifier; the identifier itself where it is of another graph."""
    prefix = F.concat(_c(graph), F.lit("::node::"))
    return F.when(_c(node).startswith(prefix), F.substring(_c(node), F.length(prefix) + 1, F.length(_c(node)))).otherwise(_c(node))
