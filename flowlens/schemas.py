"""Schemas, states and identifiers of the workflow-graph model."""

from __future__ import annotations

from pyspark.sql.types import StructType

START, END, UNRESOLVED = "__start__", "__end__", "<unresolved>"
DYNAMIC = "<dynamic:"
FULL, PARTIAL, NOT_APPLICABLE = "full", "partial", "not_applicable"
KNOWN, NOT_DERIVABLE = "known", "not_derivable"
NORMAL, CONDITIONAL = "normal", "conditional"

#: One row a file: what its text says, and nothing about what it means.
FILE_DDL = (
    "repo_id string, path string, is_ignored boolean, digest string, parse_status string, error string, lines array<string>, "
    "imports array<struct<ord:int, kind:string, local:string, original:string, module:string, level:int>>, "
    "functions array<struct<ord:int, name:string, is_module:boolean, line_start:int, line_end:int, docstring:string, body_hash:string, "
    "tools:array<struct<literal:boolean, elements:array<struct<name:string, base:string, ok:boolean>>>>, gotos:array<struct<targets:array<string>, ok:boolean>>>>, "
    "builders array<string>, "
    "calls array<struct<ord:int, var:string, method:string, line_start:int, line_end:int, in_dynamic:boolean, name:string, name_dynamic:boolean, "
    "func_kind:string, func_name:string, is_toolnode:boolean, tools:array<struct<literal:boolean, elements:array<struct<name:string, base:string, ok:boolean>>>>, "
    "src:string, dst:string, router:string, mapping:array<struct<cond:string, target:string, res:string>>, entry:string>>"
)

#: The index: name and columns of each table. files are the facts that the others were made of.
TABLES = {
    "files": FILE_DDL,
    "graphs": "repo_id string, graph_id string, file_path string, variable_name string, entry_point string",
    "nodes": "repo_id string, graph_id string, node_id string, node_ord int, name string, source_file string, line_start int, line_end int, docstring string, function_body_hash string, resolution string, tool_resolution string, routing_resolution string",
    "edges": "repo_id string, graph_id string, edge_id string, edge_ord long, source string, target string, source_node_id string, target_node_id string, type string, condition_function_name string",
    "routes": "repo_id string, graph_id string, route_id string, edge_id string, condition_value string, target_node_id string, value_resolution string",
    "tool_bindings": "repo_id string, graph_id string, binding_id string, node_id string, binding_ord long, tool_name string, tool_source string",
    "chunks": "repo_id string, graph_id string, chunk_id string, node_id string, node_name string, file_path string, line_start int, line_end int, docstring string, text string, embedding_model string, dimension int, vector array<float>",
}

#: Version of TABLES, and what each version added to the tables of the one before: column and the SQL expression that
#: gives it to rows of earlier tables. 1 knew no state of routing, 2 no facts of files.
VERSION = 3
ADDED: dict[int, dict[str, dict[str, str]]] = {
    2: {"nodes": {"routing_resolution": f"'{NOT_APPLICABLE}'"}},
    3: {},
}

#: Tables with a row or more a graph.
PARTS = tuple(t for t in TABLES if t != "files")


def columns(table: str) -> list[str]:
    return StructType.fromDDL(TABLES[table]).fieldNames()
