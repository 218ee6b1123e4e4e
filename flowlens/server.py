"""A server for tool-calling clients: JSON-RPC messages, one a line, over an Engine's verbs.

Calls run at the same time, each in a thread of its own with a tag for its Spark jobs, in the scheduler's pool `calls`;
answers are written as they come. `notifications/cancelled` with the requestId of a call ends the call's jobs.
"""

from __future__ import annotations

import inspect
import json
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from threading import Lock
from typing import TextIO

from .api import Engine

#: The version of the protocol that is spoken (a fixed value), and JSON-RPC's codes for what went wrong.
PROTOCOL = "2024-11-05"
PARSE_ERROR, BAD_REQUEST, NO_METHOD, BAD_PARAMS, FAILED = -32700, -32600, -32601, -32602, -32603
VERBS = {
    "index_repo": "Index the workflow graphs of a repository.",
    "reindex": "Index a repository again.",
    "get_graph_summary": "List graphs with their nodes and entry points.",
    "semantic_search_nodes": "Find nodes whose code is like a description.",
    "trace_path": "Find how execution gets from one node to another.",
    "what_calls_tool": "Find the nodes that use a tool.",
    "explain_conditional": "Tell where a node's branch can lead.",
}
#: Calls that run at the same time.
WORKERS = 8


def _tool(name: str) -> dict:
    parameters = inspect.signature(getattr(Engine, name)).parameters.values()
    given = [p for p in parameters if p.name != "self"]
    kinds = {p.name: {"type": "integer" if isinstance(p.default, int) else "string"} for p in given}
    return {"name": name, "description": VERBS[name], "inputSchema": {"type": "object", "properties": kinds, "required": [p.name for p in given if p.default is p.empty]}}


def _failure(key, code: int, text: str) -> dict:
    return {"jsonrpc": "2.0", "id": key, "error": {"code": code, "message": text}}


def answer(engine: Engine, message) -> dict | None:
    """The response to one message; None for a notification. A message of any form gets a response, whatever fails."""
    if not isinstance(message, dict) or not isinstance(message.get("method"), str):
        return _failure(message.get("id") if isinstance(message, dict) else None, BAD_REQUEST, "a message is an object with a method")
    key, method, params = message.get("id"), message["method"], message.get("params") or {}
    if key is None:
        return None
    if not isinstance(params, dict):
        return _failure(key, BAD_PARAMS, "params are an object")
    if method == "initialize":
        result = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "flowlens", "version": "1"}}
    elif method == "ping":
        result = {}
    elif method == "tools/list":
        result = {"tools": [_tool(n) for n in VERBS]}
    elif method == "tools/call":
        name, given = params.get("name"), params.get("arguments") or {}
        if not isinstance(name, str) or name not in VERBS:
            return _failure(key, BAD_PARAMS, f"no such tool: {name}")
        if not isinstance(given, dict):
            return _failure(key, BAD_PARAMS, "arguments are an object")
        try:
            inspect.signature(getattr(engine, name)).bind(**given)
        except TypeError as e:
            return _failure(key, BAD_PARAMS, str(e))
        try:
            said = getattr(engine, name)(**given)
            result = {"content": [{"type": "text", "text": json.dumps(said, ensure_ascii=False)}], "isError": "error" in said}
        except Exception as e:  # one odd call must not end the server
            return _failure(key, FAILED, f"{type(e).__name__}: {e}")
    else:
        return _failure(key, NO_METHOD, f"no such method: {method}")
    return {"jsonrpc": "2.0", "id": key, "result": result}


class _Calls:
    """The calls that are running, by the ids that clients gave them."""

    def __init__(self, engine: Engine, out: TextIO):
        self.engine, self.context, self.out = engine, engine.spark.sparkContext, out
        self.tags: dict[str, str] = {}
        self.lock = Lock()

    def say(self, said: dict | None) -> None:
        if said is not None:
            with self.lock:
                self.out.write(json.dumps(said, ensure_ascii=False) + "\n")
                self.out.flush()

    def run(self, message: dict, tag: str) -> None:
        self.context.addJobTag(tag)
        self.context.setLocalProperty("spark.scheduler.pool", "calls")
        try:
            self.say(answer(self.engine, message))
        finally:
            self.context.removeJobTag(tag)
            with self.lock:
                self.tags.pop(json.dumps(message.get("id")), None)

    def begin(self, message: dict, pool: ThreadPoolExecutor) -> None:
        tag = f"call-{uuid.uuid4().hex}"
        with self.lock:
            self.tags[json.dumps(message.get("id"))] = tag
        pool.submit(self.run, message, tag)

    def cancel(self, params) -> None:
        with self.lock:
            tag = self.tags.get(json.dumps(params.get("requestId"))) if isinstance(params, dict) else None
        if tag:
            self.context.cancelJobsWithTag(tag)


def serve(engine: Engine, lines: Iterable[str], out: TextIO, workers: int = WORKERS) -> None:
    """Answer each line until there are no more and all calls have ended; a line that is no JSON gets an error and ends nothing."""
    calls = _Calls(engine, out)
    with ThreadPoolExecutor(workers) as pool:
        for line in lines:
            if not line.strip():
                continue
            try:
                message = json.loads(line)
            except ValueError as e:
                calls.say(_failure(None, PARSE_ERROR, str(e)))
                continue
            kind = message.get("method") if isinstance(message, dict) else None
            if kind == "tools/call" and message.get("id") is not None:
                calls.begin(message, pool)
            elif kind == "notifications/cancelled":
                calls.cancel(message.get("params"))
            else:
                calls.say(answer(engine, message))
