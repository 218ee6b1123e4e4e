"""What one Python file says: imports, functions, builder variables and calls on them, as plain facts.

The file is parsed once. Names that stand for the workflow library's classes are looked up in the file's own imports;
everything else is left to joins over the facts of all files.
"""

from __future__ import annotations

import ast
import gc
import re
import warnings
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from functools import cached_property
from hashlib import sha256
from itertools import chain

from ..schemas import DYNAMIC, END, KNOWN, NOT_DERIVABLE, START

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
#: A call below one of these is made an unknown number of times, or later.
DYNAMIC_SCOPES = (ast.For, ast.AsyncFor, ast.While, ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp, ast.Lambda)
#: The workflow library's names, fixed by its API.
BUILDER, TOOL_NODE, SEND, COMMAND, BIND = "StateGraph", "ToolNode", "Send", "Command", "bind_tools"
METHODS = ("add_node", "add_edge", "add_conditional_edges", "set_entry_point")
#: Kinds of nodes that questions start from.
_ASKED = frozenset((ast.Import, ast.ImportFrom, ast.Assign, ast.Call, *FUNCTIONS, *DYNAMIC_SCOPES))
#: What a call to add_node may give as a node's action.
_ACTIONS = {ast.Name: "name", ast.Attribute: "attr", ast.Call: "call", ast.Lambda: "lambda", type(None): "none"}
_ODD_CALL = (AttributeError, IndexError, KeyError, TypeError, ValueError)


def _text(node: ast.AST) -> str:
    try:
        return ast.unparse(node)
    except (ValueError, TypeError, AttributeError, RecursionError):
        return "<unparseable>"


def _string(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


#: Fields of plain values, which hold no nodes, and kinds of nodes with lists that hold other things beside nodes.
_PLAIN = {"id", "attr", "asname", "module", "level", "kind", "arg", "type_comment", "is_async", "simple", "conversion"}
_MIXED = (ast.Dict, ast.arguments, ast.MatchClass)
_branches: dict[type, tuple[tuple[str, bool], ...]] = {ast.Constant: (), ast.Global: (), ast.Nonlocal: (), ast.alias: ()}


def _holders(kind: type) -> tuple[tuple[str, bool], ...]:
    """The fields of a kind of node that may hold nodes, and whether a list there holds nothing else."""
    found = _branches[kind] = tuple((f, kind not in _MIXED) for f in kind._fields if f not in _PLAIN)
    return found


def _walk(tree: ast.AST) -> list[ast.AST]:
    """The nodes of ast.walk(), in its order."""
    found = [tree]
    add, more, known, node_kind = found.append, found.extend, _branches.get, ast.AST
    for node in found:
        kind = node.__class__
        if kind is ast.Name:  # the most frequent kind: nothing but its context
            add(node.ctx)
            continue
        fields = known(kind)
        for name, pure in _holders(kind) if fields is None else fields:
            value = getattr(node, name, None)
            if value.__class__ is list:
                more(value if pure else [x for x in value if isinstance(x, node_kind)])
            elif isinstance(value, node_kind):
                add(value)
    return found


class FileFacts:
    """Facts of one parsed module; row() gives them in the shape of schemas.FILE_DDL."""

    def __init__(self, source: str):
        with nullcontext() if _batch.unwarned else unwarned():
            self.tree = ast.parse(source)
        self.source = source
        self.order = _walk(self.tree)
        #: Places in that order by kind of node, for kinds that are asked for, so that each question looks at its own nodes only.
        self.places: dict[type, list[int]] = {k: [] for k in _ASKED}
        for i, kind in enumerate(map(type, self.order)):
            if kind in _ASKED:
                self.places[kind].append(i)
        self.imports = [fact for i in self._at(ast.Import, ast.ImportFrom) for fact in self._import(i, self.order[i])]
        self.named: dict[str, str] = {f["local"]: f["original"] for f in self.imports}

    @cached_property
    def lines(self) -> list[str]:
        """The lines that positions in the tree count, with their ends."""
        return re.findall(r"[^\r\n]*(?:\r\n|\r|\n)?", self.source)

    @cached_property
    def called(self) -> list[int]:
        """Lines of the calls, in order."""
        return sorted(self.order[i].lineno for i in self.places[ast.Call])

    def _at(self, *kinds: type) -> list[int]:
        held = [p for p in map(self.places.__getitem__, kinds) if p]
        return sorted(chain.from_iterable(held)) if len(held) > 1 else held[0] if held else []

    def means(self, name: str | None, original: str) -> bool:
        """Whether a local name stands for a name of the library: that name itself, or an import of it."""
        return name == original or (name is not None and self.named.get(name) == original)

    def calls_to(self, func: ast.AST, original: str, any_attribute_alias: bool) -> bool:
        if isinstance(func, ast.Name):
            return self.means(func.id, original)
        if isinstance(func, ast.Attribute):
            return self.means(func.attr, original) if any_attribute_alias else func.attr == original
        return False

    @staticmethod
    def _import(i: int, node: ast.AST):
        kind, module, level = ("from", node.module, node.level or 0) if isinstance(node, ast.ImportFrom) else ("import", None, 0)
        return [{"ord": i, "kind": kind, "local": a.asname or a.name, "original": a.name, "module": module, "level": level} for a in node.names]

    # ---- references

    def reference(self, node: ast.AST) -> str:
        """A node's name as an edge states it: a string, a sentinel, or the expression's text."""
        found = _string(node)
        if found is not None:
            return found
        tail = node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None
        return START if self.means(tail, "START") else END if self.means(tail, "END") else _text(node)

    def goto(self, node: ast.AST) -> tuple[list[str], bool]:
        """Destinations that a goto value states, in order, and whether it states all."""
        found, stated, waiting = [], True, [node]
        while waiting:
            part = waiting.pop()
            if isinstance(part, (ast.List, ast.Tuple, ast.Set)):
                waiting += reversed(part.elts)
            elif isinstance(part, (ast.ListComp, ast.SetComp, ast.GeneratorExp)):
                waiting.append(part.elt)
            else:
                target = self._destination(part)
                found += [] if target is None else [target]
                stated = stated and target is not None
        return found, stated

    def _destination(self, node: ast.AST) -> str | None:
        """The one node that a goto value names: a string, a sentinel, or what is sent to."""
        if isinstance(node, ast.Name):
            return next((s for s, name in ((START, "START"), (END, "END")) if self.means(node.id, name)), None)
        if isinstance(node, ast.Call) and node.args and self.calls_to(node.func, SEND, True):
            return _string(node.args[0])
        return _string(node)

    def tool_list(self, node: ast.AST) -> dict:
        """A tools argument: whether it is written out, and its elements' names and bases."""
        if not isinstance(node, (ast.List, ast.Tuple)):
            return {"literal": False, "elements": []}
        return {"literal": True, "elements": [self._tool(e) for e in node.elts]}

    def _tool(self, node: ast.AST) -> dict:
        if not (isinstance(node, (ast.Name, ast.Attribute, ast.Call)) or _string(node) is not None):
            return {"name": None, "base": None, "ok": False}
        while isinstance(node, ast.Call):
            node = node.func
        match node:
            case ast.Name(id=name):
                return {"name": name, "base": name, "ok": True}
            case ast.Attribute(attr=name, value=ast.Name(id=base)):
                return {"name": name, "base": base, "ok": True}
            case ast.Attribute(attr=name):
                return {"name": name, "base": None, "ok": True}
        return {"name": _string(node) if _string(node) is not None else _text(node), "base": None, "ok": True}

    def segment(self, node: ast.AST) -> str:
        """The text of a node, whose columns are counted in bytes."""
        first, last = node.lineno - 1, node.end_lineno - 1
        if self.source.isascii():
            rows = self.lines[first : last + 1]
            rows[-1] = rows[-1][: node.end_col_offset]
            rows[0] = rows[0][node.col_offset :]
            return "".join(rows)
        end = self.lines[last].encode()[: node.end_col_offset].decode()
        if first == last:
            return end.encode()[node.col_offset :].decode()
        return "".join([self.lines[first].encode()[node.col_offset :].decode(), *self.lines[first + 1 : last], end])

    # ---- functions

    def functions(self) -> list[dict]:
        top = {id(n) for n in self.tree.body}
        return [self._function(i, self.order[i], id(self.order[i]) in top) for i in self._at(*FUNCTIONS)]

    def _function(self, i: int, node, is_module: bool) -> dict:
        tools, gotos = [], []
        start, end = min([node.lineno, *(d.lineno for d in node.decorator_list)]), node.end_lineno or node.lineno
        # no call is on a function's lines, so none is in it
        calls = bisect_left(self.called, start) < bisect_right(self.called, end)
        for call in (n for n in _walk(node) if isinstance(n, ast.Call)) if calls else ():
            if call.args and (isinstance(call.func, ast.Attribute) and call.func.attr == BIND or self.calls_to(call.func, TOOL_NODE, False)):
                tools.append(self.tool_list(call.args[0]))
            if self.calls_to(call.func, COMMAND, True):
                for value in [k.value for k in call.keywords if k.arg == "goto"][:1]:
                    targets, ok = self.goto(value)
                    gotos.append({"targets": targets, "ok": ok})
        return {
            "ord": i,
            "name": node.name,
            "is_module": is_module,
            "line_start": start,
            "line_end": end,
            "docstring": ast.get_docstring(node),
            "body_hash": sha256(self.segment(node).encode()).hexdigest(),
            "tools": tools,
            "gotos": gotos,
        }

    # ---- builders and calls on them

    def builders(self) -> list[str]:
        assigned = (self.order[i] for i in self._at(ast.Assign))
        found = (t.id for n in assigned if isinstance(n.value, ast.Call) and self.calls_to(n.value.func, BUILDER, False) for t in n.targets if isinstance(t, ast.Name))
        return list(dict.fromkeys(found))

    def calls(self, builders: list[str]) -> list[dict]:
        known, repeated, found = set(builders), set(), []
        if not known:
            return found
        for i in self._at(*DYNAMIC_SCOPES):
            repeated.update(map(id, _walk(self.order[i])[1:]) if id(self.order[i]) not in repeated else ())
        for i in self._at(ast.Call):
            node = self.order[i]
            func = node.func
            if isinstance(func, ast.Attribute) and func.attr in METHODS and isinstance(func.value, ast.Name) and func.value.id in known:
                found.append((func.value.id, func.attr, node))
        found.sort(key=lambda x: (x[2].lineno, x[2].col_offset))
        out = []
        for i, (var, method, node) in enumerate(found):
            try:
                stated = getattr(self, f"_{method}")(node)
            except _ODD_CALL:
                continue
            if stated is not None:
                out.append({"ord": i, "var": var, "method": method, "line_start": node.lineno, "line_end": node.end_lineno or node.lineno, "in_dynamic": id(node) in repeated} | stated)
        return out

    def _add_node(self, call: ast.Call) -> dict:
        named = {k.arg: k.value for k in call.keywords if k.arg}
        first, second = [*call.args[:2], None, None][:2]
        label, action = (first, second) if _string(first) is not None else (None, first)
        label = label or named.get("node") or named.get("name")
        action = action or named.get("action")
        if label is None:
            name = action.id if isinstance(action, ast.Name) else f"{DYNAMIC}{_text(call)}>"
            dynamic = not isinstance(action, ast.Name)
        else:
            name, dynamic = _string(label), False
            if name is None:
                name, dynamic = f"{DYNAMIC}{_text(label)}>", True
        kind = _ACTIONS.get(type(action), "other")
        tool_node = isinstance(action, ast.Call) and self.calls_to(action.func, TOOL_NODE, False)
        return {
            "name": name,
            "name_dynamic": dynamic,
            "func_kind": kind,
            "func_name": action.id if kind == "name" else None,
            "is_toolnode": tool_node,
            "tools": [self.tool_list(action.args[0])] if tool_node and action.args else [],
        }

    def _add_edge(self, call: ast.Call) -> dict | None:
        return None if len(call.args) < 2 else {"src": self.reference(call.args[0]), "dst": self.reference(call.args[1])}

    def _add_conditional_edges(self, call: ast.Call) -> dict | None:
        if not call.args:
            return None
        router = call.args[1] if len(call.args) > 1 else None
        paths = call.args[2] if len(call.args) > 2 else next((k.value for k in call.keywords if k.arg == "path_map"), None)
        stated = []
        if isinstance(paths, ast.Dict):
            pairs = [(k, v) for k, v in zip(paths.keys, paths.values, strict=True) if k is not None]
            stated = [{"cond": _string(k) if _string(k) is not None else _text(k), "target": self.reference(v), "res": KNOWN} for k, v in pairs]
        elif isinstance(paths, (ast.List, ast.Tuple)):
            stated = [{"cond": None, "target": self.reference(v), "res": NOT_DERIVABLE} for v in paths.elts]
        name = router.id if isinstance(router, ast.Name) else "<lambda>" if isinstance(router, ast.Lambda) else _text(router) if router is not None else None
        return {"src": self.reference(call.args[0]), "router": name, "mapping": stated}

    def _set_entry_point(self, call: ast.Call) -> dict | None:
        value = _string(call.args[0]) if call.args else None
        return None if value is None else {"entry": value}

    def row(self) -> dict:
        builders = self.builders()
        return {"imports": self.imports, "functions": self.functions(), "builders": builders, "calls": self.calls(builders)}


class _batch:
    """Whether files are parsed one after the other without warnings (unwarned())."""

    unwarned = False


@contextmanager
def unwarned() -> Iterator[None]:
    """Without what Python thinks of the files' style, which is not asked; switched off once for all files that are parsed within."""
    was = _batch.unwarned
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        _batch.unwarned = True
        try:
            yield
        finally:
            _batch.unwarned = was


@contextmanager
def uncollected() -> Iterator[None]:
    """Without passes of the garbage collector, which would go through trees that have no cycles again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def parse(content: bytes) -> dict:
    """Facts of a file's bytes, with parse_status ok, decode_error, syntax_error or error."""
    empty = {"lines": [], "imports": [], "functions": [], "builders": [], "calls": [], "error": None}
    try:
        source = content.decode("utf-8-sig")
    except UnicodeDecodeError as e:
        return empty | {"parse_status": "decode_error", "error": str(e)}
    try:
        found = FileFacts(source).row()
    except SyntaxError as e:
        return empty | {"parse_status": "syntax_error", "error": str(e)}
    except Exception as e:  # one odd file must not stop the others
        return empty | {"parse_status": "error", "error": f"{type(e).__name__}: {e}"}
    if "\\u" in source or "\\U" in source:
        found = _encodable(found)
    return empty | found | {"parse_status": "ok", "lines": source.splitlines()}


def _encodable(value):
    """`value` with lone surrogates, which escapes in literals can make, written as escapes."""
    if isinstance(value, str):
        return value.encode("utf-8", "backslashreplace").decode()
    if isinstance(value, dict):
        return {k: _encodable(v) for k, v in value.items()}
    return [_encodable(v) for v in value] if isinstance(value, list) else value
