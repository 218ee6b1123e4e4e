"""Facts of source text from SQL alone: table functions over a column, or over a whole table of files."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from .kernel import parse

#: One row a fact: its kind, place among the file's facts of that kind, the builder or function that it is of, and what it says.
FACTS = "kind string, ord int, of string, name string, source string, target string, line_start int, line_end int"


def _facts(content: bytes | bytearray | str | None) -> Iterator[tuple]:
    """FACTS rows of a file: its status, builders, functions, imports and calls on builders."""
    found = parse(content.encode() if isinstance(content, str) else bytes(content or b""))
    yield "status", 0, None, found["parse_status"], None, found["error"], None, None
    for i, name in enumerate(found["builders"]):
        yield "builder", i, name, name, None, None, None, None
    for f in found["functions"]:
        yield "function", f["ord"], None, f["name"], None, None, f["line_start"], f["line_end"]
    for i in found["imports"]:
        yield "import", i["ord"], None, i["local"], i["module"], i["original"], None, None
    for c in found["calls"]:
        yield c["method"], c["ord"], c["var"], c.get("name") or c.get("router") or c.get("entry"), c.get("src"), c.get("dst"), c["line_start"], c["line_end"]


@udtf(returnType=FACTS)
class ParseSource:
    """parse_source(code): the facts of one text, for LATERAL joins with a table that holds it."""

    def eval(self, code: str) -> Iterator[tuple]:
        yield from _facts(code)


@udtf(returnType="path string, " + FACTS)
class ParseFiles:
    """parse_files(TABLE(files)): the facts of every row (path, content) of a table, wherever its rows lie."""

    def eval(self, row: Row) -> Iterator[tuple]:
        for fact in _facts(row["content"]):
            yield row["path"], *fact


def register(spark: SparkSession) -> None:
    """Make parse_source and parse_files known to the session's SQL."""
    spark.udtf.register("parse_source", ParseSource)
    spark.udtf.register("parse_files", ParseFiles)
