"""Command line: `index PATH`, `status PATH`, both with --json, and `serve`.

Exit codes: 0 yes, 1 no (no graphs found, no index), 2 it could not be done.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence


def _write(stream, text: str) -> None:
    try:
        stream.write(text + "\n")
    except UnicodeEncodeError:
        coding = getattr(stream, "encoding", None) or "ascii"
        stream.write(text.encode(coding, "backslashreplace").decode(coding) + "\n")
    stream.flush()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="flowlens", description="Index workflow graphs in Python source and report on the index.")
    verbs = p.add_subparsers(dest="verb", required=True)
    for name, text in (("index", "index a repository"), ("status", "tell whether a repository has an index")):
        v = verbs.add_parser(name, help=text)
        v.add_argument("path")
        v.add_argument("--json", action="store_true", help="print the answer as JSON")
    verbs.add_parser("serve", help="answer tool calls as JSON lines on standard input and output")
    return p


def _engine():
    from pyspark.sql import SparkSession

    from .api import Engine

    spark = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return Engine(spark)


def main(argv: Sequence[str] | None = None, engine=None, out=None, err=None) -> int:
    out, err = out or sys.stdout, err or sys.stderr
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return 0 if e.code in (0, None) else 2
    try:
        if args.verb == "serve":
            from .server import serve

            serve(engine or _engine(), sys.stdin, out)
            return 0
        answer = (engine or _engine()).__getattribute__("index_repo" if args.verb == "index" else "repository_status")(args.path)
        if "error" in answer:
            _write(err, json.dumps(answer, ensure_ascii=False) if args.json else f"error: {answer['error']}: {answer.get('reason') or answer.get('detail') or answer.get('path')}")
            return 2
        lines = json.dumps(answer, ensure_ascii=False) if args.json else "\n".join(f"{k}: {v}" for k, v in answer.items())
        _write(out, lines)
    except Exception as e:  # the boundary of the program
        _write(err, f"error: {type(e).__name__}: {e}")
        return 2
    return 1 if answer.get("indexed") is False or answer.get("graphs_found") == 0 else 0


if __name__ == "__main__":
    sys.exit(main())
