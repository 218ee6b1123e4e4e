"""Tables of source text to file facts."""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..schemas import FILE_DDL
from .kernel import parse, uncollected, unwarned


#: Parsing takes a few seconds for as many files, or as many bytes. A task writes a file of facts, and to open one costs
#: every scan of them more than to read hundreds of small modules' facts.
FILES_A_TASK, BYTES_A_TASK = 8192, 1 << 21
#: Tasks that a job can well have; beyond them each takes more.
MOST_TASKS = 100_000


def tasks(files: int, size: int) -> int:
    """Into how many tasks the parsing of `files` files of `size` bytes together goes."""
    return max(1, min(MOST_TASKS, max(-(-files // FILES_A_TASK), -(-size // BYTES_A_TASK))))


def spread(files: DataFrame) -> DataFrame:
    """`files`, a written table, dealt out by hash into tasks that parse about equally long; its contents' lengths are read first.

    Repeated rows of one path go to one task.
    """
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).first()
    return files.repartition(tasks(n, size), "repo_id", "path")


def facts(files: DataFrame) -> DataFrame:
    """One row of facts (schemas.FILE_DDL) for each row (repo_id, path, content, is_ignored) of `files`.

    content is binary or text; is_ignored may be left out. A file that cannot be read or parsed is a row too, with its
    parse_status. Nothing is shuffled; null content counts as empty.
    """
    schema = to_arrow_schema(StructType.fromDDL(FILE_DDL))
    ignored = F.coalesce("is_ignored", F.lit(False)) if "is_ignored" in files.columns else F.lit(False)
    rows = files.select("repo_id", "path", ignored.alias("is_ignored"), F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content"))

    def work(batches):
        for batch in batches:
            repos, paths, flags, contents = (c.to_pylist() for c in batch.columns)
            with uncollected(), unwarned():
                found = [{"repo_id": r, "path": p, "is_ignored": i, "digest": sha256(c).hexdigest()} | parse(c) for r, p, i, c in zip(repos, paths, flags, contents, strict=True)]
            yield pa.RecordBatch.from_pylist(found, schema=schema)

    return rows.mapInArrow(work, FILE_DDL)
