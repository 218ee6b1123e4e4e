"""Source trees: which files there are and what they hold, listed and read by tasks.

Spark's own readers leave out files whose names begin with `_`, and with them every `__init__.py`, so tasks list folders
and read files through Arrow's file systems: `file`, and those that Arrow is built with. Folders are walked in rounds: a
task walks its folders until it has met `ENTRIES` of what they hold, and gives back the folders that it did not come to,
which are dealt out anew. A small tree is one round of one task, a large one a few rounds of many; no list of paths is
on the driver.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..plans.scratch import keep
from .paths import PRUNED, UNREAD, Ignore, guard
from .scan import tasks

#: Files and folders that a task meets in a round before it gives back the rest; bytes of files in one Arrow batch at least.
ENTRIES, BATCH = 10_000, 16 << 20

LISTED = "is_folder boolean, path string, is_ignored boolean, size long"
FILES = "repo_id string, path string, content binary, is_ignored boolean"


@dataclass(frozen=True)
class Tree:
    """A tree's root in its file system, by the name that its repository has."""

    uri: str
    repo_id: str

    @classmethod
    def of(cls, root: str | Path) -> Tree:
        """Of a local folder, whose name is its absolute path, or of a URI; ValueError for a path that guard() refuses."""
        text = os.fspath(root) if root is not None else None
        if text and len(urlsplit(text).scheme) > 1:
            guard(urlsplit(text).path or "/")
            return cls(text.rstrip("/"), text.rstrip("/"))
        place = guard(root).as_posix()
        return cls(place, place)

    def open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.uri) if "://" in self.uri else (fs.LocalFileSystem(), self.uri)

    def ignore(self) -> Ignore:
        files, top = self.open()
        try:
            with files.open_input_stream(f"{top}/.gitignore") as f:
                return Ignore.parse(f.read().decode())
        except (OSError, UnicodeDecodeError):
            return Ignore()


def _inside(files: fs.FileSystem, top: str, path: str) -> bool:
    """Whether a file's real place is in the tree; only local files can be links."""
    return not isinstance(files, fs.LocalFileSystem) or Path(path).resolve().is_relative_to(Path(top).resolve())


def _is_link(files: fs.FileSystem, path: str) -> bool:
    return isinstance(files, fs.LocalFileSystem) and os.path.islink(path)


def _walk(files: fs.FileSystem, top: str, ignore: Ignore, folders: list[tuple[str, bool]], entries: int) -> Iterator[tuple[bool, str, bool, int]]:
    """LISTED rows of what is under `folders` (path in the tree, whether it is ignored), folders where the walk stopped."""
    left, met = deque(folders), 0
    while left and met < entries:
        folder, hidden = left.popleft()
        for found in files.get_file_info(fs.FileSelector(f"{top}/{folder}".rstrip("/"), allow_not_found=True)):
            met += 1
            name, path = found.base_name, f"{folder}/{found.base_name}".lstrip("/")
            if found.type == fs.FileType.Directory:
                if name not in UNREAD and not _is_link(files, found.path):
                    left.append((path, hidden or name in PRUNED or name.endswith(".egg-info") or ignore.hides(path, True)))
            elif found.type == fs.FileType.File and name.endswith(".py") and _inside(files, top, found.path):
                yield False, path, hidden or ignore.hides(path, False), found.size or 0
    for folder, hidden in left:
        yield True, folder, hidden, 0


def list_tree(spark: SparkSession, tree: Tree, entries: int = ENTRIES) -> DataFrame:
    """(path, is_ignored, size) of every .py file of a tree, also of those whose names begin with `_` or `.`.

    Links to folders are not followed, files whose real place is outside are left out. Ignored files are listed, as
    imports may lead to them, but for those in folders of version control and installed packages.
    """
    ignore, arrow = tree.ignore(), to_arrow_schema(StructType.fromDDL(LISTED))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = tree.open()
        given = [(p, h) for b in batches for p, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        rows: list[tuple] = []
        for row in _walk(files, top, ignore, given, entries):
            rows.append(row)
            if len(rows) == entries:
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in rows], schema=arrow)
                rows = []
        yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in rows], schema=arrow)

    frontier = spark.createDataFrame([("", False)], "path string, is_ignored boolean").coalesce(1)
    found = None
    while True:
        listed = keep("listed", frontier.mapInArrow(work, LISTED))
        files = listed.where("not is_folder").select("path", "is_ignored", "size")
        found = files if found is None else found.unionByName(files)
        frontier = listed.where("is_folder").select("path", "is_ignored")
        if frontier.isEmpty():
            return found
        frontier = frontier.repartition(F.xxhash64("path"))


def read_tree(spark: SparkSession, root: str | Path) -> DataFrame:
    """FILES rows of the .py files under `root`, a local folder or a URI; a file that is gone when it comes to be read is left out."""
    tree = Tree.of(root)
    arrow = to_arrow_schema(StructType.fromDDL(FILES))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = tree.open()
        rows, held = [], 0
        for b in batches:
            for path, ignored in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    with files.open_input_stream(f"{top}/{path}") as f:
                        content = f.read()
                except FileNotFoundError:
                    continue
                rows.append({"repo_id": tree.repo_id, "path": path, "content": content, "is_ignored": ignored})
                held += len(content)
                if held >= BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    # neighbours are often large together: files are dealt out by hash, into tasks by what they hold, not by their names' lengths
    listed = list_tree(spark, tree)
    n, size = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    return listed.select("path", "is_ignored").repartition(tasks(n, size), "path").mapInArrow(work, FILES)
