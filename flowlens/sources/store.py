"""Index snapshots: Parquet tables in version folders, and numbered manifests a repository, the last of which names the current ones.

New tables are written beside the old ones and become current when their manifest is put under the next number, so
that a reader sees all of the old index or all of the new one. A number is taken once: of two writers that began on the same
manifest the later one finds it taken, and applies its change to what the other left. The last `KEPT` versions stay,
for readers that began on them. Reading never creates anything.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace
from datetime import UTC, datetime
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import search as nearest
from ..schemas import ADDED, NOT_APPLICABLE, PARTS, TABLES, VERSION, columns


@dataclass(frozen=True)
class Repository:
    """What a manifest says of a repository's index."""

    repo_id: str
    root_path: str
    last_indexed_at: str | None
    backend_type: str
    embedding_model: str
    dimension: int
    version: str
    #: The version folder of each table; `version` where it is not named.
    tables: dict[str, str] = field(default_factory=dict)
    #: The number of its manifest.
    number: int = 0
    #: The version of schemas.TABLES that each table was written in; 1 where it is not named.
    schemas: dict[str, int] = field(default_factory=dict)

    def checked(self) -> Repository:
        """Itself; an index that a later version of this library wrote raises."""
        later = sorted(t for t, v in self.schemas.items() if v > VERSION)
        if later:
            raise ValueError(f"the index of {self.repo_id} has tables of a later version: {', '.join(later)}")
        return self

    def schema(self, table: str) -> int:
        return self.schemas.get(table, 1)

    def folder(self, table: str) -> str:
        return self.tables.get(table, self.version)

    def folders(self) -> set[str]:
        return {self.folder(t) for t in TABLES}


class Conflict(RuntimeError):
    """Another writer changed the index since it was read."""


#: Versions of an index that stay, and how often a change is applied again after another writer's.
KEPT, RETRIES = 3, 20
MANIFEST = re.compile(r"manifest-([0-9]{9})\.json")


class Store:
    """Indexes of any number of repositories under one folder, a local path or a Hadoop URI."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        self._fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @staticmethod
    def key(repo_id: str) -> str:
        return hashlib.sha256(repo_id.encode()).hexdigest()[:24]

    # ---- manifests

    def _numbers(self, folder: str) -> list[int]:
        """Numbers of the manifests in a repository's folder, in order."""
        if not self._fs.exists(self._path(folder)):
            return []
        found = (MANIFEST.fullmatch(f.getPath().getName()) for f in self._fs.listStatus(self._path(folder)))
        return sorted(int(m[1]) for m in found if m)

    def _manifest(self, folder: str, number: int) -> dict:
        stream = self._fs.open(self._path(folder, f"manifest-{number:09d}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        stated = json.loads(text)
        if not isinstance(stated, dict):
            raise ValueError("it is no object")
        return stated | {"number": number}

    def get_repository(self, repo_id: str, number: int | None = None) -> Repository | None:
        """The repository's manifest, the last one or that with `number`; None if there is none. An index that cannot be read raises."""
        folder = self.key(repo_id)
        numbers = self._numbers(folder)
        if not numbers or number is not None and number not in numbers:
            return None
        try:
            found = Repository(**self._manifest(folder, numbers[-1] if number is None else number))
        except (ValueError, TypeError) as e:
            raise ValueError(f"the manifest of {repo_id} is damaged: {e}") from e
        found.checked()
        for version in sorted(found.folders()):
            if not self._fs.exists(self._path(folder, version)):
                raise ValueError(f"the index of {repo_id} lacks its version {version}")
        return found

    def versions(self, repo_id: str) -> list[int]:
        """Numbers of the versions that can be read, the current one last."""
        return self._numbers(self.key(repo_id))

    def _known(self, repo_id: str) -> Repository:
        info = self.get_repository(repo_id)
        if info is None:
            raise ValueError(f"{repo_id} has no index")
        return info

    def _all(self) -> list[Repository]:
        """The current manifest of every repository, by repo_id."""
        if not self._fs.exists(self._path()):
            return []
        found = []
        for status in self._fs.listStatus(self._path()):
            folder = status.getPath().getName()
            numbers = self._numbers(folder) if status.isDirectory() else []
            if numbers:
                found.append(Repository(**self._manifest(folder, numbers[-1])).checked())
        return sorted(found, key=lambda r: r.repo_id)

    def repositories(self) -> list[str]:
        """Repositories with an index in this store, in order."""
        return [r.repo_id for r in self._all()]

    def is_indexed(self, repo_id: str) -> bool:
        return self.get_repository(repo_id) is not None

    def _publish(self, info: Repository) -> None:
        """Make `info` the manifest of its number; Conflict if there is one."""
        folder = self.key(info.repo_id)
        part, final = self._path(folder, f"{info.version}.tmp"), self._path(folder, f"manifest-{info.number:09d}.json")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps(asdict(info)).encode()))
        out.close()
        try:
            # earlier numbers are free again once their versions are gone
            taken = info.number > max(self._numbers(folder), default=0) and self._take(part, final)
        finally:
            self._fs.delete(part, False)
        if not taken:
            raise Conflict(f"version {info.number} of {info.repo_id} is there already")
        self._forget(folder)

    def _take(self, part, final) -> bool:
        """Give the file `part` the name `final` as well, or in its place, unless it is taken; one of several that try succeeds."""
        if self._fs.getUri().getScheme() == "file":  # a rename looks first and then acts there, a link does both at once
            try:
                os.link(part.toUri().getPath(), final.toUri().getPath())
            except FileExistsError:
                return False
            return True
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        how = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(part, final, how)
        except Py4JJavaError:
            if self._fs.exists(final):
                return False
            raise
        return True

    def _forget(self, folder: str) -> None:
        """Remove versions before the last KEPT ones."""
        numbers, used = self._numbers(folder), set()
        for n in reversed(numbers):
            try:
                folders = Repository(**self._manifest(folder, n)).folders()
            except (ValueError, TypeError):
                folders = set()
            if n in numbers[-KEPT:]:
                used |= folders
                continue
            self._fs.delete(self._path(folder, f"manifest-{n:09d}.json"), False)
            for version in folders - used:
                self._fs.delete(self._path(folder, version), True)

    # ---- writing

    def _write(self, repo_id: str, version: str, name: str, df: DataFrame | None, dimension: int) -> None:
        df = self._none(name) if df is None else df.select(*columns(name))
        path = "/".join([self.root, self.key(repo_id), version, name])
        df.write.parquet(path)
        # what was written is looked at, so that vectors are computed once
        if name == "chunks" and not self._read(path, name).where((F.size("vector") != dimension) | (F.col("dimension") != dimension)).isEmpty():
            self._fs.delete(self._path(self.key(repo_id), version), True)
            raise ValueError(f"vectors of another dimension than {dimension}")

    def _put(self, base: Repository, tables: Mapping[str, DataFrame | None], kept: Mapping[str, str], at: datetime | None, over: bool = False) -> Repository:
        """Write `tables` as the version after `base`, with the `kept` folders of the others; Conflict if there is one, unless it goes `over` whatever is there."""
        version = f"v-{uuid.uuid4().hex}"
        for name in sorted(tables, key=lambda n: n != "chunks"):
            self._write(base.repo_id, version, name, tables[name], base.dimension)
        while True:
            try:
                # tables that stay keep the schema that they were written in
                schemas = {n: base.schema(n) if n in kept else VERSION for n in TABLES}
                info = replace(base, last_indexed_at=(at or datetime.now(UTC)).isoformat(), version=version, tables={n: kept.get(n, version) for n in TABLES}, number=base.number + 1, schemas=schemas)
                self._publish(info)
                return info
            except Conflict:
                if not over:
                    self._fs.delete(self._path(self.key(base.repo_id), version), True)
                    raise
                base = replace(base, number=self.versions(base.repo_id)[-1])

    def _change(self, repo_id: str, tables: Callable[[Repository], Mapping[str, DataFrame]]) -> None:
        """Put what `tables` makes of the current version in its place, again if another writer came first; tables that it does not name stay."""
        for _ in range(RETRIES):
            base = self._known(repo_id)
            new = tables(base)
            try:
                self._put(base, new, {n: base.folder(n) for n in TABLES if n not in new}, None)
                return
            except Conflict:
                continue
        raise Conflict(f"{repo_id} was changed by others {RETRIES} times")

    def replace(self, repo_id: str, root_path: str, tables: Mapping[str, DataFrame], model: str, dimension: int, at: datetime | None = None) -> Repository:
        """Make `tables` (by the names in schemas.TABLES; absent ones are empty) the repository's whole index."""
        base = Repository(repo_id, root_path, None, "parquet", model, dimension, "", number=(self.versions(repo_id) or [0])[-1])
        return self._put(base, {n: tables.get(n) for n in TABLES}, {}, at, over=True)

    def upsert_chunks(self, repo_id: str, chunks: DataFrame) -> None:
        """Add chunks to a repository's index; those with a chunk_id that it has replace it. An empty frame changes nothing, other tables stay as they are."""
        if chunks.isEmpty():
            return

        def merged(base: Repository) -> dict[str, DataFrame]:
            kept = self._table(base, "chunks").join(chunks.select("chunk_id").distinct(), "chunk_id", "left_anti")
            return {"chunks": kept.select(*columns("chunks")).unionByName(chunks.select(*columns("chunks")))}

        self._change(repo_id, merged)

    def upsert_graphs(self, repo_id: str, tables: Mapping[str, DataFrame]) -> None:
        """Put graphs with all their parts in place of those with the same graph_id; other graphs and their chunks stay.

        `tables` names graphs and any of nodes, edges, routes, tool_bindings and chunks; a part that is not named is empty for these graphs.
        """
        gone = tables["graphs"].select("graph_id").distinct()
        self._change(repo_id, lambda base: self._merged(base, gone, tables))

    def _merged(self, base: Repository, gone: DataFrame, tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        """The parts of a repository's graphs without those of the graphs `gone` (graph_id), and with `tables`."""
        new = {}
        for name in PARTS:
            kept = self._table(base, name).join(gone, "graph_id", "left_anti").select(*columns(name))
            new[name] = kept.unionByName(tables[name].select(*columns(name))) if name in tables else kept
        return new

    def refresh(self, base: Repository, stale: DataFrame, tables: Mapping[str, DataFrame], at: datetime | None = None) -> Repository:
        """Put `tables` in place of all graphs of the version `base` in the files `stale` (path); tables["files"] replaces the table of facts.

        What is stale was found from that version, so Conflict is raised if it is not the current one.
        """
        gone = self._table(base, "graphs").join(stale.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("graph_id")
        return self._put(base, self._merged(base, gone, tables) | {"files": tables["files"]}, {}, at)

    def has_files(self, repo_id: str) -> bool:
        """Whether the repository's index has the facts that it was made of, which indexes of earlier versions lack."""
        info = self.get_repository(repo_id)
        return info is not None and self._fs.exists(self._path(self.key(repo_id), info.folder("files"), "files"))

    def delete_repo(self, repo_id: str) -> None:
        """Remove a repository's index; an unknown one is no error."""
        self._fs.delete(self._path(self.key(repo_id)), True)

    # ---- reading

    def _read(self, paths: str | Sequence[str], name: str) -> DataFrame:
        given = [paths] if isinstance(paths, str) else paths
        return self.spark.read.schema(TABLES[name]).parquet(*[re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in given])  # readers take patterns

    def _none(self, name: str) -> DataFrame:
        """An empty table, for which no Python is started."""
        return self.spark.range(0, 0, 1, 1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(TABLES[name])])

    def _table(self, info: Repository, name: str) -> DataFrame:
        return migrated(self._read("/".join([self.root, self.key(info.repo_id), info.folder(name), name]), name), name, info.schema(name))

    def table(self, repo_id: str, name: str, number: int | None = None) -> DataFrame:
        """A table of a repository's index as it stands, or as version `number` had it; empty if there is none."""
        info = self.get_repository(repo_id, number)
        return self._table(info, name) if info else self._none(name)

    def list_graphs(self, repo_id: str) -> DataFrame:
        """Graphs in order of graph_id, with nodes, edges, routes and tool bindings nested."""
        return nested(*(self.table(repo_id, n) for n in ("graphs", "nodes", "edges", "routes", "tool_bindings"))).orderBy("graph_id")

    def get_graph(self, repo_id: str, graph_id: str) -> DataFrame:
        return self.list_graphs(repo_id).where(F.col("graph_id") == graph_id)

    def search(self, query: Sequence[float], top_k: int, filters: Mapping[str, str]) -> DataFrame:
        """The nearest chunks, of the repository that `filters` names or of all in the store."""
        nearest.check(top_k, filters, query, None)
        if "repo_id" in filters:
            one = self.get_repository(filters["repo_id"])
            infos = [one] if one else []
        else:
            infos = self._all()
        for info in infos:
            nearest.check(top_k, filters, query, info.dimension)
        paths: dict[int, list[str]] = {}
        for i in infos:
            paths.setdefault(i.schema("chunks"), []).append("/".join([self.root, self.key(i.repo_id), i.folder("chunks"), "chunks"]))
        # a scan for each version of the schema, however many repositories
        scans = [migrated(self._read(p, "chunks"), "chunks", version) for version, p in sorted(paths.items())]
        rows = reduce(DataFrame.unionByName, scans) if scans else self._none("chunks")
        return nearest.top_k(rows, query, top_k, filters=filters)


def migrated(rows: DataFrame, table: str, version: int) -> DataFrame:
    """Rows of a table that was written in an earlier version of the schema, with the columns that later ones added.

    `rows` has all columns of today's schema, null where the files lack them. Versions are gone through one by one, so that a
    column may be made of one that an earlier step added. Rows of today's version are given back as they are.
    """
    for step in range(version + 1, VERSION + 1):
        added = ADDED[step].get(table, {})
        rows = rows.withColumns({c: F.coalesce(c, F.expr(e)) for c, e in added.items()}) if added else rows
    return rows


def nested(graphs: DataFrame, nodes: DataFrame, edges: DataFrame, routes: DataFrame, bindings: DataFrame) -> DataFrame:
    """One row a graph with its parts as arrays of structs in order; each part is collected before they meet."""
    keys, out = ["repo_id", "graph_id"], graphs
    for name, df, order in (("nodes", nodes, "node_ord"), ("edges", edges, "edge_ord"), ("conditional_routes", routes, "route_id"), ("tool_bindings", bindings, "binding_ord")):
        columns = [c for c in df.columns if c not in keys]
        part = df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*columns).alias("_s")))), lambda x: x["_s"]).alias(name))
        out = out.join(part, keys, "left")
    return out


def to_json(graph: DataFrame) -> DataFrame:
    """(repo_id, graph_id, document): each nested graph as one JSON document."""
    return graph.select("repo_id", "graph_id", F.to_json(F.struct(*graph.columns)).alias("document"))


def from_json(documents: DataFrame, like: DataFrame) -> DataFrame:
    """Nested graphs from JSON documents, in the schema of `like`; a document without routing states has not_applicable."""
    parsed = documents.select(F.from_json("document", like.schema).alias("g")).select("g.*")
    state = lambda n: n.withField("routing_resolution", F.coalesce(n["routing_resolution"], F.lit(NOT_APPLICABLE)))
    return parsed.withColumn("nodes", F.transform("nodes", state))
