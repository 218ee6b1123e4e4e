"""Functions that live in other files, found along imports: at most three hops, unrolled as joins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import keep
from ..schemas import DYNAMIC, PARTIAL
from .arrays import first_of_each, last_of_each, let, looked_up

#: Modules that an import is followed through.
HOPS = 3


def from_imports(imports: DataFrame) -> DataFrame:
    """(repo_id, path, local, module, level, original) of from-imports; of several for a name the last."""
    named = imports.where((F.col("kind") == "from") & (F.col("original") != "*"))
    last = named.groupBy("repo_id", "path", "local").agg(F.max_by(F.struct("module", "level", "original"), "ord").alias("_i"))
    return last.select("repo_id", "path", "local", "_i.*")


def candidate_files():
    """Files that (path, module, level) may mean, in order: the module, then the package; none outside the root."""
    parts = F.split(F.coalesce("module", F.lit("")), r"\.")
    folders = F.split("path", "/")
    up = F.size(folders) - F.col("level")
    base = F.when(F.col("level") > 0, F.when(up >= 0, F.slice(folders, F.lit(1), F.greatest(up, F.lit(0))))).otherwise(F.slice(folders, F.lit(1), F.lit(0)))
    bare = F.coalesce("module", F.lit("")) == ""
    target = F.array_join(F.concat(base, parts), "/")
    package = F.array_join(F.concat(base, F.array(F.lit("__init__.py"))), "/")
    none = F.slice(folders, F.lit(1), F.lit(0))
    return F.when(base.isNull() | (bare & (F.col("level") == 0)), none).when(bare, F.array(package)).otherwise(F.array(F.concat(target, F.lit(".py")), F.concat(target, F.lit("/__init__.py"))))


def links(parsed: DataFrame) -> DataFrame:
    """(repo_id, path, to): the files that imports of each file may mean, whether they exist or not."""
    imports = parsed.select("repo_id", "path", F.explode("imports").alias("_f")).select("repo_id", "path", "_f.*")
    return from_imports(imports).select("repo_id", "path", F.explode(candidate_files()).alias("to")).distinct()


def _import_of(imports: Column, name: Column) -> Column:
    """What the last from-import of a name says: module, level, original; null if there is none."""
    named = F.filter(imports, lambda f: (f["kind"] == "from") & (f["original"] != "*") & (f["local"] == name))
    return F.array_max(F.transform(named, lambda f, i: F.struct(f["ord"], i.alias("i"), f["module"], f["level"], f["original"])))


def _wanted(own: DataFrame) -> DataFrame:
    """Partial nodes whose function, as the node's last registration names it, is imported: with what that import says."""
    named = lambda a, b: F.struct(a["var"], a["name"], a["ord"], a["resolution"], b["func_kind"], b["func_name"])
    both = let(F.col("registered"), lambda r: F.zip_with(first_of_each(r, "var", "name"), last_of_each(r, "var", "name"), named))
    partial = F.filter(both, lambda n: (n["resolution"] == PARTIAL) & ~n["name"].startswith(DYNAMIC) & (n["func_kind"] == "name"))
    led = F.filter(F.transform(partial, lambda n: F.struct(n.alias("n"), _import_of(F.col("imports"), n["func_name"]).alias("m"))), lambda x: x["m"].isNotNull())
    # files none of whose nodes names an import need not be looked at closer
    used = F.transform(F.filter("calls", lambda c: (c["method"] == "add_node") & (c["func_kind"] == "name")), lambda c: c["func_name"])
    given = F.transform(F.filter("imports", lambda f: f["kind"] == "from"), lambda f: f["local"])
    each = own.where(F.arrays_overlap(used, given)).select("repo_id", F.col("path").alias("of"), "path", F.explode(led).alias("_x"))
    return each.select("repo_id", "of", "_x.n.var", "_x.n.name", "_x.n.ord", "path", "_x.m.module", "_x.m.level", "_x.m.original", F.array().cast("array<int>").alias("_key"), F.array("path").alias("_seen"))


def resolve(own: DataFrame, parsed: DataFrame, modules: Callable[[Column], Column], cut: Callable[[str, DataFrame], DataFrame] = keep) -> DataFrame | None:
    """Bodies for partial nodes whose function's name is imported: repo_id, path, var, name and ord of the node, source_file, the function's facts fn, and
    sources, the modules that its tools come from. None if there are none.

    `own` has imports, calls and registered, in order of (var, name, ord), of files that hold graphs. Where several files could hold the function, candidates
    are tried in order, each with all that it re-exports before the next. A hop carries the order of its choices and the files that it came through, so
    circular imports end. Each hop is written out by `cut`, so that few names are sent to the files and files are not shuffled for them.
    """
    # two names of each call and import say in most repositories that there are none, and are read without the rest of the facts
    if own.where(F.arrays_overlap("calls.func_name", "imports.local")).isEmpty():
        return None
    node = ["repo_id", "of", "var", "name", "ord"]
    files = parsed.select("repo_id", F.col("path").alias("to"), F.col("functions").alias("_functions"), F.col("imports").alias("_imports"))
    at_top = F.filter("_functions", lambda f: f["is_module"] & (f["name"] == F.col("original")))
    defined = F.array_min(F.transform(at_top, lambda f: F.struct(f["ord"], f.alias("fn"))))["fn"]
    used = F.flatten(F.transform("fn.tools", lambda t: t["elements"]))
    sources = F.when(F.size(used) > 0, let(modules(F.col("_imports")), lambda m: F.transform(used, lambda e: looked_up(m, e["base"])))).otherwise(F.array().cast("array<string>"))
    frontier, found = cut("wanted", _wanted(own)), []
    for hop in range(HOPS):
        if frontier.isEmpty():
            break
        led = frontier.select(*node, "original", "_key", "_seen", F.posexplode(candidate_files()).alias("_i", "to"))
        met = led.where(~F.array_contains("_seen", F.col("to"))).join(files, ["repo_id", "to"]).withColumn("fn", defined)
        onward = F.when(F.col("fn").isNull(), _import_of(F.col("_imports"), F.col("original")))
        step = cut(f"hop{hop}", met.select(*node, F.concat("_key", F.array("_i")).alias("_key"), F.concat("_seen", F.array("to")).alias("_seen"), F.col("to").alias("path"), "fn", sources.alias("sources"), onward.alias("_m")).where("fn is not null or _m is not null"))
        found.append(step.where("fn is not null").select(*node, "_key", "path", "fn", "sources"))
        frontier = step.where("fn is null").select(*node, "path", "_m.module", "_m.level", "_m.original", "_key", "_seen")
    if not found:
        return None
    first = reduce(DataFrame.unionByName, found).groupBy(*node).agg(F.min_by(F.struct("path", "fn", "sources"), "_key").alias("_b"))
    return cut("upgrades", first.select("repo_id", F.col("of").alias("path"), "var", "name", "ord", F.col("_b.path").alias("source_file"), "_b.fn", "_b.sources"))
