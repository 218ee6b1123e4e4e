"""Indexing by difference: what changed is parsed, what that may touch is assembled anew, everything else stays.

A graph depends on its own file and on those that its imports lead to, over HOPS modules at most. So the files whose
graphs may differ are those that changed, came or went, and those from which imports lead there: the same hops, walked
backwards as joins. To assemble them their own imports are followed forwards, so that no other file is looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import keep
from ..sources.scan import facts, spread
from .assemble import Index, assemble
from .resolve import HOPS, links

FILE = ["repo_id", "path"]


@dataclass(frozen=True)
class Difference:
    """What a refresh found."""

    #: Facts of all files as they are now, and of those that were parsed for it.
    files: DataFrame
    parsed: DataFrame
    #: (repo_id, path) of files whose graphs may differ from those in the index, also of files that are gone.
    stale: DataFrame
    #: The graphs of stale files, and the facts that they were assembled from.
    index: Index
    scope: DataFrame


def _closure(start: DataFrame, along: DataFrame, source: str, target: str) -> DataFrame:
    """`start` (repo_id, path) and the files up to HOPS links away from it."""
    found = level = start
    for _ in range(HOPS):
        level = along.join(level.withColumnRenamed("path", source), ["repo_id", source], "left_semi").select("repo_id", F.col(target).alias("path")).distinct()
        found = found.unionByName(level)
    return found.distinct()


def difference(stored: DataFrame, files: DataFrame, cut: Callable[[str, DataFrame], DataFrame] = keep) -> Difference:
    """What `files` (repo_id, path, content, is_ignored) of some repositories mean for an index made of the facts `stored`.

    A file is taken as it was if path, digest and is_ignored are those of a stored one. Contents are read once; those of
    changed files are written by `cut`, as are the steps that are read more than once.
    """
    content = F.coalesce(F.col("content").cast("binary"), F.lit(b""))
    now = files.select(*FILE, F.coalesce("is_ignored", F.lit(False)).alias("is_ignored"), F.sha2(content, 256).alias("digest"), content.alias("content"))
    same = [*FILE, "is_ignored", "digest"]
    known = stored.select(*same, F.lit(True).alias("_old"))
    met = now.join(known, same, "left").select(*same, "_old", F.when(F.col("_old").isNull(), F.col("content")).alias("content"))
    status = cut("status", met)
    changed, unchanged = status.where("_old is null"), status.where("_old")
    parsed = cut("parsed", facts(spread(changed.select(*FILE, "content", "is_ignored"))))
    current = stored.join(unchanged.select(*same), same, "left_semi").unionByName(parsed)
    gone = stored.select(*FILE).join(status.select(*FILE), FILE, "left_anti")
    touched = cut("touched", changed.select(*FILE).unionByName(gone).distinct())
    along = cut("links", links(current.where("parse_status = 'ok'")))
    stale = cut("stale", _closure(touched, along, "to", "path"))
    needed = _closure(stale, along, "path", "to")
    marked = current.join(needed, FILE, "left_semi").join(stale.withColumn("_stale", F.lit(True)), FILE, "left")
    # files that are only imported from hold no graphs here
    scope = cut("scope", marked.withColumn("is_ignored", F.col("is_ignored") | F.col("_stale").isNull()).drop("_stale"))
    return Difference(current, parsed, stale, assemble(scope, cut), scope)
