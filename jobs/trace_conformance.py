"""Trace conformance: do recorded conversations follow the workflow that is declared for them?

    python -m jobs.trace_conformance --conversations PATH --output PATH [--config FILE]

Reads turns (conv_id, turn, role, ...) and a declared workflow, the configuration's edges between roles (from `__start__`
to `__end__`). Every step from one turn to the next, from the start and to the end is
`declared` (an edge), `skips` (no edge, but a declared route leads there: nodes on it were left out) or `undeclared` (no route at all).

Writes, over what an earlier run left, `OUTPUT/steps` by state and `OUTPUT/conversations`, one row a conversation, by
verdict: its worst state. A rerun over the same turns gives the same tables.

Turns are in order of (turn, role), a null turn first; rows with equal conversation, turn and role count once, and a null role is
the node `<unresolved>`. A null conv_id is a conversation like any other. A conversation may hold a third of all
turns: it is cut into buckets of turn numbers, each put in order by itself, and only the first and the number of turns
of each bucket are put in order for a whole conversation.
"""

from __future__ import annotations

import logging
from pathlib import Path

from flowlens.operators import graphops
from flowlens.plans.scratch import keep
from flowlens.schemas import END, START, UNRESOLVED
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs import common

log = logging.getLogger("flowlens.jobs.trace_conformance")
SETTINGS = str(Path(__file__).with_suffix(".json"))
STEPS = "conv_id long, step long, source string, target string, hops int, skipped array<string>, state string"
CONVERSATIONS = "conv_id long, n_turns long, n_steps long, n_skips long, n_undeclared long, first_deviation long, longest_detour int, verdict string"
#: Pairs of nodes that are sent to all tasks at most; more are joined by their nodes.
BROADCAST = 50_000


def steps(turns: DataFrame, span: int) -> DataFrame:
    """(conv_id, step, source, target): every step of every conversation, numbered from 0, the one out of the start."""
    node = F.coalesce("role", F.lit(UNRESOLVED)).alias("node")
    bucket = F.coalesce(F.floor(F.col("turn") / span), F.lit(-(1 << 62))).alias("_b")
    rows = keep("turns", turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", node, bucket).distinct())
    inner = Window.partitionBy("conv_id", "_b").orderBy(F.asc_nulls_first("turn"), "node")
    placed = rows.select("conv_id", "_b", F.col("node").alias("source"), F.row_number().over(inner).alias("_i"), F.lead("node").over(inner).alias("_next"))
    first = F.min_by("node", F.struct("turn", "node"))
    buckets = rows.groupBy("conv_id", "_b").agg(F.count(F.lit(1)).alias("_n"), first.alias("_first"))
    outer = Window.partitionBy("conv_id").orderBy("_b")
    along = keep("buckets", buckets.select("conv_id", "_b", "_first", (F.sum("_n").over(outer) - F.col("_n")).alias("_before"), F.lead("_first").over(outer).alias("_then"), (F.row_number().over(outer) == 1).alias("_opens")))
    met = placed.join(along, placed["conv_id"].eqNullSafe(along["conv_id"]) & (placed["_b"] == along["_b"])).drop(along["conv_id"])
    walked = met.select("conv_id", (F.col("_before") + F.col("_i")).alias("step"), "source", F.coalesce("_next", "_then", F.lit(END)).alias("target"))
    opened = along.where("_opens").select("conv_id", F.lit(0).cast("long").alias("step"), F.lit(START).alias("source"), F.col("_first").alias("target"))
    return opened.unionByName(walked)


def judged(walked: DataFrame, edges: list[list[str]]) -> DataFrame:
    """Steps with their state, and for those that are no edge the hops of the declared route and the nodes that it has between."""
    spark = walked.sparkSession
    rows = [("declared", "trace", f"{i}", i, a, b) for i, (a, b) in enumerate(dict.fromkeys(map(tuple, edges)))]
    declared = spark.createDataFrame(rows, "repo_id string, graph_id string, edge_id string, edge_ord int, source string, target string")
    pairs = keep("pairs", walked.select("source", "target").distinct())
    requests = pairs.join(declared, ["source", "target"], "left_anti").select(F.lit("declared").alias("repo_id"), F.lit("trace").alias("graph_id"), F.col("source").alias("from_node"), F.col("target").alias("to_node"))
    # a step from a node to itself is a way out of it and back, which a request to its own node is not
    through = requests.where("from_node = to_node").join(declared.select(F.col("source").alias("from_node"), F.col("target").alias("_first")), "from_node")
    around = graphops.shortest_routes(declared, through.select("repo_id", "graph_id", F.col("_first").alias("from_node"), "to_node"), cut=keep)
    back = around.select(F.col("to_node").alias("source"), F.col("to_node").alias("target"), (F.col("hops") + 1).alias("hops"), F.slice("route", 1, F.size("route") - 1).alias("skipped"))
    back = back.groupBy("source", "target").agg(F.min(F.struct("hops", "skipped")).alias("_r")).select("source", "target", "_r.*")
    ahead = graphops.shortest_routes(declared, requests.where("from_node <> to_node"), cut=keep)
    routes = ahead.select(F.col("from_node").alias("source"), F.col("to_node").alias("target"), "hops", F.slice("route", 2, F.size("route") - 2).alias("skipped")).unionByName(back)
    edge = declared.select("source", "target", F.lit(1).alias("hops"), F.array().cast("array<string>").alias("skipped"))
    known = keep("known", pairs.join(edge.unionByName(routes), ["source", "target"], "left"))
    state = F.when(F.col("hops") == 1, "declared").when(F.col("hops") > 1, "skips").otherwise("undeclared")
    met = walked.join(F.broadcast(known) if known.count() <= BROADCAST else known, ["source", "target"])
    return met.select("conv_id", "step", "source", "target", F.col("hops").cast("int").alias("hops"), "skipped", state.alias("state"))


def summed_up(walked: DataFrame) -> DataFrame:
    """One row a conversation from its judged steps."""
    off = F.col("state") != "declared"
    found = walked.groupBy("conv_id").agg(
        (F.count(F.lit(1)) - 1).alias("n_turns"),
        F.count(F.lit(1)).alias("n_steps"),
        F.count_if(F.col("state") == "skips").alias("n_skips"),
        F.count_if(F.col("state") == "undeclared").alias("n_undeclared"),
        F.min(F.when(off, F.col("step"))).alias("first_deviation"),
        F.max(F.when(off, F.col("hops"))).alias("longest_detour"),
    )
    return found.withColumn("verdict", F.when(F.col("n_undeclared") > 0, "undeclared").when(F.col("n_skips") > 0, "skips").otherwise("declared"))


def read(spark: SparkSession, output: str) -> DataFrame:
    """The conversations that a run wrote."""
    return common.written(spark, f"{output}/conversations", CONVERSATIONS)


def run(spark: SparkSession, conversations: str, output: str, config: str = SETTINGS) -> dict[str, int]:
    """Judge the turns in `conversations` (Parquet) and write both tables below `output`; the number of conversations by verdict."""
    settings = common.config(config, {"edges": list, "turns_per_bucket": int})
    turns = spark.read.parquet(conversations)
    log.info("read %d turns of %s", turns.count(), conversations)
    judged(steps(turns, settings["turns_per_bucket"]), settings["edges"]).write.mode("overwrite").partitionBy("state").parquet(f"{output}/steps")
    done = common.written(spark, f"{output}/steps", STEPS)
    summed_up(done).write.mode("overwrite").partitionBy("verdict").parquet(f"{output}/conversations")
    found = {r["verdict"]: r["count"] for r in read(spark, output).groupBy("verdict").count().collect()}
    log.info("wrote %d steps and %s conversations to %s", done.count(), found, output)
    return found


if __name__ == "__main__":
    common.command("trace conformance: conversations against a declared workflow", {"conversations": "Parquet table of turns", "output": "folder of the two tables"}, SETTINGS, run)
