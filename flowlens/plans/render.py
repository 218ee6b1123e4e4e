"""The driver's tables as Python modules, by string functions: what the parser reads back is known beforehand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD = "from flowlib import StateGraph, START, END, ToolNode, Command\n"


def lines(items: Column, form) -> Column:
    """One line an item."""
    return F.array_join(F.transform(items, form), "")


def _module(rows: DataFrame, path: Column, content: Column) -> DataFrame:
    return rows.select(F.lit("rendered").alias("repo_id"), path.alias("path"), content.alias("content"))


def chains(orders: DataFrame) -> DataFrame:
    """A module a customer: its orders in time as a chain of nodes, functions for even keys, entry by the first one's status."""
    item = F.struct("o_orderdate", "o_orderkey", "o_orderstatus")
    per = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(item)).alias("o"))
    name = lambda x: F.concat(F.lit("o"), x["o_orderkey"].cast("string"))
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    n = F.size("o")
    even = F.filter("o", lambda x: x["o_orderkey"] % 2 == 0)
    defs = lines(even, lambda x: F.concat(F.lit("def "), name(x), F.lit("(state):\n    return state\n")))
    adds = lines(F.col("o"), lambda x: F.concat(F.lit("g.add_node("), q(name(x)), F.lit(", "), name(x), F.lit(")\n")))
    pairs = F.zip_with(F.slice("o", F.lit(1), n - 1), F.slice("o", F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    edges = lines(pairs, lambda p: F.concat(F.lit("g.add_edge("), q(name(p["a"])), F.lit(", "), q(name(p["b"])), F.lit(")\n")))
    first, last = F.element_at("o", 1), F.element_at("o", -1)
    start = lambda x: F.concat(F.lit("g.add_edge(START, "), q(name(x)), F.lit(")\n"))
    entry = F.when(first["o_orderstatus"] == "O", start(first)).when(first["o_orderstatus"] == "F", F.concat(F.lit("g.set_entry_point("), q(name(first)), F.lit(")\n"))).otherwise(F.concat(start(first), start(last)))
    return _module(per, F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit(".py")), F.concat(F.lit(HEAD), defs, F.lit("g = StateGraph(dict)\n"), adds, edges, entry))


def branches(orders: DataFrame) -> DataFrame:
    """A module a customer: one branch over its orders' priorities, a mapping for even customers, a list for odd ones."""
    per = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("p"))
    pairs = F.array_join(F.transform("p", lambda x: F.concat(F.lit('"'), x, F.lit('": "n'), F.substring(x, 1, 1), F.lit('"'))), ", ")
    names = F.array_join(F.transform("p", lambda x: F.concat(F.lit('"n'), F.substring(x, 1, 1), F.lit('"'))), ", ")
    paths = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("{"), pairs, F.lit("}"))).otherwise(F.concat(F.lit("["), names, F.lit("]")))
    text = F.concat(F.lit(HEAD + "g = StateGraph(dict)\n"), lines(F.col("p"), lambda x: F.concat(F.lit('g.add_node("n'), F.substring(x, 1, 1), F.lit('", work)\n'))), F.lit('g.add_conditional_edges("hub", pick, '), paths, F.lit(")\n"))
    return _module(per, F.concat(F.lit("b"), F.col("o_custkey").cast("string"), F.lit(".py")), text)


def transitions(events: DataFrame) -> DataFrame:
    """A module a user: a function an event type that returns each type seen next, in alphabetical order."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = events.withColumn("to", F.lead("event_type").over(w)).groupBy("user_id", "event_type").agg(F.array_sort(F.collect_set("to")).alias("to"))
    one = F.concat(F.lit("def "), F.col("event_type"), F.lit("(state):\n"), lines(F.col("to"), lambda x: F.concat(F.lit('    Command(goto="'), x, F.lit('")\n'))), F.lit("    return state\n"))
    per = steps.select("user_id", "event_type", one.alias("f")).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_type", "f"))).alias("f"))
    text = F.concat(F.lit(HEAD), lines(F.col("f"), lambda x: x["f"]), F.lit("g = StateGraph(dict)\n"), lines(F.col("f"), lambda x: F.concat(F.lit('g.add_node("'), x["event_type"], F.lit('", '), x["event_type"], F.lit(")\n"))))
    return _module(per, F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".py")), text)


def tools(lineitem: DataFrame) -> DataFrame:
    """A module an order: a tool node over its parts, with further ones spread in where a line has number 1 and an odd part."""
    per = lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("p"), F.max((F.col("l_linenumber") == 1) & (F.col("l_partkey") % 2 == 1)).alias("more"))
    names = F.array_join(F.transform("p", lambda x: F.concat(F.lit("p"), x.cast("string"))), ", ")
    text = F.concat(F.lit(HEAD + "from parts import p1\ng = StateGraph(dict)\ng.add_node(\"tools\", ToolNode(["), names, F.when(F.col("more"), F.lit(", *others")).otherwise(""), F.lit("]))\n"))
    return _module(per, F.concat(F.lit("t"), F.col("l_orderkey").cast("string"), F.lit(".py")), text)


def imported(nation: DataFrame) -> DataFrame:
    """A function a nation behind n_nationkey % 5 modules that hand it on, and a graph that uses it."""
    key = F.col("n_nationkey").cast("string")
    k = (F.col("n_nationkey") % 5).cast("int")
    at = lambda i: F.concat(F.lit("h"), key, F.lit("_"), i.cast("string"))
    use = F.concat(F.lit(HEAD + "from "), at(F.lit(0)), F.lit(" import f"), key, F.lit("\ng = StateGraph(dict)\ng.add_node(\"n\", f"), key, F.lit(")\n"))
    graphs = _module(nation, F.concat(F.lit("n"), key, F.lit(".py")), use)
    hops = nation.select("n_nationkey", F.explode(F.sequence(F.lit(0), k)).alias("i"))
    hop = F.col("i")
    body = F.when(hop < k, F.concat(F.lit("from "), at(hop + 1), F.lit(" import f"), key, F.lit("\n"))).otherwise(F.concat(F.lit("def f"), key, F.lit('(state):\n    """Nation."""\n    return state\n')))
    return graphs.unionByName(_module(hops, F.concat(at(hop), F.lit(".py")), body))


def bodies(supplier: DataFrame) -> DataFrame:
    """Two modules a supplier: a graph of one node, and its function, whose key says which tools it binds and where it goes."""
    k, key = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    use = F.concat(F.lit(HEAD + "from w"), key, F.lit(" import work\ng = StateGraph(dict)\ng.add_node(\"n\", work)\n"))
    bound = F.when(k % 3 == 1, "    llm.bind_tools([t1, t2])\n").when(k % 3 == 2, "    llm.bind_tools([t1, *more])\n").otherwise("")
    goes = F.when(k % 4 == 1, 'Command(goto="n2")').when(k % 4 == 2, 'Command(goto=["n2", "n3"])').when(k % 4 == 3, "Command(goto=pick(state))").otherwise("state")
    body = F.concat(F.lit('from flowlib import Command\nfrom tools import t1\n\n\ndef work(state):\n    """Supplier '), key, F.lit('."""\n'), bound, F.lit("    return "), goes, F.lit("\n"))
    return _module(supplier, F.concat(F.lit("s"), key, F.lit(".py")), use).unionByName(_module(supplier, F.concat(F.lit("w"), key, F.lit(".py")), body))


def damaged(modules: DataFrame) -> DataFrame:
    """Every tenth module (by the number in its name) cut inside a bracket, every tenth after it with a byte order mark, one with bad bytes, one with half a surrogate pair in a literal."""
    n = F.regexp_extract("path", "([0-9]+)", 1).cast("long")
    content = F.when(n % 10 == 0, F.concat(F.col("content"), F.lit("broken(\n")).cast("binary")).when(n % 10 == 1, F.concat(F.lit(b"\xef\xbb\xbf"), F.col("content").cast("binary"))).when(n % 10 == 2, F.concat(F.lit(b"x = '\xff'\n"), F.col("content").cast("binary"))).when(n % 10 == 4, F.concat(F.col("content"), F.lit('g.add_node("\\ud800")\n')).cast("binary")).otherwise(F.col("content").cast("binary"))
    return modules.withColumn("content", content)


def long_chains(customer: DataFrame) -> DataFrame:
    """A module a nation: as many edges as it has customers, one after the other."""
    per = customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    text = lines(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.concat(F.lit('g.add_edge("a'), i.cast("string"), F.lit('", "a'), (i + 1).cast("string"), F.lit('")\n')))
    return _module(per, F.concat(F.lit("l"), F.col("c_nationkey").cast("string"), F.lit(".py")), F.concat(F.lit(HEAD + "g = StateGraph(dict)\n"), text))


def aliased(nation: DataFrame) -> DataFrame:
    """A module a nation that imports the builder and the start under other names; odd nations build something else."""
    key = F.col("n_nationkey").cast("string")
    made = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("S"), key)).otherwise(F.lit("Other"))
    text = F.concat(F.lit("from flowlib import START as BEGIN, StateGraph as S"), key, F.lit("\ng = "), made, F.lit('(dict)\ng.add_node("n'), key, F.lit('", work)\ng.add_edge(BEGIN, "n'), key, F.lit('")\n'))
    return _module(nation, F.concat(F.lit("a"), key, F.lit(".py")), text)


def looped(nation: DataFrame) -> DataFrame:
    """A module a nation with one node; even nations add it in a loop."""
    key = F.col("n_nationkey").cast("string")
    head = F.lit(HEAD + "def work(state):\n    return state\ng = StateGraph(dict)\n")
    loop = F.when(F.col("n_nationkey") % 2 == 0, F.lit("for x in names:\n    ")).otherwise(F.lit(""))
    return _module(nation, F.concat(F.lit("d"), key, F.lit(".py")), F.concat(head, loop, F.lit('g.add_node("n'), key, F.lit('", work)\n')))
