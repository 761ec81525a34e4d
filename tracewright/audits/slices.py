"""Slices that overlap, risk chains of functions and summaries of what they do, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.audits.registry import audit, calls, facts, nodes
from tracewright.audits.relations import resolved_calls
from tracewright.operators.chains import risk_chains
from tracewright.operators.merging import slice_groups
from tracewright.operators.summaries import propagate
from tracewright.sources.tables import table


def slices(spark: SparkSession, d: str) -> DataFrame:
    """An order as a slice: its parts in a half-month are nodes, large lines edges, suppliers files; a line of 45 and more
    names the sink."""
    when = F.concat_ws("-", F.date_format("l_shipdate", "yyyyMM"), F.floor(F.dayofmonth("l_shipdate") / 16).cast("string"))
    node = F.concat_ws("@", "l_partkey", when)
    of = lambda cond, c: F.collect_set(F.when(cond, c))
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("slice_id"))
    return li.agg(
        F.floor(F.max("l_quantity") / 10).cast("long").alias("risk"), F.collect_set(node).alias("nodes"), of(F.col("l_quantity") > 30, node).alias("edges"),
        F.collect_set(F.col("l_suppkey").cast("string")).alias("files"), F.min(F.when(F.col("l_quantity") >= 45, node)).alias("sink"),
    )


@audit("U6", None)
def overlapping_slices(spark: SparkSession, d: str) -> DataFrame:
    """Which group a slice joins depends on those before it; the test has a plain loop."""
    g = slice_groups(slices(spark, d), 8)
    return g.select("group_id", F.size("slice_ids").cast("long").alias("slices"), F.array_join("files", ",").alias("files"), "risk")


def statements(spark: SparkSession, d: str) -> DataFrame:
    """A customer's lines as the statements of a function, in the order of ship dates; a part picks the names."""
    li = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("fn")), "l_orderkey")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").cast("string"), F.col("l_discount").cast("decimal(4,2)").cast("string"))
    n = F.col("l_partkey") % 10
    kind = F.when(n == 0, "parameter").when(n == 1, "allocate").when(n == 2, "guard").when(n == 3, "copy").otherwise("assign")
    name = lambda c: F.concat(F.lit("v"), (c % 7).cast("string"))
    call = F.concat(F.lit("s"), key)
    allocates = (n == 1) | (n.isin(4, 5) & (F.col("l_tax") > 0.03))
    own = F.concat(F.lit("s"), key)
    return li.select(
        "fn", F.datediff("l_shipdate", F.lit("1990-01-01")).cast("long").alias("line"), key.alias("seq"), kind.alias("kind"), name(F.col("l_suppkey")).alias("target"),
        F.array_distinct(F.array(name(F.col("l_orderkey")), name(F.col("l_partkey") + F.col("l_linenumber")))).alias("names"),
        F.when(F.col("l_discount") > 0.04, F.array(F.lit("*"))).otherwise(F.array().cast("array<string>")).alias("operations"),
        F.when((kind == "copy") | ((kind == "assign") & (F.col("l_quantity") > 40)), F.array(call)).otherwise(F.array().cast("array<string>")).alias("sources"),
        F.when(allocates, own).alias("allocation"), (F.col("l_returnflag") == "A").alias("narrow"), (F.col("l_linestatus") == "O").alias("strong"), F.array(name(F.col("l_orderkey") + 1)).alias("bound"),
    )


@audit("G12", None)
def function_risk_chains(spark: SparkSession, d: str) -> DataFrame:
    """States replace one another in source order; the test follows each allocation backwards instead."""
    c = risk_chains(statements(spark, d))
    text = lambda x: F.array_join(F.transform(x, lambda v: v.cast("string")), ",").alias(x)
    return c.select("fn", "allocation", "line", text("sources"), text("source_lines"), text("names"), text("transforms"), "guard", text("guard_lines"), text("copies"), "score", "confidence")


def summaries(spark: SparkSession, d: str) -> DataFrame:
    """What a function does by itself: its writes through parameters p0 to p2, of which the first two are pointers."""
    f = facts(spark, d).filter("kind = 'write'").select("node_id", F.concat(F.lit("p"), F.substring("name", 2, 1)).alias("p"), F.concat(F.lit("n * "), F.col("bound").cast("string")).alias("x"))
    f = f.filter("p <> 'p2'").groupBy("node_id", "p").agg(F.array_sort(F.collect_set("x")).alias("xs")).groupBy("node_id")
    own = f.agg(F.array_sort(F.collect_list("p")).alias("written"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "xs")))).alias("extents"))
    n = nodes(spark, d).join(own, "node_id", "left")
    names, k = F.array(F.lit("p0"), F.lit("p1"), F.lit("n")), F.col("node_id") % 5
    return n.select(
        F.col("node_id").alias("node"), names.alias("parameters"), F.slice(names, 1, 2).alias("pointers"), F.create_map(F.lit("q"), F.lit("p0")).alias("aliases"), "written", "extents",
        F.when(k < 3, F.array(F.concat(F.lit("r"), k.cast("string")))).alias("returns"), F.when(k == 3, "consumed_or_required").when(k == 4, "pass_through").otherwise("unknown").alias("kind"), F.when(k == 4, F.array(F.lit("p1"))).alias("passed"),
    )


def summary_calls(spark: SparkSession, d: str) -> DataFrame:
    r = resolved_calls(calls(spark, d), nodes(spark, d), ["memcpy"])
    key, k = F.concat_ws("-", "caller", "line", "callee"), F.col("caller") + F.col("line")
    some = lambda i: F.element_at(F.array(*[F.lit(x) for x in ("p0", "(char *)p1 + n", "&q", "other", "n")]), ((k + i) % 5 + 1).cast("int"))
    r = r.withColumns({"call_id": key, "arguments": F.array(some(0), some(1), F.concat(F.lit("n + "), F.col("line").cast("string"))), "result": F.concat(F.lit("r"), (F.col("line") % 3).cast("string"))})
    return r.select("call_id", "caller", "target", (F.col("callee") != "memcpy").alias("direct"), "callee", "arguments", "result").dropDuplicates(["call_id"])


@audit("G8 F6", None)
def capacity_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Calls are visited in their order within each pass; the test has the plain sequence."""
    s = propagate(summaries(spark, d), summary_calls(spark, d))
    extents = F.array_sort(F.transform(F.map_entries("extents"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ";"))))
    return s.select("node", F.array_join("written", ",").alias("written"), F.array_join(extents, "|").alias("extents"), "kind", F.array_join("passed", ",").alias("passed"), F.array_join("calls", ",").alias("calls"), "depth")
