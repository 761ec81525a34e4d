"""The registry of the audit queries, and the views that several of them share.

A view gives the driver's tables the roles that audit data has: orders are runs, their lines are what a run admitted and
found, events are logs, documents and labels are findings with verdicts. Each view has a DataFrame form and an SQL form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Operator numbers of the inventory that a query covers.
COVERS: dict[str, tuple[str, ...]] = {}


def audit(covers: str, sql: str | None) -> Callable[[Query], Query]:
    """Registers a query by its function's name; covers: operator numbers, separated by blanks."""

    def register(f: Query) -> Query:
        name = f.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        COVERS[name] = tuple(covers.split())
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def whole(x: Column | str) -> Column:
    return F.floor(x).cast("long")


def runs(spark: SparkSession, d: str) -> DataFrame:
    """One row a run: run_id, case_id, family, outcome, valid, three kinds of input tokens, output_tokens, started."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    outcome = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "budget_limited").when(F.col("o_orderpriority") < "3", "invalid").otherwise("interrupted")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("run_id"),
        F.col("c_nationkey").cast("long").alias("case_id"),
        F.col("c_mktsegment").alias("family"),
        outcome.alias("outcome"),
        F.col("o_orderstatus").isin("F", "O").alias("valid"),
        whole("o_totalprice").alias("input_tokens"),
        whole(F.col("o_totalprice") / 4).alias("cache_read_tokens"),
        whole(F.col("o_totalprice") / 16).alias("cache_write_tokens"),
        whole(F.col("o_totalprice") / 8).alias("output_tokens"),
        F.col("o_orderdate").alias("started"),
    )


RUNS = """runs AS (SELECT o_orderkey AS run_id, c_nationkey::BIGINT AS case_id, c_mktsegment AS family,
  CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'budget_limited' WHEN o_orderpriority < '3' THEN 'invalid' ELSE 'interrupted' END AS outcome,
  o_orderstatus IN ('F', 'O') AS valid, floor(o_totalprice)::BIGINT AS input_tokens, floor(o_totalprice / 4)::BIGINT AS cache_read_tokens,
  floor(o_totalprice / 16)::BIGINT AS cache_write_tokens, floor(o_totalprice / 8)::BIGINT AS output_tokens, o_orderdate AS started
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def found(spark: SparkSession, d: str) -> DataFrame:
    """What a run admitted and found: run_id, session_index, hunter, target_id, candidate_id, target_match, state, validity, observed."""
    state = F.when(F.col("l_quantity") > 40, "reportable").when(F.col("l_quantity") > 10, "reproduced").otherwise("raw")
    validity = F.when(F.col("l_discount") > 0.07, "false").when(F.col("l_tax") > 0.07, "unknown").otherwise("real")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        F.col("l_linenumber").cast("long").alias("session_index"),
        F.col("l_returnflag").alias("hunter"),
        F.col("l_partkey").alias("target_id"),
        F.col("l_suppkey").alias("candidate_id"),
        (F.col("l_quantity") > 25).alias("target_match"),
        state.alias("state"),
        validity.alias("validity"),
        F.col("l_shipdate").alias("observed"),
    )


FOUND = """found AS (SELECT l_orderkey AS run_id, l_linenumber::BIGINT AS session_index, l_returnflag AS hunter, l_partkey AS target_id, l_suppkey AS candidate_id,
  l_quantity > 25 AS target_match, CASE WHEN l_quantity > 40 THEN 'reportable' WHEN l_quantity > 10 THEN 'reproduced' ELSE 'raw' END AS state,
  CASE WHEN l_discount > 0.07 THEN 'false' WHEN l_tax > 0.07 THEN 'unknown' ELSE 'real' END AS validity, l_shipdate AS observed FROM lineitem)"""


def work(spark: SparkSession, d: str) -> DataFrame:
    """One row a work item: work_id, campaign, component, family, hunter, required, risk (1 to 5), score, status, attempt."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    risk = 6 - F.substring("o_orderpriority", 1, 1).cast("long")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("work_id"),
        F.date_format("o_orderdate", "yyyy-MM").alias("campaign"),
        F.col("c_mktsegment").alias("component"),
        F.col("c_nationkey").cast("long").alias("family"),
        F.concat(F.lit("h"), (F.col("o_custkey") % 4).cast("string")).alias("hunter"),
        ((F.col("o_orderstatus") == "F") & (risk >= 4)).alias("required"),
        risk.alias("risk"),
        whole(F.col("o_totalprice") / 1000).alias("score"),
        F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "running").otherwise("pending").alias("status"),
        (1 + F.col("o_custkey") % 3).alias("attempt"),
    )


WORK = """work AS (SELECT o_orderkey AS work_id, strftime(o_orderdate, '%Y-%m') AS campaign, c_mktsegment AS component, c_nationkey::BIGINT AS family,
  'h' || (o_custkey % 4) AS hunter, o_orderstatus = 'F' AND 6 - left(o_orderpriority, 1)::BIGINT >= 4 AS required, 6 - left(o_orderpriority, 1)::BIGINT AS risk,
  floor(o_totalprice / 1000)::BIGINT AS score, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'pending' END AS status, (1 + o_custkey % 3)::BIGINT AS attempt
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Function spans: node_id, path, symbol, line, end_line, visibility."""
    key = F.col("o_orderkey")
    line = (key % 97 * 10).cast("long")
    return table(spark, d, "orders").select(key.alias("node_id"), F.col("o_custkey").alias("path"), F.concat(F.lit("f"), (key % 500).cast("string")).alias("symbol"), line.alias("line"), (line + 5 + key % 30).alias("end_line"), F.when(F.col("o_orderstatus") == "F", "external").otherwise("static").alias("visibility"))


NODES = """nodes AS (SELECT o_orderkey AS node_id, o_custkey AS path, 'f' || (o_orderkey % 500) AS symbol, o_orderkey % 97 * 10 AS line, o_orderkey % 97 * 10 + 5 + o_orderkey % 30 AS end_line, CASE o_orderstatus WHEN 'F' THEN 'external' ELSE 'static' END AS visibility FROM orders)"""


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts about variables: fact_id, node_id, kind (allocation, write, guard, loop), line, name, bound."""
    kind = F.when(F.col("l_linenumber") % 4 == 1, "allocation").when(F.col("l_linenumber") % 4 == 2, "write").when(F.col("l_linenumber") % 4 == 3, "guard").otherwise("loop")
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("fact_id"), F.col("l_orderkey").alias("node_id"), kind.alias("kind"), (F.col("l_partkey") % 40).alias("line"), F.concat(F.lit("v"), (F.col("l_suppkey") % 3).cast("string")).alias("name"), F.col("l_quantity").cast("long").alias("bound"))


FACTS = """facts AS (SELECT l_orderkey * 8 + l_linenumber AS fact_id, l_orderkey AS node_id, CASE l_linenumber % 4 WHEN 1 THEN 'allocation' WHEN 2 THEN 'write' WHEN 3 THEN 'guard' ELSE 'loop' END AS kind, l_partkey % 40 AS line, 'v' || (l_suppkey % 3) AS name, l_quantity::BIGINT AS bound FROM lineitem)"""


def calls(spark: SparkSession, d: str) -> DataFrame:
    """Call sites: caller, path, callee (a symbol), line."""
    li = table(spark, d, "lineitem").filter("l_linestatus = 'O'")
    callee = F.when(F.col("l_suppkey") % 7 == 0, "memcpy").otherwise(F.concat(F.lit("f"), (F.col("l_partkey") % 700).cast("string")))
    return li.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("path")), "l_orderkey").select(F.col("l_orderkey").alias("caller"), "path", callee.alias("callee"), F.col("l_linenumber").cast("long").alias("line"))


CALLS = """calls AS (SELECT l_orderkey AS caller, o_custkey AS path, CASE WHEN l_suppkey % 7 = 0 THEN 'memcpy' ELSE 'f' || (l_partkey % 700) END AS callee, l_linenumber::BIGINT AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'O')"""
