"""Graph queries, and others over whole tables; ``__spark_entry__`` registers them without ``_whole``.

Recursive SQL over the whole trade graph is too slow in DuckDB, so the graph queries are tested by brute force instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import scalars as S
from tracewright.operators import aggregates as A
from tracewright.operators import graph as G
from tracewright.operators import joins as J
from tracewright.queries import Query
from tracewright.sources.tables import conflicts, new_rows, table

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: A node is its key times 8 and one of these: keys of different tables don't meet.
KINDS = {"region": 0, "nation": 1, "customer": 2, "order": 3, "part": 4, "supplier": 5}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _node(kind: str, key: str) -> Column:
    return F.col(key).cast("long") * 8 + KINDS[kind]


def _links(spark: SparkSession, d: str, *names: str) -> DataFrame:
    """src, dst of every row of the tables, with repeats."""
    links = {
        "nation": ("supplier", "supplier", "s_suppkey", "nation", "s_nationkey"),
        "customer": ("customer", "nation", "c_nationkey", "customer", "c_custkey"),
        "order": ("orders", "customer", "o_custkey", "order", "o_orderkey"),
        "part": ("lineitem", "order", "l_orderkey", "part", "l_partkey"),
        "supplier": ("lineitem", "part", "l_partkey", "supplier", "l_suppkey"),
        "region": ("nation", "region", "n_regionkey", "nation", "n_nationkey"),
    }
    some = [table(spark, d, t).select(_node(a, x).alias("src"), _node(b, y).alias("dst")) for t, a, x, b, y in (links[n] for n in names)]
    return reduce(DataFrame.union, some).dropna()


def _edges(spark: SparkSession, d: str, *names: str) -> DataFrame:
    """Each link once."""
    return _links(spark, d, *names).distinct()


#: Customers place orders of parts from suppliers of nations that have customers.
TRADE = ("order", "part", "supplier", "nation", "customer")
#: The same without the way back, so no path has more than four steps.
SUPPLY = TRADE[:4]


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").filter("c_mktsegment = 'BUILDING' and c_acctbal < 0").select(_node("customer", "c_custkey").alias("node"))


@query()
def reachability_whole(spark: SparkSession, d: str) -> DataFrame:
    return G.reachable(_edges(spark, d, *TRADE), _seeds(spark, d))


@query()
def shortest_paths_whole(spark: SparkSession, d: str) -> DataFrame:
    found = G.shortest_paths(_edges(spark, d, *SUPPLY), _seeds(spark, d), 4)
    return found.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))


@query()
def nearest_seeds_whole(spark: SparkSession, d: str) -> DataFrame:
    found = G.nearest_seeds(_links(spark, d, *TRADE), _seeds(spark, d), 4)
    return found.withColumn("seeds", F.array_join(F.transform("seeds", lambda x: x.cast("string")), ","))


@query()
def connected_components_whole(spark: SparkSession, d: str) -> DataFrame:
    return G.components(_edges(spark, d, *TRADE))


@query()
def dominators_whole(spark: SparkSession, d: str) -> DataFrame:
    """From a root above the regions down to the suppliers of the parts ordered."""
    root = 7  # key 0 of a kind that no table has
    top = table(spark, d, "region").select(F.lit(root).cast("long").alias("src"), _node("region", "r_regionkey").alias("dst"))
    return G.dominators(top.union(_links(spark, d, "region", "customer", "order", "part", "supplier")), root)


@query("""
SELECT source, CASE WHEN count(DISTINCT toxic) = 1 THEN min(CASE toxic WHEN 1 THEN 'false' ELSE 'real' END) ELSE 'conflict' END AS verdict
FROM labels JOIN documents USING (doc_id) GROUP BY source""")
def verdict_conflicts_whole(spark: SparkSession, d: str) -> DataFrame:
    given = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return A.verdicts(given.withColumn("v", F.when(F.col("toxic") == 1, "false").otherwise("real")), ["source"], "v")


@query("""
SELECT DISTINCT s_suppkey, c_custkey FROM supplier, customer WHERE (s_nationkey = c_nationkey AND c_mktsegment = 'BUILDING') OR (s_suppkey = c_custkey AND c_mktsegment = 'BUILDING')""")
def theta_or_whole(spark: SparkSession, d: str) -> DataFrame:
    """A pair whose keys have several rows is left to one of the rows' pairs, so pairs aren't compared with one another."""

    def rows(df: DataFrame, key: str, nation: str, all_: str) -> DataFrame:
        each = df.groupBy(key).agg(F.array_sort(F.collect_set(nation)).alias(all_))
        return each.select(key, all_, F.explode_outer(all_).alias(nation))

    c = rows(table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'"), "c_custkey", "c_nationkey", "c_all")
    s = rows(table(spark, d, "supplier"), "s_suppkey", "s_nationkey", "s_all")
    pairs = J.match_either(s, c, [("s_nationkey", "c_nationkey"), ("s_suppkey", "c_custkey")])
    common = F.array_min(F.array_intersect("s_all", "c_all"))
    first = lambda side: F.col(f"{side}_nationkey").eqNullSafe(F.coalesce(common, F.array_min(f"{side}_all")))
    alone = (F.size("s_all") <= 1) & (F.size("c_all") <= 1)
    return pairs.filter(F.when(alone, True).otherwise(first("s") & first("c"))).select("s_suppkey", "c_custkey")


@query("""
SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'O')
WHERE r = 1 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def insert_if_absent_whole(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return new_rows(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey")


@query("""
SELECT doc_id FROM documents a JOIN (SELECT doc_id, lang, CASE WHEN n_chars > 2000 THEN 'moved' ELSE source END AS source FROM documents) b USING (doc_id)
WHERE a.source <> b.source OR a.lang <> b.lang""")
def immutable_conflicts_whole(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    again = docs.withColumn("source", F.when(F.col("n_chars") > 2000, "moved").otherwise(F.col("source")))
    return conflicts(docs.drop("n_chars"), again.drop("n_chars"), ["doc_id"], ["lang", "source"])


@query(r"""
SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '_') AS slug,
  left(regexp_replace(trim(text), '\s+', ' ', 'g'), 80) AS short FROM conversations""")
def text_normalisation_whole(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", S.slug(F.col("text")).alias("slug"), S.compact(F.col("text"), 80).alias("short"))
