"""Queries over whole tables: against brute force, or DuckDB where they have SQL."""

import os
import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.test_audit_queries import plain
from tracewright import whole
from tracewright.operators import joins as J

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return con


TRADE = """SELECT o_custkey * 8 + 2, o_orderkey * 8 + 3 FROM orders UNION SELECT l_orderkey * 8 + 3, l_partkey * 8 + 4 FROM lineitem
UNION SELECT l_partkey * 8 + 4, l_suppkey * 8 + 5 FROM lineitem UNION SELECT s_suppkey * 8 + 5, s_nationkey * 8 + 1 FROM supplier
UNION SELECT c_nationkey * 8 + 1, c_custkey * 8 + 2 FROM customer"""


@pytest.fixture(scope="module")
def trade(duck):
    return set(duck.execute(TRADE).fetchall())


@pytest.fixture(scope="module")
def seeds(duck):
    return [x for (x,) in duck.execute("SELECT c_custkey * 8 + 2 FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 0").fetchall()]


def steps(edges, start, gone=None, depth=10**9):
    """Fewest steps from the starts to each node."""
    after = edges
    if not isinstance(edges, dict):
        after = defaultdict(list)
        for a, b in edges:
            after[a].append(b)
    found, front = dict.fromkeys(start, 0), list(start)
    for n in range(1, depth + 1):
        front = list({b for a in front for b in after.get(a, ()) if b not in found and b != gone})
        if not front:
            break
        found.update(dict.fromkeys(front, n))
    return found


def rows(spark, name):
    return sorted(map(tuple, whole.queries()[name](spark, FOLDER).collect()))


def test_reachability(spark, trade, seeds):
    assert seeds and rows(spark, "reachability_whole") == sorted(steps(trade, seeds).items())


def test_shortest_paths(spark, trade, seeds):
    after = defaultdict(list)
    for a, b in trade:
        if b % 8 != 2:
            after[a].append(b)
    want = []
    for seed in seeds:
        best, front = {seed: (seed,)}, [(seed,)]
        while front:
            grown = sorted((*p, b) for p in front for b in after.get(p[-1], ()) if b not in best)
            front = list({p[-1]: p for p in reversed(grown)}.values())
            best.update({p[-1]: p for p in front})
        want += [(seed, n, len(p) - 1, ">".join(map(str, p))) for n, p in best.items()]
    assert rows(spark, "shortest_paths_whole") == sorted(want)


def test_nearest_seeds(spark, trade, seeds):
    both, near = trade | {(b, a) for a, b in trade}, {}
    for seed in sorted(seeds):
        for node, n in steps(both, [seed], depth=4).items():
            if node not in near or n < near[node][0]:
                near[node] = (n, [seed])
            elif n == near[node][0]:
                near[node][1].append(seed)
    assert rows(spark, "nearest_seeds_whole") == sorted((node, n, ",".join(map(str, s))) for node, (n, s) in near.items())


def test_components(spark, trade):
    both, left, want = trade | {(b, a) for a, b in trade}, {x for e in trade for x in e}, []
    while left:
        least = min(left)
        part = set(steps(both, [least]))
        left -= part
        want += [(x, least) for x in part]
    assert rows(spark, "connected_components_whole") == sorted(want)


def test_dominators(spark, duck, trade):
    edges = {(a, b) for a, b in trade if b % 8 != 1}
    edges |= set(duck.execute("SELECT 7, r_regionkey * 8 FROM region UNION SELECT n_regionkey * 8, n_nationkey * 8 + 1 FROM nation").fetchall())
    after = defaultdict(list)
    for a, b in edges:
        after[a].append(b)
    nodes = set(steps(after, [7]))
    want = [(n, 7) for n in nodes]
    for gone in nodes - {7}:
        want += [(n, gone) for n in (nodes - set(steps(after, [7], gone)) if gone in after else {gone})]
    assert len(nodes) > 1500 and rows(spark, "dominators_whole") == sorted(want)


@pytest.mark.parametrize("name", sorted(whole.oracle_sql()))
def test_sql(spark, duck, name):
    got = plain(whole.queries()[name](spark, FOLDER).toPandas())
    assert got == plain(duck.execute(whole.oracle_sql()[name]).df())


def test_verdicts_of_all_labels(spark, tmp_path):
    spark.createDataFrame([(1, 0, 1), (3, 0, 0)], "doc_id long, quality int, toxic int").toPandas().to_parquet(tmp_path / "labels.parquet")
    spark.createDataFrame([(1, "s"), (3, "s")], "doc_id long, source string").toPandas().to_parquet(tmp_path / "documents.parquet")
    assert [tuple(r) for r in whole.queries()["verdict_conflicts_whole"](spark, str(tmp_path)).collect()] == [("s", "conflict")]


def test_conflicts_of_odd_ids(spark):
    assert any(r["doc_id"] % 2 for r in whole.queries()["immutable_conflicts_whole"](spark, FOLDER).collect())


def test_slug_of_whole_text(spark, tmp_path):
    rows = [(1, 0, "-" * 200 + "A b"), (1, 1, "x" * 199 + " y" * 50)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").toPandas().to_parquet(tmp_path / "conversations.parquet")
    got = {r["turn"]: r["slug"] for r in whole.queries()["text_normalisation_whole"](spark, str(tmp_path)).collect()}
    assert got == {0: "a_b", 1: "x" * 199 + "_y" * 50}


def test_pairs_of_keys_with_several_rows_come_once_from_many_tasks(spark, tmp_path):
    r = random.Random(8)
    suppliers = [(k % 40, r.choice([None, 0, 1, 2])) for k in range(90)] + [(None, 1)]
    customers = [(k % 60, r.choice([None, 0, 1, 3]), "BUILDING") for k in range(150)] + [(None, 0, "BUILDING"), (1, 2, "OTHER")]
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = [tuple(x) for x in whole.queries()["theta_or_whole"](spark, str(tmp_path)).collect()]
    want = {(s, c) for s, m in suppliers for c, n, seg in customers if seg == "BUILDING" and ((m is not None and m == n) or (s is not None and s == c))}
    key = lambda p: tuple((x is not None, x) for x in p)
    assert sorted(got, key=key) == sorted(want, key=key)
    one = spark.range(300).select((F.col("id") % 1).alias("k"), F.col("id").alias("a"))
    pairs = J.spread_join(one, one.select(F.col("k").alias("n"), F.col("a").alias("b")), ("k", "n"))
    most = pairs.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert pairs.count() == 90000 and most < 30000  # one task had all
