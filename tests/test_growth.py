"""Queries that stay small as tables grow: what their plans and steps hold, and that results stay those of their SQL."""

import json
import os
import random

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F
from test_audit_queries import FOLDER, plain

from tracewright import audits
from tracewright.audits import predicates
from tracewright.operators import fitting, folds
from tracewright.operators import graph as G
from tracewright.operators import merging


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def altered(tmp_path, table, expression):
    """The smallest tables, of which one is replaced by a select over it; a DuckDB connection to them."""
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        os.symlink(f"{FOLDER}/{f}", tmp_path / f)
    (tmp_path / f"{table}.parquet").unlink()
    con.execute(f"copy (select {expression} from '{FOLDER}/{table}.parquet') to '{tmp_path}/{table}.parquet'")
    for f in os.listdir(tmp_path):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{tmp_path}/{f}'")
    return con


def same_as_sql(spark, tmp_path, con, name):
    got = plain(audits.QUERIES[name](spark, str(tmp_path)).toPandas())
    assert len(got) and got == plain(con.execute(audits.SQL[name]).df())


def test_origins_of_findings_without_a_candidate(spark, tmp_path):
    con = altered(tmp_path, "lineitem", "* replace (case when l_linenumber % 3 = 0 then null else l_suppkey end as l_suppkey)")
    same_as_sql(spark, tmp_path, con, "finding_origins")


def test_score_components_count_without_copies_of_rows(spark, tmp_path):
    con = altered(tmp_path, "lineitem", "* replace (case when l_orderkey % 3 = 0 then null else l_returnflag end as l_returnflag, case when l_orderkey % 11 = 0 then null else l_partkey end as l_partkey)")
    same_as_sql(spark, tmp_path, con, "score_components")
    assert "Expand" not in physical(audits.QUERIES["score_components"](spark, FOLDER))


def test_obligations_do_not_sort_all_items(spark):
    assert "partial_min(work_id" in physical(audits.QUERIES["bound_obligations"](spark, FOLDER))


def test_components_of_a_star_take_few_rounds(spark, monkeypatch):
    stored = []
    cut = G.cut
    monkeypatch.setattr(G, "cut", lambda df: stored.append(1) or cut(df))
    edges = spark.range(3000).selectExpr("8 * id + 2 as src", "cast(9 + id % 5 * 8 as long) as dst")
    got = {x["node"]: x["component"] for x in G.components(edges).collect()}
    assert got == {8 * k + 2: 2 + 8 * (k % 5) for k in range(3000)} | {9 + 8 * k: 2 + 8 * k for k in range(5)}
    assert len(stored) <= 6
    stored.clear()
    monkeypatch.setattr(G, "FEW_EDGES", 10)
    assert {x["node"]: x["component"] for x in G.components(edges).collect()} == got


def test_folds_read_columns_as_lists(spark):
    columns = [pa.array(x, k) for x, k in [([["a", None], None, [], ["é"]], pa.list_(pa.string())), ([1, None, 2**62 + 1], pa.int64()), ([True, False], pa.bool_()), ([None, "x"], pa.string()), ([[1], [2, 3]], pa.list_(pa.int64()))]]
    assert all(folds._values(c.slice(k)) == c.slice(k).to_pylist() for c in columns for k in (0, 1))


def test_texts_are_read_once_for_runs_of_all_lengths(spark, monkeypatch):
    read = []
    runs = predicates._word_runs
    monkeypatch.setattr(predicates, "_word_runs", lambda df, *a: read.append(df.columns) or runs(df, *a))
    texts = spark.createDataFrame([(1, "A b\tc d e f g h i j"), (2, "c d"), (3, ""), (4, "x " * 30)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "b"), (2, "C  d"), (3, "b c d e f g h i j"), (4, "d c"), (5, "x x x x x x x x x"), (6, "b c d e f g h i k")], "item_id long, passage string")
    got = sorted(map(tuple, predicates.passages(items, texts).collect()))
    assert got == [(1, 1), (2, 1), (2, 2), (3, 1), (5, 4)] and len(read) == 2


def test_priorities_store_one_table_however_long_a_chain(spark, monkeypatch):
    stored = []
    for module in (G, merging):
        monkeypatch.setattr(module, "cut", lambda df, cut=module.cut: stored.append(1) or cut(df))
    kinds = "fn long, block long, address long, index long, result string, operands array<string>, own int"
    rows = [(1, 0, k, 0, f"c{k}", [f"c{k + 1}", None], 0 if k == 0 else None) for k in range(40)]
    rows += [(1, 1, 5, 1, "c50", None, None), (1, 1, 6, 0, "c60", ["c50"], None), (1, 1, 6, 0, None, None, 1), (None, 0, 1, 1, "a", ["a"], 2)]
    got = merging.evidence_slices(spark.createDataFrame(rows, kinds), 100, 9).collect()
    kept = {(x["fn"], x["block"]): (x["priority"], x["address"], x["kept"]) for x in got}
    # A row at the address of one with a priority has the least relaxed one.
    assert kept[1, 1] == (1, 6, [1, 0, 0]) and kept[1, 0] == (0, 0, [0] * 40) and len(stored) == 1


def test_a_variable_is_known_by_one_row(spark, tmp_path):
    con = altered(tmp_path, "lineitem", "* replace (case when l_linenumber % 5 = 0 then null else l_suppkey end as l_suppkey)")
    same_as_sql(spark, tmp_path, con, "static_findings")
    assert physical(audits.QUERIES["static_findings"](spark, FOLDER)).count("Join") == 1


def test_responses_are_dealt_once(spark):
    kinds = {
        "responses": "response long, omissions array<string>", "functions": "response long, fn string, excerpt string", "instructions": "response long, fn string, block string, address long, index long, text string",
        "edges": "response long, caller string, address long, callee string, guards array<string>", "facts": "response long, fact_id string, kind string, fn string, address long, index long, protected boolean",
    }
    rows = {
        "responses": [(1, None)], "functions": [(1, "f", "x" * 900), (1, "f", None)], "instructions": [(1, "f", "b", 5, 0, "t"), (1, "f", "c", 6, 0, "t")], "edges": [(1, "f", 5, "g", ["b", None])],
        "facts": [(1, "a", "unknown", "f", None, 0, True), (1, "b" * 300, "guard", "f", 5, 0, False)],
    }
    got = fitting.fit_responses(**{k: spark.createDataFrame(v, kinds[k]) for k, v in rows.items()}, maximum=500)
    assert physical(got).count("Exchange") == 1
    kept = json.loads(got.first()["body"])
    # A protected fact without an address stays as well, and a function's second row adds no edges.
    assert got.first()["dropped"] == 1 and [f["fact_id"] for f in kept["facts"]] == ["a"]
    assert kept["edges"] == [] and [[b["block"] for b in f["blocks"]] for f in kept["functions"]] == [["c"], ["c"]]
    assert len(json.loads(fitting.fit_responses(**{k: spark.createDataFrame(v, kinds[k]) for k, v in rows.items()}, maximum=9000).first()["body"])["edges"]) == 1


def test_dominators_of_layers_look_at_each_edge_once(spark, monkeypatch):
    stored, cut = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: stored.append(1) or cut(df))
    r = random.Random(3)
    layers = {(1, 10 + k) for k in range(4)} | {(10 + r.randrange(4), 100 + r.randrange(9)) for _ in range(12)} | {(100 + r.randrange(9), 1000 + r.randrange(20)) for _ in range(40)}
    graphs = [layers] + [{(r.randrange(1, n), r.randrange(1, n)) for _ in range(m)} | {(1, 2)} for n, m in ((12, 18), (20, 40), (30, 45))]
    # A node found early and late: on the shortest way 2 is on all ways to 4, but not on the long one.
    graphs.append({(1, 2), (2, 4), (1, 3), (3, 5), (5, 4), (4, 6), (6, 5), (4, 4), (6, 1)})
    for k, edges in enumerate(graphs):
        stored.clear()
        got = {tuple(x) for x in G.dominators(spark.createDataFrame(sorted(edges) * 2, "src long, dst long"), 1).collect()}

        def reached(gone, edges=edges):
            seen = {1} - {gone}
            while new := {b for a, b in edges if a in seen and b != gone} - seen:
                seen |= new
            return seen

        nodes = reached(None)
        assert got == {(n, gone) for gone in nodes for n in nodes - reached(gone)}
        assert k or len(stored) <= 5  # the edges, and what each layer gets, with an empty one


def test_nearest_seeds_are_stored_once_for_all_nodes_behind_a_hub(spark, monkeypatch):
    stored, cut = [], G.cut

    def count(df):
        out = cut(df)
        stored.append(out.agg(F.sum(F.size("seeds"))).first()[0] or 0 if "seeds" in out.columns else 0)
        return out

    monkeypatch.setattr(G, "cut", count)
    r = random.Random(5)
    hubs = [(k, 1000 + k % 2) for k in range(80)] + [(1000 + k % 3, 2000 + k) for k in range(150)] + [(79, 1002), (2000, 3000), (2001, 3000), (2002, 3000), (3000, 3000)]
    graphs = [(hubs, list(range(80)))] + [([(r.randrange(60), r.randrange(60)) for _ in range(90)], r.sample(range(70), 20)) for _ in range(2)]
    for k, (edges, seeds) in enumerate(graphs):
        both, want = {*edges} | {(b, a) for a, b in edges}, {}
        for seed in sorted(seeds):
            at, front = {seed: 0}, {seed}
            for n in range(1, 5):
                front = {b for a, b in both if a in front} - at.keys()
                at |= dict.fromkeys(front, n)
            for node, n in at.items():
                if node not in want or n < want[node][0]:
                    want[node] = (n, [])
                if n == want[node][0]:
                    want[node][1].append(seed)
        tables = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(x,) for x in seeds], "node long")
        for options, few in [({}, G.FEW_SEEDS), ({"most": 1}, G.FEW_SEEDS), ({"most": 2}, 0)] if k < 2 else [({"most": 2}, G.FEW_SEEDS)]:
            stored.clear()
            with monkeypatch.context() as m:
                m.setattr(G, "FEW_SEEDS", few)
                got = {x["node"]: (x["distance"], x["seeds"]) for x in G.nearest_seeds(*tables, 4, **options).collect()}
            assert got == want
            assert k or sum(stored) < 300  # each of 150 nodes stored a list of 40 or so
