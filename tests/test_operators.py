"""Operators on small fixtures with nulls, ties and empty inputs."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tracewright.functions import scalars as S
from tracewright.operators import aggregates as A
from tracewright.operators import graph as G
from tracewright.operators import joins as J
from tracewright.operators import ranking as R
from tracewright.sources.tables import json_lines, new_rows, source_files
from tracewright.streaming import lifecycle as L


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_cvss(spark):
    vectors = [("AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", 9.8), ("AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N", 6.1), ("AV:L/AC:H/PR:H/UI:R/S:U/C:N/I:N/A:N", 0.0), ("AV:N", None)]
    df = spark.createDataFrame([(v,) for v, _ in vectors], "v string").select("v", S.cvss_base(F.col("v")).alias("s"))
    assert dict(map(tuple, df.collect())) == dict(vectors)


def test_strict_sum(spark):
    df = spark.createDataFrame([(1, 2.0), (1, None), (2, 3.0)], "g int, x double").groupBy("g").agg(A.strict_sum(F.col("x")).alias("s"))
    assert rows(df) == [(1, None), (2, 3.0)]


def test_range_and_overlap(spark):
    points = spark.createDataFrame([(1,), (5,), (9,), (None,)], "p long")
    spans = spark.createDataFrame([("a", 1, 5), ("b", 5, 9), ("c", 7, 3)], "n string, s long, e long")
    assert rows(J.range_join(points, spans, "p", "s", "e", 2).select("p", "n")) == [(1, "a"), (5, "a"), (5, "b"), (9, "b")]
    assert rows(J.range_join(points, spans, "p", "s", "e", 2, closed=False).select("p", "n")) == [(1, "a"), (5, "b")]
    other = spans.select(F.col("n").alias("m"), F.col("s").alias("t"), F.col("e").alias("f")).filter("t <= f")
    left = J.range_join(points, spans, "p", "s", "e", 2, how="left").select("p", "n")
    assert rows(left) == rows(spark.createDataFrame([(1, "a"), (5, "a"), (5, "b"), (9, "b"), (None, None)], "p long, n string"))
    assert rows(J.overlap_join(spans.filter("s <= e"), other, ("s", "e"), ("t", "f"), 2).select("n", "m")) == [("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")]


def test_as_of(spark):
    left = spark.createDataFrame([(1, 10), (1, 3), (2, 5)], "k int, t long")
    right = spark.createDataFrame([(1, 4, "x"), (1, 10, "y"), (1, 10, "z")], "k int, t long, v string")
    assert rows(J.as_of(left, right, ["k"], "t", ["v"], "v")) == [(1, 10, "z"), (1, 3, None), (2, 5, None)]


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (4, 2), (9, 9), (7, 8)], "src long, dst long")
    seeds = spark.createDataFrame([(1,)], "node long")
    assert rows(G.reachable(edges, seeds)) == [(1, 0), (2, 1), (3, 1), (4, 2)]
    assert ("1>3>4") in [">".join(map(str, r["path"])) for r in G.shortest_paths(edges, seeds, 5).collect()]
    assert rows(G.components(edges)) == [(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7), (9, 9)]
    assert rows(G.dominators(edges, 1)) == [(1, 1), (2, 1), (2, 2), (3, 1), (3, 3), (4, 1), (4, 3), (4, 4)]


def test_next_fit_streams_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        df = spark.createDataFrame([("a", i, 4) for i in range(8)] + [("b", 0, 50)], "g string, o int, n int")
        got = R.next_fit(df, "g", "o", "n", 10, separator=1)
        assert rows(got.select("g", "o", "bin")) == [("a", i, i // 2) for i in range(8)] + [("b", 0, 0)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty(spark):
    empty = spark.createDataFrame([], "src long, dst long")
    assert G.components(empty).count() == 0
    assert A.longest_run(empty, ["src"], "dst").count() == 0


def test_new_rows(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (2, "d"), (2, "c")], "k int, v string")
    assert rows(new_rows(old, new, ["k"], ["v"])) == [(2, "c")]


def test_json_lines_and_sources(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text(json.dumps({"ts": "t", "type": "x"}) + "\n\n")
    bad.write_text('{"ts": "t", "type"\n')
    assert rows(json_lines(spark, str(good), "ts string, type string")) == [("t", "x")]
    with pytest.raises(Exception, match="(?i)malformed"):
        json_lines(spark, str(bad), "ts string, type string").collect()
    (tmp_path / "src" / "build").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("x")
    (tmp_path / "src" / "test_a.py").write_text("y")
    (tmp_path / "src" / "build" / "b.py").write_text("z")
    got = source_files(spark, str(tmp_path / "src"), ["py"]).select(F.element_at(F.split("path", "/"), -1), "size", "is_test")
    assert rows(got) == [("a.py", 1, False), ("test_a.py", 1, True)]


def test_spans_of_all_lengths(spark):
    r = random.Random(2)
    spans = [(k, s, s + r.choice([0, 3, 40, 900, 50_000, 4_000_000])) for k in range(60) for s in [r.randrange(5000)]]
    points = [(r.randrange(6000),) for _ in range(50)]
    a = spark.createDataFrame(spans, "n long, s long, e long")
    b = a.select(F.col("n").alias("m"), F.col("s").alias("t"), F.col("e").alias("f"))
    got = J.overlap_join(a, b, ("s", "e"), ("t", "f"), 4).select("n", "m").collect()
    want = [(x[0], y[0]) for x in spans for y in spans if x[1] <= y[2] and y[1] <= x[2]]
    assert sorted(map(tuple, got)) == sorted(want)
    inside = J.range_join(spark.createDataFrame(points, "p long"), a, "p", "s", "e", 4).select("p", "n").collect()
    assert sorted(map(tuple, inside)) == sorted((p, n) for (p,) in points for n, s, e in spans if s <= p <= e)


def test_merged_ranges_over_cells(spark):
    r = random.Random(3)
    spans = [(k % 2, s, s + r.randrange(30)) for k in range(300) for s in [r.randrange(20_000)]]
    got = A.merged_ranges(spark.createDataFrame(spans, "g long, s long, e long"), ["g"], "s", "e", 64).collect()
    for g in (0, 1):
        covered = sorted({x for k, s, e in spans if k == g for x in range(s, e + 1)})
        starts = [x for x, y in zip(covered, [-9, *covered], strict=False) if x - y > 1]
        assert sorted(x["s"] for x in got if x["g"] == g) == starts


def test_streamed_leases_equal_batch(spark, tmp_path):
    """Over several micro-batches, beats in any order within the lateness, and one that comes too late."""
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    schema = "entity string, at timestamp"
    batches = [[("u", at(30)), ("u", at(0)), ("v", at(0))], [("u", at(5)), ("u", at(90)), ("u", at(31))], [("w", at(4000))], [("u", at(2)), ("w", at(4001))], [("w", at(9000))]]
    (tmp_path / "beats").mkdir()
    stream = L.stream_leases(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "beats")), 10)
    q = stream.writeStream.format("memory").queryName("leases").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        for k, rows_ in enumerate(batches):
            (tmp_path / "beats" / f"{k}.json").write_text("\n".join(json.dumps({"entity": e, "at": x.isoformat()}) for e, x in rows_))
            q.processAllAvailable()
    finally:
        q.stop()
    # The beat at 2 came after the watermark had passed it; the last one is still waiting.
    df = spark.createDataFrame([x for k, b in enumerate(batches[:4]) for x in b if x != ("u", at(2))], schema)
    batch = L.leases(df, "entity", ["at"], "at", 10).select("entity", "at", "attempt")
    assert rows(spark.table("leases")) == rows(batch)


def test_carried_sums_and_digest_trees_over_ranges(spark):
    import hashlib

    r = random.Random(9)
    rows_ = [(r.choice(["a", "b", None]), r.choice([None, *range(300)]), r.choice([None, 1, 2, 7])) for _ in range(500)]
    df = spark.createDataFrame(rows_, "k string, i long, n long")
    got = A.carried_sum(df, ["k"], "i", "n", "upto", 4, 3)
    assert got.columns == ["k", "i", "n", "upto"]
    low = lambda i: -1 if i is None else i
    want = [(k, i, n, sum(m or 0 for q, j, m in rows_ if q == k and low(j) <= low(i))) for k, i, n in rows_]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    sha = lambda xs: hashlib.sha256("\n".join(xs).encode()).hexdigest()
    tree = {x["k"]: x["root"] for x in A.digest_tree(df, ["k"], "i", F.concat_ws("-", "i", "n"), "root", 4, 2).collect()}
    for key in ("a", "b", None):
        level = [(i, "-".join(str(x) for x in (i, n) if x is not None)) for k, i, n in rows_ if k == key]
        for _ in range(2):
            groups = {}
            for i, e in sorted(level, key=lambda x: (low(x[0]), x[1])):
                groups.setdefault(None if i is None else i // 4, []).append(e)
            level = [(i, sha(es)) for i, es in groups.items()]
        assert tree[key] == sha([e for _, e in sorted(level, key=lambda x: low(x[0]))])


def test_contracted_components(spark):
    r = random.Random(4)
    edges = [(1000 + i, 999) for i in range(60)] + [(i, i + 1) for i in range(40)] + [(r.randrange(2000, 2050), r.randrange(2000, 2050)) for _ in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = {x["node"]: x["component"] for x in G.contracted_components(spark.createDataFrame([*edges, (5000, 5000)], "src long, dst long")).collect()}
    assert got == {5000: 5000} | {x: find(x) for x in root}
    assert G.contracted_components(spark.createDataFrame([], "src long, dst long")).count() == 0
