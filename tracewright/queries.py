"""Registry of the audit queries over the driver's tables: each name has a DataFrame form and DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewright.functions import scalars as S
from tracewright.operators import aggregates as A
from tracewright.operators import graph as G
from tracewright.operators import joins as J
from tracewright.operators import ranking as R
from tracewright.sources.tables import conflicts, new_rows, put_content, table
from tracewright.streaming import lifecycle as L

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
FLAGSHIP = "rate_at_k"

# Fixed values shared by the DataFrame form and the SQL.
PRICES = [("A", 3.0), ("N", 1.5), ("R", None)]
STEPS = [("view", "click"), ("click", "purchase"), ("view", "view"), ("click", "view"), ("signup", "view"), ("purchase", "view"), ("view", "signup")]


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _b(name: str) -> str:
    """SQL of the Wilson bounds of columns hits and n."""
    z, p = "1.959963984540054::DOUBLE", "(hits::DOUBLE / n)"
    sign = "-" if name == "low" else "+"
    return f"round((({p} + {z} * {z} / (2 * n)) {sign} {z} * sqrt({p} * (1 - {p}) / n + {z} * {z} / (4.0 * n * n))) / (1 + {z} * {z} / n), 6)"


_RATE = f"n, hits, round(hits::DOUBLE / n, 6) AS rate, {_b('low')} AS low, {_b('high')} AS high"


@query(f"""
WITH o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, min(i) FILTER (event_type = 'error') AS first FROM o GROUP BY user_id),
c AS (SELECT k, count(*) AS n, count(*) FILTER (first <= k) AS hits FROM f, (VALUES (3), (6), (12)) v(k) GROUP BY k)
SELECT k::INT AS k, {_RATE} FROM c""")
def rate_at_k(spark: SparkSession, d: str) -> DataFrame:
    events = R.ranked(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "i")
    return A.rate_at_k(events, "user_id", "i", F.col("event_type") == "error", [3, 6, 12])


@query(f"""
WITH c AS (SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS hits FROM events GROUP BY 1)
SELECT event_type, {_RATE} FROM c""")
def rate_by_type(spark: SparkSession, d: str) -> DataFrame:
    return A.rate(table(spark, d, "events"), ["event_type"], F.coalesce(F.col("value") > 50, F.lit(False)))


_PRICED = "(SELECT *, CASE l_returnflag WHEN 'A' THEN 3.0 WHEN 'N' THEN 1.5 END AS price FROM lineitem)"


@query(f"""
SELECT l_linestatus, l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity,
  CASE WHEN count(price) = count(*) THEN round(sum(l_quantity * price / 1000), 4) END AS cost FROM {_PRICED} GROUP BY 1, 2""")
def usage_cost(spark: SparkSession, d: str) -> DataFrame:
    prices = spark.createDataFrame(PRICES, "l_returnflag string, price double")
    usage = table(spark, d, "lineitem").join(F.broadcast(prices), "l_returnflag", "left")  # three constant rows
    cost = A.strict_sum(F.col("l_quantity") * F.col("price") / 1000)
    return usage.groupBy("l_linestatus", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(cost, 4).alias("cost"))


@query("""
WITH e AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0), o AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
x AS (SELECT coalesce(e.doc_id, o.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'fn' WHEN e.doc_id IS NULL THEN 'fp' ELSE 'tp' END AS outcome FROM e FULL JOIN o ON e.doc_id = o.doc_id),
c AS (SELECT lang, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn FROM x JOIN documents USING (doc_id) GROUP BY lang)
SELECT *, round(tp::DOUBLE / greatest(1, tp + fp), 6) AS precision, round(tp::DOUBLE / greatest(1, tp + fn), 6) AS recall FROM c""")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    found = J.expected_and_observed(labels.filter("quality = 0"), labels.filter("toxic = 1"), ["doc_id"])
    return A.confusion(found.join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id"), ["lang"], "outcome")


@query("""
WITH a AS (SELECT count(DISTINCT user_id) AS users, avg(value) AS mean_value, count(*) FILTER (event_type = 'error')::DOUBLE / count(*) AS error_rate, max(NULL::DOUBLE) AS missing FROM events)
SELECT 'users' AS gate, users::DOUBLE AS actual, 100.0::DOUBLE AS required, users >= 100 AS passed FROM a
UNION ALL SELECT 'mean_value', round(mean_value, 6), 1000.0, round(mean_value, 6) <= 1000 FROM a
UNION ALL SELECT 'error_rate', round(error_rate, 6), 0.1, round(error_rate, 6) <= 0.1 FROM a
UNION ALL SELECT 'missing', missing, 0.0, false FROM a""")
def release_gates(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "events").agg(
        F.countDistinct("user_id").alias("users"),
        F.round(F.avg("value"), 6).alias("mean_value"),
        F.round(F.avg((F.col("event_type") == "error").cast("double")), 6).alias("error_rate"),
        F.max(F.lit(None).cast("double")).alias("missing"),
    )
    return A.gates(one, [("users", ">=", 100), ("mean_value", "<=", 1000), ("error_rate", "<=", 0.1), ("missing", ">=", 0)])


@query("""
SELECT o_custkey, count(*) AS reviews, count(DISTINCT o_orderstatus) AS verdicts,
  CASE WHEN count(*) < 2 THEN 'insufficient' WHEN count(DISTINCT o_orderstatus) > 1 THEN 'disagree'
    WHEN max(o_totalprice) >= 300000 AND count(DISTINCT o_orderpriority) < 2 THEN 'needs_second_configuration' ELSE 'agreed' END AS status
FROM orders GROUP BY o_custkey""")
def consensus(spark: SparkSession, d: str) -> DataFrame:
    n, v = F.count(F.lit(1)), F.countDistinct("o_orderstatus")
    status = F.when(n < 2, "insufficient").when(v > 1, "disagree").when((F.max("o_totalprice") >= 300000) & (F.countDistinct("o_orderpriority") < 2), "needs_second_configuration").otherwise("agreed")
    return table(spark, d, "orders").groupBy("o_custkey").agg(n.alias("reviews"), v.alias("verdicts"), status.alias("status"))


@query("""
SELECT event_type, floor(value / 10)::BIGINT AS signature, count(*) AS members, arg_min(event_id, (ts, event_id)) AS representative, count(DISTINCT user_id) AS routes
FROM events WHERE value IS NOT NULL GROUP BY 1, 2""")
def crash_clusters(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").filter("value is not null").withColumn("signature", F.floor(F.col("value") / 10).cast("long"))
    return A.clusters(events, ["event_type", "signature"], ["ts", "event_id"], "user_id").select("event_type", "signature", "members", F.col("first.event_id").alias("representative"), "routes")


@query("""
WITH i AS (SELECT event_type, event_id - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS g FROM (SELECT DISTINCT event_type, event_id FROM events))
SELECT event_type, max(n) AS longest FROM (SELECT event_type, g, count(*) AS n FROM i GROUP BY 1, 2) GROUP BY 1""")
def longest_runs(spark: SparkSession, d: str) -> DataFrame:
    return A.longest_run(table(spark, d, "events"), ["event_type"], "event_id")


@query("""
WITH c AS (SELECT *, l_orderkey * 10 AS s, l_orderkey * 10 + l_quantity::BIGINT AS e FROM lineitem),
w AS (SELECT l_returnflag, s, e, max(e) OVER (PARTITION BY l_returnflag ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM c),
g AS (SELECT *, sum((s > coalesce(m, s - 2) + 1)::INT) OVER (PARTITION BY l_returnflag ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM w)
SELECT l_returnflag, min(s) AS s, max(e) AS e FROM g GROUP BY l_returnflag, g""")
def adjacent_ranges(spark: SparkSession, d: str) -> DataFrame:
    spans = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_orderkey") * 10).alias("s"), (F.col("l_orderkey") * 10 + F.col("l_quantity").cast("long")).alias("e"))
    return A.merged_ranges(spans, ["l_returnflag"], "s", "e")


@query("""
SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderstatus <> 'F', o_totalprice DESC, o_orderkey) AS r
FROM customer LEFT JOIN orders ON c_custkey = o_custkey) WHERE r = 1""")
def pick_definition(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders")
    return J.pick_one(c, o, F.col("c_custkey") == F.col("o_custkey"), ["c_custkey"], [F.col("o_orderstatus") != "F", F.desc("o_totalprice"), F.col("o_orderkey")]).select("c_custkey", "o_orderkey")


@query("SELECT p_partkey, p_brand FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount > 0.05 AND l_returnflag = 'A')")
def unresolved_parts(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "lineitem").filter("l_discount > 0.05 and l_returnflag = 'A'").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey", "p_brand").join(used, "p_partkey", "left_anti")


@query("""
SELECT event_id, p_partkey, p_size FROM events JOIN part ON event_id BETWEEN p_partkey * 5 AND p_partkey * 5 + p_size AND event_type = 'error'""")
def line_containment(spark: SparkSession, d: str) -> DataFrame:
    spans = table(spark, d, "part").select("p_partkey", "p_size", (F.col("p_partkey") * 5).alias("a"), (F.col("p_partkey") * 5 + F.col("p_size")).alias("b"))
    points = table(spark, d, "events").filter("event_type = 'error'").select("event_id")
    return J.range_join(points, spans, "event_id", "a", "b", 32).select("event_id", "p_partkey", "p_size")


@query("""
SELECT x.p_partkey AS a, y.p_partkey AS b FROM part x JOIN part y ON x.p_brand = y.p_brand AND x.p_partkey < y.p_partkey
WHERE x.p_partkey * 3 <= y.p_partkey * 3 + y.p_size AND y.p_partkey * 3 <= x.p_partkey * 3 + x.p_size""")
def line_overlap(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    side = lambda n: p.select("p_brand", F.col("p_partkey").alias(n), (F.col("p_partkey") * 3).alias(f"{n}_s"), (F.col("p_partkey") * 3 + F.col("p_size")).alias(f"{n}_e"))
    return J.overlap_join(side("a"), side("b"), ("a_s", "a_e"), ("b_s", "b_e"), 32, ["p_brand"]).filter("a < b").select("a", "b")


@query("""
SELECT p.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
LEFT JOIN LATERAL (SELECT event_id FROM events v WHERE v.user_id = p.user_id AND v.event_type = 'view' AND v.ts <= p.ts ORDER BY v.ts DESC, v.event_id DESC LIMIT 1) v ON true""")
def latest_before(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    views = e.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return J.as_of(e.filter("event_type = 'purchase'"), views, ["user_id"], "ts", ["view_id"], "view_id").select("event_id", "view_id")


@query("""
WITH u AS (SELECT n_name, min(n_nationkey) AS k FROM nation GROUP BY 1 HAVING count(*) = 1)
SELECT s_suppkey, coalesce(a.n_nationkey, u.k, try_cast(regexp_extract(s_name, '([0-9]+)$', 1) AS BIGINT) % 25)::BIGINT AS target
FROM supplier LEFT JOIN nation a ON a.n_nationkey = s_nationkey AND s_acctbal > 5000 LEFT JOIN u ON u.n_name = s_name""")
def callee_resolution(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    unique = n.groupBy("n_name").agg(F.min("n_nationkey").alias("k"), F.count(F.lit(1)).alias("c")).filter("c = 1").drop("c")
    s = table(spark, d, "supplier").join(n.select(F.col("n_nationkey").alias("tagged")), (F.col("tagged") == F.col("s_nationkey")) & (F.col("s_acctbal") > 5000), "left")
    s = s.join(unique, F.col("n_name") == F.col("s_name"), "left")
    parsed = F.regexp_extract("s_name", "([0-9]+)$", 1).try_cast("long") % 25
    return s.select("s_suppkey", F.coalesce(F.col("tagged").cast("long"), F.col("k").cast("long"), parsed).alias("target"))


@query("""
WITH c AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_quantity > 49), n AS (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
SELECT DISTINCT l_partkey AS node FROM c WHERE l_suppkey IN (SELECT s_suppkey FROM n) UNION SELECT DISTINCT l_suppkey FROM c WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 5)""")
def neighbour_expansion(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "lineitem").filter("l_quantity > 49").select("l_suppkey", "l_partkey").distinct()
    changed = table(spark, d, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    small = table(spark, d, "part").filter("p_size < 5").select(F.col("p_partkey").alias("l_partkey"))
    return edges.join(changed, "l_suppkey", "left_semi").select(F.col("l_partkey").alias("node")).union(edges.join(small, "l_partkey", "left_semi").select("l_suppkey")).distinct()


@query("""
SELECT c_custkey, o_orderkey, score FROM (SELECT o_custkey AS c_custkey, o_orderkey, score, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey) AS r FROM
(SELECT *, 20 * (o_orderstatus = 'F')::INT + 4 * (o_orderpriority IN ('1-URGENT', '2-HIGH'))::INT + (o_totalprice / 100000)::INT AS score FROM (SELECT * REPLACE (floor(o_totalprice) AS o_totalprice) FROM orders))) WHERE r <= 3""")
def knowledge_top_k(spark: SparkSession, d: str) -> DataFrame:
    score = 20 * (F.col("o_orderstatus") == "F").cast("int") + 4 * F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int") + F.rint(F.floor("o_totalprice") / 100000).cast("int")
    rows = table(spark, d, "orders").withColumn("score", score)
    return R.top_k(rows, ["o_custkey"], [F.desc("score"), F.col("o_orderkey")], 3).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "score")


@query("""
SELECT event_id, floor((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 5)::BIGINT AS wave FROM events""")
def wave_assignment(spark: SparkSession, d: str) -> DataFrame:
    return R.waves(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], 5).select("event_id", "wave")


@query("""
SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1""")
def first_wins(spark: SparkSession, d: str) -> DataFrame:
    return R.top_k(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], 1).select("event_id")


@query("""
SELECT n_name, count(*) FILTER (covered) AS covered, count(*) FILTER (NOT covered) AS uncovered FROM
(SELECT n_name, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000) AS covered FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1""")
def coverage_plan(spark: SparkSession, d: str) -> DataFrame:
    expected = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    done = table(spark, d, "orders").filter("o_orderstatus = 'F' and o_totalprice > 200000").select(F.col("o_custkey").alias("k")).distinct()
    flag = expected.join(done, F.col("c_custkey") == F.col("k"), "left")
    return flag.groupBy("n_name").agg(F.count("k").alias("covered"), F.sum(F.col("k").isNull().cast("long")).alias("uncovered"))


@query("""
SELECT event_id, 'fact_' || left(sha256(event_type || chr(0) || user_id || chr(0) || coalesce(props, '')), 20) AS fact_id FROM events""")
def content_identity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", S.digest("fact_", F.col("event_type"), F.col("user_id"), F.col("props")).alias("fact_id"))


@query("""
SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(regexp_replace(lower(text), '\\s+', ' ', 'g'))""")
def fingerprint_groups(spark: SparkSession, d: str) -> DataFrame:
    keyed = table(spark, d, "documents").select("doc_id", F.sha2(F.regexp_replace(F.lower("text"), "\\s+", " "), 256).alias("k"))
    return keyed.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).drop("k")


_METRIC = {"AV": "NALP", "AC": "LH", "PR": "NLH", "UI": "NR", "S": "UC", "C": "HLN", "I": "HLN", "A": "HLN"}


def _cvss_sql() -> str:
    weight = lambda t, c: "CASE " + c + "".join(f" WHEN '{k}' THEN {v}::DOUBLE" for k, v in S.CVSS[t].items()) + " END"
    pick = ", ".join(f"substr('{v}', (p_partkey // {7 ** i} % {len(v)} + 1)::INT, 1) AS {k}" for i, (k, v) in enumerate(_METRIC.items()))
    return f"""
WITH m AS (SELECT p_partkey, {pick} FROM part),
i AS (SELECT *, 1 - (1 - {weight("CIA", "C")}) * (1 - {weight("CIA", "I")}) * (1 - {weight("CIA", "A")}) AS iss FROM m),
b AS (SELECT *, CASE S WHEN 'C' THEN 7.52::DOUBLE * (iss - 0.029::DOUBLE) - 3.25::DOUBLE * pow(iss - 0.02::DOUBLE, 15) ELSE 6.42::DOUBLE * iss END AS impact,
  8.22::DOUBLE * {weight("AV", "AV")} * {weight("AC", "AC")} * CASE S WHEN 'C' THEN {weight("PR_C", "PR")} ELSE {weight("PR_U", "PR")} END * {weight("UI", "UI")} AS ease FROM i),
s AS (SELECT p_partkey, CASE WHEN impact <= 0 THEN 0.0::DOUBLE ELSE ceil(round(least(10.0::DOUBLE, CASE S WHEN 'C' THEN 1.08::DOUBLE * (impact + ease) ELSE impact + ease END) * 100000) / 10000) / 10 END AS score FROM b)
SELECT p_partkey, score, CASE WHEN score = 0 THEN 'none' WHEN score < 4 THEN 'low' WHEN score < 7 THEN 'medium' WHEN score < 9 THEN 'high' ELSE 'critical' END AS severity FROM s"""


@query(_cvss_sql())
def cvss_scores(spark: SparkSession, d: str) -> DataFrame:
    parts = [F.concat(F.lit(f"{k}:"), F.substring(F.lit(v), (F.expr(f"p_partkey div {7 ** i}") % len(v) + 1).cast("int"), F.lit(1))) for i, (k, v) in enumerate(_METRIC.items())]
    scored = table(spark, d, "part").select("p_partkey", S.cvss_base(F.concat_ws("/", *parts)).alias("score"))
    return scored.withColumn("severity", S.severity(F.col("score")))


@query("""
SELECT event_id, greatest(coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0), 0) AS k FROM events""")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", S.positive_int(F.get_json_object("props", "$.k")).alias("k"))


@query("""
SELECT source, count(*) AS total, count(DISTINCT text) AS distinct_texts, round((1 - count(DISTINCT text)::DOUBLE / count(*)) * 100, 2) AS reduction FROM documents GROUP BY 1""")
def reduction(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.countDistinct(F.xxhash64("text"), F.sha2("text", 256)).alias("distinct_texts"))
    return g.withColumn("reduction", S.reduction_percent(F.col("distinct_texts"), F.col("total")))


_ALLOWED = " OR ".join(f"(f = '{a}' AND event_type = '{b}')" for a, b in STEPS)


@query(f"""
SELECT event_id, f AS from_state, event_type AS to_state FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM events) WHERE f IS NOT NULL AND NOT ({_ALLOWED})""")
def illegal_transitions(spark: SparkSession, d: str) -> DataFrame:
    return L.illegal(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", STEPS).select("event_id", "from_state", F.col("event_type").alias("to_state"))


@query("""
WITH l AS (SELECT event_id, user_id, ts, lag(ts) OVER w AS b, lead(ts) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, coalesce(n <= ts + INTERVAL 600 SECOND, false) AS renewed,
  (1 + sum(coalesce(ts > b + INTERVAL 600 SECOND, false)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS attempt FROM l""")
def lease_sweep(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return L.leases(events, "user_id", ["ts", "event_id"], "ts", 600).select("event_id", "renewed", "attempt")


@query("""
SELECT user_id, k, count(*) AS n, CASE WHEN count(DISTINCT event_type) > 1 THEN 'conflict' WHEN count(*) > 1 THEN 'replay' ELSE 'first' END AS outcome
FROM (SELECT user_id, event_type, json_extract_string(props, '$.k') AS k FROM events) GROUP BY 1, 2""")
def idempotent_replay(spark: SparkSession, d: str) -> DataFrame:
    return L.replays(table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k")), "user_id", "k", "event_type")


@query("SELECT DISTINCT 'sha256:' || sha256(text) AS digest, left(sha256(text), 2) AS shard FROM documents")
def content_addresses(spark: SparkSession, d: str) -> DataFrame:
    return put_content(table(spark, d, "documents").select("text"), "text").select("digest", "shard")


@query("""
SELECT c_mktsegment, n_name, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM (
  SELECT c_mktsegment, n_name, unnest(list_filter([CASE WHEN c_acctbal < 0 THEN 'debt' END, CASE WHEN c_acctbal > 9000 THEN 'wealth' END, CASE WHEN c_custkey % 2 = 0 THEN 'even' END], lambda x: x IS NOT NULL)) AS reason
  FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1, 2""")
def file_reasons(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    found = F.array_compact(F.array(F.when(F.col("c_acctbal") < 0, "debt"), F.when(F.col("c_acctbal") > 9000, "wealth"), F.when(F.col("c_custkey") % 2 == 0, "even")))
    each = c.select("c_mktsegment", "n_name", F.explode(found).alias("reason"))
    return each.groupBy("c_mktsegment", "n_name").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_totalprice < 20000 THEN 'too_small' WHEN o_orderpriority = '5-LOW' THEN 'low_priority' END AS omitted,
  concat_ws(',', CASE WHEN o_orderstatus = 'P' THEN 'pending' END, CASE WHEN o_totalprice < 20000 THEN 'too_small' END, CASE WHEN o_orderpriority = '5-LOW' THEN 'low_priority' END) AS all_reasons FROM orders""")
def eligibility(spark: SparkSession, d: str) -> DataFrame:
    rules = [("pending", F.col("o_orderstatus") == "P"), ("too_small", F.col("o_totalprice") < 20000), ("low_priority", F.col("o_orderpriority") == "5-LOW")]
    return table(spark, d, "orders").select("o_orderkey", S.first_reason(*rules).alias("omitted"), S.reasons(*rules).alias("all_reasons"))


@query("""
SELECT user_id, min(ts) FILTER (event_type = 'error') AS first_error, median(value) AS median_value, count(*) AS n FROM events GROUP BY 1""")
def time_to_first(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "error", F.col("ts"))).alias("first_error"), F.median("value").alias("median_value"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT event_id, sha256(coalesce(before, '') || '|' || event_type || '|' || event_id) AS link FROM (SELECT event_id, event_type, lag(sha256(event_id::VARCHAR)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)""")
def continuation_links(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.coalesce(F.lag(F.sha2(F.col("event_id").cast("string"), 256)).over(w), F.lit(""))
    return table(spark, d, "events").select("event_id", F.sha2(F.concat_ws("|", before, "event_type", F.col("event_id").cast("string")), 256).alias("link"))


@query("""
SELECT url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_replace(regexp_replace(lower(url), '^https?://', ''), '[?#].*$', '') AS key FROM pages""")
def url_keys(spark: SparkSession, d: str) -> DataFrame:
    key = F.regexp_replace(F.regexp_replace(F.lower("url"), "^https?://", ""), "[?#].*$", "")
    return table(spark, d, "pages").select("url", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), key.alias("key"))


@query("""
WITH c AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT l_suppkey, sum(n) * 100 - min(l_partkey) AS score FROM c GROUP BY 1)
SELECT n_name, s_suppkey, score::BIGINT AS score FROM (SELECT n_name, s_suppkey, score, row_number() OVER (PARTITION BY n_name ORDER BY score DESC, s_suppkey) AS r FROM s JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey) WHERE r <= 2""")
def routing_scores(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem").groupBy("l_suppkey").agg((F.count(F.lit(1)) * 100 - F.min("l_partkey")).cast("long").alias("score"))
    j = s.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return R.top_k(j, ["n_name"], [F.desc("score"), F.col("s_suppkey")], 2).select("n_name", "s_suppkey", "score")
