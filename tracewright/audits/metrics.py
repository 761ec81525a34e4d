"""Cohort metrics: totals, rates with id lists, costs, gates, clusters and scores.

All are plain aggregates with partial aggregation before their shuffle; what is gathered into a list is bounded by its
group (a case, a signature, a run), never by the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewright.audits.registry import FOUND, RUNS, WORK, audit, found, runs, whole, work
from tracewright.functions.scalars import wilson
from tracewright.operators import aggregates as A
from tracewright.sources.tables import table

COUNTERS = ["sessions", "calls", "failed_calls", "input_tokens", "cache_read_tokens", "cache_write_tokens", "output_tokens", "tool_calls", "retries", "files_read", "bytes_read", "wall_time_ms"]


def ids(value: str) -> Column:
    """The distinct values of a group as one sorted text."""
    return F.array_join(F.array_sort(F.collect_set(value)), ",")


def tally(condition: Column, name: str) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0)).cast("long").alias(name)


def ratio(hits: str, n: str) -> Column:
    return F.when(F.col(n) > 0, F.round(F.col(hits) / F.col(n), 6))


def usage_totals(df: DataFrame, groups: Sequence[str], counters: Sequence[str], cost: str) -> DataFrame:
    """The sum of each counter and a cost that is null if any row has none."""
    return df.groupBy(*groups).agg(*[F.sum(c).cast("long").alias(c) for c in counters], A.strict_sum(F.col(cost)).cast("long").alias(cost))


def _usage(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    q, price = F.col("l_quantity"), F.col("l_extendedprice")
    values = [F.lit(1), F.col("l_linenumber"), F.col("l_tax") > 0.07, q * 100, q * F.col("l_linenumber"), F.col("l_linenumber"), price / 100, q, F.col("l_discount") > 0.09, q / 5, price, q * 1000]
    scope = F.when(F.col("l_returnflag") == "A", "ranker").when(F.col("l_returnflag") == "N", "hunter").otherwise("reviewer")
    cost = F.when(~((F.col("l_linenumber") == 7) & (F.col("l_linestatus") == "F")), whole(price))
    return li.select(F.col("l_orderkey").alias("work_id"), F.col("l_suppkey").alias("run_id"), scope.alias("scope"), *[whole(v.cast("double")).alias(c) for v, c in zip(values, COUNTERS, strict=True)], cost.alias("cost_cents"))


_VALUES = ["1", "l_linenumber", "(l_tax > 0.07)::INT", "l_quantity * 100", "l_quantity * l_linenumber", "l_linenumber", "l_extendedprice / 100", "l_quantity", "(l_discount > 0.09)::INT", "l_quantity / 5", "l_extendedprice", "l_quantity * 1000"]
_USAGE = f"""usage AS (SELECT l_orderkey AS work_id, l_suppkey AS run_id, CASE l_returnflag WHEN 'A' THEN 'ranker' WHEN 'N' THEN 'hunter' ELSE 'reviewer' END AS scope,
  {", ".join(f"floor({v})::BIGINT AS {c}" for v, c in zip(_VALUES, COUNTERS, strict=True))},
  CASE WHEN NOT (l_linenumber = 7 AND l_linestatus = 'F') THEN floor(l_extendedprice)::BIGINT END AS cost_cents FROM lineitem)"""
_SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in COUNTERS)
_STRICT = "CASE WHEN count(cost_cents) = count(*) THEN sum(cost_cents) END::BIGINT AS cost_cents"


@audit("A1", f"WITH {_USAGE} SELECT run_id, {_SUMS}, {_STRICT} FROM usage GROUP BY run_id")
def usage_by_run(spark: SparkSession, d: str) -> DataFrame:
    return usage_totals(_usage(spark, d), ["run_id"], COUNTERS, "cost_cents")


@audit(
    "A3",
    f"""WITH {_USAGE}, files AS (SELECT o_orderkey AS work_id, CASE WHEN o_orderpriority < '2' THEN 'ranker' WHEN o_orderpriority < '4' THEN 'hunter' ELSE 'reviewer' END AS scope, floor(o_totalprice)::BIGINT AS input_tokens FROM orders),
own AS (SELECT work_id, scope, sum(input_tokens) AS input_tokens FROM usage GROUP BY 1, 2)
SELECT scope, sum(input_tokens)::BIGINT AS input_tokens, count(*) FILTER (origin = 'store') AS from_store, count(*) FILTER (origin = 'files') AS from_files FROM (
  SELECT scope, input_tokens, 'store' AS origin FROM own UNION ALL SELECT scope, input_tokens, 'files' FROM files ANTI JOIN own USING (work_id, scope)) GROUP BY scope""",
)
def usage_by_scope(spark: SparkSession, d: str) -> DataFrame:
    """Sums by scope; where the store has a (work, scope) row it wins over the one from files."""
    priority = F.col("o_orderpriority")
    scope = F.when(priority < "2", "ranker").when(priority < "4", "hunter").otherwise("reviewer")
    files = table(spark, d, "orders").select(F.col("o_orderkey").alias("work_id"), scope.alias("scope"), whole("o_totalprice").alias("input_tokens"))
    own = _usage(spark, d).groupBy("work_id", "scope").agg(F.sum("input_tokens").alias("input_tokens"))
    left = files.join(own, ["work_id", "scope"], "left_anti").withColumn("origin", F.lit("files"))
    both = own.withColumn("origin", F.lit("store")).unionByName(left)
    return both.groupBy("scope").agg(F.sum("input_tokens").cast("long").alias("input_tokens"), tally(F.col("origin") == "store", "from_store"), tally(F.col("origin") == "files", "from_files"))


@audit("A4", f"WITH {_USAGE} SELECT work_id, sum(input_tokens + cache_read_tokens + cache_write_tokens)::BIGINT AS input_tokens FROM usage GROUP BY work_id")
def input_by_work(spark: SparkSession, d: str) -> DataFrame:
    total = F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens")
    return _usage(spark, d).groupBy("work_id").agg(F.sum(total).cast("long").alias("input_tokens"))


@audit(
    "A5 A10",
    """SELECT n_name AS path, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS categories, coalesce(max(CASE WHEN c_acctbal > 0 THEN (c_acctbal / 2000)::INT + 1 END), 1)::BIGINT AS risk,
  count(DISTINCT c_custkey) AS nodes, string_agg(DISTINCT left(c_name, 13), ',' ORDER BY left(c_name, 13)) AS slice_ids FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1""",
)
def path_slices(spark: SparkSession, d: str) -> DataFrame:
    """Per path: its categories, greatest risk (1 if there is none), nodes and sorted slice ids."""
    risk = F.when(F.col("c_acctbal") > 0, F.round(F.col("c_acctbal") / 2000).cast("long") + 1)
    joined = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("slice", F.substring("c_name", 1, 13))
    return joined.groupBy(F.col("n_name").alias("path")).agg(ids("c_mktsegment").alias("categories"), F.coalesce(F.max(risk), F.lit(1)).cast("long").alias("risk"), F.countDistinct("c_custkey").alias("nodes"), ids("slice").alias("slice_ids"))


@audit(
    "A7 A13",
    f"""WITH {WORK}, g AS (SELECT component, family, string_agg(DISTINCT hunter, ',' ORDER BY hunter) AS hunters, count(DISTINCT hunter) AS n, min(CASE status WHEN 'done' THEN 3 WHEN 'running' THEN 2 ELSE 1 END) AS c, min(work_id) AS first, count(*) AS evidence FROM work GROUP BY 1, 2)
SELECT component, family, hunters, CASE c WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence, first AS obligation_id, evidence, n >= 2 AS needs_specialist, string_agg(h, ',' ORDER BY h) FILTER (h <> p) AS specialists
FROM (SELECT *, unnest(string_split(hunters, ',')) AS h, string_split(hunters, ',')[1] AS p FROM g) GROUP BY ALL EXCLUDE (h, p, c, n)""".replace("GROUP BY ALL EXCLUDE (h, p, c, n)", "GROUP BY component, family, hunters, c, first, evidence, n"),
)
def obligation_groups(spark: SparkSession, d: str) -> DataFrame:
    """Obligations of equal kind and facts as one: united evidence and hunters, the least confidence; all hunters but the
    first are specialists where there are two or more."""
    rank = F.when(F.col("status") == "done", 3).when(F.col("status") == "running", 2).otherwise(1)
    g = work(spark, d).groupBy("component", "family").agg(F.array_sort(F.collect_set("hunter")).alias("h"), F.min(rank).alias("c"), F.min("work_id").alias("obligation_id"), F.count("*").alias("evidence"))
    others = F.slice("h", F.lit(2), F.size("h"))
    confidence = F.when(F.col("c") == 3, "high").when(F.col("c") == 2, "medium").otherwise("low")
    return g.select("component", "family", F.array_join("h", ",").alias("hunters"), confidence.alias("confidence"), "obligation_id", "evidence", (F.size("h") >= 2).alias("needs_specialist"), F.when(F.size("h") >= 2, F.array_join(others, ",")).alias("specialists"))


@audit("A9", "SELECT l_partkey AS path, string_agg(DISTINCT l_linenumber, ',' ORDER BY l_linenumber) AS lines, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1")
def evidence_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_set("l_linenumber")), lambda x: x.cast("string")), ",").alias("lines"), F.countDistinct("l_linenumber").alias("n"))


def missing_elements(df: DataFrame, groups: Sequence[str], elements: dict[str, Column]) -> DataFrame:
    """The elements that some row of a group lacks, sorted, as one text; empty if none lacks any."""
    lacks = F.array_compact(F.array(*[F.when(~present, F.lit(name)) for name, present in sorted(elements.items())]))
    return df.groupBy(*groups).agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(lacks)))), ",").alias("missing"), F.count("*").alias("chains"))


@audit(
    "A14",
    f"""WITH {FOUND} SELECT target_id, concat_ws(',', CASE WHEN bool_or(NOT target_match) THEN 'match' END, CASE WHEN bool_or(state = 'raw') THEN 'reproduction' END, CASE WHEN bool_or(validity = 'unknown') THEN 'verdict' END) AS missing, count(*) AS chains FROM found GROUP BY 1""",
)
def missing_chain_elements(spark: SparkSession, d: str) -> DataFrame:
    return missing_elements(found(spark, d), ["target_id"], {"match": F.col("target_match"), "reproduction": F.col("state") != "raw", "verdict": F.col("validity") != "unknown"})


@audit("A15", f"WITH {WORK} SELECT component, status, count(*) AS n FROM work GROUP BY 1, 2")
def queue_counts(spark: SparkSession, d: str) -> DataFrame:
    return work(spark, d).groupBy("component", "status").agg(F.count("*").alias("n"))


@audit(
    "A16",
    f"""WITH {WORK}, {FOUND}, t AS (SELECT DISTINCT run_id, target_id FROM found), o AS (SELECT run_id, target_id, max(CASE WHEN state = 'reportable' THEN 2 WHEN state = 'reproduced' THEN 1 ELSE 0 END) AS best FROM found GROUP BY 1, 2)
SELECT campaign, count(*) AS planned, count(*) FILTER (outcome = 'finding') AS finding, count(*) FILTER (outcome = 'no_finding') AS no_finding, count(*) FILTER (outcome = 'deferred') AS deferred, count(*) FILTER (outcome = 'missing') AS missing,
  round(count(*) FILTER (outcome IN ('finding', 'no_finding'))::DOUBLE / count(*), 6) AS completion FROM (
  SELECT campaign, CASE WHEN best = 2 THEN 'finding' WHEN best = 1 THEN 'no_finding' WHEN status = 'done' THEN 'no_finding' WHEN status = 'running' THEN 'deferred' ELSE 'missing' END AS outcome FROM t JOIN o USING (run_id, target_id) JOIN work ON run_id = work_id) GROUP BY 1""",
)
def target_completion(spark: SparkSession, d: str) -> DataFrame:
    """Targets by outcome; a target that reported nothing is closed by its work's status: no finding if done, else deferred or missing."""
    best = F.max(F.when(F.col("state") == "reportable", 2).when(F.col("state") == "reproduced", 1).otherwise(0)).alias("best")
    o = found(spark, d).groupBy("run_id", "target_id").agg(best).join(work(spark, d), F.col("run_id") == F.col("work_id"))
    rule = F.when(F.col("best") == 2, "finding").when((F.col("best") == 1) | (F.col("status") == "done"), "no_finding").when(F.col("status") == "running", "deferred").otherwise("missing")
    o = o.withColumn("outcome", rule).groupBy("campaign").agg(F.count("*").alias("planned"), *[tally(F.col("outcome") == x, x) for x in ("finding", "no_finding", "deferred", "missing")])
    return o.withColumn("completion", F.round((F.col("finding") + F.col("no_finding")) / F.col("planned"), 6))


@audit(
    "A17",
    """SELECT user_id, count(*) AS calls, count(*) FILTER (event_type = 'error') AS failures, sum(CASE WHEN event_type = 'error' AND value > 100 THEN 1 ELSE 0 END)::BIGINT AS protocol, sum(CASE WHEN event_type = 'error' AND value > 50 AND value <= 100 THEN 1 ELSE 0 END)::BIGINT AS schema,
  sum(CASE WHEN event_type = 'error' AND coalesce(value <= 50, true) THEN 1 ELSE 0 END)::BIGINT AS other FROM events GROUP BY 1""",
)
def protocol_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Calls, failures, and failures by category."""
    bad, v = F.col("event_type") == "error", F.col("value")
    category = F.when(v > 100, "protocol").when(v > 50, "schema").otherwise("other")
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("calls"), tally(bad, "failures"), *[tally(bad & (category == c), c) for c in ("protocol", "schema", "other")])


@audit(
    "A18 O12",
    f"""WITH {FOUND}, s AS (SELECT candidate_id, count(*) AS findings, count(*) FILTER (session_index > 4) AS beyond, count(*) FILTER (session_index > 4 AND state = 'reportable') AS high, count(*) FILTER (session_index IN (5, 6) AND state = 'reportable') AS probe, count(DISTINCT session_index) FILTER (session_index > 4) AS sessions FROM found GROUP BY 1)
SELECT candidate_id, findings, sessions AS extension_sessions, beyond AS incremental_findings, high AS incremental_high, CASE WHEN sessions > 0 THEN round(beyond::DOUBLE / sessions, 6) END AS yield, sessions >= 2 AND probe = 0 AS stop_early FROM s""",
)
def extension_yield(spark: SparkSession, d: str) -> DataFrame:
    """What sessions beyond the standard boundary added; the extension stops if its first two sessions gave nothing high."""
    beyond, high = F.col("session_index") > 4, F.col("state") == "reportable"
    s = found(spark, d).groupBy("candidate_id").agg(
        F.count("*").alias("findings"),
        F.countDistinct(F.when(beyond, F.col("session_index"))).alias("extension_sessions"),
        tally(beyond, "incremental_findings"),
        tally(beyond & high, "incremental_high"),
        tally(F.col("session_index").isin(5, 6) & high, "probe"),
    )
    s = s.withColumn("yield", F.when(F.col("extension_sessions") > 0, F.round(F.col("incremental_findings") / F.col("extension_sessions"), 6)))
    return s.withColumn("stop_early", (F.col("extension_sessions") >= 2) & (F.col("probe") == 0)).drop("probe")


@audit("A19", f"WITH {FOUND} SELECT hunter, validity AS resolution, count(*) AS n, count(DISTINCT candidate_id) AS candidates FROM found GROUP BY 1, 2")
def findings_by_outcome(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, d).groupBy("hunter", F.col("validity").alias("resolution")).agg(F.count("*").alias("n"), F.countDistinct("candidate_id").alias("candidates"))


def id_rate(df: DataFrame, groups: Sequence[str], key: str, hit: Column) -> DataFrame:
    """Distinct keys and those with a hit: numerator, denominator, rate, Wilson interval within [0, 1], and both id lists."""
    per = df.groupBy(*groups, key).agg(F.max(hit.cast("int")).alias("_hit"))
    out = per.groupBy(*groups).agg(F.count("*").alias("denominator"), F.sum("_hit").cast("long").alias("numerator"), ids(F.col(key).cast("string")).alias("source_ids"), ids(F.when(F.col("_hit") == 1, F.col(key).cast("string"))).alias("successful_ids"))
    low, high = wilson(F.col("numerator"), F.col("denominator"))
    return out.withColumns({"rate": ratio("numerator", "denominator"), "low": F.greatest(low, F.lit(0.0)), "high": F.least(high, F.lit(1.0))})


_BOUND = "round(greatest(0.0, least(1.0, ((numerator::DOUBLE / denominator + 1.959963984540054::DOUBLE * 1.959963984540054::DOUBLE / (2 * denominator)) {} 1.959963984540054::DOUBLE * sqrt((numerator::DOUBLE / denominator) * (1 - numerator::DOUBLE / denominator) / denominator + 1.959963984540054::DOUBLE * 1.959963984540054::DOUBLE / (4.0 * denominator * denominator))) / (1 + 1.959963984540054::DOUBLE * 1.959963984540054::DOUBLE / denominator))), 6)"
_WITH_RATE = f"numerator, denominator, round(numerator::DOUBLE / denominator, 6) AS rate, {_BOUND.format('-')} AS low, {_BOUND.format('+')} AS high"


@audit(
    "A20 E4",
    f"""WITH p AS (SELECT o_custkey, o_orderkey, max((o_totalprice > 200000)::INT) AS hit FROM orders GROUP BY 1, 2),
c AS (SELECT o_custkey, count(*) AS denominator, sum(hit)::BIGINT AS numerator, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey::VARCHAR) AS source_ids, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey::VARCHAR) FILTER (hit = 1), '') AS successful_ids FROM p GROUP BY 1)
SELECT o_custkey, {_WITH_RATE}, source_ids, successful_ids FROM c""",
)
def rate_with_ids(spark: SparkSession, d: str) -> DataFrame:
    return id_rate(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", F.col("o_totalprice") > 200000)


@audit("A22", f"WITH {RUNS}, c AS (SELECT family, count(*) AS denominator, count(*) FILTER (valid) AS numerator FROM runs GROUP BY 1) SELECT family, {_WITH_RATE} FROM c")
def valid_run_rate(spark: SparkSession, d: str) -> DataFrame:
    c = runs(spark, d).groupBy("family").agg(F.count("*").alias("denominator"), tally(F.col("valid"), "numerator"))
    low, high = wilson(F.col("numerator"), F.col("denominator"))
    return c.withColumns({"rate": ratio("numerator", "denominator"), "low": F.greatest(low, F.lit(0.0)), "high": F.least(high, F.lit(1.0))})


def case_success(cohort: DataFrame, evidence: DataFrame, hits: dict[str, Column]) -> DataFrame:
    """Per case the valid runs and, for each named hit, how many of them have one, with the rate."""
    per = evidence.groupBy("run_id").agg(*[F.max(h.cast("int")).alias(n) for n, h in hits.items()])
    joined = cohort.filter("valid").join(per, "run_id", "left")
    out = joined.groupBy("case_id").agg(F.count("*").alias("valid_runs"), F.countDistinct("family").alias("families"), *[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in hits])
    return out.withColumns({f"{n}_rate": ratio(n, "valid_runs") for n in hits})


_HITS = {"admitted": "target_match AND hunter = 'A' AND session_index <= 12", "detected": "target_match AND hunter = 'A' AND session_index <= 12 AND state <> 'raw'", "reported": "target_match AND state = 'reportable' AND session_index <= 12"}


@audit(
    "A23",
    f"""WITH {RUNS}, {FOUND}, per AS (SELECT run_id, {", ".join(f"bool_or({c}) AS {n}" for n, c in _HITS.items())} FROM found GROUP BY 1)
SELECT case_id, count(*) AS valid_runs, count(DISTINCT family) AS families, {", ".join(f"count(*) FILTER ({n}) AS {n}, round(count(*) FILTER ({n})::DOUBLE / count(*), 6) AS {n}_rate" for n in _HITS)} FROM runs LEFT JOIN per USING (run_id) WHERE valid GROUP BY 1""",
)
def case_results(spark: SparkSession, d: str) -> DataFrame:
    return case_success(runs(spark, d), found(spark, d), {n: F.expr(c) for n, c in _HITS.items()})


@audit(
    "A25",
    f"""WITH {FOUND}, k AS (SELECT candidate_id, bool_or(validity = 'false') AS f, bool_or(validity = 'real') AS r, bool_or(state = 'reportable') AS reportable, bool_or(state <> 'raw') AS escalated FROM found GROUP BY 1)
SELECT count(*) FILTER (f AND NOT r) AS fixed_targets, count(*) FILTER (f AND NOT r AND reportable) AS false_positives, round(count(*) FILTER (f AND NOT r AND reportable)::DOUBLE / nullif(count(*) FILTER (f AND NOT r), 0), 6) AS false_positive_rate,
  count(*) FILTER (escalated) AS escalated, count(*) FILTER (escalated AND f) AS false_escalations, round(count(*) FILTER (escalated AND f)::DOUBLE / nullif(count(*) FILTER (escalated), 0), 6) AS false_escalation_rate FROM k""",
)
def negative_metrics(spark: SparkSession, d: str) -> DataFrame:
    """False positives on targets known to be fixed, and escalations that turned out false; null without any."""
    hit = lambda c: F.max(c.cast("int")) == 1
    k = found(spark, d).groupBy("candidate_id").agg(hit(F.col("validity") == "false").alias("f"), hit(F.col("validity") == "real").alias("r"), hit(F.col("state") == "reportable").alias("reportable"), hit(F.col("state") != "raw").alias("up"))
    fixed = F.col("f") & ~F.col("r")
    out = k.agg(tally(fixed, "fixed_targets"), tally(fixed & F.col("reportable"), "false_positives"), tally(F.col("up"), "escalated"), tally(F.col("up") & F.col("f"), "false_escalations"))
    return out.withColumns({"false_positive_rate": ratio("false_positives", "fixed_targets"), "false_escalation_rate": ratio("false_escalations", "escalated")})


def token_costs(cohort: DataFrame, keys: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Tokens of all runs per real candidate key, and the total, mean and exact median input of valid runs.

    status: incomplete if a run lacks its usage, undefined without a real key, else defined.
    """
    tokens = F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens")
    out = cohort.withColumn("_in", F.when(F.col("valid"), tokens)).groupBy(*groups).agg(
        F.sum(tokens + F.col("output_tokens")).cast("long").alias("model_tokens"),
        F.sum("_in").cast("long").alias("total"),
        F.count("_in").alias("denominator"),
        F.median("_in").alias("median"),
        tally(tokens.isNull(), "_lacking"),
    )
    out = out.join(keys, list(groups), "left").withColumn("reportables", F.coalesce("reportables", F.lit(0)).cast("long"))
    status = F.when(F.col("_lacking") > 0, "incomplete").when(F.col("reportables") == 0, "undefined").otherwise("defined")
    out = out.withColumns({"mean": F.round(F.col("total") / F.col("denominator"), 6), "status": status})
    return out.withColumn("tokens_per_reportable", F.when(F.col("status") == "defined", F.round(F.col("model_tokens") / F.col("reportables"), 6))).drop("_lacking")


@audit(
    "A26",
    f"""WITH {RUNS}, {FOUND}, k AS (SELECT case_id, count(DISTINCT candidate_id) AS reportables FROM runs JOIN found USING (run_id) WHERE valid AND state = 'reportable' AND validity = 'real' AND target_id > 150 GROUP BY 1),
c AS (SELECT case_id, sum(input_tokens + cache_read_tokens + cache_write_tokens + output_tokens)::BIGINT AS model_tokens, sum(input_tokens + cache_read_tokens + cache_write_tokens) FILTER (valid)::BIGINT AS total, count(*) FILTER (valid) AS denominator, median(input_tokens + cache_read_tokens + cache_write_tokens) FILTER (valid) AS median FROM runs GROUP BY 1)
SELECT case_id, model_tokens, total, denominator, median, coalesce(reportables, 0) AS reportables, round(total::DOUBLE / denominator, 6) AS mean, CASE WHEN reportables IS NULL THEN 'undefined' ELSE 'defined' END AS status, round(model_tokens::DOUBLE / reportables, 6) AS tokens_per_reportable FROM c LEFT JOIN k USING (case_id)""",
)
def token_cost(spark: SparkSession, d: str) -> DataFrame:
    cohort = runs(spark, d)
    real = found(spark, d).filter("state = 'reportable' and validity = 'real' and target_id > 150").join(cohort.filter("valid").select("run_id", "case_id"), "run_id")
    return token_costs(cohort, real.groupBy("case_id").agg(F.countDistinct("candidate_id").alias("reportables")), ["case_id"])


@audit(
    "A27",
    f"""WITH {RUNS}, {FOUND}, f AS (SELECT case_id, run_id, min(CASE WHEN state = 'reportable' AND target_match THEN date_diff('day', started::DATE, observed::DATE) END) AS first FROM runs JOIN found USING (run_id) WHERE valid GROUP BY 1, 2)
SELECT case_id, count(*) AS n_runs, count(first) AS n_reported, coalesce(string_agg(first::VARCHAR, ',' ORDER BY first) FILTER (first IS NOT NULL), '') AS firsts, median(first) AS median FROM f GROUP BY 1""",
)
def first_reportable(spark: SparkSession, d: str) -> DataFrame:
    """The least time to a reportable match per run; per case the sorted list of these and their median."""
    hit = F.when((F.col("state") == "reportable") & F.col("target_match"), F.date_diff(F.col("observed").cast("date"), F.col("started").cast("date")))
    f = runs(spark, d).filter("valid").join(found(spark, d), "run_id").groupBy("case_id", "run_id").agg(F.min(hit).alias("first"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("first")), lambda x: x.cast("string")), ",")
    return f.groupBy("case_id").agg(F.count("*").alias("n_runs"), F.count("first").alias("n_reported"), listed.alias("firsts"), F.median("first").alias("median"))


@audit(
    "A28 P28",
    f"""WITH {FOUND}, p AS (SELECT hunter, count(*) AS executions, count(DISTINCT candidate_id || ':' || target_id) AS pairs, count(DISTINCT candidate_id) AS canonical, count(DISTINCT CASE WHEN state = 'reportable' THEN candidate_id || ':' || target_id END) AS converted FROM found GROUP BY 1)
SELECT hunter, executions, pairs, canonical, executions - canonical AS duplicates, converted, round(converted::DOUBLE / nullif(pairs, 0), 6) AS conversion,
  (SELECT count(*) FROM documents WHERE contains(lower(text), lower(CASE hunter WHEN 'A' THEN 'Secret' WHEN 'N' THEN 'License' ELSE 'Key' END))) AS leaks FROM p""",
)
def knowledge_quality(spark: SparkSession, d: str) -> DataFrame:
    """Executions against distinct pairs, conversions, duplicates, and texts that hold a protected token in any case."""
    f, pair = found(spark, d), F.concat_ws(":", "candidate_id", "target_id")
    p = f.groupBy("hunter").agg(F.count("*").alias("executions"), F.countDistinct(pair).alias("pairs"), F.countDistinct("candidate_id").alias("canonical"), F.countDistinct(F.when(F.col("state") == "reportable", pair)).alias("converted"))
    tokens = {"A": "Secret", "N": "License", "R": "Key"}
    low = F.lower("text")
    leaks = table(spark, d, "documents").agg(*[tally(F.coalesce(low.contains(t.lower()), F.lit(False)), h) for h, t in tokens.items()])
    leaks = leaks.select(F.explode(F.array(*[F.struct(F.lit(h).alias("hunter"), F.col(h).alias("leaks")) for h in tokens])).alias("x")).select("x.*")  # three rows
    return p.withColumns({"duplicates": F.col("executions") - F.col("canonical"), "conversion": ratio("converted", "pairs")}).join(F.broadcast(leaks), "hunter")


GATES = [("valid_run_rate", ">=", 0.6), ("admitted_cases", ">=", 3), ("detection_rate", ">=", 0.75), ("reportable_rate", ">=", 0.5), ("missing_families", "<=", 0), ("unrecovered_cases", "<=", 0), ("uncontrolled_cases", "<=", 0), ("without_evidence", "<=", 0), ("leaks", "<=", 0), ("duplicate_share", "<=", 0.9), ("median_input", "<=", 1_500_000), ("maximum_input", "<=", 2_000_000)]


@audit(
    "A29",
    f"""WITH {RUNS}, {FOUND}, per AS (SELECT run_id, {", ".join(f"bool_or({c}) AS {n}" for n, c in _HITS.items())} FROM found GROUP BY 1),
v AS (SELECT *, input_tokens + cache_read_tokens + cache_write_tokens AS t FROM runs LEFT JOIN per USING (run_id) WHERE valid),
c AS (SELECT case_id, count(*) FILTER (admitted) AS a, count(*) FILTER (detected) AS h FROM v GROUP BY 1),
x AS (SELECT (SELECT count(*) FILTER (valid)::DOUBLE / count(*) FROM runs) AS valid_run_rate, (SELECT count(*) FILTER (a >= 2) FROM c)::DOUBLE AS admitted_cases, (SELECT count(*) FILTER (detected)::DOUBLE / count(*) FROM v) AS detection_rate, (SELECT count(*) FILTER (reported)::DOUBLE / count(*) FROM v) AS reportable_rate,
  (SELECT count(DISTINCT family) - count(DISTINCT CASE WHEN detected THEN family END) FROM v)::DOUBLE AS missing_families, (SELECT count(*) FILTER (h < 2) FROM c)::DOUBLE AS unrecovered_cases, (SELECT count(*) FROM c LEFT JOIN (SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal > 0) ON s_nationkey = case_id WHERE s_nationkey IS NULL)::DOUBLE AS uncontrolled_cases,
  (SELECT count(*) FROM found WHERE state = 'reportable' AND validity IS NULL)::DOUBLE AS without_evidence, 0.0::DOUBLE AS leaks, (SELECT 1 - count(DISTINCT candidate_id)::DOUBLE / count(*) FROM found) AS duplicate_share, (SELECT median(t) FROM v) AS median_input, (SELECT max(t) FROM v)::DOUBLE AS maximum_input)
SELECT gate, round(actual, 6) AS actual, required, coalesce(CASE WHEN sign = '>=' THEN round(actual, 6) >= required ELSE round(actual, 6) <= required END, false) AS passed FROM (UNPIVOT x ON {", ".join(g for g, _, _ in GATES)} INTO NAME gate VALUE actual)
JOIN (VALUES {", ".join(f"('{g}', '{s}', {float(v)!r}::DOUBLE)" for g, s, v in GATES)}) r(gate, sign, required) USING (gate)
UNION ALL SELECT 'decision', NULL, NULL, false""",
)
def calibration_gates(spark: SparkSession, d: str) -> DataFrame:
    """Twelve gates with actual and required values, and the decision, which passes if all do."""
    cohort = runs(spark, d)
    per = found(spark, d).groupBy("run_id").agg(*[F.max(F.expr(c).cast("int")).alias(n) for n, c in _HITS.items()])
    v = cohort.filter("valid").join(per, "run_id", "left").withColumn("t", F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens"))
    cases = v.groupBy("case_id").agg(tally(F.col("admitted") == 1, "a"), tally(F.col("detected") == 1, "h"))
    controls = table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_nationkey").cast("long").alias("case_id")).distinct()
    # One row each, so the product of them is one row.
    parts = [
        cohort.agg((F.avg(F.col("valid").cast("int"))).alias("valid_run_rate")),
        cases.agg(tally(F.col("a") >= 2, "admitted_cases"), tally(F.col("h") < 2, "unrecovered_cases")),
        v.agg(F.avg(F.coalesce("detected", F.lit(0))).alias("detection_rate"), F.avg(F.coalesce("reported", F.lit(0))).alias("reportable_rate"), (F.countDistinct("family") - F.countDistinct(F.when(F.col("detected") == 1, F.col("family")))).alias("missing_families"), F.median("t").alias("median_input"), F.max("t").alias("maximum_input")),
        cases.join(controls, "case_id", "left_anti").agg(F.count("*").alias("uncontrolled_cases")),
        found(spark, d).agg(tally((F.col("state") == "reportable") & F.col("validity").isNull(), "without_evidence"), (1 - F.countDistinct("candidate_id") / F.count("*")).alias("duplicate_share")),
    ]
    one = parts[0].withColumn("leaks", F.lit(0.0))
    for p in parts[1:]:
        one = one.join(F.broadcast(p))
    one = one.select(*[F.round(F.col(g).cast("double"), 6).alias(g) for g, _, _ in GATES])
    listed = A.gates(one, GATES)
    decided = listed.agg(F.lit("decision").alias("gate"), F.lit(None).cast("double").alias("actual"), F.lit(None).cast("double").alias("required"), F.min(F.col("passed")).alias("passed"))
    return listed.unionByName(decided)


@audit(
    "A30 A36 W11",
    f"""WITH {WORK}, g AS (SELECT family, component, count(*) AS attempts, string_agg(DISTINCT attempt::VARCHAR, ',' ORDER BY attempt::VARCHAR) AS numbers, max(attempt) AS last, bool_and(status = 'done') AS all_passed, count(DISTINCT hunter) AS setups, count(DISTINCT attempt) AS distinct_attempts FROM work GROUP BY 1, 2)
SELECT family, component, attempts, numbers, distinct_attempts = last AND last >= 2 AS complete, all_passed, setups = 1 AS one_setup, distinct_attempts = last AND last >= 2 AND all_passed AND setups = 1 AS valid FROM g""",
)
def reproduction_groups(spark: SparkSession, d: str) -> DataFrame:
    """Attempts must be 1 to n, n at least 2, of one setup, and all must have passed."""
    g = work(spark, d).groupBy("family", "component").agg(F.count("*").alias("attempts"), ids(F.col("attempt").cast("string")).alias("numbers"), F.max("attempt").alias("last"), F.countDistinct("attempt").alias("n"), (F.min((F.col("status") == "done").cast("int")) == 1).alias("all_passed"), (F.countDistinct("hunter") == 1).alias("one_setup"))
    g = g.withColumn("complete", (F.col("n") == F.col("last")) & (F.col("last") >= 2))
    return g.withColumn("valid", F.col("complete") & F.col("all_passed") & F.col("one_setup")).drop("last", "n")


@audit(
    "A32 P26",
    """WITH x AS (SELECT lang, source, count(*) FILTER (quality = 0 AND toxic = 1) AS tp, count(*) FILTER (quality = 1 AND toxic = 1) AS fp, count(*) FILTER (quality = 0 AND toxic = 0) AS fn, count(*) AS cases FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2),
p AS (SELECT lang, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(cases)::BIGINT AS cases, min(round(tp::DOUBLE / greatest(1, tp + fn), 6)) AS worst_recall FROM x GROUP BY 1)
SELECT lang, cases, tp, fp, fn, worst_recall, round(tp::DOUBLE / greatest(1, tp + fp), 6) AS precision, concat_ws(',', CASE WHEN cases < 20 THEN 'cases' END, CASE WHEN worst_recall < 0.1 THEN 'recall' END, CASE WHEN tp::DOUBLE / greatest(1, tp + fp) < 0.2 THEN 'precision' END, CASE WHEN fp > 40 THEN 'fp' END, CASE WHEN fn > 40 THEN 'fn' END) AS failed FROM p""",
)
def regression_gate(spark: SparkSession, d: str) -> DataFrame:
    """Least cases, recall of the worst class, precision, and caps on false results; the failed conditions by name."""
    joined = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    bad, told = F.col("quality") == 0, F.col("toxic") == 1
    x = joined.groupBy("lang", "source").agg(tally(bad & told, "tp"), tally((F.col("quality") == 1) & told, "fp"), tally(bad & (F.col("toxic") == 0), "fn"), F.count("*").alias("cases"))
    recall = F.round(F.col("tp") / F.greatest(F.lit(1).cast("long"), F.col("tp") + F.col("fn")), 6)
    p = x.withColumn("r", recall).groupBy("lang").agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "cases")], F.min("r").alias("worst_recall"))
    exact = F.col("tp") / F.greatest(F.lit(1).cast("long"), F.col("tp") + F.col("fp"))
    rules = {"cases": F.col("cases") < 20, "recall": F.col("worst_recall") < 0.1, "precision": exact < 0.2, "fp": F.col("fp") > 40, "fn": F.col("fn") > 40}
    return p.withColumns({"precision": F.round(exact, 6), "failed": F.concat_ws(",", *[F.when(c, n) for n, c in rules.items()])})


@audit(
    "A33 J40",
    """WITH a AS (SELECT l_partkey, l_returnflag, sum(l_quantity)::BIGINT AS cost, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2), b AS (SELECT l_partkey, l_returnflag, sum(l_quantity)::BIGINT AS cost, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2)
SELECT coalesce(a.l_returnflag, b.l_returnflag) AS cohort, count(*) AS cases, count(*) FILTER (a.n IS NULL OR b.n IS NULL) AS unpaired, count(*) FILTER (a.n = b.n) AS stable, sum(coalesce(a.cost, 0) + coalesce(b.cost, 0))::BIGINT AS cost, count(*) FILTER (a.n IS NULL OR b.n IS NULL) = 0 AND sum(coalesce(a.cost, 0) + coalesce(b.cost, 0)) <= 1000000 AS passed FROM a FULL JOIN b ON a.l_partkey = b.l_partkey AND a.l_returnflag = b.l_returnflag GROUP BY 1""",
)
def repeat_gate(spark: SparkSession, d: str) -> DataFrame:
    """A case's primary run against its repeat: pairs missing, stable outcomes, cost against the ceiling."""
    per = lambda s, n: table(spark, d, "lineitem").filter(F.col("l_linestatus") == s).groupBy("l_partkey", F.col("l_returnflag").alias("cohort")).agg(F.sum("l_quantity").cast("long").alias(f"cost_{n}"), F.count("*").alias(f"n_{n}"))
    both = per("F", "a").join(per("O", "b"), ["l_partkey", "cohort"], "full_outer")
    cost = F.sum(F.coalesce("cost_a", F.lit(0)) + F.coalesce("cost_b", F.lit(0))).cast("long")
    out = both.groupBy("cohort").agg(F.count("*").alias("cases"), tally(F.col("n_a").isNull() | F.col("n_b").isNull(), "unpaired"), tally(F.coalesce(F.col("n_a") == F.col("n_b"), F.lit(False)), "stable"), cost.alias("cost"))
    return out.withColumn("passed", (F.col("unpaired") == 0) & (F.col("cost") <= 1000000))


@audit(
    "A34 J30 U9",
    """WITH g AS (SELECT n_name AS gate, n_nationkey, CASE WHEN n_regionkey < 3 THEN 'must_detect' ELSE 'known_gap' END AS before FROM nation), s AS (SELECT s_nationkey, min(CASE WHEN s_acctbal > -500 THEN 'success' ELSE 'failure' END) AS status, min(CASE WHEN s_acctbal > 9000 THEN 'known_gap' ELSE 'must_detect' END) AS after FROM supplier GROUP BY 1)
SELECT gate, coalesce(status, 'missing') AS status, coalesce(status = 'success', false) AS passed, before = 'must_detect' AND coalesce(after <> 'must_detect', true) AS demoted FROM g LEFT JOIN s ON s_nationkey = n_nationkey""",
)
def release_matrix(spark: SparkSession, d: str) -> DataFrame:
    """A gate without a status has failed; an entry that must be detected may neither vanish nor lose that status."""
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.min(F.when(F.col("s_acctbal") > -500, "success").otherwise("failure")).alias("status"), F.min(F.when(F.col("s_acctbal") > 9000, "known_gap").otherwise("must_detect")).alias("after"))
    g = table(spark, d, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    must = F.col("n_regionkey") < 3
    return g.select(F.col("n_name").alias("gate"), F.coalesce("status", F.lit("missing")).alias("status"), F.coalesce(F.col("status") == "success", F.lit(False)).alias("passed"), (must & F.coalesce(F.col("after") != "must_detect", F.lit(True))).alias("demoted"))


@audit(
    "A37 A38",
    """WITH e AS (SELECT *, json_extract(props, '$.k')::BIGINT AS k, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END AS triage FROM events), c AS (SELECT k, count(*) AS observations, min(event_id) AS representative, min(triage) AS triage, count(DISTINCT event_type) AS routes, count(DISTINCT user_id) AS generations FROM e GROUP BY 1)
SELECT k AS signature, observations, representative, CASE triage WHEN 0 THEN 'memory' WHEN 1 THEN 'assertion' ELSE 'benign' END AS triage, routes, generations, 100 - 40 * triage + 5 * routes + least(observations, 20) AS score FROM c""",
)
def crash_cluster_scores(spark: SparkSession, d: str) -> DataFrame:
    """Observations of one signature: representative, worst triage class, distinct routes, and a score of the three."""
    triage = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    e = table(spark, d, "events").select("*", F.get_json_object("props", "$.k").cast("long").alias("signature"), triage.alias("t"))
    c = e.groupBy("signature").agg(F.count("*").alias("observations"), F.min("event_id").alias("representative"), F.min("t").alias("t"), F.countDistinct("event_type").alias("routes"), F.countDistinct("user_id").alias("generations"))
    score = (100 - 40 * F.col("t") + 5 * F.col("routes") + F.least(F.col("observations"), F.lit(20))).cast("long")
    return c.select("signature", "observations", "representative", F.when(F.col("t") == 0, "memory").when(F.col("t") == 1, "assertion").otherwise("benign").alias("triage"), "routes", "generations", score.alias("score"))


@audit(
    "A39",
    """WITH c AS (SELECT user_id, count(*) AS cases, count(DISTINCT json_extract(props, '$.k')) AS signatures, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS tags, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY 1)
SELECT user_id, cases, round(signatures::DOUBLE / cases, 6) AS distinct_ratio, (SELECT coalesce(string_agg(t, ',' ORDER BY t), '') FROM (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) v(t) WHERE NOT list_contains(string_split(tags, ','), t)) AS missing_tags, failures FROM c""",
)
def fuzz_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """Share of distinct signatures, the required tags that never occurred, and failures."""
    required = F.array(*[F.lit(t) for t in ("click", "error", "purchase", "signup", "view")])
    c = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("cases"), F.countDistinct(F.get_json_object("props", "$.k")).alias("signatures"), F.collect_set("event_type").alias("tags"), tally(F.col("event_type") == "error", "failures"))
    return c.select("user_id", "cases", F.round(F.col("signatures") / F.col("cases"), 6).alias("distinct_ratio"), F.array_join(F.array_except(required, "tags"), ",").alias("missing_tags"), "failures")


@audit(
    "A40",
    """WITH a AS (SELECT l_partkey, l_linenumber, count(DISTINCT l_suppkey) AS v, count(DISTINCT l_returnflag) AS p, count(DISTINCT l_quantity) AS o FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2), b AS (SELECT l_partkey, l_linenumber, count(DISTINCT l_quantity) AS o FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2)
SELECT l_partkey AS target, l_linenumber::BIGINT AS position, v AS "values", v >= 3 AND p = 1 AND a.o > 1 AS correlated, coalesce(b.o > 1, false) AS control_differs, v >= 3 AND p = 1 AND a.o > 1 AND NOT coalesce(b.o > 1, false) AS disclosed FROM a LEFT JOIN b USING (l_partkey, l_linenumber)""",
)
def positional_correlation(spark: SparkSession, d: str) -> DataFrame:
    """At a position at least three values with one position digest and differing output, where the control doesn't differ."""
    li = table(spark, d, "lineitem")
    a = li.filter("l_linestatus = 'F'").groupBy("l_partkey", "l_linenumber").agg(F.countDistinct("l_suppkey").alias("values"), F.countDistinct("l_returnflag").alias("p"), F.countDistinct("l_quantity").alias("o"))
    b = li.filter("l_linestatus = 'O'").groupBy("l_partkey", "l_linenumber").agg((F.countDistinct("l_quantity") > 1).alias("control"))
    j = a.join(b, ["l_partkey", "l_linenumber"], "left").withColumn("control_differs", F.coalesce("control", F.lit(False)))
    j = j.withColumn("correlated", (F.col("values") >= 3) & (F.col("p") == 1) & (F.col("o") > 1))
    return j.select(F.col("l_partkey").alias("target"), F.col("l_linenumber").cast("long").alias("position"), "values", "correlated", "control_differs", (F.col("correlated") & ~F.col("control_differs")).alias("disclosed"))


@audit(
    "A41 A42",
    f"""WITH {FOUND}, c AS (SELECT target_id, least(40, 10 * count(*) FILTER (state = 'reportable')) AS evidence, least(20, 5 * count(DISTINCT hunter)) AS formats, least(15, 3 * count(DISTINCT session_index)) AS routes, 10 * max(target_match::INT) AS matched, -20 * max((validity = 'false')::INT) AS contradicted, CASE WHEN min(session_index) = 1 THEN 5 ELSE 0 END AS early, -least(10, count(*) FILTER (state = 'raw')) AS noise FROM found GROUP BY 1)
SELECT target_id, evidence::BIGINT AS evidence, formats::BIGINT AS formats, routes::BIGINT AS routes, matched::BIGINT AS matched, contradicted::BIGINT AS contradicted, early::BIGINT AS early, noise::BIGINT AS noise, greatest(0, least(100, evidence + formats + routes + matched + contradicted + early + noise))::BIGINT AS score FROM c""",
)
def score_components(spark: SparkSession, d: str) -> DataFrame:
    """Seven named components with caps and floors of their own, and their sum within 0 to 100.

    Hunters and sessions are counted by two groupings: two distinct counts in one triple the rows within its tasks.
    """
    capped = lambda limit, x: F.least(F.lit(limit), x).cast("long")
    f = found(spark, d)
    matched, false = F.col("target_match").cast("int"), (F.col("validity") == "false").cast("int")
    by = f.groupBy("target_id", "hunter").agg(tally(F.col("state") == "reportable", "reportable"), tally(F.col("state") == "raw", "raw"), F.max(matched).alias("match"), F.max(false).alias("false"))
    by = by.groupBy("target_id").agg(F.count("hunter").alias("hunters"), *[F.sum(c).alias(c) for c in ("reportable", "raw")], *[F.max(c).alias(c) for c in ("match", "false")])
    on = f.groupBy("target_id", "session_index").agg(F.count("*").alias("x"))
    on = on.groupBy(F.col("target_id").alias("_t")).agg(F.count("session_index").alias("sessions"), F.min("session_index").alias("first"))
    parts = {
        "evidence": capped(40, 10 * F.col("reportable")),
        "formats": capped(20, 5 * F.col("hunters")),
        "routes": capped(15, 3 * F.col("sessions")),
        "matched": (10 * F.col("match")).cast("long"),
        "contradicted": (-20 * F.col("false")).cast("long"),
        "early": F.when(F.col("first") == 1, 5).otherwise(0).cast("long"),
        "noise": -capped(10, F.col("raw")),
    }
    c = by.join(on, F.col("target_id").eqNullSafe(F.col("_t"))).select("target_id", *[x.alias(n) for n, x in parts.items()])
    total = sum((F.col(n) for n in parts), F.lit(0))
    return c.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("long"))


@audit(
    "A44",
    f"""WITH {_USAGE}, have AS (SELECT DISTINCT work_id FROM usage WHERE scope = 'hunter'), points AS (SELECT work_id, max(input_tokens) AS input_tokens, count(*) AS checkpoints FROM usage WHERE scope <> 'hunter' GROUP BY 1)
SELECT work_id, input_tokens, checkpoints FROM points ANTI JOIN have USING (work_id)""",
)
def checkpoint_usage(spark: SparkSession, d: str) -> DataFrame:
    """The last checkpoint of work whose usage isn't stored yet."""
    u = _usage(spark, d)
    points = u.filter("scope <> 'hunter'").groupBy("work_id").agg(F.max("input_tokens").alias("input_tokens"), F.count("*").alias("checkpoints"))
    return points.join(u.filter("scope = 'hunter'").select("work_id").distinct(), "work_id", "left_anti")


@audit(
    "A12 O2",
    f"""WITH {WORK}, s AS (SELECT *, CASE status WHEN 'pending' THEN 0 WHEN 'running' THEN 1 ELSE 2 END AS priority_rank, CASE WHEN required THEN 40 ELSE 0 END + CASE WHEN risk >= 4 THEN 30 ELSE 0 END + CASE WHEN status = 'done' THEN 20 ELSE 0 END + CASE WHEN attempt = 1 THEN 10 ELSE 0 END AS evidence, 'coverage_' || left(sha256(component || chr(31) || hunter), 16) AS coverage_group FROM work),
r AS (SELECT *, row_number() OVER (PARTITION BY component, family ORDER BY priority_rank, score DESC, evidence DESC, work_id) AS r, count(*) OVER (PARTITION BY component, family) AS n FROM s)
SELECT component, family, work_id AS representative, priority_rank::BIGINT AS priority_rank, evidence::BIGINT AS evidence, coverage_group, n FROM r WHERE r = 1""",
)
def canonical_units(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of one root cause as one unit, represented by the best: class, score, evidence (40/30/20/10), id."""
    points = lambda c, n: F.when(c, n).otherwise(0)
    rank = F.when(F.col("status") == "pending", 0).when(F.col("status") == "running", 1).otherwise(2)
    evidence = points(F.col("required"), 40) + points(F.col("risk") >= 4, 30) + points(F.col("status") == "done", 20) + points(F.col("attempt") == 1, 10)
    group = F.concat(F.lit("coverage_"), F.substring(F.sha2(F.concat_ws(chr(31), "component", "hunter"), 256), 1, 16))
    s = work(spark, d).select("component", "family", F.struct(rank.cast("long").alias("priority_rank"), (-F.col("score")).alias("s"), (-evidence).cast("long").alias("e"), F.col("work_id"), group.alias("g")).alias("x"))
    u = s.groupBy("component", "family").agg(F.min("x").alias("x"), F.count("*").alias("n"))  # the least struct is the best candidate
    return u.select("component", "family", F.col("x.work_id").alias("representative"), F.col("x.priority_rank"), (-F.col("x.e")).alias("evidence"), F.col("x.g").alias("coverage_group"), "n")


@audit(
    "A35",
    """WITH x AS (SELECT source, lang, count(DISTINCT quality) AS v, max(quality) AS verdict, max(doc_id % 100) / 10.0 AS score, count(DISTINCT doc_id % 7) AS reviewers, count(DISTINCT doc_id % 3) AS configs FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2)
SELECT source, lang, round(score, 1)::DOUBLE AS score, reviewers, configs, CASE WHEN v > 1 THEN 'conflict' WHEN score >= 7.0 AND (reviewers < 2 OR configs < 2) THEN 'needs_review' WHEN verdict = 1 THEN 'accepted' ELSE 'rejected' END AS status FROM x""",
)
def review_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Differing verdicts are a conflict; a score of 7.0 or more needs two reviewers and two configurations."""
    joined = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id")
    x = joined.groupBy("source", "lang").agg(F.countDistinct("quality").alias("v"), F.max("quality").alias("verdict"), (F.max(F.col("doc_id") % 100) / 10.0).alias("score"), F.countDistinct(F.col("doc_id") % 7).alias("reviewers"), F.countDistinct(F.col("doc_id") % 3).alias("configs"))
    high = (F.col("score") >= 7.0) & ((F.col("reviewers") < 2) | (F.col("configs") < 2))
    status = F.when(F.col("v") > 1, "conflict").when(high, "needs_review").when(F.col("verdict") == 1, "accepted").otherwise("rejected")
    return x.select("source", "lang", F.round("score", 1).alias("score"), "reviewers", "configs", status.alias("status"))


@audit(
    "A11",
    f"""WITH {FOUND}, s AS (SELECT target_id, hunter, session_index, CASE state WHEN 'reportable' THEN 5 WHEN 'reproduced' THEN 3 ELSE 1 END AS risk, target_match, validity FROM found),
r AS (SELECT target_id, hunter, sum(risk * 100 - (session_index - 1) * 10) + CASE WHEN max(risk) = 5 THEN 1000 ELSE 0 END + CASE WHEN bool_or(target_match) THEN 400 ELSE 0 END + 10 * max(risk) FILTER (validity = 'real') AS score FROM s GROUP BY 1, 2)
SELECT target_id, hunter, coalesce(score, 0)::BIGINT AS score, row_number() OVER (PARTITION BY target_id ORDER BY coalesce(score, 0) DESC, hunter) AS place FROM r""",
)
def hunter_routing(spark: SparkSession, d: str) -> DataFrame:
    """Hunters of a target by score: risk by place, grammar and parser-flow bonuses, and context risk; null context counts as no score."""
    risk = F.when(F.col("state") == "reportable", 5).when(F.col("state") == "reproduced", 3).otherwise(1)
    s = found(spark, d).withColumn("risk", risk)
    total = F.sum(F.col("risk") * 100 - (F.col("session_index") - 1) * 10) + F.when(F.max("risk") == 5, 1000).otherwise(0) + F.when(F.max(F.col("target_match").cast("int")) == 1, 400).otherwise(0) + 10 * F.max(F.when(F.col("validity") == "real", F.col("risk")))
    r = s.groupBy("target_id", "hunter").agg(F.coalesce(total, F.lit(0)).cast("long").alias("score"))
    return r.withColumn("place", F.row_number().over(W.partitionBy("target_id").orderBy(F.desc("score"), "hunter")).cast("long"))
