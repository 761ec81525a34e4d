"""Reports: canonical JSON, Markdown, SARIF, bundles, manifests, packets. Texts are built by expressions, a row a report."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.audits.metrics import ids, tally
from tracewright.audits.predicates import truncate_utf8
from tracewright.audits.registry import FOUND, WORK, audit, found, work
from tracewright.functions import scalars as S
from tracewright.operators import ranking as R
from tracewright.operators.aggregates import carried_sum, digest_tree
from tracewright.operators.fitting import DROP_CLASS, fit_responses
from tracewright.sources.tables import table

#: SARIF levels of severities.
LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "none": "none"}


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


_REPORT = f"""{FOUND}, {WORK}, f AS (SELECT run_id, count(*) AS evidence, max(session_index) AS sessions, max((state = 'reportable')::INT) AS reportable, string_agg(DISTINCT hunter, ',' ORDER BY hunter) AS reviewers, string_agg(DISTINCT validity, ',' ORDER BY validity) AS verdicts FROM found GROUP BY 1),
r AS (SELECT run_id, component, risk, evidence, sessions, reviewers, verdicts, CASE WHEN reportable = 1 AND risk = 5 THEN 'critical' WHEN reportable = 1 THEN 'high' WHEN risk >= 4 THEN 'medium' WHEN risk >= 2 THEN 'low' ELSE 'none' END AS severity FROM f JOIN work ON work_id = run_id),
j AS (SELECT *, '{{"schema_version":1,"run":{{"id":' || run_id || ',"component":"' || component || '"}},"finding":{{"severity":"' || severity || '","risk":' || risk || '}},"evidence":{{"count":' || evidence || ',"sessions":' || sessions || '}},"consensus":{{"reviewers":"' || reviewers || '","verdicts":"' || verdicts || '"}}}}' AS report FROM r)"""


def canonical_reports(spark: SparkSession, d: str) -> DataFrame:
    """run_id, component, risk, evidence, sessions, reviewers, verdicts, severity, report: one nested record a run."""
    f = found(spark, d).groupBy("run_id").agg(F.count("*").alias("evidence"), F.max("session_index").alias("sessions"), F.max((F.col("state") == "reportable").cast("int")).alias("reportable"), ids("hunter").alias("reviewers"), ids("validity").alias("verdicts"))
    r = f.join(work(spark, d).select(F.col("work_id").alias("run_id"), "component", "risk"), "run_id")
    severity = F.when((F.col("reportable") == 1) & (F.col("risk") == 5), "critical").when(F.col("reportable") == 1, "high").when(F.col("risk") >= 4, "medium").when(F.col("risk") >= 2, "low").otherwise("none")
    r = r.withColumn("severity", severity).drop("reportable")
    record = F.struct(
        F.lit(1).alias("schema_version"),
        F.struct(F.col("run_id").alias("id"), "component").alias("run"),
        F.struct("severity", "risk").alias("finding"),
        F.struct(F.col("evidence").alias("count"), "sessions").alias("evidence"),
        F.struct("reviewers", "verdicts").alias("consensus"),
    )
    return r.withColumn("report", F.to_json(record))


@audit("K10 K9", f"WITH {_REPORT} SELECT run_id, report, sha256(report) AS digest FROM j")
def canonical_report(spark: SparkSession, d: str) -> DataFrame:
    return canonical_reports(spark, d).select("run_id", "report", F.sha2("report", 256).alias("digest"))


_SARIF = """'{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"tracewright","rules":[{"id":"' || component || '"}]}},"results":[{"ruleId":"' || component || '","level":"' || CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' WHEN 'low' THEN 'note' ELSE 'none' END || '","message":{"text":"' || evidence || ' facts"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"src/' || run_id || '.c"},"region":{"startLine":' || sessions || '}}}]}]}]}'"""


@audit("K12", f"WITH {_REPORT} SELECT run_id, {_SARIF} AS sarif FROM j".replace("{_SARIF}", _SARIF))
def sarif_export(spark: SparkSession, d: str) -> DataFrame:
    """One rule, one result with its level by severity, one location."""
    level = F.coalesce(*[F.when(F.col("severity") == k, F.lit(v)) for k, v in LEVELS.items()])
    location = F.struct(F.struct(F.struct(text("src/", F.col("run_id"), ".c").alias("uri")).alias("artifactLocation"), F.struct(F.col("sessions").alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("component").alias("ruleId"), level.alias("level"), F.struct(text(F.col("evidence"), " facts").alias("text")).alias("message"), F.array(location).alias("locations"))
    driver = F.struct(F.lit("tracewright").alias("name"), F.array(F.struct(F.col("component").alias("id"))).alias("rules"))
    log = F.struct(F.lit("2.1.0").alias("version"), F.array(F.struct(F.struct(driver.alias("driver")).alias("tool"), F.array(result).alias("results"))).alias("runs"))
    return canonical_reports(spark, d).select("run_id", F.to_json(log).alias("sarif"))


_MARKDOWN = "'# ' || component || chr(10) || chr(10) || '- Severity: **' || severity || '**' || chr(10) || '- Evidence: ' || evidence || ' facts in ' || sessions || ' sessions' || chr(10) || '- Verdicts: ' || verdicts || chr(10)"


def markdown() -> Column:
    return text("# ", F.col("component"), "\n\n- Severity: **", F.col("severity"), "**\n- Evidence: ", F.col("evidence"), " facts in ", F.col("sessions"), " sessions\n- Verdicts: ", F.col("verdicts"), "\n")


@audit(
    "K11 K13 K18",
    f"""WITH {_REPORT}, b AS (SELECT run_id, severity, report, {_MARKDOWN} AS md, {_SARIF} AS sarif FROM j) SELECT run_id, CASE WHEN severity IN ('critical', 'high') THEN 'reports' ELSE 'quarantine' END AS folder, name, strlen(content) AS size, sha256(content) AS digest FROM (SELECT run_id, severity, unnest(['report.json', 'report.md', 'report.sarif', 'summary.txt']) AS name, unnest([report, md, sarif, severity]) AS content FROM b)""",
)
def report_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Four files a run with their digests; reports that no verdict supports are moved aside."""
    sarif = sarif_export(spark, d)
    b = canonical_reports(spark, d).withColumn("md", markdown()).join(sarif, "run_id")
    files = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("content")) for n, c in (("report.json", "report"), ("report.md", "md"), ("report.sarif", "sarif"), ("summary.txt", "severity"))])
    f = b.select("run_id", F.when(F.col("severity").isin("critical", "high"), "reports").otherwise("quarantine").alias("folder"), F.explode(files).alias("x"))
    return f.select("run_id", "folder", "x.name", F.octet_length("x.content").cast("long").alias("size"), F.sha2("x.content", 256).alias("digest"))


@audit(
    "K14 K15",
    f"""WITH {FOUND}, m AS (SELECT hunter AS metric, count(*) FILTER (state = 'reportable') AS numerator, count(*) AS denominator FROM found GROUP BY 1) SELECT metric, '| ' || metric || ' | ' || numerator || ' | ' || denominator || ' | ' || floor(100.0 * numerator / denominator)::BIGINT || ' % |' AS line, '{{"metric":"' || metric || '","denominator":' || denominator || ',"numerator":' || numerator || '}}' AS json, numerator * 5 >= denominator AS gate FROM m""",
)
def metrics_report(spark: SparkSession, d: str) -> DataFrame:
    m = found(spark, d).groupBy(F.col("hunter").alias("metric")).agg(tally(F.col("state") == "reportable", "numerator"), F.count("*").alias("denominator"))
    share = F.floor(100.0 * F.col("numerator") / F.col("denominator")).cast("long")
    line = text("| ", F.col("metric"), " | ", F.col("numerator"), " | ", F.col("denominator"), " | ", share, " % |")
    return m.select("metric", line.alias("line"), F.to_json(F.struct("metric", "denominator", "numerator")).alias("json"), (F.col("numerator") * 5 >= F.col("denominator")).alias("gate"))


@audit(
    "K16 S3 S4",
    """WITH r AS (SELECT source, lang, doc_id, n_chars, sha256(coalesce(text, '')) AS digest, sum(n_chars) OVER (PARTITION BY source, lang ORDER BY doc_id) AS running FROM documents),
a AS (SELECT source, lang, doc_id // 4096 AS i, sha256(string_agg(doc_id || ':' || digest, chr(10) ORDER BY doc_id)) AS e FROM r GROUP BY 1, 2, 3), b AS (SELECT source, lang, i // 4096 AS i, sha256(string_agg(e, chr(10) ORDER BY i)) AS e FROM a GROUP BY 1, 2, 3), t AS (SELECT source, lang, sha256(string_agg(e, chr(10) ORDER BY i)) AS root FROM b GROUP BY 1, 2)
SELECT source, lang, count(*) AS members, sum(n_chars)::BIGINT AS total, count(*) FILTER (running <= 100000 AND n_chars <= 20000) AS accepted, count(*) FILTER (n_chars > 20000) AS too_large, count(*) <= 500 AND sum(n_chars) <= 10000000 AS valid, root FROM (SELECT r.*, root FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source AND r.lang IS NOT DISTINCT FROM t.lang) GROUP BY source, lang, root""",
)
def snapshot_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Members in order with their digests, caps for a file, for the bytes up to it and for the whole, and the root of a
    tree of digests over the sorted entries; sums and digests go by ranges of ids, so that no task holds a manifest."""
    f = table(spark, d, "documents").select("source", "lang", "doc_id", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    keys = ["source", "lang"]
    roots = digest_tree(f, keys, "doc_id", F.concat_ws(":", F.col("doc_id").cast("string"), "digest"), "root").withColumnsRenamed({k: f"_{k}" for k in keys})
    r = carried_sum(f.drop("digest"), keys, "doc_id", "n_chars", "upto")
    out = r.groupBy(*keys).agg(F.count("*").alias("members"), F.sum("n_chars").cast("long").alias("total"), tally((F.col("upto") <= 100000) & (F.col("n_chars") <= 20000), "accepted"), tally(F.col("n_chars") > 20000, "too_large"))
    same = F.col("source").eqNullSafe(F.col("_source")) & F.col("lang").eqNullSafe(F.col("_lang"))
    return out.join(roots, same).drop("_source", "_lang").withColumn("valid", (F.col("members") <= 500) & (F.col("total") <= 10000000))


@audit(
    "K17",
    f"""WITH {WORK}, c AS (SELECT l_orderkey AS work_id, min(l_returnflag) AS policy, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) SELECT work.work_id, CASE WHEN c.work_id IS NULL THEN 'built' WHEN policy = 'A' AND n = attempt THEN 'cached' ELSE 'replaced' END AS outcome FROM work LEFT JOIN c USING (work_id)""",
)
def packet_cache(spark: SparkSession, d: str) -> DataFrame:
    """A cached packet counts only if snapshot, policy and digest match; else it is built again and replaces the old one."""
    c = table(spark, d, "lineitem").filter("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("work_id")).agg(F.min("l_returnflag").alias("policy"), F.count("*").alias("n"))
    outcome = F.when(F.col("n").isNull(), "built").when((F.col("policy") == "A") & (F.col("n") == F.col("attempt")), "cached").otherwise("replaced")
    return work(spark, d).join(c, "work_id", "left").select("work_id", outcome.alias("outcome"))


def fitted(parts: DataFrame, key: str, size: str, order: Sequence[str], most: int, least: int) -> DataFrame:
    """Each part's kept size: optional parts go in reverse order until a packet's sizes sum to most; the first part is
    protected, and is cut itself, but not below least, if it is too long alone. Folded as a stream of sorted rows."""
    schema = parts.schema.add("kept", "long")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, left = object(), 0
        for frame in batches:
            out = []
            for k, n in zip(frame[key], frame[size], strict=True):
                if k != last:
                    last, left = k, most
                    kept = max(min(int(n), left), min(int(n), least))
                else:
                    kept = int(n) if n <= left else 0
                left -= kept
                out.append(kept)
            yield frame.assign(kept=pd.Series(out, index=frame.index, dtype="int64"))

    return parts.repartition(key).sortWithinPartitions(key, *order).mapInPandas(fold, schema)


@audit(
    "O24 O22",
    """WITH RECURSIVE p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, strlen(coalesce(text, ''))::BIGINT AS size FROM conversations),
r AS (SELECT conv_id, turn, i, size, greatest(least(size, 900), least(size, 200)) AS kept, 900 - greatest(least(size, 900), least(size, 200)) AS room FROM p WHERE i = 1 UNION ALL SELECT p.conv_id, p.turn, p.i, p.size, CASE WHEN p.size <= room THEN p.size ELSE 0 END, room - CASE WHEN p.size <= room THEN p.size ELSE 0 END FROM r JOIN p ON p.conv_id = r.conv_id AND p.i = r.i + 1)
SELECT conv_id, turn, size, kept FROM r""",
)
def packet_fit(spark: SparkSession, d: str) -> DataFrame:
    """What of a packet fits into its bytes: the first excerpt is protected, later parts go whole or not at all."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    return fitted(c, "conv_id", "size", ["turn", "role", "text"], 900, 200).select("conv_id", "turn", "size", "kept")


def responses(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """A customer's orders as the functions of a response, their lines as instructions, calls and facts."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("response"), "o_orderpriority", "o_orderstatus")
    li = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    place = [F.col("l_orderkey").alias("fn"), F.col("l_partkey").alias("address"), F.col("l_linenumber").cast("long").alias("index")]
    kind = F.element_at(F.array(*[F.lit(k) for k in DROP_CLASS]), (1 + F.col("l_suppkey") % len(DROP_CLASS)).cast("int"))
    block = (F.col("l_linenumber") % 3).cast("string")
    return {
        "responses": o.groupBy("response").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("omissions")),
        "functions": o.select("response", F.col("o_orderkey").alias("fn"), F.repeat(F.concat("o_orderpriority", F.lit("é ")), (F.col("o_orderkey") % 9).cast("int")).alias("excerpt")),
        "instructions": li.select("response", *place, block.alias("block"), F.concat_ws(" ", "l_returnflag", F.lit("←"), F.col("l_quantity").cast("long").cast("string")).alias("text")).dropDuplicates(["response", "fn", "address", "index"]),
        "edges": li.filter("l_tax > 0.04").select("response", F.col("l_orderkey").alias("caller"), (F.col("l_partkey") - F.floor(F.col("l_discount") * 10)).cast("long").alias("address"), F.col("l_suppkey").alias("callee"), F.array(block, F.lit("1")).alias("guards")),
        "facts": li.filter("l_quantity > 10").select("response", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long"), F.col("l_extendedprice").cast("long")).alias("fact_id"), kind.alias("kind"), *place, ((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 44)).alias("protected")),
    }


@audit("O33", None)
def response_fit(spark: SparkSession, d: str) -> DataFrame:
    """Sizes are those of the JSON, byte by byte; the test removes and serialises again and again."""
    out = fit_responses(**responses(spark, d), maximum=3000)
    return out.select("response", "outcome", "dropped", F.octet_length("body").cast("long").alias("bytes"), F.sha2("body", 256).alias("digest"))


@audit(
    "O25",
    f"""WITH {FOUND}, s AS (SELECT run_id, hunter, count(*) AS facts, sum(target_id)::BIGINT AS bytes FROM found GROUP BY 1, 2), t AS (SELECT run_id, sum(bytes) AS total, count(*) AS shards FROM s GROUP BY 1) SELECT run_id, CASE WHEN total > 300 THEN hunter ELSE 'whole' END AS shard, sum(facts)::BIGINT AS facts, sum(bytes)::BIGINT AS bytes FROM s JOIN t USING (run_id) GROUP BY 1, 2""",
)
def packet_shards(spark: SparkSession, d: str) -> DataFrame:
    """A packet that loses evidence is split by what it is about; one that fits stays whole."""
    s = found(spark, d).groupBy("run_id", "hunter").agg(F.count("*").alias("facts"), F.sum("target_id").alias("bytes"))
    t = s.groupBy("run_id").agg(F.sum("bytes").alias("total"))
    shard = F.when(F.col("total") > 300, F.col("hunter")).otherwise("whole")
    return s.join(t, "run_id").groupBy("run_id", shard.alias("shard")).agg(F.sum("facts").cast("long").alias("facts"), F.sum("bytes").cast("long").alias("bytes"))


@audit(
    "C7 C9 C10",
    """WITH d AS (SELECT doc_id, quality, toxic, lang, CASE toxic WHEN 1 THEN 'AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H' ELSE 'AV:L/AC:H/PR:H/UI:R/S:U/C:L/I:N/A:N' END AS vector, CASE WHEN strlen(t) <= 40 THEN t ELSE left(t, 37) || '...' END AS excerpt FROM (SELECT *, regexp_replace(left(coalesce(text, ''), 60), '[^ -~]', '?', 'g') AS t FROM labels JOIN documents USING (doc_id)))
SELECT doc_id, vector, CASE toxic WHEN 1 THEN 9.8 ELSE 1.8 END::DOUBLE AS score, CASE toxic WHEN 1 THEN 'critical' ELSE 'low' END AS severity, excerpt, CASE WHEN quality = 0 AND toxic = 1 THEN 'confirmed' WHEN quality <> toxic THEN 'rejected' ELSE 'inconclusive' END AS verdict FROM d""",
)
def review_packets(spark: SparkSession, d: str) -> DataFrame:
    """A candidate with its excerpt, vector, score, severity and coordinated verdict."""
    toxic = F.col("toxic") == 1
    vector = F.when(toxic, "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H").otherwise("AV:L/AC:H/PR:H/UI:R/S:U/C:L/I:N/A:N")
    start = F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), 1, 60), "[^ -~]", "?")
    verdict = F.when((F.col("quality") == 0) & toxic, "confirmed").when(F.col("quality") != F.col("toxic"), "rejected").otherwise("inconclusive")
    joined = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").withColumn("vector", vector)
    return joined.select("doc_id", "vector", S.cvss_base(F.col("vector")).alias("score"), S.severity(S.cvss_base(F.col("vector"))).alias("severity"), truncate_utf8(start, 40).alias("excerpt"), verdict.alias("verdict"))


@audit(
    "C1 C14",
    f"""WITH {FOUND}, {WORK}, f AS (SELECT run_id, count(*) AS facts, count(DISTINCT target_id) AS targets, max(session_index) AS last FROM found GROUP BY 1), k AS (SELECT component, count(*) AS peers FROM work GROUP BY 1) SELECT work_id, '{{"work":' || work_id || ',"slices":' || coalesce(targets, 0) || ',"facts":' || coalesce(facts, 0) || ',"peers":' || peers || '}}' AS context FROM work LEFT JOIN f ON run_id = work_id JOIN k USING (component)""",
)
def work_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Slices, facts and peers of a work item as one nested record."""
    f = found(spark, d).groupBy(F.col("run_id").alias("work_id")).agg(F.count("*").alias("facts"), F.countDistinct("target_id").alias("targets"))
    w = work(spark, d)
    k = w.groupBy("component").agg(F.count("*").alias("peers"))
    zero = F.lit(0).cast("long")
    record = F.struct(F.col("work_id").alias("work"), F.coalesce("targets", zero).alias("slices"), F.coalesce("facts", zero).alias("facts"), "peers")
    return w.join(f, "work_id", "left").join(k, "component").select("work_id", F.to_json(record).alias("context"))


@audit(
    "C2 C3 C4",
    f"""WITH {WORK}, x AS (SELECT component, family, hunter, max(risk) AS risk, string_agg(work_id::VARCHAR, ',' ORDER BY work_id::VARCHAR) AS slices FROM work GROUP BY 1, 2, 3), h AS (SELECT DISTINCT hunter FROM work), g AS (SELECT DISTINCT component, family FROM work)
SELECT g.component, g.family, h.hunter, coalesce(risk, 1) AS risk, sha256('{{"component":"' || g.component || '","family":' || g.family || ',"hunter":"' || h.hunter || '","slices":"' || coalesce(slices, '') || '"}}') AS digest FROM g CROSS JOIN h LEFT JOIN x ON x.component = g.component AND x.family = g.family AND x.hunter = h.hunter""",
)
def cartesian_plan(spark: SparkSession, d: str) -> DataFrame:
    """Every file with every hunter, the four of a constant list, so the rows grow with the files; and the plan's digest."""
    w = work(spark, d)
    x = w.groupBy("component", "family", "hunter").agg(F.max("risk").alias("risk"), ids(F.col("work_id").cast("string")).alias("slices"))
    g = w.select("component", "family").distinct().withColumn("hunter", F.explode(F.array(*[F.lit(f"h{k}") for k in range(4)])))
    record = F.to_json(F.struct("component", "family", "hunter", F.coalesce("slices", F.lit("")).alias("slices")))
    return g.join(x, ["component", "family", "hunter"], "left").select("component", "family", "hunter", F.coalesce("risk", F.lit(1)).cast("long").alias("risk"), F.sha2(record, 256).alias("digest"))


@audit(
    "C8 C11 C20 C22",
    f"""WITH {FOUND}, {WORK}, c AS (SELECT run_id, candidate_id, min(session_index) AS first_session, max(CASE state WHEN 'reportable' THEN 2 WHEN 'reproduced' THEN 1 ELSE 0 END) AS s, bool_or(target_match) AS target_match, string_agg(DISTINCT validity, ',' ORDER BY validity) AS validity FROM found GROUP BY 1, 2)
SELECT run_id, candidate_id, CASE s WHEN 2 THEN 'reportable' WHEN 1 THEN 'reproduced' ELSE 'raw' END AS state, first_session, target_match, CASE WHEN contains(validity, ',') THEN 'conflict' ELSE validity END AS validity, CASE WHEN status = 'done' THEN 'admitted' WHEN s = 2 THEN 'deferred' ELSE 'open' END AS route FROM c JOIN work ON work_id = run_id""",
)
def candidate_records(spark: SparkSession, d: str) -> DataFrame:
    """A candidate's best state, first session, match and verdict, and the route of its critical sink."""
    rank = F.when(F.col("state") == "reportable", 2).when(F.col("state") == "reproduced", 1).otherwise(0)
    c = found(spark, d).groupBy("run_id", "candidate_id").agg(F.min("session_index").alias("first_session"), F.max(rank).alias("s"), (F.max(F.col("target_match").cast("int")) == 1).alias("target_match"), ids("validity").alias("v"))
    c = c.join(work(spark, d).select(F.col("work_id").alias("run_id"), "status"), "run_id")
    state = F.when(F.col("s") == 2, "reportable").when(F.col("s") == 1, "reproduced").otherwise("raw")
    route = F.when(F.col("status") == "done", "admitted").when(F.col("s") == 2, "deferred").otherwise("open")
    return c.select("run_id", "candidate_id", state.alias("state"), "first_session", "target_match", F.when(F.col("v").contains(","), "conflict").otherwise(F.col("v")).alias("validity"), route.alias("route"))


@audit(
    "C17 C18",
    f"""WITH {FOUND}, q AS (SELECT run_id, candidate_id AS path, session_index AS line FROM found WHERE state = 'reportable'), g AS (SELECT DISTINCT run_id, candidate_id AS path FROM found WHERE hunter = 'A') SELECT run_id, path, string_agg(DISTINCT line, ',' ORDER BY line) AS lines, bool_or(g.path IS NOT NULL) AS satisfied FROM q LEFT JOIN g USING (run_id, path) GROUP BY 1, 2""",
)
def required_reads(spark: SparkSession, d: str) -> DataFrame:
    """The lines that a run's focus requires to be read, by path, and whether a read record satisfies them."""
    f = found(spark, d).withColumnRenamed("candidate_id", "path")
    q = f.filter("state = 'reportable'").groupBy("run_id", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_set("session_index")), lambda x: x.cast("string")), ",").alias("lines"))
    g = f.filter("hunter = 'A'").select("run_id", "path", F.lit(True).alias("read")).distinct()
    return q.join(g, ["run_id", "path"], "left").select("run_id", "path", "lines", F.coalesce("read", F.lit(False)).alias("satisfied"))
