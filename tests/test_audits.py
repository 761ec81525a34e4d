"""The audit queries against DuckDB on the smallest tables; those without SQL against plain loops."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from test_audit_queries import FOLDER, plain

from tracewright import audits
from tracewright.audits import predicates, registry, relations, scheduling, stores
from tracewright.streaming.states import FINDING_EDGES, FINDING_STATES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(audits.SQL))
def test_audit(spark, duck, name):
    assert plain(audits.QUERIES[name](spark, FOLDER).toPandas()) == plain(duck.execute(audits.SQL[name]).df())


def test_every_operator_number_is_of_the_inventory():
    sections = "SKPJAWOUGFXEDCN"
    assert all(n[0] in sections and n[1:].isdigit() for covered in audits.COVERS.values() for n in covered)


def test_transitions_against_a_loop(spark):
    r = random.Random(3)
    rows = [(f"f{r.randrange(30)}", k, f"k{r.randrange(6)}", r.choice(FINDING_STATES[:8])) for k in range(600)]
    got = stores.apply_transitions(spark.createDataFrame(rows, "f string, at long, key string, target string"), "f", ["at"], "key", "target", FINDING_EDGES, "hypothesis")
    want, state, used = [], {}, {}
    for f, _, key, target in rows:
        now = state.get(f, "hypothesis")
        if used.get((f, key)) == target:
            outcome = "replayed"
        elif (f, key) in used:
            outcome = "key_conflict"
        elif (now, target) in FINDING_EDGES:
            outcome, state[f], used[f, key] = "applied", target, target
        else:
            outcome = "illegal"
        want.append((f, key, target, now, state.get(f, "hypothesis"), outcome))
    assert sorted((x["f"], x["key"], x["target"], x["from_state"], x["state"], x["outcome"]) for x in got.collect()) == sorted(want)
    assert {x[-1] for x in want} == {"applied", "replayed", "key_conflict", "illegal"}


def test_reservations_against_a_loop(spark):
    r = random.Random(4)
    rows = []
    for run in range(12):
        at, critical = 0, {w for w in range(6) if r.random() < 0.4}
        works = [r.randrange(6) for _ in range(25)]
        n = len(critical & set(works))
        for w in works:
            at += r.randrange(60)
            rows.append((run, w, at, r.randrange(1, 400), r.randrange(1, 200), w in critical, n))
    df = spark.createDataFrame(rows, "run long, work long, at long, input long, output long, critical boolean, critical_works long")
    limits = dict(hard=1800, soft=1700, output=900, per_work=900, reserve=200, deadline=700)
    got = sorted(tuple(x) for x in scheduling.reservations(df, "run", ["at", "work", "input", "output"], **limits).collect())
    want = []
    for run in range(12):
        mine = sorted((x for x in rows if x[0] == run), key=lambda x: (x[2], x[1], x[3], x[4]))
        began, used, out, by, called = mine[0][2], 0, 0, {}, set()
        for x in mine:
            _, w, at, give, ask, critical, n = x
            kept = 200 * (n - len(called) - (critical and w not in called))
            if at - began >= 700:
                reason = "deadline"
            elif by.get(w, 0) + give > 900:
                reason = "input_per_work"
            elif give > 1800 - used - kept:
                reason = "critical_reserve"
            elif give > 1700 - used:
                reason = "soft_stop"
            elif out >= 900:
                reason = "max_output"
            else:
                reason = None
            granted = 0 if reason else min(ask, 900 - out)
            if reason is None:
                by[w], used, out = by.get(w, 0) + give, used + give, out + granted
                called |= {w} if critical else set()
            want.append((*x, reason, granted))
    assert got == sorted(want)
    assert {x[-2] for x in got} >= {None, "input_per_work", "critical_reserve"}


@pytest.mark.parametrize("sessions", [6, 60])
def test_diverse_admission_of_reduced_groups_is_that_of_whole_ones(spark, sessions):
    items = scheduling.candidates(spark, FOLDER).withColumn("campaign", F.substring("campaign", 1, 4))
    got = scheduling.diverse_allocation(items, ["campaign"], scheduling.candidate_order(), sessions).toPandas()
    order = items.select("*", F.struct(*[F.struct(c.alias("x")).alias(f"k{i}") for i, c in enumerate(scheduling.candidate_order())]).alias("_k")).orderBy("campaign", "_k")
    groups = {}
    for x in order.collect():
        row = x.asDict()
        row["obligations"], row["weights"] = list(row["obligations"]), dict(row["weights"])
        groups.setdefault(row["campaign"], []).append(row)
    want = {}
    for rows in groups.values():
        passes = scheduling.Diverse(rows, sessions, True)
        passes.run()
        for r in rows:
            want[r["work_id"]] = (*passes.picked.get(r["work_id"], (None, None)), None if r["work_id"] in passes.picked else passes.reason(r))
    none = lambda v: None if v is None or v != v else v
    assert len(got) == len(want) == items.count()
    assert {x.work_id: (none(x.place), none(x.quota), none(x.reason)) for x in got.itertuples()} == want
    quotas, reasons = {q for _, q, _ in want.values()}, {r for _, _, r in want.values()}
    assert quotas >= ({"decisive_obligation", "chain_critical"} if sessions == 6 else {"obligation_required", "seed_diverse", "high_risk", "borrowed"}), quotas
    assert reasons >= {"duplicate_obligation", "max_sessions"}, reasons


def test_nearest_against_all_pairs(spark):
    r = random.Random(5)
    left, right = [(r.randrange(4), r.randrange(50), k) for k in range(60)], [(r.randrange(3), r.randrange(50), 100 + k) for k in range(40)]
    got = relations.nearest(spark.createDataFrame(left, "g long, at long, id long"), spark.createDataFrame(right, "g long, at long, other long"), ["g"], "at", "other")
    for x in got.collect():
        near = sorted((abs(at - x["at"]), at, o) for g, at, o in right if g == x["g"])
        assert (x["distance"], x["other"]) == ((near[0][0], near[0][2]) if near else (None, None))


def test_a_bad_log_line_is_named(spark):
    lines = spark.createDataFrame([(1, '{"ts":"a","type":"b"}'), (2, " ")], "line long, entry string")
    assert stores.checked_log(lines).count() == 1
    with pytest.raises(Exception, match="line 3"):
        stores.checked_log(lines.union(spark.createDataFrame([(3, '{"ts":"a"}')], "line long, entry string"))).collect()


def test_plans_have_no_nested_loops(spark):
    """Pairs come from equality joins: no plan of a query forms a product, but for one-row tables."""
    for name in ("call_resolution", "bound_obligations", "nearest_length_check", "node_at_line", "guard_control", "work_allocation", "oracle_matches"):
        plan = audits.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
    plan = audits.QUERIES["slice_top"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # each task keeps six rows a key before the shuffle
    plan = registry.QUERIES["input_by_work"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan.split("ReadSchema")[1]


def test_paths_against_the_fixed_values(spark):
    """All extensions and folders, each in another case too, and names that only look like one."""
    python, node, java, c = [".py"], [".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx"], [".java", ".kt"], [".c", ".h", ".l", ".y"]
    of = {e: n for n, es in (("python", python), ("node", node), ("java", java), ("c", c)) for e in es}
    assert len(of) == 13
    skip = ".git node_modules __pycache__ .venv venv env dist build target .mypy_cache .pytest_cache .tox vendor third_party docs examples migrations".split()
    hints = ["test", "tests", "__tests__", "spec", "specs"]
    assert len(skip) == 17
    rows = [(f"src/a{e}", n, False, False) for e, n in of.items()] + [(f"src/a.b{e.upper()}", n, False, False) for e, n in of.items()]
    rows += [(f"x/{s}/a.c", "c", True, False) for s in skip] + [(f"x/{s.upper()}/a.c", "c", False, False) for s in skip if s.upper() != s]
    rows += [(f"{h}/a.py", "python", False, True) for h in hints] + [(f"a/{h.upper()}/b.py", "python", False, True) for h in hints]
    rows += [(".c", None, False, False), ("a/.py", None, False, False), ("a..c", "c", False, False), ("c", None, False, False), ("testing/a.go", None, False, False), ("a/test_b.c", "c", False, False), ("build", None, True, False), ("a.c/b", None, False, False)]
    df = spark.createDataFrame([(p,) for p, *_ in rows], "path string")
    got = df.select("path", *[x.alias(n) for x, n in zip(predicates.path_columns("path"), ("language", "skipped", "is_test"), strict=True)])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(rows, key=repr)


def test_evidence_adds_up_and_one_hunter_comes_first(spark):
    rows = [(required, risk, status, attempt) for required in (True, False) for risk in (3, 4) for status in ("done", "running") for attempt in (1, 2)]
    got = spark.createDataFrame(rows, "required boolean, risk long, status string, attempt long").select("*", scheduling.evidence_points().alias("points")).collect()
    assert {x[:4]: x["points"] for x in got} == {x: 40 * x[0] + 30 * (x[1] == 4) + 20 * (x[2] == "done") + 10 * (x[3] == 1) for x in rows}
    work = [(w, "pending", 1, True, 4, 1, "c", 0, h) for w, h in enumerate(("h3", "h0", "h2", "h1"))]
    df = spark.createDataFrame(work, "work_id long, status string, score long, required boolean, risk long, attempt long, component string, family long, hunter string")
    keys = df.select("hunter", scheduling.candidate_order()[3].alias("k")).collect()
    assert {x["hunter"]: x["k"] for x in keys} == {"h0": 0, "h1": 1, "h2": 1, "h3": 1}


def test_passages_against_contains(spark):
    r = random.Random(11)
    word = lambda: f"w{r.randrange(60)}"
    protected = [(k, " ".join(word() for _ in range(r.choice([1, 2, 3, 7, 8, 9, 30])))) for k in range(40)] + [(90, None), (91, " \n "), (92, "Ä b\tC"), (0, "w1")]
    texts = [(k, " ".join(word() for _ in range(r.choice([0, 1, 5, 200])))) for k in range(60)] + [(100, None), (101, ""), (102, "x ä  B\nc y"), (103, "xä b c")]
    texts += [(200 + k, f"before {p}\n after") for k, (_, p) in enumerate(protected) if p and k % 2]
    got = predicates.passages(spark.createDataFrame(protected, "item_id long, passage string"), spark.createDataFrame([*texts, *texts[:5]], "doc_id long, text string"))
    flat = lambda t: " " + " ".join(t.lower().split()) + " "
    want = {(i, d) for i, p in protected for d, t in texts if p and p.split() and t is not None and flat(p) in flat(t)}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {(92, 102)} <= want and (92, 103) not in want
    none = spark.createDataFrame([], "item_id long, passage string")
    assert predicates.passages(none, spark.createDataFrame(texts, "doc_id long, text string")).collect() == []


def test_selected_lines_are_united_before_they_are_shuffled(spark):
    plan = scheduling.selected_lines(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "collect_set" not in plan


def test_diverse_passes_do_not_rescan_a_group_for_each_obligation():
    class Counted(list):
        scans = 0

        def __iter__(self):
            Counted.scans += 1
            return super().__iter__()

    rows = Counted({"work_id": i, "family": i % 7, "hunter": f"h{i % 4}", "required": i % 3 == 0, "risk": i % 6, "critical": i % 11 == 0, "chain": "", "group": str(i % 90), "obligations": [f"k{i % 5}:{i % 50}"], "weights": {f"k{i % 5}:{i % 50}": 60 + i % 61}} for i in range(3000))
    passes = scheduling.Diverse(rows, 16, True)
    passes.run()
    assert len(passes.picked) == passes.capacity and Counted.scans < 30


def test_functions_flow_in_streams_of_sorted_rows(spark):
    """No frame a function, which costs a thousand times its few blocks."""
    for name in ("control_flow_facts", "forward_taint"):
        plan = audits.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan, name
