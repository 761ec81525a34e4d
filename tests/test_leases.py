"""Leases of tasks against a plain loop, as a log and as a stream over several micro-batches."""

import datetime as dt
import json
import random

import pytest

from tracewright.streaming import leases as L
from tracewright.streaming import states

T0 = dt.datetime(2024, 1, 1)
FIELDS = ["run_id", "task_key", "task_type", "at", "request_id", "action", "worker", "token", "attempt", "seconds", "status", "error", "target", "key"]
SCHEMA = f"run_id long, task_key string, {L.REQUEST}"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def requests(seed, n, keys=4):
    """Requests of workers that remember their last acquisition, and some that don't own what they claim."""
    r, out, claims = random.Random(seed), [], {}
    for key in range(keys):
        for kind in ("hunt", "review"):
            out.append((1, f"k{key}", kind, at(0), f"a{kind}", "enqueue", None, None, None, None, None, None, None, None))
    for i in range(n):
        key, kind, when, rid = f"k{r.randrange(keys)}", r.choice(["hunt", "review"]), at(1 + 7 * i + r.randrange(7)), f"r{i:05d}"
        action = r.choice(["acquire", "acquire", "acquire", "beat", "beat", "finish", "sweep", "defer", "requeue", "nonsense"])
        worker, token = claims.get((key, kind), ("w0", "none"))
        if action == "acquire":
            worker, token = f"w{r.randrange(3)}", f"t{i}"
            claims[key, kind] = worker, token
        elif r.random() < 0.15:
            token = "stolen"
        finish = action == "finish"
        status = r.choice(["completed", "failed", "running", "Bad"]) if finish else None
        target = r.choice([None, "statically_supported", "poc_ready", "rejected", "reportable"]) if finish else None
        error = r.choice(["no budget", " "]) if action == "defer" else None
        attempt = r.choice([None, None, 1]) if action == "beat" else None
        out.append((1, key, kind, when, rid, action, worker, token, attempt, r.choice([None, 30, 300, 0]) if action in ("acquire", "beat") else None, status, error, target, f"i{r.randrange(3)}" if target else None))
    return out


def plain(rows, max_attempts=3, sweeping=False, until=None):
    """The rules, written out over dictionaries."""
    out, tasks, findings, used = [], {}, {}, {}

    def tell(row, outcome):
        t = tasks.get(row[:3], dict(status=None, attempt=0, worker=None, token=None, expires=None, error=None))
        out.append((*row[:6], outcome, t["status"], t["attempt"], t["worker"], t["token"], t["expires"], findings.get(row[:2], "hypothesis"), t["error"]))

    def drop(t, status, error):
        t.update(status=status, error=error, worker=None, token=None, expires=None)

    def lapse(t):
        if t["attempt"] >= max_attempts:
            drop(t, "failed", "worker lease expired; attempts exhausted")
            return "exhausted"
        t["attempt"] += 1
        drop(t, "pending", "worker lease expired")
        return "requeued"

    def sweep_until(pair, when, inclusive):
        while True:
            ends = sorted((t["expires"], k) for k, t in tasks.items() if k[:2] == pair and t["status"] == "running" and (t["expires"] < when or inclusive and t["expires"] <= when))
            if not ends:
                return
            end, k = ends[0]
            outcome = lapse(tasks[k])
            tell((*k, end, None, "sweep"), outcome)

    for row in sorted(rows, key=lambda x: (x[3], x[4])):
        run, key, kind, now, rid, action, worker, token, attempt, seconds, status, error, target, idem = row
        k, pair = (run, key, kind), (run, key)
        if sweeping:
            sweep_until(pair, now, False)
        t = tasks.get(k)
        live = t is not None and t["status"] == "running" and t["worker"] == worker and t["token"] == token and attempt in (None, t["attempt"]) and t["expires"] > now
        late = t is not None and t["status"] == "running" and t["expires"] <= now
        length = 60 if seconds is None else seconds
        if action not in ("enqueue", "acquire", "beat", "finish", "sweep", "defer", "requeue"):
            outcome = "bad_request"
        elif action == "enqueue":
            outcome = "exists" if t else "created"
            if not t:
                tasks[k] = dict(status="pending", attempt=1, worker=None, token=None, expires=None, error=None)
        elif t is None:
            outcome = "unknown_task"
        elif action == "acquire":
            if length < 1:
                outcome = "bad_request"
            elif t["status"] == "pending" or late and t["attempt"] < max_attempts:
                outcome = "reacquired" if late else "acquired"
                t.update(status="running", attempt=t["attempt"] + late, worker=worker, token=token, expires=now + dt.timedelta(seconds=length), error=None)
            elif late:
                outcome = lapse(t)
            else:
                outcome = "held" if t["status"] == "running" else "not_pending"
        elif action == "beat":
            outcome = "bad_request" if length < 1 else "extended" if live else "lost"
            if outcome == "extended":
                t["expires"] = now + dt.timedelta(seconds=length)
        elif action == "finish":
            have = used.get((*pair, idem)) if idem else None
            if status in ("running", "Bad"):
                outcome = "bad_request"
            elif not live:
                outcome = "lost"
            elif target and have and have != target:
                outcome = "key_conflict"
            elif target and not have and (findings.get(pair, "hypothesis"), target) not in states.FINDING_EDGES:
                outcome = "illegal_transition"
            else:
                outcome = "finished"
                if target and not have:
                    findings[pair] = used[*pair, idem] = target
                drop(t, status, None)
        elif action == "sweep":
            outcome = lapse(t) if late else "kept"
        elif action == "defer":
            outcome = "bad_request" if not error.strip() else "deferred" if t["status"] == "pending" else "refused"
            if outcome == "deferred":
                t.update(status="budget_deferred", error=error)
        else:
            outcome = "returned" if t["status"] == "budget_deferred" else "refused"
            if outcome == "returned":
                t.update(status="pending", error=None)
        tell(row, outcome)
    if sweeping:
        for pair in {x[:2] for x in tasks}:
            sweep_until(pair, until, True)
    return out


def told(df):
    names = ["run_id", "task_key", "task_type", "at", "request_id", "action", "outcome", "status", "attempt", "worker", "token", "expires", "finding", "error"]
    return sorted((tuple(x[n] for n in names) for x in df.collect()), key=repr)


def test_log_against_a_loop(spark):
    rows = []
    for run, seed in enumerate((3, 4, 5)):
        rows += [(run, *x[1:]) for x in requests(seed, 900, keys=20)]
    rows.append((9, "k0", "hunt", at(1), "z", "beat", "w", "t", None, None, None, None, None, None))
    want = sorted((x for run in (0, 1, 2, 9) for x in plain([y for y in rows if y[0] == run])), key=repr)
    assert told(L.task_log(spark.createDataFrame(rows, SCHEMA).repartition(7))) == want
    outcomes = {x[6] for x in want}
    assert outcomes >= {"acquired", "reacquired", "held", "exhausted", "not_pending", "extended", "lost", "finished", "illegal_transition", "requeued", "kept", "deferred", "returned", "refused", "bad_request", "unknown_task", "created"}, outcomes


def test_finding_and_task_change_together(spark):
    row = lambda n, kind, action, **x: (1, "k", kind, at(n), f"r{n:02d}{kind}", action, *(x.get(f) for f in FIELDS[6:]))
    own = dict(worker="w", token="t", status="completed")
    rows = [row(0, "hunt", "enqueue"), row(0, "review", "enqueue"), row(1, "hunt", "acquire", worker="w", token="t"), row(1, "review", "acquire", worker="w", token="t")]
    rows += [row(2, "hunt", "finish", **own, target="reportable", key="a"), row(3, "hunt", "finish", **own, target="statically_supported", key="b")]
    rows += [row(4, "review", "finish", **own, target="poc_ready", key="b"), row(5, "review", "finish", **own, target="statically_supported", key="b"), row(6, "review", "beat", **own)]
    got = {x["request_id"]: (x["outcome"], x["status"], x["finding"]) for x in L.task_log(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got["r02hunt"] == ("illegal_transition", "running", "hypothesis")
    assert got["r03hunt"] == ("finished", "completed", "statically_supported")
    assert got["r04review"] == ("key_conflict", "running", "statically_supported")
    assert got["r05review"] == ("finished", "completed", "statically_supported")  # the key made this transition before
    assert got["r06review"] == ("lost", "completed", "statically_supported")
    assert L.task_log(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("sweeping", [False, True])
def test_stream_against_a_loop(spark, tmp_path, sweeping):
    """Requests shuffled within the lateness, over four micro-batches; one comes too late; a last one moves the watermark."""
    r = random.Random(6)
    rows = sorted(requests(7, 160, keys=2), key=lambda x: x[3])
    late = (1, "k0", "hunt", at(2), "late", "sweep", None, None, None, None, None, None, None, None)
    end = (2, "z", "hunt", at(90_000), "end", "sweep", None, None, None, None, None, None, None, None)
    size = len(rows) // 3 + 1
    batches = [rows[k : k + size] for k in range(0, len(rows), size)]
    for b in batches:
        r.shuffle(b)
    moved = batches[0].pop()  # comes one batch later, within the lateness
    batches[1].append(moved)
    batches += [[late], [end], [(2, "z", "hunt", at(90_001), "end2", "sweep", *[None] * 8)]]
    folder = tmp_path / "requests"
    folder.mkdir()
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = L.task_stream(spark.readStream.schema(SCHEMA).json(str(folder)), lateness=700, sweeping=sweeping)
        q = stream.writeStream.format("memory").queryName(f"tasks_{sweeping}").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
        try:
            for k, batch in enumerate(batches):
                (folder / f"{k}.json").write_text("\n".join(json.dumps({f: v.isoformat() if isinstance(v, dt.datetime) else v for f, v in zip(FIELDS, x, strict=True)}) for x in batch))
                q.processAllAvailable()
        finally:
            q.stop()
    finally:
        spark.conf.unset(provider)
    got = [x for x in told(spark.table(f"tasks_{sweeping}")) if x[0] == 1]
    assert got == sorted(plain(rows, sweeping=sweeping, until=at(80_000)), key=repr)


def test_states_are_the_twelve_and_the_fourteen():
    assert len(states.RUN_STATES) == 12 and len(states.RUN_EDGES) == 27
    assert len(states.FINDING_STATES) == 14 and len(states.FINDING_EDGES) == 44 == len(set(states.FINDING_EDGES))
    after = lambda edges, x: {b for a, b in edges if a == x}
    assert after(states.RUN_EDGES, "planning") == {"building", "failed", "cancelled"}
    assert after(states.RUN_EDGES, "reporting") == {"completed", "failed", "cancelled"}
    assert not any(after(states.RUN_EDGES, x) for x in ("completed", "failed", "cancelled"))
    endings = {"rejected", "unclear", "statically_refuted", "resource_infeasible", "verification_deferred"}
    want = {
        "hypothesis": {"statically_supported", "environment_blocked"} | endings,
        "statically_supported": {"poc_ready", "environment_blocked"} | endings,
        "poc_ready": {"reproduction_pending", "environment_blocked"} | endings,
        "reproduction_pending": {"reproduced", "environment_blocked"} | endings,
        "reproduced": {"reviewer_verified"} | endings,
        "reviewer_verified": {"reportable", "policy_blocked"} | endings,
        "environment_blocked": {"reproduction_pending", "verification_deferred"},
        "policy_blocked": {"reviewer_verified"},
    }
    assert {x: after(states.FINDING_EDGES, x) for x in states.FINDING_STATES} == {x: want.get(x, set()) for x in states.FINDING_STATES}
