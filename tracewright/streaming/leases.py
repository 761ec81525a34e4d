"""Leases of tasks: acquire, beat, finish, sweep, defer and requeue, over logs and over streams of requests.

A request has run_id, task_key, task_type, at (timestamp), request_id (unique among those of a task_key), action, worker,
token, attempt, seconds, status, error, target and key. The tasks of one (run_id, task_key), one a type, work on one
finding, which begins as a hypothesis; they are one state, so that a task and the finding change together. Actions:

- ``enqueue``: makes the task, pending, if there is none; attempt is its first one (1 if null).
- ``acquire``: pending work gets a lease for ``seconds``. Of running work a lease that has run out (or has no expiry) is
  taken over with the next attempt, and the task fails at ``max_attempts``; a live lease is held.
- ``beat``: a live lease is extended to at + seconds. Live means: the task runs, worker and token are those that acquired
  it, attempt (if given) is that of the lease, and the expiry is later than at. Any other beat is lost and changes nothing.
- ``finish``: a live lease ends in ``status``, which can't be pending or running. With a target the task's finding makes
  that transition in the same step, or nothing happens: a transition that isn't allowed and a key that stands for another
  target refuse the whole request; a key that made this transition before is replayed.
- ``sweep``: running work whose lease has run out goes back to pending with the next attempt, or fails.
- ``defer``: pending work waits for budget, with an error as its reason; ``requeue`` returns it, on the same attempt.

A grant's token is its acquiring request's ``token``, which the worker draws, or its request_id where that is null. Requests
of a (run_id, task_key) take effect in the order of at and request_id. Each gives one row: its outcome, and the task and
the finding after it.

Defined cases: a null or unknown action is refused as ``bad_request``; so is an acquire without worker or with seconds
below 1, a finish in no terminal status, and a deferral without reason. A request for a task that was never enqueued is
``unknown_task``. Seconds null: 60. Null run_id, task_key and task_type are values like others. Empty log: no rows.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tracewright.operators.folds import ordered_fold
from tracewright.streaming.states import FINDING_EDGES

KEYS = ["run_id", "task_key"]
REQUEST = "task_type string, at timestamp, request_id string, action string, worker string, token string, attempt long, seconds long, status string, error string, target string, key string"
RESULT = "task_type string, at timestamp, request_id string, action string, outcome string, status string, attempt long, worker string, token string, expires timestamp, finding string, error string"
_FINDING = "finding string, used map<string, string>"
_TASK = "status string, attempt long, worker string, token string, expires timestamp, error string"
_NAMES = [f.split()[0] for f in REQUEST.split(", ")]
_RESULTS = [f.split()[0] for f in RESULT.split(", ")]
_EDGES = frozenset(FINDING_EDGES)


class Finding:
    """What the tasks of a (run_id, task_key) work on."""

    def __init__(self):
        self.state, self.used = "hypothesis", {}

    def refusal(self, target: str, key: str | None) -> str | None:
        """Makes the transition under its idempotency key, or says why not."""
        before = self.used.get(key)
        if before is not None:
            return None if before == target else "key_conflict"
        if (self.state, target) not in _EDGES:
            return "illegal_transition"
        self.state = target
        if key is not None:
            self.used[key] = target
        return None


class Task:
    """One task's state; ``apply`` carries out a request and names its outcome."""

    def __init__(self, finding: Finding, max_attempts: int):
        self.finding, self.max_attempts = finding, max_attempts
        self.status = self.worker = self.token = self.expires = self.error = None
        self.attempt = 0

    def apply(self, row: dict) -> str:
        if row["action"] not in _ACTIONS:
            return "bad_request"
        if self.status is None and row["action"] != "enqueue":
            return "unknown_task"
        return getattr(self, f"_{row['action']}")(row, row["at"])

    def lapsed(self, now: dt.datetime) -> bool:
        return self.status == "running" and (self.expires is None or self.expires <= now)

    def _release(self, status: str, error: str | None) -> None:
        self.status, self.error = status, error
        self.worker = self.token = self.expires = None

    def _live(self, row: dict, now: dt.datetime) -> bool:
        own = row["worker"] is not None and row["worker"] == self.worker and (row["token"] or None) == self.token
        return self.status == "running" and own and row["attempt"] in (None, self.attempt) and not self.lapsed(now)

    def _enqueue(self, row: dict, now: dt.datetime) -> str:
        if self.status is not None:
            return "exists"
        self.status, self.attempt = "pending", 1 if row["attempt"] is None else row["attempt"]
        return "created"

    def _acquire(self, row: dict, now: dt.datetime) -> str:
        seconds = 60 if row["seconds"] is None else row["seconds"]
        if not (row["worker"] or "").strip() or seconds < 1:
            return "bad_request"
        outcome = "acquired"
        if self.status == "running":
            if not self.lapsed(now):
                return "held"
            if self.attempt >= self.max_attempts:
                self._release("failed", "worker lease expired; attempts exhausted")
                return "exhausted"
            self.attempt, outcome = self.attempt + 1, "reacquired"
        elif self.status != "pending":
            return "not_pending"
        self._release("running", None)
        self.worker, self.token, self.expires = row["worker"], row["token"] or row["request_id"], now + dt.timedelta(seconds=seconds)
        return outcome

    def _beat(self, row: dict, now: dt.datetime) -> str:
        seconds = 60 if row["seconds"] is None else row["seconds"]
        if seconds < 1:
            return "bad_request"
        if not self._live(row, now):
            return "lost"
        self.expires = now + dt.timedelta(seconds=seconds)
        return "extended"

    def _finish(self, row: dict, now: dt.datetime) -> str:
        if row["status"] in ("pending", "running") or not re.fullmatch("[a-z][a-z0-9_]{0,63}", row["status"] or ""):
            return "bad_request"
        if not self._live(row, now):
            return "lost"
        if row["target"] is not None and (why := self.finding.refusal(row["target"], row["key"])):
            return why
        self._release(row["status"], row["error"] or None)
        return "finished"

    def _sweep(self, row: dict, now: dt.datetime) -> str:
        if not self.lapsed(now):
            return "kept"
        if self.attempt >= self.max_attempts:
            self._release("failed", "worker lease expired; attempts exhausted")
            return "exhausted"
        self.attempt += 1
        self._release("pending", "worker lease expired")
        return "requeued"

    def _defer(self, row: dict, now: dt.datetime) -> str:
        if not (row["error"] or "").strip():
            return "bad_request"
        if self.status != "pending":
            return "refused"
        self.status, self.error = "budget_deferred", row["error"]
        return "deferred"

    def _requeue(self, row: dict, now: dt.datetime) -> str:
        if self.status != "budget_deferred":
            return "refused"
        self.status, self.error = "pending", None
        return "returned"


_ACTIONS = ("enqueue", "acquire", "beat", "finish", "sweep", "defer", "requeue")


class Unit:
    """The state of a (run_id, task_key): its finding and its tasks by type."""

    def __init__(self, max_attempts: int = 3):
        self.finding, self.tasks, self.max_attempts = Finding(), {}, max_attempts

    def task(self, kind: str | None) -> Task:
        return self.tasks.setdefault(kind, Task(self.finding, self.max_attempts))

    def step(self, row: dict) -> list[tuple]:
        task = self.task(row["task_type"])
        outcome = task.apply(row)
        return [(row["task_type"], row["at"], row["request_id"], row["action"], outcome, task.status, task.attempt, task.worker, task.token, task.expires, self.finding.state, task.error)]

    def end(self) -> list[tuple]:
        return []


def task_log(requests: DataFrame, max_attempts: int = 3) -> DataFrame:
    """The outcome of each request of a log, with its task and finding after it."""
    rows = requests.select(*KEYS, *_NAMES)
    return ordered_fold(rows, KEYS, ["at", "request_id"], lambda: Unit(max_attempts), RESULT)


def _naive(x: dt.datetime | None) -> dt.datetime | None:
    """Times in UTC without a zone, whatever the stream's workers give."""
    x = x.to_pydatetime() if isinstance(x, pd.Timestamp) else x
    return None if x is None or pd.isna(x) else x.astimezone(dt.UTC).replace(tzinfo=None) if x.tzinfo else x


def _plain(name: str, value: object) -> object:
    if name == "at":
        return _naive(value)
    return None if pd.isna(value) else int(value) if name in ("attempt", "seconds") else value


def _millis(x: dt.datetime) -> int:
    """The first millisecond whose watermark has passed x."""
    return -(-(x - dt.datetime(1970, 1, 1)) // dt.timedelta(milliseconds=1))


class TaskProcessor(StatefulProcessor):
    """The tasks of a key, and the requests that the watermark hasn't passed; timers wake it when it does.

    With ``sweeping`` a lease that runs out is swept by its own timer, at its expiry: a row without request_id.
    """

    def __init__(self, max_attempts: int, sweeping: bool):
        self.max_attempts, self.sweeping = max_attempts, sweeping

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.finding = handle.getValueState("finding", _FINDING)
        self.tasks = handle.getMapState("tasks", "task_type string", _TASK)
        self.waiting = handle.getListState("waiting", REQUEST)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            if len(frame):
                self.waiting.appendList([tuple(_plain(n, v) for n, v in zip(_NAMES, row, strict=True)) for row in frame[_NAMES].itertuples(index=False)])
        yield from self._due(key, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._due(key, timerValues)

    def close(self) -> None:
        pass

    def _restored(self) -> Unit:
        unit = Unit(self.max_attempts)
        if self.finding.exists():
            unit.finding.state, used = self.finding.get()
            unit.finding.used = dict(used or {})
        for (kind,), (status, attempt, worker, token, expires, error) in self.tasks.iterator() if self.tasks.exists() else ():
            task = unit.task(kind)
            task.status, task.attempt, task.worker, task.token, task.expires, task.error = status, attempt, worker, token, _naive(expires), error
        return unit

    def _lapsing(self, unit: Unit) -> list[tuple[dt.datetime, str]]:
        running = [(t.expires, k) for k, t in unit.tasks.items() if t.status == "running"] if self.sweeping else []
        return sorted(running, key=lambda x: (x[0], x[1] or ""))

    def _due(self, key: tuple, timers) -> Iterator[pd.DataFrame]:
        mark, unit, out = timers.getCurrentWatermarkInMs(), self._restored(), []
        stored = [dict(zip(_NAMES, x, strict=True)) for x in self.waiting.get()] if self.waiting.exists() else []
        rows = sorted(({**r, "at": _naive(r["at"])} for r in stored), key=lambda r: (r["at"], r["request_id"]))
        due = [r for r in rows if _millis(r["at"]) <= mark]
        left = rows[len(due) :]
        for r in [*due, None]:
            while (ends := self._lapsing(unit)) and _millis(ends[0][0]) <= mark and (r is None or ends[0][0] < r["at"]):
                out.extend(unit.step(dict.fromkeys(_NAMES) | {"task_type": ends[0][1], "at": ends[0][0], "action": "sweep"}))
            if r is not None:
                out.extend(unit.step(r))
        if out:
            self.finding.update((unit.finding.state, unit.finding.used))
            for kind, t in unit.tasks.items():
                self.tasks.updateValue((kind,), (t.status, t.attempt, t.worker, t.token, t.expires, t.error))
        if due:
            self.waiting.clear()
            if left:
                self.waiting.put([tuple(r[n] for n in _NAMES) for r in left])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        if wake := [_millis(x) for x in [*(r["at"] for r in left[:1]), *(e for e, _ in self._lapsing(unit)[:1])]]:
            self.handle.registerTimer(max(min(wake), mark + 1))
        if out:
            yield pd.DataFrame([(*key, *x) for x in out], columns=[*KEYS, *_RESULTS])


def task_stream(requests: DataFrame, max_attempts: int = 3, lateness: int = 600, sweeping: bool = False) -> DataFrame:
    """``task_log`` over a stream of requests; the session's state store must be RocksDB.

    Requests may come in any order within ``lateness`` seconds of the latest: each waits in the state until the watermark
    has passed it. Later ones are dropped by the watermark. A task's state stays, as its terminal status refuses requests.
    """
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in (requests.schema[k] for k in KEYS))
    rows = requests.select(*KEYS, *[F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(REQUEST)]).withWatermark("at", f"{lateness} seconds")
    return rows.groupBy(*KEYS).transformWithStateInPandas(TaskProcessor(max_attempts, sweeping), f"{keys}, {RESULT}", "append", "eventTime")
