"""Tasks that workers claim by leases: an ordered log of requests folded into outcomes, attempts and states.

A request is (seq: its place in the log, stage, task, at, kind, owner, seconds, input, config, force, stage_lease, result,
retryable, retry_after, code). Kinds: claim, heartbeat, complete, fail of a task; acquire, renew, release of a stage's lease.
A lease that runs out ends its attempt then (kind expire): the task waits for a retry, and what its worker brings later
is refused. Tasks begin as pending when the log first names them.

In batch, a task's requests are sorted into one partition and folded as they stream by, so memory holds one state,
whatever the log. Stage leases are a fold of their own over claims that ask for one; which claims get that far depends
on the tasks in turn, so both are repeated until that set stays: every round settles the log up to its first difference.
As a stream, all of a stage is folded in one state by the same steps, and timers end the leases.

Defined cases: null owners never conflict with a lease's owner on complete and fail; a lease lasts a second at least;
without seconds 300; a null `at` is a request that never came; requests that repeat a seq are separate, in any order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..tables import settle
from .folds import folded as _fold

FIELDS = "seq long, stage string, task string, at long, kind string, owner string, seconds int, input string, config string, force boolean, stage_lease boolean, result string, retryable boolean, retry_after double, code string"
OUTCOME = "seq long, stage string, task string, at long, kind string, owner string, outcome string, reached boolean, status string, lease_owner string, lease_expires_at long, next_retry_at long, error_code string, result string, attempt_no int, attempt_status string, attempt_started_at long, attempt_finished_at long"
STAGE_KINDS = ("acquire", "renew", "release")
LEASE = 300
_NEW = {"status": "pending", "owner": None, "expires": None, "due": None, "attempts": 0, "input": None, "config": None, "result": None, "code": None, "attempt": None, "started": None, "finished": None}


def expired(s: dict, at: int) -> dict | None:
    """The state after its lease ran out by `at`, or None where it didn't. The attempt ends with the lease."""
    if s["status"] != "running" or (s["expires"] is not None and s["expires"] > at):
        return None
    return s | {"status": "retry_waiting", "owner": None, "expires": None, "due": None, "code": "lease_expired", "attempt": "retry_waiting", "finished": s["expires"]}


def step(s: dict, r: dict, stage_free: bool) -> tuple[dict, str, bool]:
    """(state, outcome, whether a claim got as far as the stage's lease) after a request; leases that ran out are ended before."""
    at, until = r["at"], r["at"] + max(1, r["seconds"] if r["seconds"] is not None else LEASE) * 1_000_000
    if r["kind"] == "claim":
        same = all(r[k] is None or r[k] == s[k] for k in ("input", "config"))
        if s["status"] == "succeeded" and same and not r["force"]:
            return s, "reusable", False
        if s["status"] == "succeeded" or (r["force"] and s["status"] in ("blocked", "cancelled", "skipped")):
            s = s | {"status": "pending", "owner": None, "expires": None, "due": None, "result": None, "code": None}
        if s["status"] == "running":
            return s, "leased", False
        if s["status"] not in ("pending", "retry_waiting", "failed"):
            return s, "closed", False
        if s["due"] is not None and s["due"] > at:
            return s, "not_due", False
        if r["stage_lease"] and not stage_free:
            return s, "stage_leased", True
        given = {k: r[k] for k in ("input", "config") if r[k] is not None}
        return s | given | {"status": "running", "owner": r["owner"], "expires": until, "due": None, "code": None, "attempts": s["attempts"] + 1, "attempt": "running", "started": at, "finished": None}, "claimed", bool(r["stage_lease"])
    if s["code"] == "lease_expired" and s["status"] == "retry_waiting":
        return s, "lease_lost", False
    if r["kind"] == "heartbeat":
        if s["status"] != "running" or (r["owner"] and s["owner"] != r["owner"]):
            return s, "not_owner", False
        return s | {"expires": until}, "renewed", False
    if r["owner"] and s["owner"] not in (None, r["owner"]):
        return s, "not_owner", False
    closed = {"owner": None, "expires": None}
    if r["kind"] == "complete":
        ended = {"attempt": "succeeded", "finished": at} if s["attempts"] else {}
        return s | closed | ended | {"status": "succeeded", "due": None, "code": None, "result": r["result"] if r["result"] is not None else s["result"]}, "completed", False
    if r["kind"] == "fail":
        status = "retry_waiting" if r["retryable"] else "blocked"
        ended = {"attempt": status, "finished": at} if s["attempt"] == "running" else {}
        due = at + int(max(0.0, r["retry_after"] or 0.0) * 1_000_000) if r["retryable"] else None
        return s | closed | ended | {"status": status, "due": due, "code": r["code"]}, status, False
    return s, "unknown_kind", False


def stage_step(s: dict, r: dict) -> tuple[dict, bool]:
    """(lease, whether the request was granted) of a stage; a claim acquires like an acquire. Others' leases hold until they run out."""
    at, until = r["at"], r["at"] + max(1, r["seconds"] if r["seconds"] is not None else LEASE) * 1_000_000
    if r["kind"] in ("acquire", "claim"):
        if s["owner"] and s["expires"] is not None and s["expires"] > at and s["owner"] != r["owner"]:
            return s, False
        return {"owner": r["owner"], "expires": until}, True
    if r["kind"] == "renew":
        if (r["owner"] and s["owner"] != r["owner"]) or (s["expires"] is not None and s["expires"] <= at):
            return s, False
        return s | {"expires": until}, True
    if r["owner"] and s["owner"] not in (None, r["owner"]):
        return s, False
    return {"owner": None, "expires": None}, True


_NO_LEASE = {"owner": None, "expires": None}
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in map(str.split, ddl.split(", "))])


def _row(r: dict, s: dict, kind: str, at: int | None, outcome: str, reached: bool = False) -> dict:
    return {
        "seq": r["seq"] if kind != "expire" else None, "stage": r["stage"], "task": r["task"], "at": at, "kind": kind, "owner": r["owner"] if kind != "expire" else None, "outcome": outcome, "reached": reached, "status": s["status"],
        "lease_owner": s["owner"], "lease_expires_at": s["expires"], "next_retry_at": s["due"], "error_code": s["code"], "result": s["result"], "attempt_no": s["attempts"], "attempt_status": s["attempt"], "attempt_started_at": s["started"], "attempt_finished_at": s["finished"],
    }


def told(s: dict, r: dict, stage_free: bool) -> tuple[dict, list[dict]]:
    """(state, rows) of a request, with the end of a lease that ran out before it."""
    rows, over = [], expired(s, r["at"])
    if over is not None:
        s = over
        rows.append(_row(r, s, "expire", s["finished"], "retry_waiting"))
    s, outcome, reached = step(s, r, stage_free)
    return s, [*rows, _row(r, s, r["kind"], r["at"], outcome, reached)]


def _last_lease(horizon: int | None):
    """What ends after a task's last request: a lease that runs out by the horizon."""

    def end(s: dict, r: dict) -> list[dict]:
        over = expired(s, horizon) if horizon is not None else None
        return [_row(r, over, "expire", over["finished"], "retry_waiting")] if over is not None else []

    return end


def folded(requests: DataFrame, horizon: int | None = None) -> DataFrame:
    """A row for each request, with its outcome and the task and attempt after it, and one for each lease that ran out (by
    `horizon`, after a task's last request). Requests of stages alone come back by `stage_outcomes`."""
    log = settle(requests.filter("at is not null").select(*(c.split()[0] for c in FIELDS.split(", "))))
    tasks, leases = log.filter(~F.col("kind").isin(*STAGE_KINDS)), log.filter(F.col("kind").isin(*STAGE_KINDS))
    asking = tasks.filter("kind = 'claim' and stage_lease")
    end = _last_lease(horizon)

    def move(s: dict, r: dict) -> tuple[dict, list[dict]]:
        return told(s, r, r["granted"] is not False)

    reached, out = None, None
    while True:
        asked = asking if reached is None else asking.join(reached, "seq", "left_semi")
        grants = stage_outcomes(leases.unionByName(asked)).filter("kind = 'claim'").select("seq", "granted")
        out = settle(_fold(tasks.join(grants, "seq", "left"), ["task"], ["at", "seq"], lambda: _NEW, move, end, OUTCOME))
        found = out.filter("reached").select("seq")
        before = reached if reached is not None else asking.select("seq")
        if before.join(found, "seq", "left_anti").isEmpty() and found.join(before, "seq", "left_anti").isEmpty():
            return out
        reached = found


def stage_outcomes(requests: DataFrame) -> DataFrame:
    """(seq, stage, at, kind, granted, lease_owner, lease_expires_at) of requests for stage leases."""

    def move(s: dict, r: dict) -> tuple[dict, list[dict]]:
        s, granted = stage_step(s, r)
        return s, [{"seq": r["seq"], "stage": r["stage"], "at": r["at"], "kind": r["kind"], "granted": granted, "lease_owner": s["owner"], "lease_expires_at": s["expires"]}]

    return _fold(requests.filter("at is not null"), ["stage"], ["at", "seq"], lambda: _NO_LEASE, move, lambda s, r: [], "seq long, stage string, at long, kind string, granted boolean, lease_owner string, lease_expires_at long")


def _latest(outcomes: DataFrame, key: list[str], what: list[str]) -> DataFrame:
    """A key's last row: the later; at the same time the request after the end of a lease; then by seq."""
    last = F.struct("at", (F.col("kind") != "expire").alias("k"), F.coalesce("seq", F.lit(-1)).alias("s"))
    return outcomes.groupBy(*key).agg(F.max_by(F.struct(*what), last).alias("r")).select(*key, "r.*")


def states(outcomes: DataFrame) -> DataFrame:
    """(task, stage, status, lease_owner, lease_expires_at, next_retry_at, error_code, result, attempt_no) of each task at its log's end."""
    return _latest(outcomes, ["task"], ["stage", "status", "lease_owner", "lease_expires_at", "next_retry_at", "error_code", "result", "attempt_no"])


def attempts(outcomes: DataFrame) -> DataFrame:
    """(task, attempt_no, attempt_status, started_at, finished_at): one row an attempt, as it ended."""
    rows = outcomes.filter("attempt_no > 0")
    return _latest(rows, ["task", "attempt_no"], ["attempt_status", "attempt_started_at", "attempt_finished_at"]).withColumnsRenamed({"attempt_started_at": "started_at", "attempt_finished_at": "finished_at"})


class Claims(StatefulProcessor):
    """A stage's lease and its tasks as state; event-time timers end the tasks' leases."""

    def init(self, handle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "lease string")
        self.tasks = handle.getMapState("tasks", "task string", "state string")

    def _task(self, name: str) -> dict:
        return json.loads(self.tasks.getValue((name,))[0]) if self.tasks.containsKey((name,)) else _NEW

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        lease, out = json.loads(self.lease.get()[0]) if self.lease.exists() else _NO_LEASE, []
        log = [r for part in rows for r in pa.RecordBatch.from_pandas(part.drop(columns="event_time"), schema=_arrow(FIELDS)).to_pylist()]
        for r in sorted(log, key=lambda r: (r["at"], r["seq"])):
            if r["kind"] in STAGE_KINDS:
                lease, _ = stage_step(lease, r)
                continue
            free = stage_step(lease, r)[1] if r["kind"] == "claim" and r["stage_lease"] else True
            s, rows_ = told(self._task(r["task"]), r, free)
            if rows_[-1]["reached"]:
                lease, _ = stage_step(lease, r)
            self.tasks.updateValue((r["task"],), (json.dumps(s),))
            out += rows_
            if s["status"] == "running":
                self.handle.registerTimer(-(-s["expires"] // 1000))
        self.lease.update((json.dumps(lease),))
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, out = expiredTimerInfo.getExpiryTimeInMs() * 1000, []
        for (name,), (state,) in list(self.tasks.iterator()):
            over = expired(json.loads(state), at)
            if over is not None:
                self.tasks.updateValue((name,), (json.dumps(over),))
                out.append(_row({"seq": None, "stage": key[0], "task": name, "owner": None}, over, "expire", over["finished"], "retry_waiting"))
        yield _frame(out)

    def close(self) -> None:
        pass




def _frame(rows: list[dict]) -> pd.DataFrame:
    """Rows as pandas with nullable types, so that longs stay longs."""
    return pa.Table.from_pylist(rows, schema=_arrow(OUTCOME)).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype(), pa.bool_(): pd.BooleanDtype()}.get)


def streamed(requests: DataFrame, late: str = "1 minute") -> DataFrame:
    """The same over a stream. `at` is in microseconds; requests later than the watermark are folded as they come."""
    timed = requests.filter("at is not null").withColumn("event_time", F.timestamp_micros("at")).withWatermark("event_time", late)
    return timed.groupBy("stage").transformWithStateInPandas(statefulProcessor=Claims(), outputStructType=OUTCOME, outputMode="append", timeMode="eventTime")
