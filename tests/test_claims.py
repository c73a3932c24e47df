"""The claim protocol: every branch as a literal, batch against a plain loop, stream against batch."""

import random

import pytest

from newsloom.operators import claims

S = 1_000_000
NAMES = [c.split()[0] for c in claims.FIELDS.split(", ")]


def req(seq, at, kind, task="t", owner="w1", stage="s", **more):
    return {n: None for n in NAMES} | {"seq": seq, "at": at * S, "kind": kind, "task": task, "owner": owner, "stage": stage, "force": False, "stage_lease": False} | more


def _fold(spark, rows, horizon=None):
    df = spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], claims.FIELDS).repartition(3)
    return claims.folded(df, horizon)


def _outcomes(spark, rows, horizon=None):
    got = _fold(spark, rows, horizon).collect()
    return [r.outcome for r in sorted((r for r in got if r.kind != "expire"), key=lambda r: r.seq)], got


@pytest.mark.parametrize(("rows", "want"), [
    ([req(1, 0, "claim"), req(2, 10, "claim", owner="w2")], ["claimed", "leased"]),
    ([req(1, 0, "claim", seconds=5), req(2, 6, "claim", owner="w2")], ["claimed", "claimed"]),
    ([req(1, 0, "claim", seconds=5), req(2, 4, "heartbeat", seconds=5), req(3, 8, "complete"), req(4, 9, "claim")], ["claimed", "renewed", "completed", "reusable"]),
    ([req(1, 0, "claim", seconds=5), req(2, 4, "heartbeat", owner="w2")], ["claimed", "not_owner"]),
    ([req(1, 0, "claim", seconds=5), req(2, 5, "complete"), req(3, 6, "fail"), req(4, 6, "heartbeat")], ["claimed", "lease_lost", "lease_lost", "lease_lost"]),
    ([req(1, 0, "claim", seconds=0), req(2, 1, "complete")], ["claimed", "lease_lost"]),
    ([req(1, 0, "claim"), req(2, 1, "complete", owner="w2"), req(3, 1, "complete", owner=None)], ["claimed", "not_owner", "completed"]),
    ([req(1, 0, "claim", input="a", config="c"), req(2, 1, "complete"), req(3, 2, "claim", input="a", config="c"), req(4, 2, "claim", input="b")], ["claimed", "completed", "reusable", "claimed"]),
    ([req(1, 0, "claim", input="a"), req(2, 1, "complete"), req(3, 2, "claim"), req(4, 2, "claim", config="z")], ["claimed", "completed", "reusable", "claimed"]),
    ([req(1, 0, "claim"), req(2, 1, "complete"), req(3, 2, "claim", force=True)], ["claimed", "completed", "claimed"]),
    ([req(1, 0, "claim"), req(2, 1, "fail", retryable=False, code="schema"), req(3, 2, "claim"), req(4, 3, "claim", force=True)], ["claimed", "blocked", "closed", "claimed"]),
    ([req(1, 0, "claim"), req(2, 1, "fail", retryable=True, retry_after=9.5), req(3, 10, "claim"), req(4, 11, "claim")], ["claimed", "retry_waiting", "not_due", "claimed"]),
    ([req(1, 0, "claim"), req(2, 1, "fail", retryable=True), req(3, 1, "claim")], ["claimed", "retry_waiting", "claimed"]),
    ([req(1, 0, "complete"), req(2, 1, "claim"), req(3, 1, "what")], ["completed", "reusable", "unknown_kind"]),
])
def test_branches(spark, rows, want):
    assert _outcomes(spark, rows)[0] == want


def test_expired_attempts_and_states(spark):
    rows = [req(1, 0, "claim", seconds=5), req(2, 9, "claim", owner="w2", seconds=5), req(3, 11, "complete", owner="w2", result="r"), req(4, 0, "claim", task="u", seconds=7)]
    out = _fold(spark, rows, horizon=7 * S)
    got = sorted(map(tuple, claims.attempts(out).select("task", "attempt_no", "attempt_status", "started_at", "finished_at").collect()))
    assert got == [("t", 1, "retry_waiting", 0, 5 * S), ("t", 2, "succeeded", 9 * S, 11 * S), ("u", 1, "retry_waiting", 0, 7 * S)]
    got = {r.task: (r.status, r.result, r.error_code, r.lease_owner) for r in claims.states(out).collect()}
    assert got == {"t": ("succeeded", "r", None, None), "u": ("retry_waiting", None, "lease_expired", None)}


def test_stage_leases_depend_on_tasks(spark):
    """The claim at 2 is refused by its task, so it takes no stage lease, and the one at 3 by another worker gets it."""
    rows = [
        req(1, 0, "claim", stage_lease=True, seconds=1), req(2, 2, "complete", task="t", owner=None), req(3, 3, "claim", owner="w1", stage_lease=True, task="u", seconds=9), req(4, 4, "complete", task="u", owner="w1"),
        req(5, 20, "claim", task="u", owner="w1", stage_lease=True, seconds=99), req(6, 21, "claim", task="v", owner="w2", stage_lease=True), req(7, 22, "claim", task="x", owner="w1", stage_lease=True), req(8, 23, "release", task=None, owner="w2"), req(9, 24, "claim", task="x", owner="w1", stage_lease=True),
    ]
    got = {r.seq: r.outcome for r in _fold(spark, rows).collect() if r.kind != "expire"}
    assert got == {1: "claimed", 2: "lease_lost", 3: "claimed", 4: "completed", 5: "reusable", 6: "claimed", 7: "stage_leased", 9: "claimed"}
    leases = claims.stage_outcomes(spark.createDataFrame([tuple(r[n] for n in NAMES) for r in [req(1, 0, "acquire", seconds=5), req(2, 1, "acquire", owner="w2"), req(3, 5, "renew"), req(4, 6, "acquire", owner="w2"), req(5, 7, "release"), req(6, 8, "renew", owner="w2", seconds=1), req(7, 9, "release", owner=None)]], claims.FIELDS))
    assert [r.granted for r in leases.orderBy("seq").collect()] == [True, False, False, True, False, True, True]


def _random(seed, n=300):
    rng, rows, at = random.Random(seed), [], 0
    for i in range(n):
        at += rng.choice([0, 0, 1, 3])
        kind = rng.choice(["claim", "claim", "claim", "heartbeat", "complete", "fail", "acquire", "renew", "release"])
        rows.append(req(i, at, kind, task=f"t{rng.randrange(9)}", owner=rng.choice(["w1", "w2", None]), stage=f"s{rng.randrange(2)}", seconds=rng.choice([1, 4, 20, None]), force=rng.random() < 0.2, stage_lease=rng.random() < 0.5, input=rng.choice(["a", "b", None]), retryable=rng.random() < 0.5, retry_after=rng.choice([None, 2.0])))
        rows[-1]["task"] = f"{rows[-1]['stage']}:{rows[-1]['task']}"
    return rows


def _plain(rows, horizon):
    """One loop over the whole log, tasks and stages together."""
    tasks, stages, out = {}, {}, []
    for r in sorted(rows, key=lambda r: (r["at"], r["seq"])):
        lease = stages.get(r["stage"], claims._NO_LEASE)
        if r["kind"] in claims.STAGE_KINDS:
            stages[r["stage"]] = claims.stage_step(lease, r)[0]
            continue
        s, made = claims.told(tasks.get(r["task"], claims._NEW), r, claims.stage_step(lease, r)[1] if r["stage_lease"] and r["kind"] == "claim" else True)
        if made[-1]["reached"]:
            stages[r["stage"]] = claims.stage_step(lease, r)[0]
        tasks[r["task"]] = s
        out += made
    for t, s in tasks.items():
        if (over := claims.expired(s, horizon)) is not None:
            out.append(claims._row({"seq": None, "stage": t.split(":")[0], "task": t, "owner": None}, over, "expire", over["finished"], "retry_waiting"))
    return out


def _sorted(rows):
    return sorted(map(repr, (tuple((k, v) for k, v in sorted(r.items())) for r in rows)))


@pytest.mark.parametrize("seed", [1, 2])
def test_batch_equals_plain_loop(spark, seed):
    rows = _random(seed)
    horizon = max(r["at"] for r in rows) + 1000 * S
    assert _sorted(r.asDict() for r in _fold(spark, rows, horizon).collect()) == _sorted(_plain(rows, horizon))


def test_stream_equals_batch(spark, tmp_path):
    rows = _random(5, 120)
    horizon = max(r["at"] for r in rows) + 1000 * S
    late = req(10**6, horizon // S + 120, "heartbeat", task="end:x", stage="end")  # moves the watermark past the last lease
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for i, part in enumerate((rows[:50], rows[50:], [late], [late | {"seq": 10**6 + 1}])):
        spark.createDataFrame([tuple(r[n] for n in NAMES) for r in part], claims.FIELDS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log/{i}")
        out = claims.streamed(spark.readStream.schema(claims.FIELDS).option("recursiveFileLookup", True).parquet(f"{tmp_path}/log"))
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").filter("stage <> 'end'").collect()
    assert _sorted(r.asDict() for r in got) == _sorted(_plain(rows, horizon))


def test_empty(spark):
    out = _fold(spark, [req(1, 0, "claim")]).filter("false")
    assert claims.folded(spark.createDataFrame([], claims.FIELDS)).count() == 0 and claims.states(out).count() == 0
