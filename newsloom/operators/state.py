"""Incremental state: upserts, fingerprints, leases, as set operations over tables and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_row(rows: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """The last row of each key by `order`; of rows that tie, or without an order, the greatest as text: never an arbitrary one."""
    by = F.struct(*(F.col(c) for c in order or []), F.to_json(F.struct(*rows.columns)).alias("_text"))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), by).alias("r")).select("r.*")


def latest(log: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The last row of each key: a grouped maximum, combined before the shuffle."""
    return log.groupBy(*keys).agg(F.max_by(F.struct(*log.columns), F.struct(at, tie)).alias("r")).select("r.*")


# What a material change sends back to new.
PROCESSED = ("hotspot", "rejected", "filtered", "ai_failed", "screened_out", "screen_failed", "analysis_filtered", "analysis_failed", "candidate")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], coalesced: list[str], overwritten: list[str], material: list[str], cleared: dict[str, object] | None = None, exempt: Column | None = None) -> DataFrame:
    """Rows of both by key: of `coalesced` columns the new value unless null or empty, of `overwritten` ones the new value.

    Where a `material` column changes, a processed row goes back to status new, and the columns of `cleared` (of the old
    rows) get their values: what an earlier pass decided. Rows for which `exempt` holds (a condition on the sides o and
    n) change without that. One full outer join on the key.
    """
    o, n = old.withColumn("_old", F.lit(True)).alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    both = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    is_new, is_old = F.col("_old").isNull(), F.col("_new").isNull()  # a null key is a key
    given = lambda c: F.when(F.col(f"n.{c}").cast("string") != "", F.col(f"n.{c}"))
    after = {c: F.coalesce(given(c), F.col(f"o.{c}")) for c in coalesced} | {c: F.when(is_old, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")) for c in overwritten}
    changed = F.lit(False)
    for c in material:
        changed = changed | ~after[c].eqNullSafe(F.col(f"o.{c}"))
    again = ~is_new & ~is_old & changed & F.col("o.status").isin(*PROCESSED)
    if exempt is not None:
        again = again & ~F.coalesce(exempt, F.lit(False))
    status = F.when(is_new | again, "new").otherwise(F.col("o.status"))
    kept = [F.when(again, F.lit(v)).otherwise(F.col(f"o.{c}")).alias(c) for c, v in (cleared or {}).items()]
    return both.select(*(F.coalesce(F.col(f"o.{k}"), F.col(f"n.{k}")).alias(k) for k in keys), *(v.alias(c) for c, v in after.items()), status.alias("status"), *kept)


def reusable(tasks: DataFrame, fingerprint: Column) -> DataFrame:
    """Succeeded tasks whose input is the same as now."""
    return tasks.filter((F.col("status") == "succeeded") & F.col("fingerprint").eqNullSafe(fingerprint))


def claimable(tasks: DataFrame, now: Column) -> DataFrame:
    """Pending, failed or waiting tasks that are due, and running ones whose lease is over."""
    open_ = F.col("status").isin("pending", "retry_waiting", "failed") & F.coalesce(F.col("next_retry_at") <= now, F.lit(True))
    return tasks.filter(open_ | ((F.col("status") == "running") & F.coalesce(F.col("lease_expires_at") <= now, F.lit(True))))


def recovered(tasks: DataFrame, now: Column) -> DataFrame:
    """Expired running tasks become retry_waiting, with the reason."""
    gone = (F.col("status") == "running") & (F.col("lease_expires_at") <= now)
    return tasks.withColumn("error_code", F.when(gone, "lease_expired").otherwise(F.col("error_code"))).withColumn("status", F.when(gone, "retry_waiting").otherwise(F.col("status")))


def stage_status(tasks: DataFrame, stage: str) -> DataFrame:
    """A stage's status from its tasks: succeeded if all are done, running if one runs; blocked if one is and none may still
    go on or has failed; failed if one has and none may still go on; else pending."""
    has = lambda *s: F.max(F.col("status").isin(*s).cast("int")) == 1
    done = F.min(F.col("status").isin("succeeded", "skipped", "cancelled").cast("int")) == 1
    status = F.when(done, "succeeded").when(has("running"), "running").when(has("blocked") & ~has("pending", "retry_waiting", "failed"), "blocked")
    return tasks.groupBy(stage).agg(status.when(has("failed") & ~has("pending", "retry_waiting"), "failed").otherwise("pending").alias("status"))


def run_status(stages: DataFrame, run: str, expected: int, finalize: bool = True) -> DataFrame:
    """A run's status from its stages' progress: open while one is missing or active, partial if one is, else completed."""
    n = lambda s: F.count_if(F.col("progress") == s)
    status = F.when((F.count_distinct("stage") < expected) | (n("active") > 0), "running").when(n("partial") > 0, "partial").when(n("succeeded") == F.count(F.lit(1)), "completed" if finalize else "running").otherwise("running")
    return stages.groupBy(run).agg(status.alias("status"))


def failed_task(status: Column, lease_expires_at: Column, retryable: Column, now: Column) -> Column:
    """A running task that fails within its lease waits if it may be retried, else is blocked; a late report changes nothing."""
    late = (status == "running") & F.coalesce(lease_expires_at <= now, F.lit(False))
    return F.when(late, status).when(retryable, "retry_waiting").otherwise("blocked")


def resume_plan(stages: DataFrame, order: list[str]) -> DataFrame:
    """(run, stage): stages with work left whose earlier stages are all done; order: the stages' names."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("stage"))
    left = stages.filter(~F.col("progress").isin("succeeded")).withColumn("_r", rank)
    return left.groupBy("run").agg(F.min_by("stage", "_r").alias("stage"))


def merged_events(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Event upsert: arrays united in first-seen order, highest score, earliest and latest time. One outer join; a null key is one
    like others, as in `upsert`."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}").eqNullSafe(F.col(f"n.{key}")), "full_outer")
    none = F.array().cast("array<string>")
    union = F.array_distinct(F.concat(F.coalesce("o.sources", none), F.coalesce("n.sources", none)))
    return both.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), union.alias("sources"), F.greatest("o.score", "n.score").alias("score"), F.least("o.first_seen", "n.first_seen").alias("first_seen"), F.greatest("o.last_seen", "n.last_seen").alias("last_seen"))


# ---- stages and tasks --------------------------------------------------------------------------

_LEASE_OVER = ("error_category", "error_code", "error_message")


def listed(tasks: DataFrame, now: Column, *, statuses: tuple[str, ...] | None = None, subject_type: str | None = None, input_fingerprint: str | None = None, config_fingerprint: str | None = None, reusable_only: bool = False, with_expired: bool = False) -> DataFrame:
    """Tasks by status, subject and fingerprints; running ones whose lease is over are hidden unless asked for."""
    rows = tasks if statuses is None else tasks.filter(F.col("status").isin(*statuses))
    for name, value in (("subject_type", subject_type), ("input_fingerprint", input_fingerprint), ("config_fingerprint", config_fingerprint), ("status", "succeeded" if reusable_only else None)):
        rows = rows if value is None else rows.filter(F.col(name) == value)
    return rows if with_expired else rows.filter((F.col("status") != "running") | F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") > now))


def run_items(rows: DataFrame, *, roles: tuple[str, ...] | None = None, statuses: tuple[str, ...] | None = None) -> DataFrame:
    """A run's items by role and status, in the order in which they joined it."""
    rows = rows if roles is None else rows.filter(F.col("role").isin(*roles))
    rows = rows if statuses is None else rows.filter(F.col("status").isin(*statuses))
    return rows.orderBy("run_item_id")


def remaining(tasks: DataFrame, fingerprint: Column, limit: int | None) -> tuple[DataFrame, Column]:
    """(tasks left to do, the first `limit` by id; whether more are left): reusable ones are dropped before the limit."""
    left = tasks.filter(~((F.col("status") == "succeeded") & F.col("fingerprint").eqNullSafe(fingerprint)))
    if limit is None:
        return left, F.lit(False)
    return left.orderBy("task_id").limit(limit), F.lit(not left.orderBy("task_id").offset(limit).isEmpty())


def acquired(stages: DataFrame, owner: str, now: Column, seconds: int = 300) -> DataFrame:
    """Stages after `owner` asks for their lease: one that another holds stays as it is (acquired is false). A stage that
    wasn't running, or whose lease was over, starts anew and counts an attempt."""
    active = F.coalesce(F.col("lease_owner").isNotNull() & (F.col("lease_expires_at") > now), F.lit(False))
    ours = ~(active & (F.col("lease_owner") != owner))
    starts = ours & ((F.col("status") != "running") | F.coalesce(F.col("lease_expires_at") <= now, F.lit(False)))
    over = F.col("status").isin("succeeded", "failed", "blocked", "cancelled", "skipped")
    return stages.withColumns({
        "acquired": ours, "lease_owner": F.when(ours, owner).otherwise(F.col("lease_owner")), "lease_expires_at": F.when(ours, now + F.make_dt_interval(secs=F.lit(max(1, seconds)))).otherwise(F.col("lease_expires_at")),
        "status": F.when(starts, "running").otherwise(F.col("status")), "started_at": F.when(starts, F.coalesce("started_at", now)).otherwise(F.col("started_at")), "attempt_count": F.coalesce("attempt_count", F.lit(0)) + starts.cast("int"),
        "finished_at": F.when(starts & over, None).otherwise(F.col("finished_at")),
    })


def heartbeat(stages: DataFrame, owner: str, now: Column, seconds: int = 300) -> DataFrame:
    """Leases of `owner` that aren't over run on; `renewed` says which."""
    ours = F.coalesce((F.col("lease_owner") == owner) & (F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") > now)), F.lit(False))
    return stages.withColumns({"renewed": ours, "lease_expires_at": F.when(ours, now + F.make_dt_interval(secs=F.lit(max(1, seconds)))).otherwise(F.col("lease_expires_at"))})


def released(stages: DataFrame, owner: str, status: str | None = None) -> DataFrame:
    """Leases of `owner`, or of nobody, end; with `status` the stage takes it."""
    ours = F.col("lease_owner").isNull() | (F.col("lease_owner") == owner)
    out = stages.withColumn("lease_expires_at", F.when(~ours, F.col("lease_expires_at")))
    if status:
        out = out.withColumn("status", F.when(ours, status).otherwise(F.col("status")))
    return out.withColumn("lease_owner", F.when(~ours, F.col("lease_owner")))


def retried(tasks: DataFrame, *, blocked: bool = False, ids: DataFrame | None = None, reset_attempts: bool = False) -> DataFrame:
    """Failed and waiting tasks (with `blocked` those too; of `ids` only) go back to pending, without error, lease and due time."""
    again = F.col("status").isin("failed", "retry_waiting", *(("blocked",) if blocked else ()))
    rows = tasks
    if ids is not None:
        rows = rows.join(ids.select("task_id", F.lit(True).alias("_asked")).distinct(), "task_id", "left")
        again = again & F.coalesce("_asked", F.lit(False))
    return _pending(rows, again, reset_attempts).select(*tasks.columns)


def _pending(tasks: DataFrame, again: Column, reset_attempts: bool, *more: str) -> DataFrame:
    gone = [c for c in ("next_retry_at", "lease_owner", "lease_expires_at", "heartbeat_at", *_LEASE_OVER, *more) if c in tasks.columns]
    out = tasks.withColumn("_again", again).withColumns({c: F.when(~F.col("_again"), F.col(c)) for c in gone})
    if reset_attempts and "attempt_count" in tasks.columns:
        out = out.withColumn("attempt_count", F.when(F.col("_again"), 0).otherwise(F.col("attempt_count")))
    return out.withColumn("status", F.when(F.col("_again"), "pending").otherwise(F.col("status"))).drop("_again")


def reset(tasks: DataFrame, *, succeeded: bool = False, reset_attempts: bool = False) -> DataFrame:
    """All tasks go back to pending, succeeded ones only if asked; results go with them."""
    again = F.lit(True) if succeeded else F.col("status") != "succeeded"
    return _pending(tasks, again, reset_attempts, "result")


def busy(stages: DataFrame, tasks: DataFrame, now: Column) -> DataFrame:
    """(run, stage): stages that somebody works on: a lease that isn't over, or a running task whose isn't."""
    held = stages.filter(F.col("lease_owner").isNotNull() & (F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") > now))).select("run", "stage")
    going = tasks.filter((F.col("status") == "running") & (F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") > now))).select("run", "stage")
    return held.unionByName(going).distinct()


def invalidated(stages: DataFrame, tasks: DataFrame, rebuilt: DataFrame, order: list[str], now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stages, tasks, refused) after (run, stage) of `rebuilt` are built anew: later stages of the run go with their tasks,
    unless one of them is busy, in which case the run is refused and keeps all. order: the stages' names."""
    place = lambda c: F.array_position(F.array(*map(F.lit, order)), c)
    up = rebuilt.groupBy("run").agg(F.min(place(F.col("stage"))).alias("_up"))
    later = lambda rows: rows.join(up, "run").filter(place(F.col("stage")) > F.col("_up")).drop("_up")
    refused = later(busy(stages, tasks, now)).groupBy("run").agg(F.array_sort(F.collect_set("stage")).alias("stages"))
    gone = later(stages.select("run", "stage")).join(refused.select("run"), "run", "left_anti")
    keep = lambda rows: rows.join(gone, ["run", "stage"], "left_anti").select(*rows.columns)
    return keep(stages), keep(tasks), refused


def first_payloads(attempts: DataFrame, key: str, at: str, payload: str) -> DataFrame:
    """(key, payload, its sha-256): the first payload that isn't null stays, whatever later attempts bring."""
    got = attempts.filter(F.col(payload).isNotNull()).groupBy(key).agg(F.min_by(payload, F.struct(at, payload)).alias(payload))
    return got.withColumn("payload_hash", F.sha2(payload, 256))


def replayed(steps: DataFrame, session: str = "session") -> DataFrame:
    """(session, searches, queries, last_sequence): an agent's search state from its step log, in order of sequence.
    steps: (session, sequence, kind, tool_name, input)."""
    hits = F.array_sort(F.collect_list(F.when((F.col("kind") == "tool_call") & (F.col("tool_name") == "search_web"), F.struct("sequence", "input"))))
    out = steps.groupBy(session).agg(hits.alias("h"), F.max("sequence").alias("last_sequence"))
    return out.select(session, F.size("h").alias("searches"), F.array_distinct(F.transform("h", lambda x: x["input"])).alias("queries"), "last_sequence")


# ---- rows by key -------------------------------------------------------------------------------

def last_rows(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """New rows over old ones of the same key; others stay. For sources, screenings, analyses: one row a key, of several new
    ones the last by `order`."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(one_row(new, keys, order), allowMissingColumns=True)


def source_columns(specs: DataFrame) -> DataFrame:
    """Sources as stored: nested feed and github options as columns, the name defaults to the id, the group to general."""
    feed, git = F.col("feed"), F.col("github")
    nested = {"feed_format": feed["format"], "feed_adapter": feed["adapter"], **{f"github_{k}": git[k] for k in ("mode", "query", "sort", "order", "pushed_days", "period")}}
    kept = ("transport", "url", "enabled", "priority", "fetch_interval", "default_limit", "account_url", "content_class")
    filled = lambda c, d: F.coalesce(F.when(F.col(c) != "", F.col(c)), d)
    return specs.select("id", filled("name", F.col("id")).alias("name"), filled("source_group", F.lit("general")).alias("source_group"), *kept, *(v.alias(k) for k, v in nested.items()))


def source_specs(rows: DataFrame) -> DataFrame:
    """The reverse: nested options out of the columns, those of the other transports null."""
    feed = F.when(F.col("transport").isin("feed", "rsshub"), F.struct(F.coalesce("feed_format", F.lit("rss")).alias("format"), F.coalesce("feed_adapter", F.lit("generic")).alias("adapter")))
    git = F.when(F.col("transport") == "github", F.struct(*(F.col(f"github_{k}").alias(k) for k in ("mode", "query", "sort", "order", "pushed_days", "period"))))
    return rows.select("id", "name", "source_group", "transport", "url", "enabled", "priority", "fetch_interval", "default_limit", "account_url", "content_class", feed.alias("feed"), git.alias("github"))


def event_members(old: DataFrame, new: DataFrame, items: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(event_id, item_id, source_id, source_group, source_url, source_title, identity_key, match_type, is_primary): an item is
    in one event at most, so a new row moves it there (of several the last by `order`); what the new row leaves open stays,
    else comes from the item. One outer join on the item."""
    o, n = old.alias("o"), one_row(new, ["item_id"], order).alias("n")
    both = o.join(n, F.col("o.item_id") == F.col("n.item_id"), "full_outer").withColumn("_item", F.coalesce("n.item_id", "o.item_id"))
    i = items.select(F.col("item_id").alias("_item"), F.col("source_id").alias("_source"), F.col("source_group").alias("_group"), F.coalesce("canonical_url", "source_url").alias("_url"), F.col("title").alias("_title"))
    rows = both.join(i, "_item", "left")
    first = lambda name, *rest: F.coalesce(F.col(f"n.{name}"), F.col(f"o.{name}"), *map(F.col, rest)).alias(name)
    moved = F.col("n.item_id").isNotNull()
    kept = lambda name, default: F.when(moved, F.coalesce(F.col(f"n.{name}"), F.lit(default))).otherwise(F.col(f"o.{name}")).alias(name)
    return rows.select(first("event_id"), F.col("_item").alias("item_id"), first("source_id", "_source"), first("source_group", "_group"), F.coalesce("o.source_url", "_url").alias("source_url"), F.coalesce("o.source_title", "_title").alias("source_title"), first("identity_key"), kept("match_type", "deterministic"), kept("is_primary", False))


def replaced_admissions(old: DataFrame, new: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(admissions, errors): the runs that `new` holds are replaced whole. Ranks are 1 at least, scores 0 to 100; a decision
    must be known and the item of the same build, else the row is an error (and its run keeps what it had)."""
    scope = items.select("item_id", F.col("build_id").alias("_build")).distinct()
    rows = new.withColumn("decision", F.coalesce(F.when(F.trim("decision") != "", F.trim("decision")), F.lit("filtered"))).join(scope, "item_id", "left")
    error = F.when(F.col("item_id").isNull(), "missing_item_id").when(~F.col("_build").eqNullSafe(F.col("run_id")), "outside_run").when(~F.col("decision").isin("active", "reserve", "filtered"), "unsupported_decision")
    rows = rows.withColumn("error", error)
    errors = rows.filter("error is not null").select("run_id", "item_id", "error")
    fine = rows.join(errors.select("run_id").distinct(), "run_id", "left_anti")
    text = lambda c: F.coalesce(F.trim(c), F.lit("")).alias(c)
    fine = fine.select("run_id", "item_id", "decision", F.when(F.col("rank").isNotNull(), F.greatest(F.lit(1), F.col("rank"))).alias("rank"), F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce("guarded_score", F.lit(0)))).alias("guarded_score"), text("reason_code"), text("reason"))
    return old.join(fine.select("run_id").distinct(), "run_id", "left_anti").select(*fine.columns).unionByName(fine), errors


def with_status(rows: DataFrame, changes: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """Rows with the status that `changes` (key, status, …) gives them: of several the last by `order`."""
    new = one_row(changes, [key], order).select(key, F.col("status").alias("_status"))
    return rows.join(new, key, "left").withColumn("status", F.coalesce("_status", "status")).drop("_status").select(*rows.columns)


COUNTERS = ("fetched", "inserted", "screened", "screened_out", "screen_failed", "analyzed", "analysis_filtered", "analysis_failed", "candidate", "failed")


def finished_runs(runs: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Runs with their results (run_id, status, counters, selected, partial, partial_reason, error): counters that a result
    has replace the run's; selected falls back to candidate; errors are cut at 4000."""
    r = results.select("run_id", *(F.col(c).alias(f"_{c}") for c in results.columns if c != "run_id"), F.lit(True).alias("_done"))
    rows = runs.join(r, "run_id", "left")
    has = lambda c: F.col(f"_{c}") if f"_{c}" in r.columns else F.lit(None)
    out = {c: F.coalesce(has(c), F.col(c)) for c in ("status", "partial", *COUNTERS)}
    out["selected"] = F.coalesce(has("selected"), has("candidate"), F.col("selected"))
    out["partial_reason"] = F.coalesce(F.when(F.trim(has("partial_reason").cast("string")) != "", F.trim(has("partial_reason").cast("string"))), F.col("partial_reason"))
    out["error"] = F.when(F.col("_done"), F.substring(has("error").cast("string"), 1, 4000)).otherwise(F.col("error"))
    out["finished_at"] = F.when(F.col("_done"), now).otherwise(F.col("finished_at"))
    return rows.withColumns(out).select(*runs.columns)


def finished_attempts(attempts: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Attempts with their results (attempt_id, status, items_fetched, http_status, error): an error's code is what stands
    before its first colon."""
    from ..functions import text

    r = results.select("attempt_id", F.col("status").alias("_status"), F.col("items_fetched").alias("_items"), F.col("http_status").alias("_http"), F.col("error").alias("_error"))
    rows = attempts.join(r, "attempt_id", "left")
    done = F.col("_status").isNotNull()
    out = {"status": F.coalesce("_status", "status"), "items_fetched": F.coalesce("_items", "items_fetched"), "http_status": F.coalesce("_http", "http_status"), "error_code": F.coalesce("error_code", text.error_code(F.col("_error"))), "error_message": F.coalesce(F.substring("_error", 1, 4000), F.col("error_message")), "finished_at": F.when(done, now).otherwise(F.col("finished_at"))}
    return rows.withColumns(out).select(*attempts.columns)


def source_state(sources: DataFrame, attempts: DataFrame, base: int = 60, cap: int = 86_400) -> DataFrame:
    """Sources with health, failures in a row and back-off out of their attempt log; skipped attempts change nothing.
    attempts: (source_id, attempt_id, at, status: success, degraded, failed or skipped)."""
    from ..functions import dates
    from .ranking import failure_streaks

    rows = failure_streaks(attempts.filter("status <> 'skipped'"), "source_id", "at", "attempt_id", F.col("status") == "failed")
    last = rows.groupBy("source_id").agg(F.max_by(F.struct("status", "streak", "at"), F.struct("at", "attempt_id")).alias("l"))
    health = F.when(F.col("l.status") == "failed", "failed").when(F.col("l.status") == "degraded", "degraded").otherwise("healthy")
    state = last.select(F.col("source_id").alias("id"), health.alias("health_status"), F.col("l.streak").cast("long").alias("consecutive_failures"), F.col("l.at").alias("last_fetched_at"), F.when(F.col("l.streak") > 0, F.col("l.at") + F.make_dt_interval(secs=F.least(F.lit(cap), dates.backoff_seconds(F.col("l.streak"), base, cap)))).alias("backoff_until"))
    return sources.join(state, "id", "left").withColumn("health_status", F.coalesce("health_status", F.lit("unknown"))).withColumn("consecutive_failures", F.coalesce("consecutive_failures", F.lit(0).cast("long")))


def finished_fetches(sources: DataFrame, attempts: DataFrame, results: DataFrame, now: Column, base: int = 60, cap: int = 86_400) -> tuple[DataFrame, DataFrame]:
    """(attempts, sources) after fetches ended, in one step: attempts with their results, and of their log the sources' health,
    streaks and back-off. An attempt that was skipped leaves its source as it was, so it never wipes out a failure."""
    ended = finished_attempts(attempts, results, now)
    log = ended.filter("finished_at is not null").select("source_id", "attempt_id", F.col("finished_at").alias("at"), "status")
    kept = [c for c in sources.columns if c not in ("health_status", "consecutive_failures", "last_fetched_at", "backoff_until")]
    return ended, source_state(sources.select(*kept), log, base, cap)


def without_build(tables: dict[str, DataFrame], run_id: int) -> dict[str, DataFrame]:
    """Every table without a build's rows (column build_id or run_id): its items, events, stages, tasks, admissions."""
    return {n: t.filter(~F.coalesce(F.col("build_id" if "build_id" in t.columns else "run_id") == run_id, F.lit(False))) for n, t in tables.items()}


def without_events(evidence: DataFrame, events: DataFrame) -> DataFrame:
    """Evidence whose event is cleared stays, without one."""
    gone = events.select("event_id", F.lit(True).alias("_gone"))
    return evidence.join(gone, "event_id", "left").withColumn("event_id", F.when(F.col("_gone").isNull(), F.col("event_id"))).select(*evidence.columns)


def lease_seconds(turns: Column, per_turn: int, least: int, most: int) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), turns * per_turn))
