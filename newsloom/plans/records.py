"""Public projections: event packages, report records, envelopes, candidates; a build's funnel; the digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import policy
from ..operators.entities import identity_keys
from ..operators.events import related_hints, url_of

_STRINGS = "array<string>"
#: Cap of a candidate's body.
BODY = 16_000


def _strings(c: Column) -> Column:
    """Trimmed, without blanks, distinct, in order."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast(_STRINGS)), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def package(events: DataFrame) -> DataFrame:
    """The eleven fields that selection gets of an event. events: (event_id, title, summary_cn, topic, source_group,
    source_groups, risk_flags, review_state, novelty_status, draft: struct of event_family_key, facts, publishability,
    history_status, caveats)."""
    groups = _strings(F.col("source_groups"))
    lone = text.trimmed_or_null(F.col("source_group"))
    blockers, caveats, _ = policy.routed_flags(_strings(F.col("risk_flags")))
    more = F.filter(_strings(F.col("draft.caveats")), lambda x: ~x.isin(*policy.AUDIT_ONLY))
    novelty = F.lower(F.coalesce("novelty_status", F.lit("")))
    history = F.when(novelty.isin("updated", "meaningful_update"), "meaningful_update").when(novelty.isin("new", "repeat", "uncertain"), novelty).otherwise("")
    filled = lambda c, other: F.coalesce(F.when(c != "", c), other)
    none = F.lit("")
    return events.select(
        "event_id", F.coalesce("title", none).alias("title"), F.coalesce("summary_cn", none).alias("summary_cn"), F.coalesce("draft.event_family_key", none).alias("event_family_key"), F.col("draft.facts").alias("facts"),
        filled(F.col("draft.publishability"), F.coalesce("review_state", none)).alias("publishability"), filled(F.trim("draft.history_status"), history).alias("history_status"), "topic",
        F.when(F.size(groups) > 0, groups).when(lone.isNotNull(), F.array(lone)).otherwise(groups).alias("source_groups"), blockers.alias("eligibility_blockers"), F.array_union(caveats, more).alias("editorial_caveats"),
    )


def records(events: DataFrame, members: DataFrame, items: DataFrame, sources: DataFrame, screens: DataFrame, decisions: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """One public record an event that was selected, with its references, screening audit and verified evidence.

    events: (event_id, event_key, display_score, topic, content_class, source_group, source_ids, source_groups, title,
    summary_cn, canonical_url, novelty_status, risk_flags, keywords, review_state, resolution_confidence, first_seen_at,
    last_seen_at); members: (event_id, item_id, source_id, source_group, source_url, source_title, match_type,
    match_confidence, is_primary); items: (item_id, title, canonical_url, summary, summary_cn, content_text, content_depth,
    status, published_at, captured_at); screens: (item_id, decision, reason_code, confidence); decisions: (event_id,
    display_order, reason_code, reason). Members are gathered by event once; an event's are a few.
    """
    i = items.select(F.col("item_id").alias("_i"), *(F.col(c).alias(f"i_{c}") for c in items.columns if c != "item_id"))
    rows = members.join(i, F.col("item_id") == F.col("_i"), "left").join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("source_group").alias("_group")), "source_id", "left")
    rows = rows.join(screens.select(F.col("item_id").alias("_s"), F.struct("decision", "reason_code", "confidence").alias("screen")), F.col("item_id") == F.col("_s"), "left")
    plain = lambda c: F.when(c != "", text.plain(c))
    summary = F.coalesce(F.when(F.col("i_summary_cn") != "", F.col("i_summary_cn")), F.col("i_summary"))
    ref = F.struct(
        "item_id", "source_id", "source_name", F.coalesce("source_group", "_group").alias("source_group"), F.coalesce("source_url", "i_canonical_url").alias("source_url"), F.coalesce("source_title", "i_title").alias("title"), "match_type", "match_confidence", "is_primary",
        plain(summary).alias("ai_summary"), plain(F.col("i_summary")).alias("source_summary"), plain(F.col("i_content_text")).alias("content_text"), F.col("i_content_depth").alias("content_depth"),
    )
    rows = rows.select("event_id", ref.alias("ref"), F.when(F.col("screen").isNotNull(), F.struct("item_id", "screen.decision", "screen.reason_code", "screen.confidence")).alias("audit"), F.col("i_status").alias("status"), F.when(F.col("is_primary"), F.struct(F.col("i_published_at").alias("p"), F.col("i_captured_at").alias("c"))).alias("lead"))
    inner = rows.groupBy("event_id").agg(F.array_sort(F.collect_list("ref")).alias("source_refs"), F.array_sort(F.collect_list("audit")).alias("screen_audit"), F.array_sort(F.collect_set("status")).alias("member_statuses"), F.max("lead").alias("_lead"))
    out = events.join(decisions.select("event_id", "display_order", F.col("reason_code").alias("_code"), F.col("reason").alias("_reason")), "event_id").join(inner, "event_id", "left")
    picked = lambda f: F.filter(F.transform("source_refs", lambda r: r[f]), lambda x: x.isNotNull() & (x != ""))
    none = F.array().cast(_STRINGS)
    united = lambda own, f: F.array_distinct(F.concat(F.coalesce(F.col(own), none), F.coalesce(picked(f), none)))
    novelty = F.lower(F.coalesce("novelty_status", F.lit("unknown")))
    kind = F.when(novelty.isin("new", "updated", "repeat", "unknown"), novelty).otherwise("unknown")
    code, reason = F.coalesce(F.when(F.col("_code") != "", F.col("_code")), F.lit("selected")), F.trim(F.coalesce("_reason", F.lit("")))
    groups = united("source_groups", "source_group")
    out = out.select(
        F.lit("intel_event").alias("record_type"), F.lit("stage_d").alias("stage"), "event_key", "event_id", F.col("event_id").alias("id"), "display_order", F.lit(True).alias("selected"), F.lit("selected").alias("status"), F.coalesce("display_score", F.lit(0)).cast("double").alias("display_score"),
        "topic", "content_class", F.coalesce("source_group", F.get(groups, F.lit(0))).alias("source_group"), groups.alias("source_groups"), united("source_ids", "source_id").alias("source_ids"), "title", F.col("title").alias("original_title"), F.col("summary_cn").alias("summary"), "summary_cn",
        F.col("canonical_url").alias("url"), "canonical_url", F.struct(kind.alias("kind")).alias("provenance"), F.coalesce("risk_flags", none).alias("risk_flags"), reason.alias("reason"), code.alias("reason_code"), F.struct(code.alias("reason_code"), reason.alias("reason"), F.struct(kind.alias("kind")).alias("provenance")).alias("metadata"),
        "keywords", "source_refs", "review_state", F.coalesce("resolution_confidence", F.lit(0)).cast("int").alias("resolution_confidence"), "member_statuses", "screen_audit", "first_seen_at", "last_seen_at", F.col("_lead.p").alias("published_at"), F.col("_lead.c").alias("captured_at"),
    )
    if evidence is None:
        return out
    refs = evidence.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("url", "host", "claim", "excerpt"))).alias("verification_refs"))
    return out.join(refs, "event_id", "left")


def envelope(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Items as a provider gets them, with what is wrong (structural_error) where one can't be sent."""
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "source_group", F.col("content_class").alias("source_content_class"))
    rows = items.join(s, "source_id", "left")
    blank = lambda c: ~F.coalesce(F.trim(c) != "", F.lit(False))
    error = F.when(blank(F.col("source_id")) | blank(F.col("title")) | blank(F.col("content_hash")), "item failed the structural prefilter").when(F.col("source_name").isNull(), "unknown source")
    return rows.select(F.col("item_id").cast("string").alias("item_id"), "source_id", "source_name", "source_group", F.coalesce("content_class", "source_content_class").alias("source_content_class"), "external_id", "content_hash", text.plain(F.col("title")).alias("title"), F.coalesce("canonical_url", "source_url").alias("url"), "published_at", "captured_at", text.plain(F.col("summary")).alias("summary"), text.plain(F.col("content_text")).alias("body_text"), error.alias("structural_error"))


def candidates(admissions: DataFrame, items: DataFrame, reviews: DataFrame, sources: DataFrame, full: bool = False) -> DataFrame:
    """Admitted items as clustering gets them; with `full` also body (16,000 characters) and class. All joins are outer."""
    r = reviews.select("item_id", F.col("summary_cn").alias("r_summary"), F.col("topic").alias("r_topic"), F.col("keywords").alias("r_keywords"))
    rows = admissions.join(items, "item_id", "left").join(r, "item_id", "left").join(sources.select(F.col("id").alias("source_id"), "source_group"), "source_id", "left")
    url = url_of(F.col("canonical_url"), F.col("source_url"))
    out = [
        F.col("item_id").alias("id"), F.col("decision").alias("bucket"), "rank", "guarded_score", "title", F.coalesce("r_summary", "summary").alias("summary_cn"), F.col("r_topic").alias("topic"), F.coalesce("r_keywords", F.array().cast(_STRINGS)).alias("keywords"), url.alias("canonical_url"), "external_id",
        identity_keys(F.col("external_id"), url).alias("identity_keys"), related_hints(F.col("external_id"), url).alias("related_identity_hints"), F.coalesce("published_at", "captured_at").alias("published_at"), F.struct(F.col("source_id").alias("id"), F.col("source_group").alias("group"), "content_class").alias("source"),
    ]
    if full:
        filled = lambda c: F.when(F.col(c) != "", F.col(c))
        out += [F.substring(F.coalesce(filled("content_text"), filled("summary"), filled("title"), F.lit("")), 1, BODY).alias("content_text"), "source_url", "content_class"]
    return rows.select(*out)


def admissions_listed(admissions: DataFrame, items: DataFrame, sources: DataFrame, reviews: DataFrame, decisions: tuple[str, ...] | None = None) -> DataFrame:
    """Admissions with item, source and review (outer joins), by decision, rank (none last), item."""
    rows = admissions if decisions is None else admissions.filter(F.col("decision").isin(*decisions))
    rows = rows.join(items, "item_id", "left").join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id", "left").join(reviews.select("item_id", "topic"), "item_id", "left")
    return rows.orderBy("decision", F.asc_nulls_last("rank"), "item_id")


def drafts(plan: DataFrame) -> DataFrame:
    """Plan events as drafts to keep, and what a view shows of them."""
    given = lambda c, d: F.coalesce(F.when(F.col(c) != "", F.col(c)), d)
    return plan.select(
        F.col("event_key").alias("draft_key"), "item_ids", "title", "summary_cn", given("topic", F.lit("technology_insight")).alias("topic"), given("novelty_status", F.lit("uncertain")).alias("novelty_status"), "prior_event_key",
        given("review_state", given("publishability", F.lit("candidate"))).alias("review_state"), F.col("caveats").alias("risk_flags"), F.struct(F.lit("responses_agent_plan_commit").alias("saved_by"), "event_family_key", "facts", "history_status", "publishability", "split_reason", "caveats").alias("metadata"),
    )


# ---- a build's summary -------------------------------------------------------------------------

TASK_STATUSES = ("pending", "running", "succeeded", "failed", "retry_waiting", "blocked", "skipped", "cancelled")


def task_counts(tasks: DataFrame, export_status: str | None = None) -> DataFrame:
    """(run, stage, total, one count a status). With `export_status` the running export tasks count as that already."""
    status = F.col("status")
    if export_status:
        status = F.when((F.col("stage") == "export") & (status == "running"), "succeeded" if export_status == "succeeded" else "failed").otherwise(status)
    return tasks.groupBy("run", "stage").agg(F.count(F.lit(1)).alias("total"), *(F.count_if(status == s).alias(s) for s in TASK_STATUSES))


def first_errors(stages: DataFrame, tasks: DataFrame) -> DataFrame:
    """(run, stage, category, code, message): the stage's own error, else that of its first task by id that has one."""
    cols = ("error_category", "error_code", "error_message")
    some = F.coalesce(*(F.when(F.col(c) != "", F.lit(True)) for c in cols)).isNotNull()
    rows = stages.select("run", "stage", F.lit(-1).cast("long").alias("task_id"), *cols).unionByName(tasks.select("run", "stage", F.col("task_id").cast("long"), *cols)).filter(some)
    best = rows.groupBy("run", "stage").agg(F.min_by(F.struct(*cols), "task_id").alias("e"))
    filled = lambda c: F.coalesce(F.when(F.col(f"e.{c}") != "", F.col(f"e.{c}")), F.lit("unknown"))
    return best.select("run", "stage", filled("error_category").alias("category"), filled("error_code").alias("code"), text.truncated(F.col("e.error_message")).alias("message"))


def funnel(runs: DataFrame, tasks: DataFrame, run_items: DataFrame, stages: DataFrame) -> DataFrame:
    """One row a run with the counters of its funnel and their fall-backs.

    tasks: (run, stage, task_id, subject_type, status, result: struct of reason, decision, filtered, selected_count,
    below_min_score, analysis_filtered, missing_item, missing_review, event_ids, candidate_event_ids, selected); run_items:
    (run, status); stages: (run, stage, fetched, inserted, candidate_count, too_old, future_timestamp,
    missing_published_at: what the stage's own metadata counts). Each table is grouped by run once; no windows.
    """
    t, r = tasks, F.col("result")
    at = lambda s: F.col("stage") == s
    ok, failed = F.col("status") == "succeeded", F.col("status").isin("failed", "retry_waiting", "blocked")
    reason = F.when(at("screen") & (F.col("status") == "skipped"), _time_reason(r["reason"]))
    decision = F.lower(F.coalesce(r["decision"], F.lit("")))
    whole = (F.col("subject_type") == "run") & ok
    first = lambda cond, value: F.min_by(value, F.when(cond, F.col("task_id")))
    reasons = ("too_old", "future_timestamp", "missing_published_at")
    by_task = t.groupBy("run").agg(
        F.count_if(at("screen")).alias("screen_tasks"), F.count_if(at("screen") & (F.col("status") == "skipped")).alias("screen_skipped"), *(F.count_if(reason == x).alias(f"t_{x}") for x in reasons),
        F.count_if(at("screen") & ok & decision.isin("pass", "uncertain")).alias("stage_a_pass"), F.count_if(at("screen") & ok & decision.isin("reject", "excluded")).alias("a_rejected"), F.count_if(at("screen") & failed).alias("a_failed"),
        F.count_if(at("analyze") & (F.col("subject_type") == "item") & ok & F.coalesce(r["filtered"], F.lit(False))).alias("b_filtered"), F.count_if(at("analyze") & (F.col("subject_type") == "item") & ok & ~F.coalesce(r["filtered"], F.lit(False))).alias("b_good"), F.count_if(at("analyze") & failed).alias("b_failed"),
        *(first(at("cluster") & whole & r["selected_count"].isNotNull(), r[x]).alias(f"c_{x}") for x in ("selected_count", "below_min_score", "analysis_filtered", "missing_item", "missing_review")),
        F.size(F.array_distinct(F.coalesce(first(at("cluster") & (F.col("subject_type") == "run"), r["event_ids"]), F.array().cast("array<bigint>")))).alias("stage_c_events"),
        F.coalesce(F.size(first(at("stage_d") & whole, r["candidate_event_ids"])), F.lit(0)).alias("stage_d_total"), F.coalesce(F.size(first(at("stage_d") & whole, r["selected"])), F.lit(0)).alias("stage_d_selected"),
    )
    items = run_items.groupBy("run").agg(F.count(F.lit(1)).alias("frozen"), *(F.count_if(F.col("status") == s).alias(f"i_{s}") for s in ("screened_out", "screen_failed", "candidate", "analysis_filtered", "analysis_failed")))
    meta = stages.groupBy("run").agg(*(F.max(F.when(at(s), F.col(c))).alias(f"m_{c}") for s, c in (("fetch", "fetched"), ("fetch", "inserted"), ("stage_d", "candidate_count"), *(("screen", x) for x in reasons))))
    rows = runs.select("run").join(by_task, "run", "left").join(items, "run", "left").join(meta, "run", "left").na.fill(0)
    c = F.col
    timed = c("t_too_old") + c("t_future_timestamp") + c("t_missing_published_at")
    by_reason = {x: F.when(timed > 0, c(f"t_{x}")).otherwise(F.greatest(F.lit(0), c(f"m_{x}"))) for x in reasons}
    excluded = by_reason["too_old"] + by_reason["future_timestamp"] + by_reason["missing_published_at"]
    analyzed = c("b_good") + c("b_filtered")
    or_ = lambda a, b: F.when(a != 0, a).otherwise(b)
    window = F.when(c("screen_tasks") > 0, c("screen_tasks") - c("screen_skipped")).otherwise(c("frozen") - excluded)
    return rows.select(
        "run", or_(c("m_fetched"), c("frozen")).alias("fetched"), or_(c("m_inserted"), c("frozen")).alias("inserted"), "frozen", F.greatest(F.lit(0), window).alias("within_stage_a_window"), excluded.alias("time_excluded"), *(v.alias(k) for k, v in by_reason.items()),
        "stage_a_pass", or_(c("i_screened_out"), c("a_rejected")).alias("stage_a_excluded"), F.greatest("i_screen_failed", "a_failed").alias("stage_a_failed"), or_(analyzed, c("i_candidate")).alias("stage_b_analyzed"), or_(c("b_filtered"), c("i_analysis_filtered")).alias("stage_b_structurally_filtered"),
        F.greatest("i_analysis_failed", "b_failed").alias("stage_b_failed"), c("c_selected_count").alias("stage_c_input_selected"), c("c_below_min_score").alias("stage_c_input_below_min_score"), c("c_analysis_filtered").alias("stage_c_input_structurally_filtered"), (c("c_missing_item") + c("c_missing_review")).alias("stage_c_input_invalid_contract"),
        "stage_c_events", "stage_d_total", F.greatest("stage_d_total", "m_candidate_count").alias("stage_d_candidate_count"), "stage_d_selected", c("frozen").alias("full_rebuild_items"),
    )


def _time_reason(value: Column) -> Column:
    from ..functions import dates

    return dates.time_exclusion(value)


def selection(tasks: DataFrame, stages: DataFrame) -> DataFrame:
    """(run, event_id, display_order, reason_code, reason, error): the selection that a finished stage D left, in its order.
    A run whose stage isn't done, has an open or failed task, no run task, or a selection that is no partition of its
    candidates gives one row with the error. tasks: (run, stage, subject_type, status, result: struct of
    candidate_event_ids, selected: array of struct of event_id, reason_code, reason, unselected: array of ids)."""
    mine = tasks.filter("stage = 'stage_d'")
    open_ = F.count_if(F.col("status").isin("pending", "running", "retry_waiting", "failed", "blocked"))
    done = mine.groupBy("run").agg(open_.alias("open"), F.count_if(F.col("subject_type") == "run").alias("n"), F.max(F.when(F.col("subject_type") == "run", F.col("result"))).alias("r"))
    rows = stages.filter("stage = 'stage_d'").select("run", F.col("status").alias("stage_status")).join(done, "run", "left")
    chosen = F.transform("r.selected", lambda x: x["event_id"])
    both = F.concat(chosen, F.coalesce("r.unselected", F.array().cast("array<bigint>")))
    whole = (F.size(both) == F.size("r.candidate_event_ids")) & (F.size(F.array_distinct(both)) == F.size(both)) & (F.size(F.array_except(both, "r.candidate_event_ids")) == 0)
    error = F.when((F.col("stage_status") != "succeeded") | (F.coalesce("open", F.lit(0)) > 0), "stage_d_incomplete").when(F.coalesce("n", F.lit(0)) != 1, "run_task_missing").when(~F.coalesce(whole, F.lit(False)), "invalid_selection")
    rows = rows.withColumn("error", error)
    none = F.lit(None)
    bad = rows.filter("error is not null").select("run", none.cast("bigint").alias("event_id"), none.cast("int").alias("display_order"), none.cast("string").alias("reason_code"), none.cast("string").alias("reason"), "error")
    good = rows.filter("error is null").select("run", F.posexplode("r.selected").alias("p", "s")).select("run", "s.event_id", (F.col("p") + 1).alias("display_order"), "s.reason_code", "s.reason", none.cast("string").alias("error"))
    return good.unionByName(bad)


def source_details(statuses: DataFrame, kinds: tuple[str, ...] = ("failed", "degraded")) -> DataFrame:
    """(run, status, sources): per run and status the sources with their errors, by id. A run has a few hundred sources."""
    rows = statuses.filter(F.col("status").isin(*kinds))
    return rows.groupBy("run", "status").agg(F.array_sort(F.collect_list(F.struct("source_id", text.error_code(F.col("error")).alias("code")))).alias("sources"))


# What the digest reads.
DIGEST = {"title": "# AI 日报 · ", "kept": "保留条目：", "topics": "主题分类统计：", "none": "未分类", "event": "- 事件：", "order": "展示顺序：", "class": "- 类别：", "source": "来源：", "state": "状态：", "summary": "- 摘要：", "no_summary": "暂无摘要", "why": "- 选稿依据：", "no_why": "未记录", "risk": "- 风险：", "no_risk": "无", "warn": "- 来源警告：", "no_source": "未标注来源"}


def digest_lines(records_: DataFrame) -> DataFrame:
    """(edition_date, display_order, line_no, line): the digest's blocks, a row a line, so that no row holds a whole digest."""
    d = DIGEST
    tick = lambda c: F.concat(F.lit("`"), F.coalesce(c.cast("string"), F.lit("None")), F.lit("`"))
    filled = lambda c, other: F.coalesce(F.when(c != "", c), F.lit(other))
    primary = F.coalesce(F.get(F.filter("source_refs", lambda r: r["is_primary"]), F.lit(0)), F.get("source_refs", F.lit(0)))
    name = F.coalesce(text.trimmed_or_null(primary["source_name"]), text.trimmed_or_null(primary["source_id"]), F.get("source_ids", F.lit(0)), F.lit(d["no_source"]))
    link = F.coalesce(text.trimmed_or_null(primary["source_url"]), F.col("url"))
    label = F.replace(F.replace(name, F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]"))
    shown = F.when(link.isNotNull(), F.concat(F.lit("["), label, F.lit("]("), link, F.lit(")"))).otherwise(label)
    lines = F.array(
        F.concat(F.lit("## "), F.col("display_order").cast("string"), F.lit(". "), filled(F.col("title"), "(untitled)")),
        F.concat(F.lit(d["event"]), tick(F.col("event_id")), F.lit(" | " + d["order"]), tick(F.col("display_order")), F.lit(" | display_score="), tick(F.col("display_score")), F.lit(" | topic="), tick(F.col("topic"))),
        F.concat(F.lit(d["class"]), tick(F.col("content_class")), F.lit(" | " + d["source"]), shown, F.lit(" | " + d["state"] + "`selected`")),
        F.concat(F.lit(d["summary"]), filled(F.col("summary"), d["no_summary"])), F.concat(F.lit(d["why"]), filled(F.col("reason"), d["no_why"])), F.concat(F.lit(d["risk"]), filled(F.array_join("risk_flags", ", "), d["no_risk"])), F.lit(""),
    )
    return records_.select("edition_date", "display_order", F.posexplode(lines).alias("line_no", "line"))


def digest_head(records_: DataFrame) -> DataFrame:
    """(edition_date, line): title, number of records, counts by topic, else class."""
    label = F.coalesce(F.when(F.col("topic") != "", F.col("topic")), F.when(F.col("content_class") != "", F.col("content_class")), F.lit(DIGEST["none"]))
    counts = records_.groupBy("edition_date", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    inner = F.array_sort(F.collect_list(F.struct("label", "n")))
    text_ = F.array_join(F.transform(inner, lambda x: F.concat(x["label"], F.lit("="), x["n"].cast("string"))), "、")
    return counts.groupBy("edition_date").agg(F.concat(F.lit(DIGEST["title"]), F.col("edition_date").cast("string"), F.lit("\n\n" + DIGEST["kept"]), F.sum("n").cast("string"), F.lit("\n\n" + DIGEST["topics"]), text_).alias("line"))


def warning_line(warnings: Column) -> Column:
    """Source warnings (array of struct of source_id, status) as one line, each once; null without any."""
    shown = F.transform(F.filter(warnings, lambda w: F.trim(w["source_id"]) != ""), lambda w: F.concat(F.trim(w["source_id"]), F.lit("（"), F.coalesce(F.when(w["status"] != "", w["status"]), F.lit("failed")), F.lit("）")))
    return F.when(F.size(shown) > 0, F.concat(F.lit(DIGEST["warn"]), F.array_join(F.array_distinct(shown), "、")))
