"""Deterministic policies: freshness gate, screening guard, admission, risk flags, history, publishability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text

# The only reasons that end screening; flags by their effect.
HARD_REJECTS = ("irrelevant", "spam", "pure_advertisement", "navigation_or_index", "empty_content", "duplicate_without_update")
BLOCKERS = ("confirmed_repeat_without_material_change", "candidate_without_facts", "source_conflict_on_event_core")
AUDIT_ONLY = ("prior_event_outside_history_window", "history_match_not_found", "invalid_novelty_status", "invalid_publishability", "search_not_configured", "search_budget_exhausted", "needs_review")
OFFICIAL_GROUPS = ("official_blog", "official_research", "x_official")
PROJECT_GROUPS = ("github_trending", "github_release", "github_search", "producthunt")


def content_class(group: Column, transport: Column) -> Column:
    """From a source's group and transport, their case and outer spaces aside."""
    g, t = F.lower(F.trim(F.coalesce(group, F.lit("")))), F.lower(F.trim(F.coalesce(transport, F.lit(""))))
    return F.when(g.isin(*OFFICIAL_GROUPS), "official_model_company").when(g == "tech_media", "news_media").when(g.isin(*PROJECT_GROUPS) | (t == "github"), "project_tool").otherwise("community_social")


def freshness(at: Column, edition: Column, reference: Column, trending: Column) -> tuple[Column, Column]:
    """(eligible, reason): from the previous day's midnight, inclusive, to the reference time; trending items are exempt."""
    at = at.cast("timestamp")
    reason = F.when(trending, "trending_exempt").when(at.isNull(), "missing_published_at").when(at > reference, "future_timestamp").when(at < dates.cutoff(edition), "too_old").otherwise("within_window")
    return reason.isin("trending_exempt", "within_window"), reason


def screen_guard(decision: Column, reason: Column, confidence: Column, threshold: int = 90, status: Column | None = None) -> tuple[Column, Column]:
    """(decision, added flag): a successful reject stands only for a hard reason and enough confidence; others are untouched."""
    good = F.lit(True) if status is None else F.coalesce(status == "success", F.lit(False))
    sure = F.coalesce(confidence, F.lit(0)) >= max(0, min(threshold, 100))
    reject, hard = good & (decision == "reject"), text.reason_code(reason).isin(*HARD_REJECTS)
    flag = F.when(reject & ~hard, "screen:non_hard_reject_reason").when(reject & ~sure, "screen:low_confidence_reject")
    return F.when(flag.isNotNull(), "uncertain").otherwise(decision), flag


# Reasons of admission.
MISSING, INVALID, IRRELEVANT, LOW, READY = "analysis_projection_missing", "analysis_structural_invalid", "below_ai_relevance_threshold", "below_score_threshold", "analysis_ready"


def admission(projected: Column, summary: Column, relevance: Column, score: Column, least_relevance: int = 60, least_score: int = 60) -> tuple[Column, Column]:
    """(decision, reason), gates in their order; a missing relevance passes. projected: whether a successful analysis is there."""
    blank = ~F.coalesce(F.regexp_replace(summary, r"^\s+|\s+$", "") != "", F.lit(False))
    bounded = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(score, F.lit(0))))
    reason = F.when(~F.coalesce(projected, F.lit(False)), MISSING).when(blank, INVALID).when(relevance < least_relevance, IRRELEVANT).when(bounded < least_score, LOW).otherwise(READY)
    return F.when(reason == READY, "active").otherwise("filtered"), reason


def relevance(components: Column, key: str = "audience_relevance") -> Column:
    """A component of a map of score texts, 0 to 100: null where it is absent, 0 where it is no number."""
    value = F.try_element_at(components, F.lit(key))
    return F.when(F.map_contains_key(components, key) & value.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(value.try_cast("int"), F.lit(0)))))


def screened_in(decision: Column) -> Column:
    """Whether screening lets an item go on to analysis."""
    return F.coalesce(decision.isin("pass", "uncertain"), F.lit(False))


def structural_rejects(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid items, rejects as screening results): an item needs a source, a title and a content hash that aren't blank."""
    full = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    valid = full("source_id") & full("title") & full("content_hash")
    flags = F.array(F.lit("prefilter:structural_invalid"))
    rejects = items.filter(~valid).select("item_id", F.lit("reject").alias("decision"), F.lit("structural_invalid").alias("reason_code"), F.lit(100).alias("confidence"), flags.alias("risk_flags"), F.lit("success").alias("status"))
    return items.filter(valid), rejects


def out_of_scope(tasks: DataFrame, items: DataFrame, screens: DataFrame) -> DataFrame:
    """Analysis tasks that a forced rerun skips: their item is out of the run, or its screening ended it."""
    ended = screens.filter((F.col("status") == "success") & ~screened_in(F.col("decision"))).select("item_id", F.lit("screened_out").alias("ended"))
    known = items.select("item_id", F.lit(True).alias("known")).distinct()
    rows = tasks.join(known, "item_id", "left").join(ended, "item_id", "left")
    return rows.filter(F.col("known").isNull() | F.col("ended").isNotNull()).select(*tasks.columns, F.when(F.col("known").isNull(), "out_of_scope").otherwise("screened_out").alias("reason"))


def analysis_guard(status: Column, summary: Column, source_summary: Column, title: Column) -> tuple[Column, Column]:
    """(summary, failure): a successful analysis without a summary takes the source's, else the title; what is left without
    one fails as summary_empty, an unsuccessful one as analysis_failed."""
    blank = lambda c: ~F.coalesce(F.trim(c) != "", F.lit(False))
    other = F.trim(F.coalesce(F.when(source_summary != "", source_summary), title, F.lit("")))
    good = F.coalesce(status == "success", F.lit(False))
    out = F.when(good & blank(summary) & (other != ""), other).otherwise(F.coalesce(summary, F.lit("")))
    return out, F.when(~good, "analysis_failed").when(blank(out), "summary_empty")


def screen_failure(items: DataFrame, error: Column, code: Column) -> DataFrame:
    """Screening results of items whose call failed: uncertain, no confidence, so that they go on or wait."""
    lit = F.lit
    return items.select("item_id", lit("uncertain").alias("decision"), lit("provider_failure").alias("reason_code"), lit(0).alias("confidence"), F.array(lit("ai:screen_failed")).alias("risk_flags"), lit("screen_failed").alias("status"), code.alias("error_code"), text.truncated(error, 4000).alias("error_message"))


def analysis_failure(items: DataFrame, error: Column, code: Column) -> DataFrame:
    """Analysis results of items whose call failed: the default topic, no summary, no score."""
    lit = F.lit
    return items.select("item_id", lit("technology_insight").alias("topic"), lit("").alias("summary_cn"), lit(0).alias("b1_priority"), lit("analysis_failed").alias("status"), code.alias("error_code"), text.truncated(error, 4000).alias("error_message"))


def is_trending(transport: Column, mode: Column) -> Column:
    return F.coalesce((F.lower(transport) == "github") & (F.lower(mode) == "trending"), F.lit(False))


def is_source_warning(stage: Column, failed_sources: Column, warnings: Column, failed: Column, partial_reason: Column) -> Column:
    """Failed sources of a fetch stage are a warning, not a failure of the run. The first two: arrays; failed: their number."""
    some = (F.coalesce(F.size(failed_sources), F.lit(0)) > 0) | (F.coalesce(F.size(warnings), F.lit(0)) > 0) | (F.coalesce(failed, F.lit(0)) > 0)
    return F.coalesce(stage == "fetch", F.lit(False)) & (some | F.lower(F.coalesce(partial_reason, F.lit(""))).startswith("fetch_failed_sources:"))


def wants_article(source_id: Column, depth: Column, url: Column, sources: tuple[str, ...]) -> Column:
    """Whether an item's body is to be fetched: a source with a rule, no full text yet, and a url."""
    return F.coalesce(source_id.isin(*sources) & (F.coalesce(depth, F.lit("")) != "full") & (F.trim(url) != ""), F.lit(False))


def source_violations(specs: DataFrame) -> DataFrame:
    """(id, violation) of source rows (options flattened to columns) that break a rule: tokens, absolute urls, counts, adapter
    and format, options of each transport and mode."""
    c = F.col
    given = lambda n: c(n).isNotNull()
    mode, feed = c("github_mode"), c("transport").isin("feed", "rsshub")
    rules = {
        "id_token": ~text.is_source_token(c("id")),
        "source_group_token": given("source_group") & ~text.is_source_token(c("source_group")),
        "absolute_url": ~F.coalesce(c("url").rlike("^https?://[^/?#]+"), F.lit(False)),
        "priority_negative": c("priority") < 0,
        "fetch_interval_not_positive": c("fetch_interval") <= 0,
        "default_limit_not_positive": c("default_limit") <= 0,
        "feed_with_github_options": feed & given("github_mode"),
        "github_with_feed_options": (c("transport") == "github") & (given("feed_format") | given("feed_adapter")),
        "github_without_options": (c("transport") == "github") & ~given("github_mode"),
        "producthunt_needs_atom": (c("feed_adapter") == "producthunt") & (F.coalesce(c("feed_format"), F.lit("rss")) != "atom"),
        "anthropic_research_needs_rss": (c("feed_adapter") == "anthropic_research") & (F.coalesce(c("feed_format"), F.lit("rss")) != "rss"),
        "producthunt_needs_feed": (c("transport") == "rsshub") & (c("feed_adapter") == "producthunt"),
        "search_needs_query": (mode == "search") & ~F.coalesce(F.trim("github_query") != "", F.lit(False)),
        "pushed_days_not_positive": (mode == "search") & (c("github_pushed_days") <= 0),
        "releases_takes_no_options": (mode == "releases") & (given("github_query") | given("github_pushed_days") | given("github_period")),
        "trending_takes_no_search": (mode == "trending") & (given("github_query") | given("github_pushed_days")),
        "trending_needs_period": (mode == "trending") & ~given("github_period"),
    }
    named = F.array_compact(F.array(*(F.when(F.coalesce(v, F.lit(False)), k) for k, v in rules.items())))
    return specs.select("id", F.explode(named).alias("violation"))


def routed_flags(flags: Column) -> tuple[Column, Column, Column]:
    """(blockers, caveats, audit), each in the flags' order."""
    blockers, audit = F.filter(flags, lambda f: f.isin(*BLOCKERS)), F.filter(flags, lambda f: f.isin(*AUDIT_ONLY))
    return blockers, F.filter(flags, lambda f: ~f.isin(*BLOCKERS, *AUDIT_ONLY)), audit


def history(requested: Column, requested_prior: Column, in_window: Column, exact_prior: Column, has_facts: Column) -> tuple[Column, Column, Column]:
    """(history status, prior event, flag). requested_prior counts only if it is `in_window`; exact_prior is an event that
    shares an identity. A prior event makes a repeat, or an update if one is claimed with facts."""
    claim = F.lower(F.coalesce(requested, F.lit("uncertain")))
    asked = F.when(F.trim(requested_prior) != "", F.trim(requested_prior))
    outside = asked.isNotNull() & ~F.coalesce(in_window, F.lit(False))
    prior = F.when(~outside, F.coalesce(asked, exact_prior))
    lost = claim.isin("repeat", "meaningful_update")
    found = F.when((claim == "meaningful_update") & F.coalesce(has_facts, F.lit(False)), "meaningful_update").otherwise("repeat")
    status = F.when(outside, "uncertain").when(prior.isNotNull(), found).when(claim.isin("new", "uncertain"), claim).otherwise("uncertain")
    flag = F.when(outside, "prior_event_outside_history_window").when(prior.isNull() & lost, "history_match_not_found").when(prior.isNull() & ~claim.isin("new", "uncertain"), "invalid_novelty_status")
    return status, prior, flag


def novelty_of(history_status: Column) -> Column:
    return F.when(history_status == "meaningful_update", "updated").otherwise(history_status)


def publishability(requested: Column, novelty: Column, n_facts: Column) -> tuple[Column, Column]:
    """(publishability, flags): a repeat is rejected; a candidate needs facts; what isn't known is to be reviewed."""
    asked = F.lower(F.coalesce(F.when(requested != "", requested), F.lit("candidate")))
    known = asked.isin("candidate", "needs_review", "rejected")
    valid = F.when(known, asked).otherwise("needs_review")
    repeat = F.lower(F.coalesce(novelty, F.lit(""))) == "repeat"
    bare = (valid == "candidate") & (F.coalesce(n_facts, F.lit(0)) == 0)
    second = F.when(repeat, "confirmed_repeat_without_material_change").when(bare, "candidate_without_facts").when(valid == "needs_review", "uncertain_event_core")
    return F.when(repeat, "rejected").when(bare, "needs_review").otherwise(valid), F.array_compact(F.array(F.when(~known, "invalid_publishability"), second))


def novelty(value: Column) -> Column:
    """Aliases to new, updated, repeat, unknown."""
    v = F.translate(F.lower(F.trim(value)), "-", "_")
    return F.when(v.isin("new", "new_item", "novel", "fresh"), "new").when(v.isin("update", "updated", "version_update"), "updated").when(v.isin("repeat", "duplicate", "old"), "repeat").when(v.isNotNull(), "unknown")


def due(latest: DataFrame, now: Column) -> DataFrame:
    """Sources out of back-off whose interval (1 s at least) since their last attempt has passed. latest: one row a source."""
    ready = F.coalesce(F.col("backoff_until") <= now, F.lit(True))
    return latest.filter(ready & (F.col("last_attempt").isNull() | (now >= F.col("last_attempt") + F.make_dt_interval(secs=F.greatest(F.col("fetch_interval"), F.lit(1))))))


# Words in a failure's code or message that say what it is.
TRANSIENT = ("429", "rate limit", "ratelimit", "5xx", "500", "502", "503", "504", "service unavailable", "bad gateway")
SLOW = ("timeout", "timed out", "temporarily unavailable")
SCHEMA = ("validation", "schema", "invalid json", "missing required")


def failure_class(status: Column, code: Column, message: Column, kind: Column, exhausted: Column) -> tuple[Column, Column, Column]:
    """(retryable, category, code) of a provider's failure: by its HTTP status, the words of its code and message, and the
    name of the exception. What retries have been used up on isn't tried again; unknown failures are blocked."""
    said = F.lower(F.concat_ws(" ", F.coalesce(code, F.lit("")), F.coalesce(message, F.lit(""))))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(said, w))
    number = status.cast("string")
    schema = has(SCHEMA)
    gone = F.coalesce(exhausted, F.lit(False)) | F.coalesce(kind == "ProviderRetryExhausted", F.lit(False))
    again = F.coalesce((status == 429) | (status >= 500), F.lit(False)) | has(TRANSIENT)
    slow = F.coalesce(kind.isin("TimeoutException", "TimeoutError"), F.lit(False)) | has(SLOW)
    refused = F.coalesce(status.between(400, 499), F.lit(False))
    bad = F.coalesce(kind.isin("ValidationError", "ValueError", "TypeError", "JSONDecodeError"), F.lit(False)) | schema
    auth = status.isin(401, 403) | F.contains(said, F.lit("auth"))
    category = F.when(gone, "provider_retry_exhausted").when(again | slow, "provider_retryable").when(refused & schema, "schema").when(refused & auth, "provider_auth").when(refused, "provider_blocked").when(bad, "schema").otherwise("provider_blocked")
    named = F.when(gone, F.coalesce(code, F.lit("retry_exhausted"))).when(again, F.coalesce(number, code, F.lit("provider_retryable"))).when(slow, F.coalesce(code, number, F.lit("timeout"))).when(refused, number).when(bad, F.coalesce(code, kind, F.lit("schema_error"))).otherwise(F.coalesce(code, kind, F.lit("provider_error")))
    return category == "provider_retryable", category, F.substring(named, 1, 128)
