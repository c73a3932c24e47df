"""Edge-case vectors as literals: expected values come from the specification, not from this code or its SQL."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from newsloom.functions import dates, hashes, numbers, structured, text, urls
from newsloom.operators import entities, events, policy, projects, ranking, reading, state
from newsloom.plans import drafts, publish, records
from newsloom.sources import feeds

UTC = datetime.timezone.utc


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first().asDict()


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


L = F.lit


# ---- urls and text -----------------------------------------------------------------------------

@pytest.mark.parametrize(("url", "envelope", "event", "item"), [
    ("HTTPS://Example.COM:443/a/b/?b=2&utm_source=x&a=1&ref=z#f", "https://example.com/a/b?b=2&a=1", "https://example.com/a/b?a=1&b=2", None),
    ("http://Example.com/", "http://example.com", "http://example.com/", "http://example.com/"),
    ("http://x.org/p?a=1&amp;b=%7Ec&c=x+y&d=%zz&e", "http://x.org/p?a=1&b=~c&c=x+y&d=%25zz&e=", "http://x.org/p?a=1&b=~c&c=x+y&d=%25zz&e=", None),
    ("http://x.org/?k=2&k=1&a=%C3%A9*", "http://x.org?k=2&k=1&a=%C3%A9%2A", "http://x.org/?a=%C3%A9%2A&k=1&k=2", None),
    ("no url/", "no url/", "no url", "no url/"),
    ("  ", None, None, None),
])
def test_url_forms(spark, url, envelope, event, item):
    r = one(spark, a=urls.envelope_url(L(url)), b=urls.event_url(L(url)), c=urls.item_url(L(url)))
    assert (r["a"], r["b"]) == (envelope, event)
    assert item is None or r["c"] == item


def test_hosts_and_repositories(spark):
    fine = ["https://a.org/x", "http://8.8.8.8/", "https://[2606:4700::1]/", "http://172.32.0.1/"]
    closed = ["http://localhost/x", "http://127.0.0.1/", "http://10.1.2.3:80/", "http://192.168.0.1", "http://172.16.0.1/", "http://169.254.1.1/", "http://[::1]/", "http://[fd00::1]/x", "ftp://a.org/", "x"]
    rows = table(spark, [(u,) for u in fine + closed], "u string").select(urls.public_host_url(F.col("u")).alias("p")).collect()
    assert [r.p for r in rows] == fine + [None] * len(closed)
    r = one(spark, a=urls.repo_full_name(L("https://www.GitHub.com/Foo/Bar.git/issues")), b=urls.repo_full_name(L("https://x.com/a/b")), c=feeds.project_link(L("see"), L("at http://github.com/O/R.git, or")))
    assert (r["a"], r["b"], r["c"]) == ("Foo/Bar", None, "https://github.com/O/R")


def test_titles_and_plain_text(spark):
    r = one(spark, a=text.event_title(L("Ｆｏｏ – v1.2")), b=text.stored_title(L("Ｆｏｏ – v1.2")), c=text.event_title(L("中 文 标题：X_y")), d=text.event_title(L("Straße")), e=text.event_title(L(None).cast("string")))
    assert (r["a"], r["b"], r["c"], r["d"], r["e"]) == ("foo v1 2", "ｆｏｏ v1 2", "中文标题 x_y", "strasse", "")
    r = one(spark, a=text.plain(L(" a​  b &amp; c\r\n\r\n\r\n\r\nd\x07 ")), b=text.plain(L("<p>x &lt;b&gt;</p><script>no</script><p>y</p>")), c=text.plain(L("a\nb\tc"), newlines=False), d=text.plain(L(None).cast("string")))
    assert (r["a"], r["b"], r["c"], r["d"]) == ("a b & c\n\nd", "x <b>\n\ny", "a b c", "")


def test_small_text_functions(spark):
    r = one(
        spark, a=text.split_list(L("a, b；c|a")), b=text.family_key(L(" Fam--X__y ")), c=text.family_key(L("")), d=text.error_code(L("timeout: after 20 s")), e=text.error_code(L(": x")), f=text.search_text(L("T"), F.array(*map(L, "abcde"))),
        g=text.is_source_token(L("a-1_b")), h=text.is_source_token(L("A")), i=text.label(L("x_search"), "source_group"), j=text.label(L("my_group"), "source_group"), k=text.label(L(None).cast("string"), "status"), l=text.truncated(L("  abc "), 2),
    )
    assert (r["a"], r["b"], r["c"], r["d"], r["e"], r["f"]) == (["a", "b", "c"], "fam_x__y", "other", "timeout", "fetch_failed", "T a b c d")
    assert (r["g"], r["h"], r["i"], r["j"], r["k"], r["l"]) == (True, False, "X 搜索", "my group", "未知状态", "ab")


def test_numbers(spark):
    parts = lambda *v: numbers.weighted_score(dict(zip(("audience_relevance", "impact_scope", "independent_news_value", "material_change", "specificity"), map(L, v), strict=True)))
    r = one(spark, b=parts(100, 0, 0, 0, 0), c=numbers.suffixed(L("1.2k")), d=numbers.suffixed(L("1,234")), e=numbers.suffixed(L("2.5")), f=projects.count_of(L("1.2k")), g=projects.count_of(L("-5")), h=projects.count_of(L("x")))
    assert (r["b"], r["c"], r["d"], r["e"], r["f"], r["g"], r["h"]) == (45, 1200, 1234, 2.5, 1200, 0, 0)


def test_times(spark):
    ref = L("2024-01-15 12:00:00").cast("timestamp")
    ago = lambda s: dates.relative(L(s).cast("timestamp"), ref)
    r = one(spark, a=ago("2024-01-13 11:00:00"), b=ago("2024-01-15 09:30:00"), c=ago("2024-01-15 11:58:30"), d=ago("2024-01-15 11:59:30"), e=ago(None), f=ago("2024-01-15 13:00:00"))
    assert list(r.values()) == ["2天前", "2小时前", "1分钟前", "刚刚", "未知", "23小时前"]
    day = lambda s: dates.full_date(L(s))
    r = one(spark, a=day("2024-01-15"), b=day("soon"), c=day(None), d=dates.full_date(L("2024-01-05"), year=False), e=dates.shown(L("2024-01-15 20:00:00").cast("timestamp")), f=dates.shown(L(None).cast("timestamp")), g=dates.shown_minute(L(None).cast("timestamp")), h=dates.time_exclusion(L("Expired item")), i=dates.time_exclusion(L("ok")))
    assert list(r.values()) == ["2024年1月15日 星期一", "soon", "", "1月5日 星期五", "2024-01-16 04:00", "未知时间", "--:--", "too_old", None]
    r = one(spark, a=dates.parsed(L("bad"), L("Mon, 15 Jan 2024 10:00:00 GMT")), b=dates.parsed(L("2024-01-15T10:00:00+02:00")), c=dates.parsed(L("2024-01-15 10:00:00")), d=dates.parsed(L("x")), e=dates.edition_or_today(L(None).cast("string"), L("2024-01-15 17:00:00").cast("timestamp")), f=dates.edition_or_today(L("2024-02-30"), ref), g=dates.is_historical(L("2024-01-16"), L("2024-01-15 17:00:00").cast("timestamp")))
    assert (r["a"].hour, r["b"].hour, r["c"].hour, r["d"]) == (10, 8, 10, None)
    assert (r["e"], r["f"], r["g"]) == (datetime.date(2024, 1, 16), None, False)


# ---- policies ----------------------------------------------------------------------------------

def test_freshness(spark):
    edition, ref = L("2026-08-26").cast("date"), L("2026-08-26 12:00:00").cast("timestamp")
    for at, trending, want in [("2026-08-24 16:00:00", False, (True, "within_window")), ("2026-08-24 15:59:59", False, (False, "too_old")), ("2026-08-26 12:00:01", False, (False, "future_timestamp")), (None, False, (False, "missing_published_at")), (None, True, (True, "trending_exempt"))]:
        r = one(spark, **dict(zip("ab", policy.freshness(L(at).cast("timestamp"), edition, ref, L(trending)), strict=True)))
        assert (r["a"], r["b"]) == want


def test_screen_guard(spark):
    rows = [("spam", 95, "success"), ("spam", 89, "success"), ("low_information", 99, "success"), ("Pure-Advertisement", 90, "success"), ("spam", None, "success"), ("odd", 1, "screen_failed")]
    df = table(spark, rows, "r string, c int, s string")
    out = df.select(*policy.screen_guard(L("reject"), F.col("r"), F.col("c"), status=F.col("s"))).collect()
    assert [tuple(r) for r in out] == [("reject", None), ("uncertain", "screen:low_confidence_reject"), ("uncertain", "screen:non_hard_reject_reason"), ("reject", None), ("uncertain", "screen:low_confidence_reject"), ("reject", None)]


def test_admission(spark):
    rows = [(False, "s", 90, 90), (True, " ", 90, 90), (True, "s", 59, 99), (True, "s", None, 60), (True, "s", 60, 59), (True, "s", 60, None)]
    out = table(spark, rows, "p boolean, s string, r int, c int").select(*policy.admission(F.col("p"), F.col("s"), F.col("r"), F.col("c"))).collect()
    assert [tuple(r) for r in out] == [("filtered", "analysis_projection_missing"), ("filtered", "analysis_structural_invalid"), ("filtered", "below_ai_relevance_threshold"), ("active", "analysis_ready"), ("filtered", "below_score_threshold"), ("filtered", "below_score_threshold")]
    r = one(spark, a=policy.relevance(F.create_map(L("audience_relevance"), L("70")), ), b=policy.relevance(F.create_map(L("audience_relevance"), L("x"))), c=policy.relevance(F.create_map(L("other"), L("1"))), d=policy.relevance(F.create_map(L("audience_relevance"), L("400"))))
    assert list(r.values()) == [70, 0, None, 100]


def test_flags_history_publishability(spark):
    r = one(spark, **dict(zip("abc", policy.routed_flags(F.array(*map(L, ("confirmed_repeat_without_material_change", "needs_review", "vendor_self_test")))), strict=True)))
    assert list(r.values()) == [["confirmed_repeat_without_material_change"], ["vendor_self_test"], ["needs_review"]]
    h = lambda req, asked, known, exact, facts: one(spark, **dict(zip("abc", policy.history(L(req).cast("string"), L(asked).cast("string"), L(known), L(exact).cast("string"), L(facts)), strict=True)))
    assert list(h("new", "k", False, "x", True).values()) == ["uncertain", None, "prior_event_outside_history_window"]
    assert list(h("meaningful_update", "k", True, None, False).values()) == ["repeat", "k", None]
    assert list(h("meaningful_update", None, False, "x", True).values()) == ["meaningful_update", "x", None]
    assert list(h("Repeat", None, False, None, True).values()) == ["uncertain", None, "history_match_not_found"]
    assert list(h("odd", None, False, None, True).values()) == ["uncertain", None, "invalid_novelty_status"]
    assert list(h(None, None, False, None, True).values()) == ["uncertain", None, None]
    p = lambda req, nov, n: tuple(one(spark, **dict(zip("ab", policy.publishability(L(req).cast("string"), L(nov), L(n)), strict=True))).values())
    assert p("candidate", "repeat", 3) == ("rejected", ["confirmed_repeat_without_material_change"])
    assert p("candidate", "new", 0) == ("needs_review", ["candidate_without_facts"])
    assert p("whatever", "new", 2) == ("needs_review", ["invalid_publishability", "uncertain_event_core"])
    assert p(None, "new", 2) == ("candidate", [])
    assert p("rejected", "new", 0) == ("rejected", [])


def test_other_policies(spark):
    r = one(spark, a=policy.content_class(L(" Official_Blog"), L("feed")), b=policy.content_class(L(None).cast("string"), L("GitHub")), c=policy.is_trending(L("GITHUB"), L("Trending")), d=policy.wants_article(L("s"), L("summary"), L("u"), ("s",)), e=policy.wants_article(L("s"), L("full"), L("u"), ("s",)), f=policy.screened_in(L("uncertain")))
    assert list(r.values()) == ["official_model_company", "project_tool", True, True, False, True]
    a = lambda *v: tuple(one(spark, **dict(zip("ab", policy.analysis_guard(*(L(x).cast("string") for x in v)), strict=True))).values())
    assert a("success", " ", "src", "t") == ("src", None) and a("success", "", "", " t ") == ("t", None) and a("success", "", None, "") == ("", "summary_empty") and a("failed", "s", "x", "t") == ("s", "analysis_failed")
    w = policy.is_source_warning(L("fetch"), F.array().cast("array<string>"), F.array().cast("array<string>"), L(0), L("fetch_failed_sources: a"))
    assert one(spark, w=w)["w"] is True
    spec = "id string, transport string, url string, source_group string, priority int, fetch_interval int, default_limit int, feed_format string, feed_adapter string, github_mode string, github_query string, github_pushed_days int, github_period string"
    rows = [
        ("ok", "feed", "https://a.org", "g", 1, 60, 5, "rss", "generic", None, None, None, None), ("Bad", "feed", "a.org", "G", -1, 0, 0, "rss", "producthunt", None, None, None, None), ("s", "github", "https://a.org", None, 1, 1, 1, None, None, "search", " ", -1, None),
        ("t", "github", "https://a.org", None, 1, 1, 1, None, None, "trending", "q", None, None), ("r", "github", "https://a.org", None, 1, 1, 1, "rss", None, "releases", None, 3, None), ("n", "github", "https://a.org", None, 1, 1, 1, None, None, None, None, None, None),
    ]
    found = got(policy.source_violations(table(spark, rows, spec)), "id", "violation")
    assert {i for i, _ in found} == {"Bad", "s", "t", "r", "n"}
    assert [v for i, v in found if i == "Bad"] == sorted(["id_token", "source_group_token", "absolute_url", "priority_negative", "fetch_interval_not_positive", "default_limit_not_positive", "producthunt_needs_atom"])
    assert [v for i, v in found if i in "stn"] == ["github_without_options", "pushed_days_not_positive", "search_needs_query", "trending_needs_period", "trending_takes_no_search"]
    items, screens = table(spark, [(1,), (2,)], "item_id int"), table(spark, [(1, "success", "reject"), (2, "success", "pass")], "item_id int, status string, decision string")
    assert got(policy.out_of_scope(table(spark, [(1, 9), (2, 9), (3, 9)], "item_id int, task_id int"), items, screens), "item_id", "reason") == [(1, "screened_out"), (3, "out_of_scope")]


# ---- events ------------------------------------------------------------------------------------

def test_identities(spark):
    rows = [("github_release:9", "https://github.com/o/r"), ("G 1", "https://x.com/a"), (None, "https://github.com/O/R/"), ("e", "https://github.com/O/R")]
    out = table(spark, rows, "e string, u string").select(entities.identity_keys(F.col("e"), F.col("u")).alias("k"), events.related_hints(F.col("e"), F.col("u")).alias("h")).collect()
    assert [r.k for r in out] == [["external:github_release:9"], ["external:g1", "url:https://x.com/a"], ["url:https://github.com/O/R"], ["external:e"]]
    assert [r.h for r in out] == [["github_repo_root:https://github.com/o/r", "url:https://github.com/o/r"], [], ["github_repo_root:https://github.com/o/r"], ["github_repo_root:https://github.com/o/r"]]
    none = L(None).cast("string")
    r = one(spark, a=events.event_key(L("X"), none, L(3), L("t")), b=events.event_key(none, none, L(3), L("t")), c=events.event_key(none, none, L(0), L("A  B")), d=events.event_key(none, none, L(None).cast("int"), L("!")))
    assert list(r.values()) == ["external:x", "item:3", "title:a b", "item:unknown"]


def test_merge_prefers_and_keeps_rejected(spark):
    items = table(spark, [(1, "a"), (2, "k"), (3, "k"), (4, "k"), (5, "k")], "item_id long, external_id string").withColumns({c: L(None).cast("string") for c in ("canonical_url", "source_url")})
    members = table(spark, [("A", 1), ("A", 2), ("B", 3), ("C", 4), ("D", 5)], "draft_key string, item_id long")
    rows = table(spark, [("A", "needs_review"), ("B", "candidate"), ("C", "candidate"), ("D", "rejected")], "draft_key string, publishability string")
    assert got(events.merged_drafts(rows, members, items), "draft_key", "into") == [("A", "B"), ("B", "B"), ("C", "B"), ("D", "D")]


def test_components_of_a_chain(spark):
    edges = table(spark, [("A", "i1"), ("A", "x"), ("B", "x"), ("B", "y"), ("C", "y"), ("D", "z")], "e string, k string")
    assert got(entities.components(edges, "e", "k"), "e", "component") == [("A", "A"), ("B", "A"), ("C", "A"), ("D", "D")]


def test_family_splits(spark):
    rows = [("e1", "Fam", "candidate", "different_model_or_major_version"), ("e2", "fam", "needs_review", "odd"), ("e3", "fam", "rejected", None), ("e4", "solo", "candidate", None), ("e5", "two", "candidate", "separate_time_window_actionable"), ("e6", "two", "candidate", " standalone_pricing_quota_access_change ")]
    out = entities.family_splits(table(spark, rows, "event_key string, event_family_key string, publishability string, split_reason string"))
    assert [tuple(r) for r in out.collect()] == [("fam", 2, ["e2"])]


def test_primary_member(spark):
    rows = [(1, "github_release", "project_tool", 10, "2024-01-01"), (2, "tech_media", "news_media", 99, "2024-01-02"), (3, "X_OFFICIAL", "community_social", 10, "2024-01-03"), (4, None, None, 100, "2024-01-04")]
    df = table(spark, rows, "i long, g string, c string, p int, d string").withColumn("d", F.col("d").cast("timestamp"))
    key = ranking.primary_key(F.col("g"), F.col("c"), F.col("p"), F.col("d"), L(None).cast("timestamp"), F.col("i"))
    assert df.agg(F.min_by("i", key)).first()[0] == 3
    assert [r[0] for r in df.orderBy(key).select("i").collect()] == [3, 1, 2, 4]


def test_strict_ids_and_partitions(spark):
    rows = table(spark, [("[3, 1]",), ("[1, 1]",), ("[true]",), ("[0]",), ("[1.5]",), ("x",)], "t string")
    assert [(r.ids, r.error) for r in rows.select(*(c.alias(n) for c, n in zip(events.strict_ids(F.col("t")), ("ids", "error"), strict=True))).collect()] == [([3, 1], None), (None, "duplicate_id"), (None, "not_a_positive_id"), (None, "not_a_positive_id"), (None, "not_a_positive_id"), (None, "not_a_list")]
    assert one(spark, a=events.positive_ids(F.array(*map(L, ("3", "x", "0", "3", "7"))), 2))["a"] == [3, 7]
    ids = lambda *v: table(spark, [(x,) for x in v], "e long")
    assert got(entities.partition_errors(ids(1, 2, 3, 4), ids(1, 2, 2), ids(3, 9), "e"), "e", "error") == [(2, "twice"), (4, "missing"), (9, "unknown")]


# ---- state -------------------------------------------------------------------------------------

@pytest.mark.parametrize(("statuses", "want"), [(["succeeded", "skipped"], "succeeded"), (["running", "blocked"], "running"), (["blocked", "succeeded"], "blocked"), (["failed", "pending"], "pending"), (["blocked", "failed"], "failed"), (["blocked", "pending"], "pending"), (["failed", "succeeded"], "failed"), (["retry_waiting", "failed"], "pending")])
def test_stage_fold(spark, statuses, want):
    assert state.stage_status(table(spark, [(1, s) for s in statuses], "stage int, status string"), "stage").first()["status"] == want


def test_claims(spark):
    now = L("2024-01-15 12:00:00").cast("timestamp")
    before, after = datetime.datetime(2024, 1, 15, 11), datetime.datetime(2024, 1, 15, 13)
    rows = [(1, "succeeded", None, None), (2, "running", after, None), (3, "running", before, None), (4, "retry_waiting", None, after), (5, "retry_waiting", None, before), (6, "pending", None, None)]
    df = table(spark, rows, "task_id int, status string, lease_expires_at timestamp, next_retry_at timestamp").withColumn("error_code", L(None).cast("string"))
    assert [r[0] for r in got(state.claimable(df, now), "task_id")] == [3, 5, 6]
    assert got(state.recovered(df, now).filter("error_code is not null"), "task_id", "status", "error_code") == [(3, "retry_waiting", "lease_expired")]


def test_backoff(spark):
    df = table(spark, [(n,) for n in (0, 1, 2, 3, 11, 12, 40)], "n int").select(dates.backoff_seconds(F.col("n")).alias("s"))
    assert [r.s for r in df.collect()] == [0, 60, 120, 240, 61440, 86400, 86400]


def test_stage_leases(spark):
    now = L("2024-01-15 12:00:00").cast("timestamp")
    late, early = datetime.datetime(2024, 1, 15, 13), datetime.datetime(2024, 1, 15, 11)
    rows = [("a", "me", late, "running"), ("b", "me", early, "running"), ("c", "you", late, "running")]
    df = table(spark, rows, "stage string, lease_owner string, lease_expires_at timestamp, status string")
    assert got(state.heartbeat(df, "me", now), "stage", "renewed") == [("a", True), ("b", False), ("c", False)]
    assert got(state.released(df, "me", "pending"), "stage", "lease_owner", "status") == [("a", None, "pending"), ("b", None, "pending"), ("c", "you", "running")]


def test_invalidation_refuses_busy_runs(spark):
    now = L("2024-01-15 12:00:00").cast("timestamp")
    late = datetime.datetime(2024, 1, 15, 13)
    stages = table(spark, [(1, "a"), (1, "b"), (2, "a"), (2, "b")], "run int, stage string").withColumns({"lease_owner": L(None).cast("string"), "lease_expires_at": L(None).cast("timestamp")})
    tasks = table(spark, [(1, "b", "succeeded", None), (2, "b", "running", late)], "run int, stage string, status string, lease_expires_at timestamp")
    left, kept, refused = state.invalidated(stages, tasks, stages.filter("stage = 'a'").select("run", "stage"), ["a", "b"], now)
    assert got(left, "run", "stage") == [(1, "a"), (2, "a"), (2, "b")] and got(kept, "run") == [(2,)] and [tuple(r) for r in refused.collect()] == [(2, ["b"])]


def test_rows_by_key(spark):
    old = table(spark, [(1, "a", 1), (2, "b", 1)], "item_id int, decision string, confidence int")
    assert got(state.last_rows(old, table(spark, [(2, "c", 5), (3, "d", 6)], "item_id int, decision string, confidence int"), ["item_id"]), "item_id", "decision") == [(1, "a"), (2, "c"), (3, "d")]
    assert got(state.with_status(table(spark, [(1, "x"), (2, "y")], "item_id int, status string"), table(spark, [(2, "z")], "item_id int, status string"), "item_id"), "item_id", "status") == [(1, "x"), (2, "z")]
    att = table(spark, [(1, "running", 0, None, None, None, None)], "attempt_id int, status string, items_fetched int, http_status int, error_code string, error_message string, finished_at timestamp")
    done = table(spark, [(1, "failed", 2, 503, "timeout: x")], "attempt_id int, status string, items_fetched int, http_status int, error string")
    assert got(state.finished_attempts(att, done, L("2024-01-15").cast("timestamp")), "status", "items_fetched", "http_status", "error_code", "error_message") == [("failed", 2, 503, "timeout", "timeout: x")]
    t = {"items": table(spark, [(1, 5), (2, 6)], "item_id int, build_id int"), "stages": table(spark, [(5,), (None,)], "run_id int")}
    out = state.without_build(t, 5)
    assert got(out["items"], "item_id") == [(2,)] and got(out["stages"], "run_id") == [(None,)]
    assert got(state.without_events(table(spark, [(1, 7), (2, 8)], "evidence_id int, event_id int"), table(spark, [(7,)], "event_id int")), "evidence_id", "event_id") == [(1, None), (2, 8)]
    assert one(spark, a=state.lease_seconds(L(64), 60, 600, 7200), b=state.lease_seconds(L(1), 60, 600, 7200)) == {"a": 3840, "b": 600}


def test_upsert_resets_only_what_was_processed(spark):
    old = table(spark, [(1, "x", "candidate", 9), (2, "x", "published", 9), (3, "x", "candidate", 9), (4, "x", "candidate", 9)], "k int, a string, status string, score int")
    new = table(spark, [(1, "y"), (2, "y"), (3, ""), (4, "y")], "k int, a string")
    out = state.upsert(old, new, ["k"], ["a"], [], ["a"], {"score": 0}, exempt=F.col("o.k") == 4)
    assert got(out, "k", "a", "status", "score") == [(1, "y", "new", 0), (2, "y", "published", 9), (3, "x", "candidate", 9), (4, "y", "candidate", 9)]


# ---- projects, sources -------------------------------------------------------------------------

def test_releases_and_periods(spark):
    rows = table(spark, [('[{"name":"a"},{"tag_name":"b"},{"name":" "},{"name":"d"}]',), ('{"tag_name":"v"}',), ('["x"," ","z"]',), ("v1",), (None,)], "v string").select(projects.release_names(F.col("v")).alias("n"))
    assert [r.n for r in rows.collect()] == [["a", "b"], ["v"], ["x", "z"], ["v1"], []]
    m = F.create_map(L("trending"), L('{"daily":{"rank":"1","stars_since":"5"}}'), L("trending_period"), L("weekly"), L("stars_since"), L("1,234"))
    r = one(spark, a=projects.since(projects.trending(m), "weekly"), b=projects.since(projects.trending(m), "daily"), c=projects.since(projects.trending(m), "monthly"))
    assert list(r.values()) == [1234, 5, 0]


def test_metrics(spark):
    old = F.create_map(L("stars"), L("10"), L("forks"), L("3"), L("topics"), L('["a"]'), L("x"), L("1"))
    new = F.create_map(L("stars"), L("7"), L("forks"), L("4"), L("topics"), L('["b","a"]'), L("x"), L(None).cast("string"))
    assert one(spark, m=projects.merged_metrics(old, new))["m"] == {"stars": "10", "forks": "4", "topics": '["a","b"]', "x": "1"}
    meta = F.create_map(L("stargazers_count"), L("9"), L("license"), L('{"spdx_id":"MIT"}'), L("secret"), L("s"), L("description"), L("d" * 5000), L("topics"), L(json.dumps(["t" * 200, " "])))
    r = one(spark, a=projects.bounded_metadata(meta), b=projects.overlaid(F.create_map(L("stars"), L("1"), L("y"), L("2")), meta))
    assert "secret" not in r["a"] and len(r["a"]["description"]) == 4000 and json.loads(r["a"]["topics"]) == ["t" * 128]
    assert r["b"] == {"stars": "9", "license": "MIT", "github_metadata_fetched": "true", "y": "2"}


def test_project_report(spark):
    rows = table(spark, [(1, 1, "o/r", "u", 1500, 0, "s", "about")], "item_id int, place int, repo_full_name string, url string, stars long, forks long, source_id string, summary string").withColumns({"language": L(None).cast("string"), "pushed_at": L(None).cast("timestamp"), "topics": F.array(L("a")), "search_topics": F.array(L("b")), "trending": F.create_map(L("weekly"), F.struct(L("1").alias("rank"), L("20").alias("stars_since"), L("1").alias("stars"), L("1").alias("forks")))})
    assert [r.line for r in projects.search_line(rows).collect()] == ["| [o/r](u) | 1,500 | - | a, b | - |"]
    lines = [r.line for r in projects.detail_lines(rows).orderBy("line_no").collect()]
    assert lines[0] == "### 1. o/r" and "- 本周新增 Star（GitHub Trending）：20" in lines and "- 今日新增 Star（GitHub Trending）：-" in lines and lines[-1] == ""


def test_launches(spark):
    rows = [(1, "tag:1", "A thing", "https://p.com/1", "12 upvotes", "code: https://github.com/Own/Repo.", {"commentCount": "4"}), (2, "tag:2", "B", "https://p.com/2", "", "", {})]
    items = table(spark, rows, "item_id int, external_id string, title string, url string, summary string, content string, payload map<string,string>").withColumn("metrics", F.create_map().cast("map<string,string>"))
    meta = table(spark, [("own", "REPO", {"stargazers_count": "77"})], "owner string, repo string, metadata map<string,string>")
    out = {r.item_id: r for r in feeds.launches(items, meta).collect()}
    assert out[1].external_id == "github_repo:own/repo" and out[1].metrics["stars"] == "77" and out[1].metrics["votes"] == "12" and out[1].metrics["comments"] == "4"
    assert out[2].external_id == "tag:2" and out[2].metrics == {"producthunt_metrics_status": "unavailable_in_feed"}


def test_sources_small(spark, tmp_path):
    s = table(spark, [("a", "feed", "e1", None, "g"), ("b", "ftp", None, "Mon", ""), ("a", "github", "", "", "g")], "id string, transport string, etag string, last_modified string, source_group string")
    by, rest = feeds.routed(s)
    assert by["feed"].count() == 1 and by["github"].count() == 1 and [r.id for r in rest.collect()] == ["b"]
    assert [r.headers for r in feeds.conditional_headers(s).collect()] == [{"If-None-Match": "e1"}, {"If-Modified-Since": "Mon"}, {}]
    assert got(feeds.registry_errors(s), "id", "error") == [("a", "duplicate_id"), ("b", "missing_group")]
    r = one(spark, a=feeds.landed_status(L(304), L(None).cast("string"), L(0)), b=feeds.landed_status(L(200), L("x"), L(0)), c=feeds.landed_status(L(200), L("x"), L(2)), d=feeds.landed_status(L(503), L("x"), L(2)), e=feeds.interpolated(L("${HUB_BASE_URL}/x/${K}"), {"HUB_BASE_URL": "http://h/", "K": "v/"}), f=feeds.interpolated(L("${NO}/x"), {}))
    assert list(r.values()) == ["not_modified", "degraded", "success", "failed", "http://h/x/v/", None]
    r = one(spark, a=feeds.readme(L("aGVs\nbG8="), L("base64")), b=feeds.readme(L("%%"), L("base64")), c=feeds.answer_text(L('{"output":[{"type":"message","content":[{"type":"output_text","text":"a"},{"type":"x","text":"no"},{"type":"output_text","text":"b"}]}]}')), d=feeds.answer_text(L('{"choices":[{"message":{"content":"c"}}]}')), e=feeds.answer_text(L("{")))
    assert list(r.values()) == ["hello", None, "ab", "c", None]
    rec = feeds.loose_record(F.create_map(L("link"), L("u"), L("url"), L(" "), L("raw_summary"), L("s")))
    assert one(spark, a=rec["canonical_url"], b=rec["summary"], c=rec["external_id"]) == {"a": "u", "b": "s", "c": None}
    for i, name in enumerate(("old", "new")):
        (tmp_path / f"{name}.jsonl").write_text(json.dumps({"t": name}) + "\nbroken\n")
        import os

        os.utime(tmp_path / f"{name}.jsonl", (1000 + i, 1000 + i))
    assert [r.t for r in feeds.newest_lines(spark, str(tmp_path), "t string").collect() if r.t] == ["new"]


def test_hashes_are_stable(spark):
    r = one(spark, a=hashes.policy_fingerprint({"b": L(1), "a": L("x")}), b=hashes.policy_fingerprint({"a": L("x"), "b": L(1)}), c=hashes.stable_json({"b": L("é"), "a": L(None).cast("string")}), d=hashes.item_fingerprint(L("h"), L("x")), e=hashes.item_fingerprint(L(""), L("x"), L(None).cast("string")))
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert r["a"] == r["b"] and r["c"] == '{"b":"é"}' and r["d"] == sha("h") and r["e"] == sha("x|")


def test_structured(spark):
    r = one(spark, a=structured.decoded_map(L("{")), b=structured.decoded_strings(L('["a"]')), c=structured.is_true(L(" Yes ")))
    assert list(r.values()) == [{}, ["a"], True]


# ---- publication -------------------------------------------------------------------------------

def test_selection_read_back(spark):
    result = "struct<candidate_event_ids:array<bigint>,selected:array<struct<event_id:bigint,reason_code:string,reason:string>>,unselected:array<bigint>>"
    rows = [
        (1, "stage_d", "run", "succeeded", ([1, 2, 3], [(2, "a", "b"), (1, "c", "d")], [3])), (2, "stage_d", "run", "succeeded", ([1, 2], [(2, "a", "b")], [])), (3, "stage_d", "run", "succeeded", ([1], [(1, "a", "b")], [])), (3, "stage_d", "item", "failed", None), (4, "stage_d", "item", "succeeded", None),
        (5, "stage_d", "run", "succeeded", ([1, 2], [(1, "a", "b"), (1, "a", "b")], [])),
    ]
    tasks = table(spark, rows, f"run int, stage string, subject_type string, status string, result {result}")
    stages = table(spark, [(i, "stage_d", "succeeded") for i in range(1, 6)] + [(6, "stage_d", "running")], "run int, stage string, status string")
    assert got(records.selection(tasks, stages), "run", "event_id", "display_order", "error") == [(1, 1, 2, None), (1, 2, 1, None), (2, None, None, "invalid_selection"), (3, None, None, "stage_d_incomplete"), (4, None, None, "run_task_missing"), (5, None, None, "invalid_selection"), (6, None, None, "stage_d_incomplete")]


def test_digest_and_manifest(spark):
    ref = "array<struct<source_name:string,source_id:string,source_url:string,is_primary:boolean>>"
    rows = [("2024-01-15", 1, "T", 7, 61.5, "ai", "news_media", [("", "s[1]", "https://s", False), ("N", "s2", None, True)], ["s1"], "https://u", "sum", "", ["f"]), ("2024-01-15", 2, "", 8, 1.0, None, None, [], [], None, None, "why", [])]
    df = table(spark, rows, f"edition_date string, display_order int, title string, event_id int, display_score double, topic string, content_class string, source_refs {ref}, source_ids array<string>, url string, summary string, reason string, risk_flags array<string>")
    lines = [r.line for r in records.digest_lines(df).orderBy("display_order", "line_no").collect()]
    assert lines[:7] == ["## 1. T", "- 事件：`7` | 展示顺序：`1` | display_score=`61.5` | topic=`ai`", "- 类别：`news_media` | 来源：[N](https://u) | 状态：`selected`", "- 摘要：sum", "- 选稿依据：未记录", "- 风险：f", ""]
    assert lines[7] == "## 2. (untitled)" and lines[9] == "- 类别：`None` | 来源：未标注来源 | 状态：`selected`"
    assert [r.line for r in records.digest_head(df).collect()] == ["# AI 日报 · 2024-01-15\n\n保留条目：2\n\n主题分类统计：ai=1、未分类=1"]
    w = F.array(F.struct(L("a").alias("source_id"), L("").alias("status")), F.struct(L("a").alias("source_id"), L("failed").alias("status")), F.struct(L(" ").alias("source_id"), L("x").alias("status")))
    assert one(spark, w=records.warning_line(w))["w"] == "- 来源警告：a（failed）"
    lines_ = table(spark, [(1, i, f"l{i}") for i in range(40)] + [(2, 1, "é")], "run int, display_order int, p string")
    digests = publish.manifest(lines_, "p", ["run"])
    assert got(digests, "run", "records", "bytes") == [(1, 30, 20 * 3 + 10 * 2 + 29), (2, 1, 2)]
    runs = table(spark, [(1, "2024-01-15", False, None, None), (3, "2024-01-16", True, "x", None)], "run int, edition_date string, partial boolean, partial_reason string, reference_time timestamp")
    out = {r.run: r for r in publish.manifest_record(runs, table(spark, [(1, 5, 9)], "run int, stage_d_total int, stage_d_candidate_count int"), digests).collect()}
    assert (out[1].schema_version, out[1].artifact_status, out[1].selected_count, out[1].stage_d_candidate_count, out[1].artifacts.items_jsonl) == (7, "ready", 30, 9, "intel_items.jsonl")
    assert (out[3].artifact_status, out[3].selected_count, out[3].jsonl_bytes) == ("partial", 0, 0)


def test_display_order_needs_an_event_key(spark):
    rows = table(spark, [("d", 5, "b", "t"), ("d", 2, "a", " ")], "edition_date string, display_order int, event_key string, title string").withColumn("original_title", L(None).cast("string"))
    assert got(publish.dense_order(rows), "event_key", "display_order", "title", "original_title") == [("a", 1, "(untitled)", None), ("b", 2, "t", "t")]
    with pytest.raises(Exception, match="missing event_key"):
        publish.dense_order(rows.withColumn("event_key", L(" "))).collect()


def test_draft_workspace(spark, tmp_path):
    root = str(tmp_path)
    editions = table(spark, [(1, "2024-01-13", "x"), (2, "2024-01-14", "x"), (3, "2024-01-15", "x"), (4, "2024-01-12", None)], "edition_id int, edition_date string, published_at string").withColumns({"edition_date": F.col("edition_date").cast("date"), "status": L("published")})
    entries = table(spark, [(i, f"k{i}") for i in (1, 2, 3, 4)], "edition_id int, event_key string")
    path = drafts.create(spark, root, "2024-01-15", editions, entries)
    assert got(spark.read.parquet(f"{path}/entries"), "event_key") == [("k1",), ("k2",)]
    assert drafts.resolve(spark, root, "2024-01-15") == ("draft", path)
    audit = drafts.to_audit(spark, root, "2024-01-15")
    assert drafts.resolve(spark, root, "2024-01-15") == ("audit", audit) and got(spark.read.parquet(f"{audit}/entries"), "event_key") == [("k1",), ("k2",)]
    with pytest.raises(FileNotFoundError):
        drafts.to_audit(spark, root, "2024-01-15")
    drafts.remove(spark, audit)
    with pytest.raises(FileNotFoundError):
        drafts.resolve(spark, root, "2024-01-15")
    assert drafts.restaged("/a/x.staging/f", "/a/x.staging", "/a/x") == "/a/x/f" and drafts.restaged("/b", "/a", "/c") == "/b"
    frozen = drafts.frozen(spark, f"{root}/run", {"t": entries})
    assert got(frozen["t"], "event_key") == got(entries, "event_key")


def test_reading_of_odd_entries(spark):
    ref = "array<struct<item_id:string,source_id:string,source_name:string,source_group:string,source_url:string,title:string,is_primary:boolean,match_type:string,ai_summary:string,source_summary:string,content_text:string,content_depth:string>>"
    r = lambda i, p, u=None: (i, "s", None, None, u, None, p, None, " a &amp; b ", None, None, None)
    rows = [(1, 1, "k1", 1, "T", None, None, None, 1.5, None, None, "g", [r("5", False), r(None, True, "https://r")]), (2, 1, "k2", 2, "U", "", "s", "https://u", 2.5, "ai", "c", None, []), (3, 1, "k3", 3, "V", "O", "s", "x", None, "ai", "c", "g", [r("5", None)])]
    df = table(spark, rows, f"entry_id long, edition_id int, event_key string, display_order int, title string, original_title string, summary string, url string, display_score double, topic string, content_class string, source_group string, refs {ref}").withColumns({"source_ids": F.array(L("s"), L("q")), "risk_flags": F.array().cast("array<string>"), "keywords": F.array(L("k")), "published_at": L(None).cast("timestamp"), "reason": L(None).cast("string")})
    flat = reading.members(df)
    assert [(m.item_id, m.is_primary, m.url, m.summary) for m in flat.orderBy(*reading.in_entry_order(flat)).collect()] == [(-1002, True, "https://r", "a & b"), (5, False, None, "a & b"), (5, False, None, "a & b")]
    feed = reading.all_dynamics(df)
    assert [(m.item_id, m.entry_id, m.total) for m in feed.collect()] == [(-1002, 1, 2), (5, 1, 2)]
    sources = table(spark, [("s", "Name", "feed", "https://s", None)], "id string, name string, transport string, url string, account_url string")
    cards = {c.id: c for c in reading.cards(df, sources).collect()}
    assert (cards[1].source_name, cards[1].source_url, cards[1].display_score) == ("Name", "https://r", 2) and (cards[2].source_name, cards[2].source_url, cards[2].display_score) == ("s", None, 2) and cards[3].display_score == 0


def test_hot_keys_join_the_same(spark, monkeypatch):
    from newsloom import tables

    rows = table(spark, [(i % 3 if i % 2 else 9, i) for i in range(40)] + [(None, 99)], "k int, v int")
    side = table(spark, [(i, f"s{i}") for i in range(10)], "k int, s string")
    plain = {how: got(tables.with_hot(rows, side, "k", how), "k", "v", "s") for how in ("inner", "left")}
    edges = table(spark, [("A", "x"), ("B", "x"), ("C", "x"), ("C", "y"), ("D", "y"), ("E", "z")], "e string, k string")
    monkeypatch.setattr(tables, "HOT_ROWS", 2)
    monkeypatch.setattr(tables, "HEAVY", 10_000)
    assert {how: got(tables.with_hot(rows, side, "k", how), "k", "v", "s") for how in ("inner", "left")} == plain
    assert got(entities.components(edges, "e", "k"), "e", "component") == [("A", "A"), ("B", "A"), ("C", "A"), ("D", "A"), ("E", "E")]


def test_views_small(spark, tmp_path):
    from newsloom.operators import views

    ent = "array<struct<name:string>>"
    rows = table(spark, [(1, "Alpha", None, "body", None, ["Key"], [("Acme",)]), (2, "Beta", "alpha", None, None, None, None)], f"i int, title string, summary string, content_text string, summary_cn string, keywords array<string>, entities {ent}")
    assert got(views.candidate_matches(rows, " ALPHA acme "), "i") == [(1,)] and got(views.history_matches(rows, "alpha"), "i") == [(1,), (2,)] and views.candidate_matches(rows, "body key").count() == 1 and views.history_matches(rows, "body").count() == 0
    st = table(spark, [("a",), ("b",), ("a",), ("",), (None,)], "status string")
    assert [tuple(r) for r in views.status_counts(st).collect()] == [("a", 2), ("b", 1)]
    r = one(spark, a=views.stage_name(L(" Stage-A")), b=views.stage_name(L("d")), c=views.stage_name(L("x")))
    assert list(r.values()) == ["screen", "stage_d", None]
    ev, mem = table(spark, [(1,), (2,)], "event_id int"), table(spark, [(2, 5), (1, 5), (2, 6)], "event_id int, item_id int")
    assert [r.event_id for r in views.event_of_item(ev, mem, 5).collect()] == [1] and [r.item_id for r in views.children(mem, "event_id", 2, ["item_id"]).collect()] == [5, 6]
    publish.fetch_export(table(spark, [("T", "u", "s", 1)], "title string, url string, source_id string, a int"), str(tmp_path / "f"))
    assert [r.value for r in spark.read.text(str(tmp_path / "f" / "items")).collect()] == ['{"a":1,"source_id":"s","title":"T","url":"u"}'] and [r.value for r in spark.read.text(str(tmp_path / "f" / "digest")).collect()] == ["- [T](u) s"]
    recs = table(spark, [(2, "b"), (1, "a")], "display_order int, title string")
    dig = table(spark, [(1, 1, "y"), (1, 0, "x")], "display_order int, line_no int, line string")
    publish.export_edition(recs, dig, recs.limit(1), spark, str(tmp_path / "daily"))
    assert [r.value for r in spark.read.text(str(tmp_path / "daily" / "intel_digest.md")).collect()] == ["x", "y"] and spark.read.json(str(tmp_path / "daily" / "intel_items.jsonl")).count() == 2
