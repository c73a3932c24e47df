"""Queries of the smaller rules: texts, links, hashes, numbers, times, JSON, metadata, guards, sources, payloads, exports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .catalog import query
from .functions import dates, hashes, numbers, structured, text, urls
from .operators import events, listing, policy, projects, ranking, state, views
from .plans import drafts, publish
from .sources import feeds, pages
from .tables import shared_folder, table

NOW = "2024-02-01 12:00:00"


def _case(column: str, n: int, values: list[str]) -> str:
    """A SQL case over column modulo n that both engines read; what isn't listed is null."""
    return f"CASE {column} % {n} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


# ---- texts and links -----------------------------------------------------------------------------

_TRIM, _TOKEN, _ERROR = _case("doc_id", 4, ["'  '", "' ' || lang || ' '", "lang"]), _case("doc_id", 3, ["source", "upper(source)", "'-' || source"]), _case("doc_id", 4, ["''", "': odd'", "' http_503 : down: now '"])


@query(f"""WITH d AS (SELECT doc_id, lang, source, {_TRIM} AS t, {_TOKEN} AS k, {_ERROR} AS e FROM documents)
  SELECT doc_id, nullif(trim(t), '') AS trimmed, regexp_full_match(coalesce(k, ''), '[a-z0-9][a-z0-9_-]*') AS token, CASE WHEN e = '' THEN NULL WHEN e = ': odd' THEN 'fetch_failed' WHEN e IS NOT NULL THEN 'http_503' END AS code, substr(trim(coalesce(e, '')), 1, 9) AS cut,
    substr(source || ' ' || lang || ' b c d', 1, 12) AS search FROM d""")
def f11_texts(spark, d):
    rows = table(spark, d, "documents").selectExpr("doc_id", "lang", "source", f"{_TRIM} AS t", f"{_TOKEN} AS k", f"{_ERROR} AS e")
    words = F.array(F.col("lang"), *map(F.lit, "bcdef"))
    return rows.select("doc_id", text.trimmed_or_null(F.col("t")).alias("trimmed"), text.is_source_token(F.col("k")).alias("token"), text.error_code(F.col("e")).alias("code"), text.truncated(F.col("e"), 9).alias("cut"), text.search_text(F.col("source"), words, 12).alias("search"))


_REPO = _case("o_orderkey", 6, ["'https://github.com/Own/Repo' || CAST(o_custkey AS STRING) || '.git'", "'HTTP://www.GitHub.com/own/r' || CAST(o_custkey AS STRING) || '/?x=1'", "'https://github.com/own'", "'https://github.com/own/r/issues/' || CAST(o_custkey AS STRING)", "'https://gitlab.com/own/r'"])


@query(f"""WITH o AS (SELECT o_orderkey, o_custkey, o_orderkey % 6 AS k FROM orders) SELECT o_orderkey, CASE k WHEN 0 THEN 'own/repo' || o_custkey WHEN 1 THEN 'own/r' || o_custkey END AS repo, CASE k WHEN 0 THEN 'Own/Repo' || o_custkey WHEN 1 THEN 'own/r' || o_custkey WHEN 3 THEN 'own/r' END AS name,
    CASE WHEN k = 0 THEN 'ai pushed:>2024-01-01' WHEN k = 1 THEN 'topic:llm pushed:>2024-02-03' END AS search, CASE k WHEN 0 THEN 'https://github.com/Own/Repo' || o_custkey WHEN 1 THEN 'https://github.com/own/r' || o_custkey WHEN 3 THEN 'https://github.com/own/r' END AS link FROM o""")
def f14_repositories(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey", f"{_REPO} AS u")
    k = F.col("o_orderkey") % 6
    asked = F.when(k == 0, "ai pushed:>2024-01-01").when(k == 1, " topic:llm ")
    return rows.select("o_orderkey", urls.github_repo(F.col("u")).alias("repo"), urls.repo_full_name(F.col("u")).alias("name"), pages.pushed_query(asked, F.lit("2024-02-03").cast("date")).alias("search"), feeds.project_link(F.concat(F.lit("see "), F.col("u"), F.lit(" now"))).alias("link"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id % 50 WHEN 1 THEN 1500 + event_id % 7 * 1000 END AS votes, CASE WHEN event_id % 3 = 1 THEN event_id % 90 END AS comments, CASE event_id % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'summary' ELSE 'missing' END AS depth, CASE WHEN event_id % 5 < 3 THEN event_id END AS post_id FROM events""")
def f15_engagement(spark, d):
    i = F.col("event_id")
    n = lambda c: c.cast("string")
    said = F.when(i % 3 == 0, F.concat(F.lit("got "), n(i % 50), F.lit(" Upvotes today"))).when(i % 3 == 1, F.concat(F.lit("upvotes: "), n(i % 7 + 1), F.lit(",500; comments: "), n(i % 90))).otherwise("nothing")
    link = F.when(i % 5 == 0, F.concat(F.lit("https://t.co/?p="), n(i))).when(i % 5 == 1, F.concat(F.lit("https://t.co/9?a=1&p="), n(i), F.lit("#x"))).when(i % 5 == 2, F.concat(F.lit("/?p="), n(i), F.lit("&q=2"))).otherwise("https://t.co/?p=x")
    votes = pages.engagement(said, "upvote")
    body = F.when(i % 4 == 0, "b").otherwise(" ")
    return table(spark, d, "events").select("event_id", votes.alias("votes"), pages.engagement(said, "comment").alias("comments"), pages.content_depth(body, F.when(i % 4 < 2, "s")).alias("depth"), pages.wordpress_post_id(link).alias("post_id"))


# ---- hashes, numbers, times ----------------------------------------------------------------------

@query("""SELECT doc_id, sha256(lower('T ' || source) || chr(10) || coalesce(lang, '') || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 's' ELSE '' END || chr(10) || coalesce(text, '')) AS feed, sha256(CASE WHEN doc_id % 3 = 0 THEN 'h' || doc_id ELSE source || '|' || lang || '|' END) AS fingerprint,
  sha256('{"a":' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ',"b":"' || lang || '"' END || '}') AS policy, substr(sha256(source || chr(10) || lang), 1, 24) AS short FROM documents""")
def f31_hashes(spark, d):
    i = F.col("doc_id")
    given = F.when(i % 3 == 0, F.concat(F.lit("h"), i.cast("string"))).otherwise("")
    return table(spark, d, "documents").select(
        "doc_id", hashes.feed_hash(F.concat(F.lit("T "), "source"), F.col("lang"), F.when(i % 2 == 0, "s"), F.col("text")).alias("feed"), hashes.item_fingerprint(given, F.col("source"), F.col("lang"), F.lit(None).cast("string")).alias("fingerprint"),
        hashes.policy_fingerprint({"b": F.when(i % 2 == 1, F.col("lang")), "a": i}).alias("policy"), hashes.short_id(F.col("source"), F.col("lang")).alias("short"),
    )


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '-' ELSE format('{:,}', p_size * 12345) END AS shown, CASE p_partkey % 3 WHEN 0 THEN least(40, greatest(5, p_size)) WHEN 1 THEN 10 ELSE 10 END::BIGINT AS bounded, greatest(p_size, 25)::BIGINT AS never_less, greatest(600, least(7200, p_size * 120))::BIGINT AS lease,
  CASE p_partkey % 4 WHEN 0 THEN 1500 WHEN 1 THEN 2000000 WHEN 2 THEN 1234 ELSE 0 END::BIGINT AS counted FROM part""")
def f43_numbers(spark, d):
    size, k = F.col("p_size").cast("long"), F.col("p_partkey")
    written = F.when(k % 3 == 0, F.concat(size.cast("string"), F.lit(".9"))).when(k % 3 == 1, "x")
    figure = F.when(k % 4 == 0, "1.5k").when(k % 4 == 1, "2M").when(k % 4 == 2, "1,234").otherwise("-7")
    return table(spark, d, "part").select("p_partkey", numbers.thousands(F.when(size % 5 != 0, size * 12345).otherwise(0)).alias("shown"), numbers.bounded_int(written, 5, 40, 10).alias("bounded"), projects.merged_counter(size, F.lit(25).cast("long")).alias("never_less"), state.lease_seconds(size, 120, 600, 7200).cast("long").alias("lease"), projects.count_of(figure).alias("counted"))


@query(f"""SELECT event_id, round((epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 3600000000.0, 6) AS age, CASE event_id % 4 WHEN 0 THEN DATE '2024-01-15' WHEN 1 THEN DATE '2024-02-01' WHEN 2 THEN NULL ELSE DATE '2024-02-01' END AS edition, CASE event_id % 5 WHEN 0 THEN 'future_timestamp' WHEN 1 THEN 'missing_published_at' WHEN 2 THEN 'too_old' END AS exclusion,
  CASE WHEN event_id % 9 = 0 THEN 0 ELSE least(86400, 60 * pow(2, event_id % 9 - 1)) END::BIGINT AS backoff, epoch_us(TIMESTAMP '2024-01-13 16:00:00' + INTERVAL 24 HOUR * (event_id % 3)::INT) AS cutoff FROM events""")
def f52_dates(spark, d):
    i, now = F.col("event_id"), F.lit(NOW).cast("timestamp")
    given = F.when(i % 4 == 0, " 2024-01-15 ").when(i % 4 == 1, "").when(i % 4 == 2, "2024-1-5")
    said = F.when(i % 5 == 0, "From the FUTURE").when(i % 5 == 1, "Missing publish time").when(i % 5 == 2, "out of window").when(i % 5 == 3, "odd")
    day = F.date_add(F.lit("2024-01-15").cast("date"), (i % 3).cast("int"))
    return table(spark, d, "events").select("event_id", F.round(dates.age_hours(F.col("ts"), now), 6).alias("age"), dates.edition_or_today(given, now).alias("edition"), dates.time_exclusion(said).alias("exclusion"), dates.backoff_seconds(i % 9).alias("backoff"), F.unix_micros(dates.cutoff(day)).alias("cutoff"))


# ---- JSON and metadata ---------------------------------------------------------------------------

@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 's' || user_id WHEN 1 THEN 'c' || user_id END AS stars, '{"a":"' || event_type || '","z":' || event_id || '}' AS stable, event_id % 6 IN (0, 1, 2) AS truth, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'a,kept' END AS keys, CASE event_id % 4 WHEN 0 THEN 'x,y' ELSE '' END AS strings FROM events""")
def f61_json(spark, d):
    i, u = F.col("event_id"), F.col("user_id").cast("string")
    first = F.when(i % 3 == 0, F.create_map(F.lit("stars"), F.concat(F.lit("s"), u))).otherwise(F.create_map(F.lit("other"), u))
    second = F.when(i % 3 == 1, F.create_map(F.lit("star_count"), F.concat(F.lit("c"), u))).otherwise(F.create_map(F.lit("other"), u))
    truth = F.when(i % 6 == 0, " TRUE ").when(i % 6 == 1, "1").when(i % 6 == 2, "on").when(i % 6 == 3, "no").when(i % 6 == 4, "")
    bag = F.create_map(F.lit("a"), u, F.lit("Run_ID"), u, F.lit("x_run_id"), u, F.when(i % 2 == 0, "_run_id").otherwise("kept"), u)
    listed = F.when(i % 4 == 0, '["x","y"]').when(i % 4 == 1, "{").when(i % 4 == 2, '{"x":1}')
    return table(spark, d, "events").select("event_id", structured.first_alias("stars", first, second).alias("stars"), hashes.stable_json({"z": i, "n": F.lit(None).cast("string"), "a": F.col("event_type")}).alias("stable"), structured.is_true(truth).alias("truth"), F.array_join(F.array_sort(F.map_keys(structured.without_internal_keys(bag))), ",").alias("keys"), F.array_join(structured.decoded_strings(listed), ",").alias("strings"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '["' || repeat('t', 128) || '","u"]' END AS topics, CASE s_suppkey % 3 WHEN 0 THEN 'MIT' WHEN 1 THEN 'plain' END AS license, (s_suppkey * 7)::VARCHAR AS stars, 'kept' AS other, CASE WHEN s_suppkey % 4 = 0 THEN 'archived,missing_license' WHEN s_suppkey % 4 = 1 THEN 'fork' ELSE 'missing_license' END || CASE WHEN s_suppkey % 5 = 0 THEN ',missing_readme' ELSE '' END || ',given' AS flags FROM supplier""")
def f65_metadata(spark, d):
    k = F.col("s_suppkey")
    topics = F.when(k % 2 == 0, F.concat(F.lit('["'), F.repeat(F.lit("t"), F.lit(200)), F.lit('"," ","u"]')))
    licence = F.when(k % 3 == 0, '{"spdx_id":"MIT","name":"x"}').when(k % 3 == 1, "plain")
    meta = F.map_filter(F.create_map(F.lit("topics"), topics, F.lit("license"), licence, F.lit("stargazers_count"), (k * 7).cast("string"), F.lit("secret"), F.lit("x")), lambda _, v: v.isNotNull())
    bounded = projects.bounded_metadata(meta)
    over = projects.overlaid(F.create_map(F.lit("stars"), F.lit("1"), F.lit("other"), F.lit("kept")), bounded)
    got = lambda m, n: F.try_element_at(m, F.lit(n))
    flags = projects.risk_flags(k % 4 == 0, k % 4 == 1, F.when(k % 4 == 1, "MIT"), F.when(k % 5 != 0, "r"), F.array(F.lit("given")))
    return table(spark, d, "supplier").select("s_suppkey", got(bounded, "topics").alias("topics"), got(over, "license").alias("license"), got(over, "stars").alias("stars"), got(over, "other").alias("other"), F.array_join(flags, ",").alias("flags"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_size >= 20 THEN 'weekly' WHEN p_partkey % 2 = 0 THEN 'daily' ELSE 'weekly' END AS best, CASE WHEN p_partkey % 2 = 0 THEN 20 ELSE 0 END::BIGINT AS daily, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 7 END::BIGINT AS weekly, CASE p_partkey % 4 WHEN 0 THEN 'a,b' WHEN 1 THEN 'one' WHEN 2 THEN 'v1' ELSE '' END AS releases, p_type || ',x' || CASE WHEN p_type = 'x' THEN '' ELSE ',' || p_brand END AS topics FROM part""")
def f66_trending_map(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    bag = F.when(k % 2 == 0, F.create_map(F.lit("trending"), F.concat(F.lit('{"weekly":{"stars_since":"'), size, F.lit('"}}')), F.lit("trending_period"), F.lit(" daily "), F.lit("stars_since"), F.lit("20"))).otherwise(F.create_map(F.lit("trending_period"), F.lit("weekly"), F.lit("stars_since"), F.lit("7")))
    periods = projects.trending(bag)
    numbered = F.transform_values(periods, lambda _, v: F.struct(v["stars_since"].try_cast("double").alias("stars_since")))
    names = F.when(k % 4 == 0, '[{"name":"a"},{"name":" ","tag_name":"b"},{"name":""}]').when(k % 4 == 1, '{"name":"one"}').when(k % 4 == 2, "v1")
    topics = projects.ordered_union(F.array("p_type", F.lit("x")), F.array("p_brand", F.lit("x")))
    return table(spark, d, "part").select("p_partkey", projects.best_period(numbered).alias("best"), projects.since(periods, "daily").alias("daily"), projects.since(periods, "weekly").alias("weekly"), F.array_join(projects.release_names(names), ",").alias("releases"), F.array_join(topics, ",").alias("topics"))


# ---- guards and sources --------------------------------------------------------------------------

@query("""SELECT doc_id, doc_id % 4 IN (0, 1) AS screened_in, CASE doc_id % 3 WHEN 0 THEN least(100, doc_id % 150) WHEN 1 THEN 0 END::INTEGER AS relevance, CASE WHEN doc_id % 5 = 0 THEN 'analysis_failed' WHEN doc_id % 7 < 2 AND doc_id % 2 = 1 THEN 'summary_empty' END AS failure,
  CASE WHEN doc_id % 5 = 0 AND doc_id % 7 < 2 THEN '' WHEN doc_id % 7 >= 2 THEN 'sum' WHEN doc_id % 2 = 0 THEN 'src' ELSE '' END AS summary, doc_id % 6 = 0 AS trending, doc_id % 4 = 2 OR doc_id % 4 = 0 AND doc_id % 3 = 0 AS warning, doc_id % 3 <> 2 AND doc_id % 2 = 0 AS wants FROM documents""")
def p07_guards(spark, d):
    i = F.col("doc_id")
    decision = F.when(i % 4 == 0, "pass").when(i % 4 == 1, "uncertain").when(i % 4 == 2, "reject")
    parts = F.when(i % 3 == 0, F.create_map(F.lit("audience_relevance"), (i % 150).cast("string"))).when(i % 3 == 1, F.create_map(F.lit("audience_relevance"), F.lit("high"))).otherwise(F.create_map(F.lit("other"), F.lit("5")))
    made, failure = policy.analysis_guard(F.when(i % 5 != 0, "success").otherwise("failed"), F.when(i % 7 >= 2, "sum").otherwise(""), F.when(i % 2 == 0, " src ").otherwise(" "), F.lit(" "))
    shown = F.when((i % 5 == 0) & (i % 7 < 2), "").otherwise(made)
    none = F.array().cast("array<string>")
    warning = policy.is_source_warning(F.when(i % 4 % 2 == 0, "fetch").otherwise("screen"), F.when(i % 4 == 2, F.array(F.lit("s"))).otherwise(none), none, F.when(i % 3 == 0, 2), F.lit(None).cast("string"))
    wants = policy.wants_article(F.when(i % 3 != 2, "s1").otherwise("s2"), F.when(i % 2 == 0, "summary").otherwise("full"), F.lit("https://e.org"), ("s1",))
    return table(spark, d, "documents").select("doc_id", policy.screened_in(decision).alias("screened_in"), policy.relevance(parts).alias("relevance"), failure.alias("failure"), shown.alias("summary"), policy.is_trending(F.when(i % 2 == 0, "GitHub"), F.when(i % 3 == 0, "Trending")).alias("trending"), warning.alias("warning"), wants.alias("wants"))


@query("""SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'https://h.org/s' || s_suppkey WHEN 1 THEN 'https://h.org/x' WHEN 2 THEN NULL ELSE 'plain' END AS url, CASE s_suppkey % 3 WHEN 0 THEN 'If-None-Match=e' || s_suppkey WHEN 1 THEN 'If-Modified-Since=m' ELSE '' END AS headers, CASE s_suppkey % 5 WHEN 0 THEN 'feed' WHEN 1 THEN 'rsshub' WHEN 2 THEN 'github' ELSE 'none' END AS routed,
  CASE s_suppkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'rate_limited' WHEN 2 THEN 'auth_or_access_denied' WHEN 3 THEN 'permanent_http_error' WHEN 4 THEN 'transient_http_error' WHEN 5 THEN 'http_error' END AS error, CASE s_suppkey % 9 WHEN 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'success' ELSE 'degraded' END WHEN 6 THEN 'not_modified' ELSE 'failed' END AS landed FROM supplier""")
def s01_sources(spark, d):
    k = F.col("s_suppkey")
    n = k.cast("string")
    rows = table(spark, d, "supplier").select(k.alias("id"), F.when(k % 4 == 0, F.concat(F.lit("${RSS_BASE_URL}/s"), n)).when(k % 4 == 1, "${RSS_BASE_URL}/${NAME}").when(k % 4 == 2, "${NONE}/x").otherwise("plain").alias("url"), F.when(k % 3 == 0, F.concat(F.lit("e"), n)).alias("etag"), F.when(k % 3 == 1, "m").otherwise("").alias("last_modified"), F.when(k % 5 == 0, "feed").when(k % 5 == 1, "rsshub").when(k % 5 == 2, "github").when(k % 5 == 3, "odd").alias("transport"))
    by, left = feeds.routed(rows)
    ways = left.select("id", F.lit("none").alias("routed"))
    for name, part in by.items():
        ways = ways.unionByName(part.select("id", F.lit(name).alias("routed")))
    heads = feeds.conditional_headers(rows).select("id", F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("headers"))
    status = F.get(F.array(*map(F.lit, (200, 429, 401, 404, 503, 418, 304))), (F.col("id") % 9).cast("int"))
    told = rows.select("id", feeds.interpolated(F.col("url"), {"RSS_BASE_URL": "https://h.org/", "NAME": "x"}).alias("url"), F.when(status != 304, feeds.error_class(status)).alias("error"), feeds.landed_status(status, F.lit("b"), F.when(F.col("id") % 2 == 0, 3)).alias("landed"))
    return told.join(heads, "id").join(ways, "id")


_SPEC = {
    "id": "CASE WHEN s_suppkey % 7 = 0 THEN 'Bad Id' || CAST(s_suppkey AS STRING) ELSE 's' || CAST(s_suppkey AS STRING) END", "source_group": "CASE WHEN s_suppkey % 11 = 0 THEN 'Odd!' END", "url": "CASE WHEN s_suppkey % 5 = 0 THEN '/relative' ELSE 'https://e.org/x' END", "priority": "CAST(s_suppkey % 3 - 1 AS INT)", "fetch_interval": "CAST(s_suppkey % 4 AS INT)", "default_limit": "5",
    "transport": "CASE s_suppkey % 2 WHEN 0 THEN 'feed' ELSE 'github' END", "feed_format": "CASE WHEN s_suppkey % 13 = 0 THEN 'atom' END", "feed_adapter": "CAST(NULL AS STRING)", "github_mode": "CASE WHEN s_suppkey % 3 = 0 THEN 'releases' END",
}


@query(f"""WITH s AS (SELECT s_suppkey, {', '.join(f'{v} AS {k}' for k, v in _SPEC.items())} FROM supplier), v AS (SELECT id, unnest(list_filter([CASE WHEN s_suppkey % 7 = 0 THEN 'id_token' END, CASE WHEN s_suppkey % 11 = 0 THEN 'source_group_token' END, CASE WHEN s_suppkey % 5 = 0 THEN 'absolute_url' END, CASE WHEN priority < 0 THEN 'priority_negative' END,
  CASE WHEN fetch_interval <= 0 THEN 'fetch_interval_not_positive' END, CASE WHEN transport = 'feed' AND github_mode IS NOT NULL THEN 'feed_with_github_options' END, CASE WHEN transport = 'github' AND feed_format IS NOT NULL THEN 'github_with_feed_options' END, CASE WHEN transport = 'github' AND github_mode IS NULL THEN 'github_without_options' END], lambda x: x IS NOT NULL)) AS violation FROM s) SELECT id, violation FROM v""")
def p41_source_rules(spark, d):
    rows = table(spark, d, "supplier").selectExpr(*(f"{v} AS {k}" for k, v in _SPEC.items()), *(f"CAST(NULL AS STRING) AS {c}" for c in ("github_query", "github_sort", "github_order", "github_period", "account_url")), "CAST(NULL AS INT) AS github_pushed_days")
    checked = ("id_token", "source_group_token", "absolute_url", "priority_negative", "fetch_interval_not_positive", "feed_with_github_options", "github_with_feed_options", "github_without_options")
    return policy.source_violations(rows).filter(F.col("violation").isin(*checked))


# ---- payloads ------------------------------------------------------------------------------------

@query("""WITH s AS (SELECT s_nationkey, s_suppkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS position FROM supplier)
  SELECT 'n' || s_nationkey AS source_id, position::INTEGER AS position, 'github_repo:own/' || lower(replace(s_name, '#', '-')) AS external_id, 'Own/' || replace(s_name, '#', '-') AS title, s_suppkey * 3 AS stars, CASE WHEN s_suppkey % 2 = 0 THEN 'a,b' ELSE '' END AS topics FROM s""")
def s07_repositories(spark, d):
    """Suppliers as repositories in a search answer a nation."""
    k = F.col("s_suppkey")
    one = F.to_json(F.struct(F.concat(F.lit("Own/"), F.replace("s_name", F.lit("#"), F.lit("-"))).alias("full_name"), (k * 3).alias("stargazers_count"), F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("b"))).alias("topics"), F.lit(False).alias("archived")))
    many = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", one.alias("j")))), lambda x: x["j"]).alias("js"))
    landed = many.select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("source_id"), F.concat(F.lit('{"items":['), F.array_join("js", ","), F.lit("]}")).alias("body"))
    return feeds.repositories(landed).select("source_id", "position", "external_id", "title", "stars", F.coalesce(F.array_join("topics", ","), F.lit("")).alias("topics"))


@query("SELECT 's' || s_nationkey AS source_id, 'github_release:' || s_suppkey AS external_id, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'v' || s_suppkey END AS title, 'https://e.org/' || s_suppkey AS url FROM supplier")
def s08_releases(spark, d):
    k = F.col("s_suppkey")
    one = F.to_json(F.array(F.struct(k.alias("id"), F.when(k % 2 == 0, F.col("s_name")).alias("name"), F.concat(F.lit("v"), k.cast("string")).alias("tag_name"), F.concat(F.lit("https://e.org/"), k.cast("string")).alias("html_url"))))
    landed = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_nationkey").cast("string")).alias("source_id"), one.alias("body"))
    return feeds.releases(landed).select("source_id", "external_id", "title", "url")


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang || '!' WHEN 1 THEN lang || source WHEN 2 THEN lang END AS answer, CASE doc_id % 3 WHEN 0 THEN substr(lang || ' readme', 1, 6) WHEN 1 THEN substr(source || ' plain', 1, 6) END AS readme, CASE doc_id % 2 WHEN 0 THEN 'u' || doc_id ELSE 'l' || doc_id END AS url FROM documents""")
def s25_answers(spark, d):
    i = F.col("doc_id")
    n = i.cast("string")
    typed = lambda kind, t: F.struct(F.lit(kind).alias("type"), t.alias("text"))
    parts = F.to_json(F.struct(F.array(F.struct(F.lit("message").alias("type"), F.array(typed("output_text", F.col("lang")), typed("other", F.lit("no")), typed("output_text", F.col("source"))).alias("content"))).alias("output")))
    body = F.when(i % 4 == 0, F.to_json(F.struct(F.concat("lang", F.lit("!")).alias("output_text")))).when(i % 4 == 1, parts).when(i % 4 == 2, F.to_json(F.struct(F.array(F.struct(F.struct(F.col("lang").alias("content")).alias("message"))).alias("choices")))).otherwise("{")
    content = F.when(i % 3 == 0, F.base64(F.concat("lang", F.lit(" readme")).cast("binary"))).when(i % 3 == 1, F.concat("source", F.lit(" plain"))).otherwise(" ")
    loose = feeds.loose_record(F.create_map(F.lit("canonical_url"), F.lit(" "), F.when(i % 2 == 0, "url").otherwise("link"), F.concat(F.when(i % 2 == 0, "u").otherwise("l"), n)))
    return table(spark, d, "documents").select("doc_id", feeds.answer_text(body).alias("answer"), feeds.readme(content, F.when(i % 3 == 0, "Base64"), 6).alias("readme"), loose["canonical_url"].alias("url"))


# ---- rows and runs -------------------------------------------------------------------------------

@query("SELECT event_type AS status, count(*) AS n FROM events WHERE event_id % 2 = 0 AND user_id % 3 = 1 GROUP BY 1")
def g01_status_counts(spark, d):
    rows = table(spark, d, "events").selectExpr("event_id AS run_item_id", "user_id % 3 AS build_id", "CASE WHEN event_id % 2 = 0 THEN 'fetched' ELSE 'late' END AS role", "event_type AS status")
    return views.status_counts(state.run_items(views.within_build(rows, 1), roles=("fetched",)))


@query("SELECT event_type AS status, count(*) AS n FROM events WHERE event_type IN ('click', 'error') GROUP BY 1")
def p12_run_items(spark, d):
    rows = table(spark, d, "events").selectExpr("event_id AS run_item_id", "'fetched' AS role", "event_type AS status")
    return views.status_counts(state.run_items(rows, statuses=("click", "error")))


@query("""WITH r AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'weekly' WHEN 1 THEN 'daily' END AS period, CASE WHEN p_partkey % 2 = 0 THEN (p_size % 30)::INTEGER END AS rank, p_size AS since, p_retailprice AS stars FROM part),
  w AS (SELECT 'weekly' AS section, row_number() OVER (ORDER BY coalesce(rank, 1000000000), since DESC, stars, p_partkey) AS place, p_partkey FROM r WHERE period = 'weekly' QUALIFY place <= 20), d AS (SELECT 'daily' AS section, row_number() OVER (ORDER BY coalesce(rank, 1000000000), since DESC, stars, p_partkey) AS place, p_partkey FROM r WHERE period = 'daily' QUALIFY place <= 20),
  s AS (SELECT 'search' AS section, row_number() OVER (ORDER BY stars DESC, p_partkey) AS place, p_partkey FROM r WHERE period IS NULL QUALIFY place <= 20)
  SELECT section, place::INTEGER AS place, p_partkey AS external_id FROM (SELECT * FROM w UNION ALL SELECT * FROM d UNION ALL SELECT * FROM s)""")
def k07_report(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(k.alias("external_id"), F.when(k % 3 == 0, "weekly").when(k % 3 == 1, "daily").alias("period"), F.when(k % 2 == 0, F.col("p_size") % 30).cast("int").alias("rank"), F.col("p_size").alias("stars_since"), F.col("p_retailprice").alias("stars"), F.lit(None).cast("string").alias("pushed_at"))
    return projects.report(rows)


_IDS = "CASE o_orderkey % 5 WHEN 0 THEN '[1, 2, 3]' WHEN 1 THEN '[2, 2]' WHEN 2 THEN '[0, 4]' WHEN 3 THEN '{}' ELSE '[\"7\", ' || CAST(o_custkey + 6 AS STRING) || '1]' END"


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '1,2,3' WHEN 4 THEN '7,' || (o_custkey + 6) || '1' END AS strict, CASE o_orderkey % 5 WHEN 1 THEN 'duplicate_id' WHEN 2 THEN 'not_a_positive_id' WHEN 3 THEN 'not_a_list' END AS error, (o_custkey + 6) || ',5' AS loose FROM orders""")
def e16_ids(spark, d):
    ids, error = events.strict_ids(F.expr(_IDS))
    six = (F.col("o_custkey") + 6).cast("string")
    loose = events.positive_ids(F.array(six, F.lit("x"), F.lit("-3"), six, F.lit("5"), F.lit("9")), 2)
    csv = lambda c: F.array_join(c.cast("array<string>"), ",")
    return table(spark, d, "orders").select("o_orderkey", csv(ids).alias("strict"), error.alias("error"), csv(loose).alias("loose"))


@query("SELECT doc_id FROM documents WHERE lower(source || ' kw ' || lang) LIKE '%src1%' AND lang = 'de'")
def p18_history_search(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("title"), F.lit(None).cast("string").alias("summary"), F.array(F.lit("kw")).alias("keywords"), F.array(F.struct(F.concat(F.lit("in-"), "lang").alias("name"))).alias("entities"))
    return views.history_matches(rows, "SRC1 in-de").select("doc_id")


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'screen' WHEN 1 THEN 'analyze' WHEN 2 THEN 'cluster' WHEN 3 THEN 'stage_d' WHEN 4 THEN 'export' END AS stage, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN event_id % 50 END AS evidence_event, CASE WHEN user_id % 20 = 3 THEN 'gone' ELSE 'kept' END AS build FROM events""")
def t16_cleared(spark, d):
    i = F.col("event_id")
    rows = table(spark, d, "events").select(i.alias("evidence_id"), "user_id", F.when(i % 3 == 0, i % 50).alias("event_id"))
    cleared = rows.filter("evidence_id % 7 = 0 AND evidence_id % 3 = 0").select("event_id").distinct().filter("event_id < 0")
    kept = state.without_events(rows.select("evidence_id", "event_id"), cleared).select("evidence_id", F.when(F.col("evidence_id") % 7 != 0, F.col("event_id")).alias("evidence_event"))
    there = state.without_build({"t": rows.select(F.col("evidence_id"), (F.col("user_id") % 20).alias("run_id"))}, 3)["t"].select("evidence_id", F.lit("kept").alias("_kept"))
    name = F.when(i % 6 == 0, " Stage-A ").when(i % 6 == 1, "B").when(i % 6 == 2, "stage_c").when(i % 6 == 3, "D").when(i % 6 == 4, "export").otherwise("odd")
    staged = table(spark, d, "events").select(i.alias("evidence_id"), views.stage_name(name).alias("stage"))
    return staged.join(kept, "evidence_id").join(there, "evidence_id", "left").select(F.col("evidence_id").alias("event_id"), "stage", "evidence_event", F.coalesce("_kept", F.lit("gone")).alias("build"))


# ---- exports and drafts --------------------------------------------------------------------------

@query("SELECT display_order, event_key FROM (SELECT row_number() OVER (ORDER BY doc_id DESC) AS display_order, 'k' || doc_id AS event_key FROM documents) WHERE display_order <= 30")
def k02_export(spark, d):
    """The first thirty of all documents by falling id, exported as lines and read again as the newest export."""
    root = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    rows = ranking.ranked(table(spark, d, "documents").select("doc_id", F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("event_key")), [F.desc("doc_id")], "display_order").drop("doc_id")
    publish.export_jsonl(rows, f"{root}/intel_items.jsonl", 30)
    return feeds.json_lines(spark, f"{root}/intel_items.jsonl", "display_order long, event_key string")


@query("""SELECT kind, count(*) AS n FROM (SELECT 'edition' AS kind FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey < 100 UNION ALL SELECT 'entry' FROM lineitem WHERE l_orderkey % 3 <> 0 AND l_orderkey < 100) GROUP BY 1""")
def k10_drafts(spark, d):
    """A draft of day 100 holds what was published before; it becomes the audit, which is what is found then."""
    root = f"{shared_folder(spark)}/drafts-{uuid.uuid4().hex}"
    day = lambda c: F.date_add(F.lit("2024-01-01").cast("date"), c.cast("int"))
    editions = table(spark, d, "orders").select(F.col("o_orderkey").alias("edition_id"), day(F.col("o_orderkey")).alias("edition_date"), F.when(F.col("o_orderkey") % 3 != 0, F.lit(NOW)).alias("published_at"))
    drafts.create(spark, root, "2024-04-10", editions, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("edition_id"), "l_linenumber"))
    drafts.to_audit(spark, root, "2024-04-10")
    _, path = drafts.resolve(spark, root, "2024-04-10")
    both = spark.read.parquet(f"{path}/editions").select(F.lit("edition").alias("kind")).unionByName(spark.read.parquet(f"{path}/entries").select(F.lit("entry").alias("kind")))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_nationkey AS source, s_suppkey AS item FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) <= 2")
def w19_first_items(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_nationkey").alias("source_id"), F.col("s_suppkey").alias("position"))
    return feeds.first_per_source(rows, 2).select(F.col("source_id").alias("source"), F.col("position").alias("item"))


@query("SELECT o_custkey AS event_id, min(l_partkey % 500) AS item_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def j06_first_member(spark, d):
    """The first item of each customer's orders, as an event's members give it."""
    members = listing.looked_up(table(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 500).alias("item_id")), "l_orderkey", table(spark, d, "orders"), "o_orderkey", [F.col("o_custkey").alias("event_id")])
    firsts = listing.united(members.filter("event_id is not null"), "event_id", "item_id", ["item_id"])
    return firsts.select("event_id", F.get("values", F.lit(0)).alias("item_id"))
