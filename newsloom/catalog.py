"""All queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import surrogates
from .functions import dates, hashes, numbers, structured, text, urls
from .operators import entities, listing, policy, ranking, state, views
from .plans import publish
from .tables import ITEMS_SQL, items, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
EDITION, REFERENCE = "2024-01-15", "2024-01-15 12:00:00"


def query(sql: str | None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _micros(ts: str) -> F.Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


# ---- policy ------------------------------------------------------------------------------------

@query(f"""SELECT event_id, reason IN ('trending_exempt', 'within_window') AS eligible, reason, round((epoch_us(TIMESTAMP '{REFERENCE}') - epoch_us(ts)) / 3600000000.0, 6) AS age_hours FROM
  (SELECT *, CASE WHEN event_type = 'signup' THEN 'trending_exempt' WHEN ts IS NULL THEN 'missing_published_at' WHEN ts > TIMESTAMP '{REFERENCE}' THEN 'future_timestamp'
   WHEN ts < TIMESTAMP '2024-01-13 16:00:00' THEN 'too_old' ELSE 'within_window' END AS reason FROM events)""")
def p03_freshness_gate(spark, d):
    ref = F.lit(REFERENCE).cast("timestamp")
    eligible, reason = policy.freshness(F.col("ts"), F.lit(EDITION).cast("date"), ref, F.col("event_type") == "signup")
    return table(spark, d, "events").select("event_id", eligible.alias("eligible"), reason.alias("reason"), F.round(dates.age_hours(F.col("ts"), ref), 6).alias("age_hours"))


_SCREEN = (
    "CASE item_id % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'uncertain' ELSE 'reject' END AS decision",
    "CASE item_id % 3 WHEN 0 THEN 'Pure-Advertisement' WHEN 1 THEN 'spam' ELSE 'not interesting' END AS code",
    "item_id * 37 % 101 AS confidence",
)


@query(f"""WITH {ITEMS_SQL}, s AS (SELECT item_id, {', '.join(_SCREEN)} FROM items),
  h AS (SELECT *, replace(replace(lower(trim(code)), '-', '_'), ' ', '_') IN {policy.HARD_REJECTS} AS hard FROM s)
  SELECT item_id, CASE WHEN decision = 'reject' AND (NOT hard OR confidence < 90) THEN 'uncertain' ELSE decision END AS decision,
  CASE WHEN decision = 'reject' AND NOT hard THEN 'screen:non_hard_reject_reason' WHEN decision = 'reject' AND confidence < 90 THEN 'screen:low_confidence_reject' END AS flag FROM h""")
def p06_screen_guard(spark, d):
    rows = items(spark, d).selectExpr("item_id", *_SCREEN)
    decision, flag = policy.screen_guard(F.col("decision"), F.col("code"), F.col("confidence"))
    return rows.select("item_id", decision.alias("decision"), flag.alias("flag"))


@query(f"""WITH {ITEMS_SQL}, a AS (SELECT item_id, item_id % 50 <> 0 AS projected, CASE WHEN item_id % 17 = 0 THEN '  ' ELSE title END AS summary, CASE WHEN item_id % 7 <> 0 THEN item_id * 13 % 101 END AS relevance, item_id * 29 % 101 AS score FROM items),
  r AS (SELECT item_id, CASE WHEN NOT projected THEN 'analysis_projection_missing' WHEN coalesce(trim(summary, ' '), '') = '' THEN 'analysis_structural_invalid' WHEN relevance < 60 THEN 'below_ai_relevance_threshold' WHEN score < 60 THEN 'below_score_threshold' ELSE 'analysis_ready' END AS reason FROM a)
  SELECT item_id, CASE WHEN reason = 'analysis_ready' THEN 'active' ELSE 'filtered' END AS decision, reason FROM r""")
def p10_admission_gates(spark, d):
    i = F.col("item_id")
    decision, reason = policy.admission(i % 50 != 0, F.when(i % 17 == 0, "  ").otherwise(F.col("title")), F.when(i % 7 != 0, i * 13 % 101), i * 29 % 101)
    return items(spark, d).select("item_id", decision.alias("decision"), reason.alias("reason"))


@query(f"""WITH {ITEMS_SQL}, f AS (SELECT item_id, list_filter([CASE WHEN toxic = 1 THEN 'source_conflict_on_event_core' END, CASE WHEN quality = 0 THEN 'needs_review' END, CASE WHEN item_id % 2 = 0 THEN 'thin_source' END], lambda x: x IS NOT NULL) AS flags FROM items)
  SELECT item_id, array_to_string(list_filter(flags, lambda x: x = 'source_conflict_on_event_core'), ',') AS blockers, array_to_string(list_filter(flags, lambda x: x = 'thin_source'), ',') AS caveats, array_to_string(list_filter(flags, lambda x: x = 'needs_review'), ',') AS audit FROM f""")
def p25_flag_routing(spark, d):
    flags = F.array_compact(F.array(F.when(F.col("toxic") == 1, "source_conflict_on_event_core"), F.when(F.col("quality") == 0, "needs_review"), F.when(F.col("item_id") % 2 == 0, "thin_source")))
    routed = policy.routed_flags(flags)
    return items(spark, d).select("item_id", *(F.array_join(c, ",").alias(n) for c, n in zip(routed, ("blockers", "caveats", "audit"), strict=True)))


@query("""SELECT event_id, CASE WHEN v IN ('new', 'new_item', 'novel', 'fresh') THEN 'new' WHEN v IN ('update', 'updated', 'version_update') THEN 'updated' WHEN v IN ('repeat', 'duplicate', 'old') THEN 'repeat' ELSE 'unknown' END AS novelty
  FROM (SELECT event_id, replace(lower(trim(CASE event_id % 5 WHEN 0 THEN 'New-Item' WHEN 1 THEN ' update' WHEN 2 THEN 'OLD' WHEN 3 THEN '' ELSE 'odd' END)), '-', '_') AS v FROM events)""")
def f24_novelty(spark, d):
    i = F.col("event_id") % 5
    v = F.when(i == 0, "New-Item").when(i == 1, " update").when(i == 2, "OLD").when(i == 3, "").otherwise("odd")
    return table(spark, d, "events").select("event_id", policy.novelty(v).alias("novelty"))


_E12 = {
    "req": "CASE event_id % 5 WHEN 0 THEN 'candidate' WHEN 1 THEN 'Needs_Review' WHEN 2 THEN 'rejected' WHEN 3 THEN NULL ELSE 'odd' END", "nov": "CASE WHEN event_type = 'error' THEN 'Repeat' ELSE 'new' END", "facts": "CAST(event_id % 3 AS INT)",
    "hist": "CASE event_id % 6 WHEN 0 THEN 'new' WHEN 1 THEN 'Repeat' WHEN 2 THEN 'meaningful_update' WHEN 3 THEN 'uncertain' WHEN 4 THEN NULL ELSE 'odd' END", "asked": "CASE WHEN event_id % 7 = 0 THEN 'k' END", "known": "event_id % 14 = 0", "exact": "CASE WHEN event_id % 9 = 0 THEN 'x' END",
}


@query(f"""WITH x AS (SELECT event_id, {', '.join(f'{v} AS {k}' for k, v in _E12.items())} FROM events),
  y AS (SELECT *, lower(coalesce(req, 'candidate')) AS r, lower(nov) = 'repeat' AS rep, lower(coalesce(hist, 'uncertain')) AS h, asked IS NOT NULL AND NOT known AS outside FROM x),
  z AS (SELECT *, r IN ('candidate', 'needs_review', 'rejected') AS valid, CASE WHEN r IN ('candidate', 'needs_review', 'rejected') THEN r ELSE 'needs_review' END AS v, CASE WHEN NOT outside THEN coalesce(asked, exact) END AS prior FROM y)
  SELECT event_id, CASE WHEN rep THEN 'rejected' WHEN v = 'candidate' AND facts = 0 THEN 'needs_review' ELSE v END AS publishability,
    concat_ws(',', CASE WHEN NOT valid THEN 'invalid_publishability' END, CASE WHEN rep THEN 'confirmed_repeat_without_material_change' WHEN v = 'candidate' AND facts = 0 THEN 'candidate_without_facts' WHEN v = 'needs_review' THEN 'uncertain_event_core' END) AS flags,
    CASE WHEN outside THEN 'uncertain' WHEN prior IS NOT NULL THEN CASE WHEN h = 'meaningful_update' AND facts > 0 THEN 'meaningful_update' ELSE 'repeat' END WHEN h IN ('new', 'uncertain') THEN h ELSE 'uncertain' END AS history, prior,
    CASE WHEN outside THEN 'prior_event_outside_history_window' WHEN prior IS NULL AND h IN ('repeat', 'meaningful_update') THEN 'history_match_not_found' WHEN prior IS NULL AND h NOT IN ('new', 'uncertain') THEN 'invalid_novelty_status' END AS flag FROM z""")
def e12_publishability(spark, d):
    x = table(spark, d, "events").selectExpr("event_id", *(f"{v} AS {k}" for k, v in _E12.items()))
    state_, flags = policy.publishability(F.col("req"), F.col("nov"), F.col("facts"))
    history, prior, flag = policy.history(F.col("hist"), F.col("asked"), F.col("known"), F.col("exact"), F.col("facts") > 0)
    return x.select("event_id", state_.alias("publishability"), F.array_join(flags, ",").alias("flags"), history.alias("history"), prior.alias("prior"), flag.alias("flag"))


# ---- scalar functions --------------------------------------------------------------------------

_PARTS = {"audience_relevance": 7, "material_change": 11, "impact_scope": 13, "independent_news_value": 17, "specificity": 19}


@query(f"SELECT doc_id, CAST(greatest(0, least(100, round_even(({' + '.join(f'(doc_id * {k} % 101) * {numbers.WEIGHTS[n]}' for n, k in _PARTS.items())}) / 20.0, 0))) AS INTEGER) AS score FROM documents")
def f40_weighted_score(spark, d):
    return table(spark, d, "documents").select("doc_id", numbers.weighted_score({n: F.col("doc_id") * k % 101 for n, k in _PARTS.items()}).alias("score"))


_TAIL = r"'^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)'"


@query(f"""WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS s, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS h, regexp_replace(regexp_extract(url, {_TAIL}, 1), '/+$', '') AS path,
    list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda x: x <> '') AS q FROM pages)
  SELECT page_id, h AS host,
    s || '://' || h || path || CASE WHEN len(list_filter(q, lambda x: NOT regexp_matches(x, '^(utm_[^=]*|fbclid|gclid|mc_cid|mc_eid|ref|ref_src|spm)='))) > 0 THEN '?' || array_to_string(list_filter(q, lambda x: NOT regexp_matches(x, '^(utm_[^=]*|fbclid|gclid|mc_cid|mc_eid|ref|ref_src|spm)=')), '&') ELSE '' END AS envelope_url,
    s || '://' || h || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(list_filter(q, lambda x: NOT regexp_matches(x, '^(utm_[^=]*|campaign|fbclid|gclid|mc_cid|mc_eid|ref|ref_src|source|spm|src)='))) > 0 THEN '?' || array_to_string(list_sort(list_filter(q, lambda x: NOT regexp_matches(x, '^(utm_[^=]*|campaign|fbclid|gclid|mc_cid|mc_eid|ref|ref_src|source|spm|src)='))), '&') ELSE '' END AS event_url,
    s || '://' || h || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(q) > 0 THEN '#' || array_to_string(q, '&') ELSE '' END AS item_url
  FROM p""")
def f03_url_forms(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.host(u).alias("host"), urls.envelope_url(u).alias("envelope_url"), urls.event_url(u).alias("event_url"), urls.item_url(u).alias("item_url"))


@query("SELECT page_id, regexp_replace(regexp_extract(u, '^([^#]*)', 1), '([?&][^=&]*token[^=&]*=)[^&]*', '\\1%5BREDACTED%5D', 'g') AS url FROM (SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) || '?a=1&api_token=' || page_id AS u FROM pages)")
def f07_redacted_url(spark, d):
    u = F.concat(F.regexp_extract("url", "^([^?#]*)", 1), F.lit("?a=1&api_token="), F.col("page_id").cast("string"), F.lit("#x"))
    return table(spark, d, "pages").select("page_id", urls.redacted(u).alias("url"))


@query(r"SELECT doc_id, trim(regexp_replace(replace(lower(coalesce(split_part(text, chr(10), 1), '')), 'ß', 'ss'), '[^\p{L}\p{N}_]+', ' ', 'g')) AS title FROM documents")
def f08_title_identity(spark, d):
    return table(spark, d, "documents").select("doc_id", text.event_title(F.get(F.split("text", "\n"), F.lit(0))).alias("title"))


@query("SELECT p_partkey, CASE WHEN k = '' THEN 'other' ELSE substr(k, 1, 120) END AS family, replace(replace(lower(trim(p_brand)), '-', '_'), ' ', '_') AS code, lower(replace(p_name, ' ', '')) AS external FROM (SELECT *, regexp_replace(regexp_replace(lower(coalesce(p_name, '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS k FROM part)")
def f10_family_key(spark, d):
    return table(spark, d, "part").select("p_partkey", text.family_key(F.col("p_name")).alias("family"), text.reason_code(F.col("p_brand")).alias("code"), text.external_id(F.col("p_name")).alias("external"))


@query("SELECT c_custkey, array_to_string(l, '/') AS parts, len(l)::INTEGER AS n FROM (SELECT c_custkey, ['alpha', c_mktsegment, 'beta'] AS l FROM customer)")
def f13_split_list(spark, d):
    parts = text.split_list(F.concat(F.lit("alpha, "), F.col("c_mktsegment"), F.lit(" ;|"), F.col("c_mktsegment"), F.lit("\n beta,alpha")))
    return table(spark, d, "customer").select("c_custkey", F.array_join(parts, "/").alias("parts"), F.size(parts).alias("n"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS text FROM documents WHERE text IS NOT NULL")
def f20_collapse(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", text.collapsed(F.col("text")).alias("text"))


@query(None)
def f02_html_text(spark, d):
    return table(spark, d, "pages").select("page_id", text.html_text(F.col("html")).alias("text"))


@query(f"""WITH {ITEMS_SQL} SELECT item_id, sha256(CASE WHEN item_id % 5 = 0 THEN 'x' || item_id WHEN coalesce(source_url, '') <> '' THEN source_url ELSE lower(coalesce(title, '')) || chr(10) || coalesce(content_text, '') END) AS identity,
  sha256(coalesce(title, '') || chr(10) || coalesce(source_url, '') || chr(10) || coalesce(CAST(quality AS VARCHAR), '')) AS fingerprint, substr(sha256(coalesce(source_url, '') || chr(10) || coalesce(title, '')), 1, 24) AS short_id FROM items""")
def f30_identity_hash(spark, d):
    i = F.col("item_id")
    return items(spark, d).select("item_id", hashes.identity_hash(F.when(i % 5 == 0, F.concat(F.lit("x"), i)), F.col("source_url"), F.col("title"), F.col("content_text")).alias("identity"), hashes.joined_hash(F.col("title"), F.col("source_url"), F.col("quality")).alias("fingerprint"), hashes.short_id(F.col("source_url"), F.col("title")).alias("short_id"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size * 1000.0 WHEN 1 THEN p_size * 1000000.0 WHEN 2 THEN 1000.0 + p_size % 10 ELSE NULL END AS parsed, CASE WHEN p_size % 3 = 0 THEN '-' ELSE format('{:,}', p_size * 1000) END AS shown,
  CAST(CASE WHEN p_partkey % 2 = 0 THEN least(40, greatest(5, p_size)) ELSE 10 END AS BIGINT) AS bounded FROM part""")
def f41_numbers(spark, d):
    i, n = F.col("p_partkey"), F.col("p_size")
    raw = F.when(i % 4 == 0, F.concat(n, F.lit("k"))).when(i % 4 == 1, F.concat(n, F.lit(" M").substr(2, 1))).when(i % 4 == 2, F.concat(F.lit("1,00"), n % 10)).otherwise("none")
    return table(spark, d, "part").select("p_partkey", numbers.suffixed(raw).alias("parsed"), numbers.thousands(F.when(n % 3 != 0, n * 1000)).alias("shown"), numbers.bounded_int(F.when(i % 2 == 0, F.concat(n, F.lit(".9"))).otherwise("x"), 5, 40, 10).alias("bounded"))


@query(f"""WITH x AS (SELECT event_id, CASE WHEN event_id % 10 > 0 THEN epoch_us(TIMESTAMP '{REFERENCE}') - epoch_us(ts) END AS u FROM events), y AS (SELECT event_id, u, CAST(floor(u / 86400000000.0) AS BIGINT) AS days FROM x),
  z AS (SELECT *, (u - days * 86400000000) // 1000000 AS s FROM y)
  SELECT event_id, CASE WHEN u IS NULL THEN '未知' WHEN days > 0 THEN days || '天前' WHEN s // 3600 > 0 THEN (s // 3600) || '小时前' WHEN s // 60 > 0 THEN (s // 60) || '分钟前' ELSE '刚刚' END AS ago FROM z""")
def f54_relative_time(spark, d):
    at = F.when(F.col("event_id") % 10 > 0, F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", dates.relative(at, F.lit(REFERENCE).cast("timestamp")).alias("ago"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(json_extract_string(props, '$.stars'), json_extract_string(props, '$.k')) AS metric, try_cast(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0 AS even FROM events")
def f60_json_maps(spark, d):
    m = structured.decoded_map(F.col("props"))
    k = F.try_element_at(m, F.lit("k"))
    return table(spark, d, "events").select("event_id", k.alias("k"), F.coalesce(structured.first_alias("stars", m), k).alias("metric"), (k.try_cast("int") % 2 == 0).alias("even"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'new' ELSE json_extract_string(props, '$.k') END AS k, event_type AS t FROM events")
def f64_map_merge(spark, d):
    left = structured.decoded_map(F.col("props"))
    right = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("k"), F.lit("new"), F.lit("t"), F.col("event_type"), F.lit("a_run_id"), F.lit("1"))).otherwise(F.create_map(F.lit("t"), F.col("event_type")))
    m = structured.without_internal_keys(structured.merged(left, right))
    return table(spark, d, "events").select("event_id", F.try_element_at(m, F.lit("k")).alias("k"), F.try_element_at(m, F.lit("t")).alias("t"))


# ---- ranking -----------------------------------------------------------------------------------

_CLASS_SQL = "CASE content_class WHEN 'official_model_company' THEN 0 WHEN 'project_tool' THEN 1 WHEN 'news_media' THEN 2 ELSE 3 END"


@query(f"WITH {ITEMS_SQL} SELECT item_id, CAST(row_number() OVER (ORDER BY item_id * 29 % 101 DESC, {_CLASS_SQL}, published_at DESC NULLS LAST, item_id) AS INTEGER) AS rank FROM items WHERE item_id * 29 % 101 >= 60")
def w01_admission_rank(spark, d):
    score = F.col("item_id") * 29 % 101
    rows = items(spark, d).filter(score >= 60)
    return ranking.ranked(rows, [score.desc(), ranking.rank_of(F.col("content_class"), ranking.CLASS_RANK).asc(), F.col("published_at").desc_nulls_last(), F.col("item_id").asc()], "rank").select("item_id", "rank")


@query(f"""WITH {surrogates.sql('items')}, g AS (SELECT *, item_id % 97 AS event, coalesce(published_at, captured_at) AS t_at,
    CASE WHEN lower(source_group) IN ('official_blog', 'official_research', 'x_official', 'github_release') THEN 0 WHEN content_class = 'news_media' THEN 1 WHEN content_class = 'project_tool' THEN 2 WHEN content_class = 'community_social' THEN 3 ELSE 4 END AS r FROM items)
  SELECT event, arg_min(item_id, (r, -b1_priority, -epoch_us(t_at), item_id)) AS primary_item, CAST(max(b1_priority) AS INTEGER) AS display_score, epoch_us(min(t_at)) AS first_seen, epoch_us(max(t_at)) AS last_seen, count(*) AS members FROM g GROUP BY event""")
def w02_primary_member(spark, d):
    c = F.col
    at = F.unix_micros(F.coalesce("published_at", "captured_at"))
    key = ranking.primary_key(c("source_group"), c("content_class"), c("b1_priority"), c("published_at"), c("captured_at"), c("item_id"))
    return surrogates.view(spark, d, "items").groupBy((c("item_id") % 97).alias("event")).agg(F.min_by("item_id", key).alias("primary_item"), F.max("b1_priority").alias("display_score"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count(F.lit(1)).alias("members"))


@query("SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_size DESC, p_partkey DESC) AS INTEGER) AS rank, p_type FROM part QUALIFY rank <= 20")
def w03_top_per_period(spark, d):
    rows = ranking.ranked(table(spark, d, "part"), [F.desc("p_retailprice"), F.desc("p_size"), F.desc("p_partkey")], "rank", ["p_type"])
    return rows.filter("rank <= 20").select("p_partkey", "rank", "p_type")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 100")
def w06_page(spark, d):
    return ranking.top(table(spark, d, "orders"), [F.asc("o_orderdate"), F.asc("o_orderkey")], 50, 100).select("o_orderkey")


@query("""WITH r AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events),
  s AS (SELECT event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM r)
  SELECT event_id, CAST(streak AS BIGINT) AS streak, CAST(CASE WHEN streak = 0 THEN 0 ELSE least(86400, 60 * pow(2, streak - 1)) END AS BIGINT) AS backoff FROM s""")
def w20_backoff(spark, d):
    rows = ranking.failure_streaks(table(spark, d, "events"), "user_id", "ts", "event_id", F.col("event_type") == "error")
    return rows.select("event_id", "streak", dates.backoff_seconds(F.col("streak")).alias("backoff"))


# ---- joins -------------------------------------------------------------------------------------

@query("""SELECT e.event_id, max_by(p.event_id, (epoch_us(p.ts), p.event_id)) AS prior FROM events e JOIN events p ON e.user_id = p.user_id AND e.event_type = p.event_type AND p.ts < date_trunc('day', e.ts) AND p.ts >= date_trunc('day', e.ts) - INTERVAL 3 DAY GROUP BY 1""")
def e11_history_match(spark, d):
    """Prior rows of the three calendar days before: an equality on user, type and day (each row stands for its three days), no range join."""
    e = table(spark, d, "events")
    day = F.to_date("ts")
    prior = e.select("user_id", "event_type", F.col("event_id").alias("prior_id"), _micros("ts").alias("at"), F.explode(F.sequence(F.date_add(day, 1), F.date_add(day, 3))).alias("day"))
    found = e.select("event_id", "user_id", "event_type", day.alias("day")).join(prior, ["user_id", "event_type", "day"])
    return found.groupBy("event_id").agg(F.max_by("prior_id", F.struct("at", "prior_id")).alias("prior"))


@query("SELECT o_orderkey, count(l_orderkey) AS entries FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def j02_edition_counts(spark, d):
    entries = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return listing.counted(table(spark, d, "orders").select("o_orderkey"), entries, "o_orderkey", "entries")


@query("""SELECT o_orderkey, count(*) AS n, string_agg(p_name || ':' || s_name, ',' ORDER BY l_linenumber, p_name, s_name) AS members FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""")
def j05_nested_members(spark, d):
    """Orders as events of their lines, with parts and suppliers looked up."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("item_id"), "l_linenumber", "l_suppkey")
    lines = listing.looked_up(lines, "l_suppkey", table(spark, d, "supplier"), "s_suppkey", ["s_name"]).filter("s_name is not null")
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), "p_name")
    out = listing.nested_members(table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id")), lines, parts, order=["l_linenumber", "p_name", "s_name"], fields=[])
    shown = F.transform("members", lambda x: F.concat(x["p_name"], F.lit(":"), x["s_name"]))
    return out.filter("n_members > 0").select(F.col("event_id").alias("o_orderkey"), F.col("n_members").alias("n"), F.array_join(shown, ",").alias("members"))


@query("SELECT n_name, count(*) AS items, count(DISTINCT l_orderkey) AS editions FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def j08_source_counts(spark, d):
    rows = listing.looked_up(table(spark, d, "lineitem").select("l_suppkey", "l_orderkey"), "l_suppkey", table(spark, d, "supplier"), "s_suppkey", ["s_nationkey"])
    rows = listing.looked_up(rows, "s_nationkey", table(spark, d, "nation"), "n_nationkey", ["n_name"]).filter("n_name is not null")
    return rows.groupBy("n_name").agg(F.count(F.lit(1)).alias("items"), F.count_distinct("l_orderkey").alias("editions"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def j14_semi(spark, d):
    return listing.scoped(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def j15_anti(spark, d):
    return listing.uncovered(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT user_id, arg_max(event_id, (epoch_us(ts), event_id)) AS event_id, arg_max(event_type, (epoch_us(ts), event_id)) AS event_type FROM events GROUP BY 1")
def j17_latest_attempt(spark, d):
    return state.latest(table(spark, d, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


# ---- aggregates --------------------------------------------------------------------------------

@query("SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1")
def g04_facets(spark, d):
    return views.facets(table(spark, d, "events"), F.col("event_type"))


@query("SELECT CAST(user_id % 10 AS INTEGER) AS stage, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS n_{t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1")
def g06_status_pivot(spark, d):
    kinds = ("click", "error", "purchase", "signup", "view")
    return table(spark, d, "events").groupBy((F.col("user_id") % 10).cast("int").alias("stage")).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in kinds))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def g07_rollup(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"""WITH {ITEMS_SQL}, g AS (SELECT *, CASE WHEN published_at IS NULL OR published_at > TIMESTAMP '{REFERENCE}' OR published_at < TIMESTAMP '2024-01-13 16:00:00' THEN false ELSE true END AS fresh FROM items)
  SELECT count(*) AS fetched, count(*) FILTER (WHERE fresh) AS within_window, count(*) FILTER (WHERE NOT fresh) AS time_excluded, count(*) FILTER (WHERE fresh AND toxic = 1) AS screened_out, count(*) FILTER (WHERE fresh AND toxic = 0 AND item_id * 29 % 101 >= 60) AS admitted, count(DISTINCT source_id) AS sources FROM g""")
def g08_funnel(spark, d):
    eligible, _ = policy.freshness(F.col("published_at"), F.lit(EDITION).cast("date"), F.lit(REFERENCE).cast("timestamp"), F.lit(False))
    rows = items(spark, d).withColumn("fresh", eligible)
    return rows.agg(F.count(F.lit(1)).alias("fetched"), F.count_if("fresh").alias("within_window"), F.count_if(~F.col("fresh")).alias("time_excluded"), F.count_if(F.col("fresh") & (F.col("toxic") == 1)).alias("screened_out"), F.count_if(F.col("fresh") & (F.col("toxic") == 0) & (F.col("item_id") * 29 % 101 >= 60)).alias("admitted"), F.count_distinct("source_id").alias("sources"))


_TASK = "CASE WHEN event_id % 29 = 0 THEN 'pending' WHEN event_id % 31 = 0 THEN 'failed' WHEN event_id % 23 = 0 THEN 'blocked' WHEN event_id % 97 = 0 THEN 'running' ELSE 'succeeded' END"


@query(f"""SELECT user_id, CASE WHEN bool_and(s IN ('succeeded', 'skipped', 'cancelled')) THEN 'succeeded' WHEN bool_or(s = 'running') THEN 'running' WHEN bool_or(s = 'blocked') AND NOT bool_or(s IN ('pending', 'retry_waiting', 'failed')) THEN 'blocked' WHEN bool_or(s = 'failed') AND NOT bool_or(s IN ('pending', 'retry_waiting')) THEN 'failed' ELSE 'pending' END AS status FROM (SELECT user_id, {_TASK} AS s FROM events) GROUP BY 1""")
def g09_stage_fold(spark, d):
    return state.stage_status(table(spark, d, "events").selectExpr("user_id", f"{_TASK} AS status"), "user_id")


@query("SELECT conv_id, turn, max_turn + row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS sequence FROM (SELECT conv_id, turn, coalesce(max(CASE WHEN role <> 'assistant' THEN turn END) OVER (PARTITION BY conv_id), 0) AS max_turn, role FROM conversations) WHERE role = 'assistant'")
def g22_sequence(spark, d):
    """Answers numbered on from the last of the other turns."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role")
    new, old = rows.filter("role = 'assistant'").select("conv_id", "turn"), rows.filter("role <> 'assistant'").select("conv_id", F.col("turn").alias("sequence"))
    return listing.next_numbers(new, old, "conv_id", "sequence", [F.asc("turn")])


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY first, event_type) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2) GROUP BY 1")
def g13_ordered_union(spark, d):
    return listing.united(table(spark, d, "events"), "user_id", "event_type", ["event_id"]).select("user_id", F.array_join("values", ",").alias("kinds"))


# ---- entities ----------------------------------------------------------------------------------

@query("""WITH h AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN 'x' || CAST(doc_id % 300 AS VARCHAR) END AS ext, sha256(coalesce(text, '')) AS hash FROM documents),
  a AS (SELECT * FROM h WHERE ext IS NULL UNION ALL SELECT * FROM (SELECT * FROM h WHERE ext IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source, ext ORDER BY doc_id) = 1))
  SELECT doc_id FROM a QUALIFY row_number() OVER (PARTITION BY source, hash ORDER BY doc_id) = 1""")
def e01_two_key_dedup(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("x"), F.col("doc_id") % 300)).alias("ext"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    return entities.two_key_dedup(rows, ["source"], "ext", "hash", "doc_id").select("doc_id")


_E05 = "SELECT doc_id, 'h' || sha256(coalesce(text, '')) AS key FROM documents UNION ALL SELECT doc_id, 't' || substr(coalesce(text, ''), 1, 24) FROM documents"


@query(f"""WITH RECURSIVE k AS ({_E05}), reach AS (SELECT DISTINCT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, y.doc_id FROM reach r JOIN k x ON r.b = x.doc_id JOIN k y ON x.key = y.key)
  SELECT a AS doc_id, min(b) AS component FROM reach GROUP BY 1""")
def e05_identity_components(spark, d):
    t = F.coalesce("text", F.lit(""))
    keys = table(spark, d, "documents").select("doc_id", F.explode(F.array(F.concat(F.lit("h"), F.sha2(t, 256)), F.concat(F.lit("t"), F.substring(t, 1, 24)))).alias("key"))
    return entities.components(keys, "doc_id", "key")


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_events FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")
def e07_identity_split(spark, d):
    return entities.split_identities(table(spark, d, "orders"), "o_custkey", "o_orderpriority")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY coalesce(nullif(CASE WHEN doc_id % 7 = 0 THEN source ELSE '' END, ''), nullif(split_part(text, chr(10), 1), ''))")
def e13_first_record(spark, d):
    keys = [F.when(F.col("doc_id") % 7 == 0, F.col("source")).otherwise(""), F.get(F.split("text", "\n"), F.lit(0))]
    return entities.first_record(table(spark, d, "documents"), keys, "doc_id").select("doc_id")


@query("""WITH c AS (SELECT o_orderkey AS k FROM orders), s AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 = 0), u AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 11 <> 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 30 = 0)
  SELECT c.k AS o_orderkey, CASE WHEN n > 1 THEN 'twice' ELSE 'missing' END AS error FROM c LEFT JOIN (SELECT k, count(*) AS n FROM (SELECT * FROM s UNION ALL SELECT * FROM u) GROUP BY 1) x ON c.k = x.k WHERE coalesce(n, 0) <> 1""")
def e15_partition_check(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    return entities.partition_errors(o, o.filter(k % 3 == 0), o.filter((k % 3 != 0) & (k % 11 != 0)).unionByName(o.filter(k % 30 == 0)), "o_orderkey")


# ---- search, state, publication ----------------------------------------------------------------

@query("SELECT doc_id FROM documents WHERE coalesce(text ILIKE '%license%', false) OR coalesce(source ILIKE '%license%', false)")
def p16_search(spark, d):
    return views.search(table(spark, d, "documents"), "license", ["text", "source"]).select("doc_id")


@query("SELECT p_partkey FROM part WHERE lower(p_name || ' ' || p_type) LIKE '%red%' AND lower(p_name || ' ' || p_type) LIKE '%economy%'")
def p17_token_search(spark, d):
    return table(spark, d, "part").filter(text.matches_all(F.concat_ws(" ", "p_name", "p_type"), ["red", "Economy"])).select("p_partkey")


@query("WITH dd AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders ORDER BY 1 DESC LIMIT 7) SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE CAST(o_orderdate AS DATE) IN (SELECT day FROM dd)")
def r16_last7_editions(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return views.last_editions(rows, "day").select("o_orderkey", F.col("day").cast("string").alias("day"))


_LEASE = "event_id, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'retry_waiting' ELSE 'succeeded' END AS status, event_id % 10 AS fingerprint"


@query(f"""WITH t AS (SELECT ts, {_LEASE} FROM events) SELECT event_id, (status IN ('pending', 'retry_waiting', 'failed') AND ts <= TIMESTAMP '{REFERENCE}') OR (status = 'running' AND ts <= TIMESTAMP '{REFERENCE}') AS claimable, status = 'succeeded' AND fingerprint = 3 AS reusable,
  CASE WHEN status = 'running' AND ts <= TIMESTAMP '{REFERENCE}' THEN 'retry_waiting' ELSE status END AS after_sweep FROM t""")
def t05_leases(spark, d):
    now = F.lit(REFERENCE).cast("timestamp")
    at = F.col("ts").cast("timestamp")
    tasks = table(spark, d, "events").selectExpr("ts", *_LEASE.split(", ")).withColumns({"next_retry_at": at, "lease_expires_at": at, "error_code": F.lit(None).cast("string")})
    ids = tasks.select("event_id")
    can = state.claimable(tasks, now).select("event_id", F.lit(True).alias("claimable"))
    use = state.reusable(tasks, F.lit(3)).select("event_id", F.lit(True).alias("reusable"))
    swept = state.recovered(tasks, now).select("event_id", F.col("status").alias("after_sweep"))
    out = ids.join(can, "event_id", "left").join(use, "event_id", "left").join(swept, "event_id")
    return out.select("event_id", F.coalesce("claimable", F.lit(False)).alias("claimable"), F.coalesce("reusable", F.lit(False)).alias("reusable"), "after_sweep")


@query("""WITH o AS (SELECT doc_id AS k, source AS a, lang AS b, CASE WHEN doc_id % 7 = 0 THEN 'published' ELSE 'candidate' END AS status, 70 AS b1_priority FROM documents WHERE doc_id % 3 <> 0),
  n AS (SELECT doc_id AS k, CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN '' ELSE NULL END AS a, CASE WHEN doc_id % 5 = 0 THEN 'xx' ELSE lang END AS b FROM documents WHERE doc_id % 4 <> 0),
  j AS (SELECT coalesce(o.k, n.k) AS k, o.k IS NULL AS isnew, n.k IS NULL AS isold, coalesce(nullif(n.a, ''), o.a) AS a, CASE WHEN n.k IS NULL THEN o.b ELSE n.b END AS b, o.a AS oa, o.b AS ob, o.status, b1_priority FROM o FULL JOIN n ON o.k = n.k),
  c AS (SELECT *, NOT isnew AND NOT isold AND (a IS DISTINCT FROM oa OR b IS DISTINCT FROM ob) AND status = 'candidate' AS again FROM j)
  SELECT k, a, b, CASE WHEN isnew OR again THEN 'new' ELSE status END AS status, CASE WHEN again THEN 0 ELSE b1_priority END AS b1_priority FROM c""")
def m01_item_upsert(spark, d):
    docs = table(spark, d, "documents")
    i = F.col("doc_id")
    old = docs.filter(i % 3 != 0).select(i.alias("k"), F.col("source").alias("a"), F.col("lang").alias("b"), F.when(i % 7 == 0, "published").otherwise("candidate").alias("status"), F.lit(70).alias("b1_priority"))
    new = docs.filter(i % 4 != 0).select(i.alias("k"), F.when(i % 3 == 0, F.col("source")).when(i % 3 == 1, "").alias("a"), F.when(i % 5 == 0, "xx").otherwise(F.col("lang")).alias("b"))
    return state.upsert(old, new, ["k"], ["a"], ["b"], ["a", "b"], {"b1_priority": 0})


@query("SELECT conv_id, '# Conversation ' || conv_id || ' (' || count(*) || ')' || chr(10) || string_agg('- **' || role || '** ' || turn, chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY 1")
def k03_markdown(spark, d):
    line = F.concat(F.lit("- **"), F.col("role"), F.lit("** "), F.col("turn").cast("string"))
    return publish.markdown(table(spark, d, "conversations"), "conv_id", "Conversation", ["turn"], line)


@query("SELECT count(*) AS records, sha256(string_agg(n_name, chr(10) ORDER BY n_nationkey)) AS sha256, CAST(strlen(string_agg(n_name, chr(10) ORDER BY n_nationkey)) AS BIGINT) AS bytes FROM nation")
def k04_manifest(spark, d):
    return publish.manifest(table(spark, d, "nation").withColumnRenamed("n_nationkey", "display_order"), "n_name")


@query("""WITH s AS (SELECT user_id, user_id % 7 AS run, CASE WHEN max(value) > 99 THEN 'Failed' WHEN min(value) < 1 THEN 'degraded' ELSE 'success' END AS status, count(*) AS f, count(*) FILTER (WHERE event_type = 'click') AS i, count(*) FILTER (WHERE event_type = 'error') AS k FROM events GROUP BY 1)
  SELECT run, count(*) AS sources, sum(f)::BIGINT AS fetched, sum(i)::BIGINT AS inserted, sum(k)::BIGINT AS skipped, count(*) FILTER (WHERE status = 'Failed') AS failed, count(*) FILTER (WHERE status = 'degraded') AS degraded FROM s GROUP BY 1""")
def g16_fetch_totals(spark, d):
    status = F.when(F.max("value") > 99, "Failed").when(F.min("value") < 1, "degraded").otherwise("success")
    stats = table(spark, d, "events").groupBy("user_id").agg(status.alias("status"), F.count(F.lit(1)).alias("items_fetched"), F.count_if(F.col("event_type") == "click").alias("items_inserted"), F.count_if(F.col("event_type") == "error").alias("items_skipped"))
    return listing.fetch_totals(stats.withColumn("run", F.col("user_id") % 7), ["run"])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fresh items, admitted and ranked, with the class of each."""
    return w01_admission_rank(spark, sf_dir)
