"""Further queries: identities, members, projects, health, tasks, extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query
from .functions import text, urls
from .operators import entities, listing, policy, ranking, state, views
from .sources import pages
from .tables import ITEMS_SQL, items, table

#: After all events.
NOW = "2024-02-01 00:00:00"


@query(f"""WITH {ITEMS_SQL}, k AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'github_release:' || (item_id % 50) WHEN 1 THEN 'ext' || (item_id % 40) END AS ext, 'https://ex.org/p' || (item_id % 30) AS url FROM items)
  SELECT item_id, CASE WHEN ext IS NULL THEN 'url:' || url WHEN ext LIKE 'github_release:%' THEN 'external:' || ext ELSE 'external:' || ext || '|url:' || url END AS keys FROM k""")
def e02_identity_keys(spark, d):
    return _keyed(spark, d).select("item_id", F.array_join("keys", "|").alias("keys"))


def _keyed(spark, d):
    i = F.col("item_id")
    ext = F.when(i % 4 == 0, F.concat(F.lit(" GitHub_Release:"), (i % 50).cast("string"))).when(i % 4 == 1, F.concat(F.lit("EXT "), (i % 40).cast("string")))
    url = F.concat(F.lit("HTTPS://ex.org:443/p"), (i % 30).cast("string"), F.lit("/?utm_source=x"))
    return items(spark, d).select("item_id", entities.identity_keys(ext, url).alias("keys"))


@query(f"""WITH {ITEMS_SQL}, m AS (SELECT item_id, item_id // 10 AS event, 'ext' || (item_id % 4) AS k FROM items), p AS (SELECT event, min(item_id) AS lead, arg_min(k, item_id) AS lk FROM m GROUP BY 1)
  SELECT item_id, CASE WHEN item_id = lead THEN 'primary' WHEN k = lk THEN 'duplicate' ELSE 'related' END AS relation FROM m JOIN p USING (event)""")
def e10_member_relation(spark, d):
    m = items(spark, d).select("item_id", F.floor(F.col("item_id") / 10).alias("event"), F.array(F.concat(F.lit("ext"), (F.col("item_id") % 4).cast("string"))).alias("keys"))
    lead = m.groupBy("event").agg(F.min("item_id").alias("lead"), F.min_by("keys", "item_id").alias("lead_keys"))
    relation = F.when(F.col("item_id") == F.col("lead"), "primary").when(F.arrays_overlap("keys", "lead_keys"), "duplicate").otherwise("related")
    return m.join(lead, "event").select("item_id", relation.alias("relation"))


_E08 = {"event_key": "CAST(o_orderkey AS STRING)", "event_family_key": "CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE ' Fam-' || CAST(o_custkey AS STRING) || '_A' END", "publishability": "CASE o_orderstatus WHEN 'F' THEN 'Candidate' WHEN 'O' THEN 'needs_review' ELSE 'rejected' END", "split_reason": "CASE o_orderpriority WHEN '1-URGENT' THEN ' different_model_or_major_version' WHEN '2-HIGH' THEN 'separate_time_window_actionable' WHEN '5-LOW' THEN NULL ELSE 'other' END"}


@query(f"""WITH e AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _E08.items())} FROM orders),
  f AS (SELECT event_key, trim(regexp_replace(lower(trim(CASE WHEN event_family_key <> '' THEN event_family_key ELSE event_key END)), '[^a-z0-9_]+', '_', 'g'), '_') AS family, coalesce(trim(split_reason) IN ('different_model_or_major_version', 'separate_time_window_actionable'), false) AS fine FROM e WHERE lower(publishability) IN ('candidate', 'needs_review'))
  SELECT family AS event_family_key, count(*) AS n, string_agg(event_key, ',' ORDER BY event_key) FILTER (WHERE NOT fine) AS events FROM f GROUP BY 1 HAVING count(*) > 1 AND count(*) FILTER (WHERE NOT fine) > 0""")
def e08_family_split(spark, d):
    rows = table(spark, d, "orders").selectExpr(*(f"{v} AS {k}" for k, v in _E08.items()))
    return entities.family_splits(rows).withColumn("events", F.array_join("events", ","))


@query("""WITH k AS (SELECT l_orderkey AS item, l_suppkey AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem)
  SELECT item, score FROM k WHERE r = 1 ORDER BY score DESC, item LIMIT 40 OFFSET 20""")
def w08_member_feed(spark, d):
    """Members distinct by item, the first wins; by score, then item; one page."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_suppkey").alias("score"), "l_linenumber", "l_partkey")
    page, _ = listing.member_feed(rows, item="item", score="score", first=["l_linenumber", "l_partkey", "score"], limit=40, offset=20)
    return page.select("item", "score")


@query("""SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_size DESC, round(p_retailprice) DESC, p_partkey) AS INTEGER) AS rank FROM part WHERE p_type <> 'ECONOMY'""")
def w05_project_rank(spark, d):
    return ranking.ranked(table(spark, d, "part").filter("p_type <> 'ECONOMY'"), [F.desc("p_size"), F.round("p_retailprice").desc(), F.asc("p_partkey")], "rank").select("p_partkey", "rank")


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS INTEGER) AS attempt_no FROM events")
def w18_attempt_numbers(spark, d):
    return ranking.ranked(table(spark, d, "events"), [F.asc("ts"), F.asc("event_id")], "attempt_no", ["user_id", "event_type"]).select("event_id", "attempt_no")


@query("SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END NULLS LAST, o_orderkey) AS INTEGER) AS place FROM orders")
def w13_admission_listing(spark, d):
    rows = table(spark, d, "orders").withColumn("r", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")))
    return ranking.ranked(rows, [F.asc_nulls_last("r"), F.asc("o_orderkey")], "place", ["o_orderstatus"]).select("o_orderkey", "place")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE p_size > 10) AS active, count(*) FILTER (WHERE p_size <= 10) AS archived, coalesce(max(p_size), 0) AS max_size FROM part")
def g17_project_stats(spark, d):
    return table(spark, d, "part").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("p_size") > 10).alias("active"), F.count_if(F.col("p_size") <= 10).alias("archived"), F.coalesce(F.max("p_size"), F.lit(0)).alias("max_size"))


@query("SELECT p_brand, p_type, sum(p_size) AS total, count(*) AS n FROM part GROUP BY CUBE (p_brand, p_type)")
def g24_cube(spark, d):
    return table(spark, d, "part").cube("p_brand", "p_type").agg(F.sum("p_size").alias("total"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH a AS (SELECT user_id, arg_max(event_type, (epoch_us(ts), event_id)) AS kind, epoch_us(max(ts)) AS last FROM events GROUP BY 1)
  SELECT user_id FROM a WHERE (kind <> 'error' OR last + 3600000000 <= epoch_us(TIMESTAMP '{NOW}')) AND last + 86400000000 * greatest(user_id % 3, 1) <= epoch_us(TIMESTAMP '{NOW}')""")
def p02_due_sources(spark, d):
    at = F.col("ts").cast("timestamp")
    last = table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"), F.max(at).alias("last_attempt"))
    rows = last.withColumn("backoff_until", F.when(F.col("kind") == "error", F.col("last_attempt") + F.expr("INTERVAL 1 HOUR"))).withColumn("fetch_interval", 86400 * F.greatest((F.col("user_id") % 3).cast("int"), F.lit(1)))
    return policy.due(rows, F.lit(NOW).cast("timestamp")).select("user_id")


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'official_model_company' WHEN 1 THEN 'news_media' WHEN 2 THEN 'project_tool' ELSE 'community_social' END AS content_class FROM supplier")
def p31_content_class(spark, d):
    i = F.col("s_suppkey") % 4
    group = F.when(i == 0, "x_official").when(i == 1, "tech_media").when(i == 2, "other").otherwise("reddit_fixed")
    return table(spark, d, "supplier").select("s_suppkey", policy.content_class(group, F.when(i == 2, "github").otherwise("feed")).alias("content_class"))


@query("WITH ids AS (SELECT event_id % 300 AS k, min(event_id) AS pos FROM events WHERE event_id % 3 = 0 GROUP BY 1) SELECT k AS c_custkey, pos AS place, c_custkey IS NULL AS missing FROM ids LEFT JOIN customer ON k = c_custkey")
def j09_in_list_order(spark, d):
    """Customers in the order of a list of ids, each once, and the ids that no customer has."""
    ids = table(spark, d, "events").filter("event_id % 3 = 0").select((F.col("event_id") % 300).alias("c_custkey"), F.col("event_id").alias("position"))
    found, missing = listing.in_list_order(table(spark, d, "customer").select("c_custkey"), "c_custkey", ids)
    return found.select("c_custkey", "place", F.lit(False).alias("missing")).unionByName(missing.select("c_custkey", "place", F.lit(True).alias("missing")))


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'fr') AND coalesce(text ILIKE '%und%', false)")
def p15_entry_filters(spark, d):
    return views.search(table(spark, d, "documents").filter(F.col("lang").isin("de", "fr")), "und", ["text"]).select("doc_id", "lang")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN page_id WHEN page_id % 3 = 1 THEN page_id + 1 END AS post_id, regexp_matches(url, '^https?://[^/?#]+') AS public FROM pages")
def f28_post_id(spark, d):
    i = F.col("page_id").cast("string")
    guid = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://t.co/2024/77/?p="), i)).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://t.co/9?a=5&p="), (F.col("page_id") + 1).cast("string"), F.lit("#p=8"))).otherwise(F.concat(F.lit("https://t.co/"), i))
    return table(spark, d, "pages").select("page_id", pages.wordpress_post_id(guid).alias("post_id"), urls.is_public(F.col("url")).alias("public"))


@query("SELECT c_custkey, regexp_replace(substr('[' || c_name || '] ' || c_mktsegment, 1, 200), '([\\[\\]])', '\\\\\\1', 'g') AS label FROM customer")
def f18_markdown_label(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.markdown_label(F.concat(F.lit("["), F.col("c_name"), F.lit("] "), F.col("c_mktsegment"))).alias("label"))


@query("SELECT label AS source, n FROM (SELECT o_orderstatus AS label, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1)")
def g20_distinct_events(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("source")).agg(F.count_distinct("o_custkey").alias("n"))


@query("""WITH s AS (SELECT user_id AS run, event_type AS stage, CASE WHEN max(value) > 99 AND event_type = 'error' THEN 'partial' WHEN min(value) < 0.02 THEN 'active' ELSE 'succeeded' END AS progress FROM events GROUP BY 1, 2)
  SELECT run, CASE WHEN count(DISTINCT stage) < 5 OR count(*) FILTER (WHERE progress = 'active') > 0 THEN 'running' WHEN count(*) FILTER (WHERE progress = 'partial') > 0 THEN 'partial' ELSE 'completed' END AS status FROM s GROUP BY 1""")
def g10_run_status(spark, d):
    return state.run_status(_stages(spark, d), "run", 5)


def _stages(spark, d):
    progress = F.when((F.max("value") > 99) & (F.first("event_type") == "error"), "partial").when(F.min("value") < 0.02, "active").otherwise("succeeded")
    return table(spark, d, "events").groupBy(F.col("user_id").alias("run"), F.col("event_type").alias("stage")).agg(progress.alias("progress"))


@query("""WITH s AS (SELECT user_id AS run, event_type AS stage, CASE WHEN max(value) > 99 AND event_type = 'error' THEN 'partial' WHEN min(value) < 0.02 THEN 'active' ELSE 'succeeded' END AS progress FROM events GROUP BY 1, 2)
  SELECT run, arg_min(stage, CASE stage WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END) AS stage FROM s WHERE progress <> 'succeeded' GROUP BY 1""")
def t11_resume_plan(spark, d):
    return state.resume_plan(_stages(spark, d), ["signup", "view", "click", "purchase", "error"])


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 7 = 0 THEN 'running' WHEN event_id % 2 = 0 THEN 'retry_waiting' ELSE 'blocked' END AS status FROM events WHERE event_type = 'error'")
def t07_failed_tasks(spark, d):
    i, now = F.col("event_id"), F.lit(NOW).cast("timestamp")
    lease = F.when(i % 7 == 0, now).otherwise(now + F.expr("INTERVAL 1 HOUR"))
    after = state.failed_task(F.when(i % 3 == 0, "running").otherwise("pending"), lease, i % 2 == 0, now)
    return table(spark, d, "events").filter("event_type = 'error'").select("event_id", after.alias("status"))


@query("SELECT o_orderkey AS item, CASE WHEN o_orderkey % 4 = 0 THEN 'e' || (o_orderkey % 100) ELSE 'auto:' || o_orderkey END AS event, CASE WHEN o_orderkey % 4 = 0 THEN 'candidate' ELSE 'needs_review' END AS state FROM orders")
def e09_autofill(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("item"))
    members = o.filter("item % 4 = 0").select("item", F.concat(F.lit("e"), (F.col("item") % 100).cast("string")).alias("event"))
    return entities.autofilled(members, o, "item", "event")


@query("""SELECT l_orderkey AS event, 'u' || (l_partkey % 5) AS url, 'h' AS host, CAST(l_suppkey % 3 AS VARCHAR) AS claim, min_by(l_returnflag || l_linenumber, l_linenumber * 10000000 + l_partkey) AS excerpt FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2, 3, 4""")
def p28_verified_evidence(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("event"), (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).alias("id"), F.when(F.col("l_returnflag") == "A", " Verified").otherwise("recorded").alias("status"),
        F.concat(F.lit("u"), F.col("l_partkey") % 5).alias("url"), F.lit("").alias("final_url"), F.lit(" h ").alias("host"), (F.col("l_suppkey") % 3).cast("string").alias("claim"), F.concat("l_returnflag", "l_linenumber").alias("excerpt"),
    )
    return entities.verified_evidence(rows, "id")


@query("""WITH o AS (SELECT user_id AS k, max(value) AS score, epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS b FROM events WHERE event_type IN ('click', 'view') GROUP BY 1), n AS (SELECT user_id AS k, max(value) AS score, epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS b FROM events WHERE event_type = 'error' GROUP BY 1)
  SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'app,err' WHEN n.k IS NULL THEN 'web,app' ELSE 'web,app,err' END AS sources, greatest(o.score, n.score) AS score, least(o.a, n.a) AS first_seen, greatest(o.b, n.b) AS last_seen FROM o FULL JOIN n ON o.k = n.k""")
def m04_event_upsert(spark, d):
    e = table(spark, d, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    side = lambda rows, names: rows.groupBy(F.col("user_id").alias("k")).agg(F.max("value").alias("score"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen")).withColumn("sources", F.array(*map(F.lit, names)))
    out = state.merged_events(side(e.filter("event_type in ('click', 'view')"), ["web", "app"]), side(e.filter("event_type = 'error'"), ["app", "err"]), "k")
    return out.withColumn("sources", F.array_join("sources", ","))
