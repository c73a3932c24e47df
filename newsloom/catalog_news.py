"""Queries of the read side, events, records, tasks and rows by key, over the surrogate news tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query
from .functions import dates, text
from .operators import entities, events, policy, projects, ranking, reading, state
from .plans import publish, records
from .surrogates import sql, view
from .tables import table

NOW = "2024-01-15 12:00:00"
#: References of an entry: one to three, by its id.
_REFS = "entry_id % 3 + 1"
_REF = {
    "item_id": "CASE WHEN (entry_id + {p}) % 4 <> 0 THEN CAST(entry_id * 10 + {p} AS STRING) END", "source_id": "CASE WHEN (entry_id + {p}) % 5 <> 0 THEN 's' || CAST((entry_id * 7 + {p}) % 12 AS STRING) END", "source_name": "CASE WHEN (entry_id + {p}) % 3 = 0 THEN ' name ' || CAST(entry_id AS STRING) ELSE '' END",
    "source_group": "CASE WHEN (entry_id + {p}) % 2 = 0 THEN 'g' || CAST({p} AS STRING) END", "source_url": "CASE (entry_id + {p}) % 3 WHEN 0 THEN 'https://r.org/' || CAST({p} AS STRING) WHEN 1 THEN 'mailto:x' ELSE NULL END", "title": "CASE WHEN {p} <> 2 THEN 'ref ' || CAST({p} AS STRING) || ' of ' || CAST(entry_id AS STRING) END",
    "is_primary": "{p} = 2 AND entry_id % 2 = 0", "match_type": "CASE WHEN {p} = 1 THEN 'primary' ELSE 'related' END", "ai_summary": "CASE WHEN {p} = 1 THEN ' two  words ' END", "source_summary": "CAST(NULL AS STRING)", "content_text": "CASE WHEN {p} = 3 THEN 'body' END", "content_depth": "CAST(NULL AS STRING)",
}


def _entries(spark, d):
    one = lambda p: "named_struct(" + ", ".join(f"'{k}', {v.format(p=p)}" for k, v in _REF.items()) + ")"
    rows = view(spark, d, "entries").withColumn("refs", F.expr(f"slice(array({one(1)}, {one(2)}, {one(3)}), 1, CAST({_REFS} AS INT))"))
    ids = F.expr("array('s' || CAST(entry_id % 12 AS STRING), 's' || CAST((entry_id * 7) % 12 AS STRING))")
    return rows.withColumns({"source_ids": ids, "risk_flags": F.expr("CASE WHEN entry_id % 3 = 0 THEN array('thin', 'old') ELSE CAST(array() AS ARRAY<STRING>) END"), "keywords": F.expr("array('k')")})


def _entries_sql() -> str:
    refs = " UNION ALL ".join(f"SELECT entry_id, {p} AS pos, {', '.join(f'{v.format(p=p)} AS {k}' for k, v in _REF.items())} FROM entries WHERE {p} <= {_REFS}" for p in (1, 2, 3))
    return sql("editions", "entries", "sources") + f""", refs AS ({refs}),
      pub AS (SELECT * FROM editions WHERE status = 'published' AND published_at IS NOT NULL),
      lead AS (SELECT entry_id, arg_min(struct_pack(sid := source_id, nm := source_name, gr := source_group, ur := source_url), (CASE WHEN is_primary THEN 0 ELSE 1 END, pos)) AS p FROM refs GROUP BY 1),
      ev AS (SELECT e.*, nullif(trim(p.sid), '') AS psid, coalesce(nullif(trim(p.nm), ''), s.name, 's' || CAST(e.entry_id % 12 AS VARCHAR)) AS source_name, coalesce(nullif(trim(p.gr), ''), e.source_group) AS pgroup, s.transport AS transport,
        coalesce(CASE WHEN regexp_matches(p.ur, '^https?://[^/?#]+') THEN p.ur END, CASE WHEN regexp_matches(s.url, '^https?://[^/?#]+') THEN s.url END) AS purl, CASE WHEN regexp_matches(s.account_url, '^https?://') THEN s.account_url END AS paccount
        FROM entries e JOIN lead USING (entry_id) LEFT JOIN sources s ON s.id = p.sid)"""


def _edition(spark, d, date=None):
    return reading.resolved(view(spark, d, "editions"), date)


def _filled(spark, d):
    """The newest edition that has entries."""
    return reading.resolved(view(spark, d, "editions").join(view(spark, d, "entries").select("edition_id").distinct(), "edition_id", "left_semi"))


_NEWEST = "(SELECT edition_id FROM editions WHERE published_at IS NOT NULL ORDER BY edition_date DESC, published_at DESC LIMIT 1)"
_IN_NEWEST = f"edition_id IN (SELECT edition_id FROM pub) AND edition_id = {_NEWEST}"
_IN_FILLED = "edition_id IN (SELECT edition_id FROM pub) AND edition_id = (SELECT edition_id FROM editions WHERE published_at IS NOT NULL AND edition_id IN (SELECT edition_id FROM entries) ORDER BY edition_date DESC, published_at DESC LIMIT 1)"
_SAFE = "CASE WHEN regexp_matches({0}, '^https?://[^/?#]+') THEN {0} END"


# ---- reading -----------------------------------------------------------------------------------

@query(f"WITH {sql('editions', 'entries')} SELECT edition_id, CAST(edition_date AS VARCHAR) AS edition_date, count(entry_id) AS selected_items, coalesce(candidate_count, 0) AS candidate_items FROM editions LEFT JOIN entries USING (edition_id) WHERE editions.published_at IS NOT NULL GROUP BY ALL")
def r01_editions(spark, d):
    return reading.edition_rows(view(spark, d, "editions"), view(spark, d, "entries")).select("edition_id", dates.iso(F.col("edition_date")).alias("edition_date"), "selected_items", "candidate_items")


@query(f"WITH {sql('editions')} SELECT 'newest' AS asked, edition_id FROM editions WHERE edition_id = {_NEWEST} UNION ALL SELECT 'date', edition_id FROM editions WHERE edition_date = DATE '2024-01-08' AND published_at IS NOT NULL")
def r02_resolve_edition(spark, d):
    ask = lambda name, date: _edition(spark, d, date).select(F.lit(name).alias("asked"), "edition_id")
    return ask("newest", None).unionByName(ask("date", " 2024-01-08 ")).unionByName(ask("none", "2024-13-45"))


@query(f"""WITH {sql('editions', 'entries')}, pub AS (SELECT * FROM editions WHERE status = 'published' AND published_at IS NOT NULL), e AS (SELECT * FROM entries WHERE {_IN_NEWEST})
  SELECT 'topic' AS kind, coalesce(nullif(topic, ''), nullif(content_class, ''), '未分类') AS label, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT 'group', coalesce(nullif(source_group, ''), 'general'), count(*) FROM e GROUP BY ALL""")
def r03_dashboard(spark, d):
    topics, groups = reading.dashboard(reading.selected(_entries(spark, d), _edition(spark, d)))
    return topics.select(F.lit("topic").alias("kind"), "label", "n").unionByName(groups.select(F.lit("group").alias("kind"), "label", "n"))


@query(f"""WITH {_entries_sql()} SELECT entry_id AS id, display_order, title, CAST(round_even(display_score, 0) AS INTEGER) AS display_score, CASE WHEN entry_id % 3 = 0 THEN 'thin；old' END AS risk_note, {_SAFE.format('url')} AS url, source_name, pgroup AS source_group, psid AS source_id, transport AS source_transport, purl AS source_url, paccount AS account_url, reason, topic
  FROM ev WHERE {_IN_NEWEST} AND (topic = 'de' OR content_class = 'de' OR topic = 'fr' OR content_class = 'fr') = (topic = 'de') AND topic = 'de' ORDER BY display_order, entry_id LIMIT 5 OFFSET 1""")
def r04_featured_cards(spark, d):
    rows = reading.selected(_entries(spark, d), _edition(spark, d), category="de")
    return reading.cards(reading.paged(rows, 5, 1), view(spark, d, "sources")).select("id", "display_order", "title", "display_score", "risk_note", "url", "source_name", "source_group", "source_id", "source_transport", "source_url", "account_url", "reason", "topic")


@query(f"""WITH {_entries_sql()} SELECT entry_id AS event_id, display_order, coalesce(nullif(original_title, ''), title) AS original_title, {_SAFE.format('url')} AS url, display_score, source_name, pgroup AS source_group, CAST(entry_id % 3 + 1 AS INTEGER) AS n_refs FROM ev WHERE {_IN_FILLED} AND content_class = 'news_media' ORDER BY display_order, entry_id LIMIT 30""")
def r05_featured_events(spark, d):
    rows = reading.selected(_entries(spark, d), _filled(spark, d), content_class="news_media")
    return reading.event_view(reading.paged(rows), view(spark, d, "sources")).select("event_id", "display_order", "original_title", "url", "display_score", "source_name", "source_group", F.size("refs").alias("n_refs"))


_MEMBERS = f"""m AS (SELECT r.entry_id, display_order, pos, coalesce(CAST(r.item_id AS BIGINT), -(r.entry_id * 1000 + pos)) AS item_id, coalesce(nullif(trim(r.title), ''), nullif(e.original_title, ''), e.title) AS title, CASE WHEN r.ai_summary IS NOT NULL THEN 'two words' END AS summary,
  coalesce({_SAFE.format('r.source_url')}, {_SAFE.format('e.url')}) AS url, coalesce(nullif(trim(r.source_group), ''), e.source_group) AS source_group, is_primary, r.content_text FROM refs r JOIN entries e USING (entry_id) WHERE {_IN_NEWEST})"""


@query(f"""WITH {_entries_sql()}, {_MEMBERS.replace(_IN_NEWEST, _IN_FILLED)}, o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY display_order, entry_id, NOT is_primary, pos) AS r FROM m), u AS (SELECT * FROM o WHERE r = 1)
  SELECT item_id, title, summary, url, source_group, content_text, (SELECT count(*) FROM u) AS total FROM u ORDER BY item_id LIMIT 20 OFFSET 3""")
def r06_all_dynamics(spark, d):
    return reading.all_dynamics(reading.selected(_entries(spark, d), _filled(spark, d)), 20, 3).select("item_id", "title", "summary", "url", "source_group", "content_text", "total")


@query(f"WITH {_entries_sql()}, {_MEMBERS.replace(_IN_NEWEST, 'entry_id = 11')} SELECT entry_id, item_id, title, is_primary FROM m")
def r07_event_detail(spark, d):
    _, members = reading.detail(_entries(spark, d), view(spark, d, "sources"), 11)
    return members.select("entry_id", "item_id", "title", "is_primary")


@query(f"""WITH {_entries_sql()} SELECT 'event' AS result_type, entry_id AS id, title, CAST(round_even(display_score, 0) AS INTEGER) AS score, concat_ws('/', 'selected', nullif(content_class, ''), nullif(pgroup, '')) AS badges FROM ev WHERE {_IN_FILLED} AND (title ILIKE '%e%' OR coalesce(original_title, '') ILIKE '%e%' OR summary ILIKE '%e%' OR url ILIKE '%e%') ORDER BY display_order, entry_id LIMIT 20""")
def r08_search(spark, d):
    rows = reading.selected(_entries(spark, d), _filled(spark, d), query=" e ")
    return reading.search(rows, view(spark, d, "sources"), 99).select("result_type", "id", "title", "score", F.array_join("badges", "/").alias("badges"))


@query(f"""WITH {_entries_sql()}, c AS (SELECT DISTINCT entry_id, unnest([entry_id % 12, (entry_id * 7) % 12]) AS k FROM entries WHERE edition_id IN (SELECT edition_id FROM pub)), n AS (SELECT 's' || k AS id, count(*) AS n FROM c GROUP BY ALL)
  SELECT id, name, {_SAFE.format('url')} AS url, coalesce(consecutive_failures, 0) AS consecutive_failures, coalesce(n, 0) AS item_count FROM sources LEFT JOIN n USING (id)""")
def r09_source_rows(spark, d):
    return reading.source_rows(view(spark, d, "sources"), _entries(spark, d), view(spark, d, "editions")).select("id", "name", "url", "consecutive_failures", "item_count")


@query(f"""WITH {_entries_sql()}, e AS (SELECT * FROM entries WHERE edition_id IN (SELECT edition_id FROM pub))
  SELECT 'source_group' AS kind, source_group AS value FROM e WHERE source_group <> '' UNION SELECT 'content_class', content_class FROM e WHERE content_class <> '' UNION SELECT 'content_class', unnest({list(reading.CONTENT_CLASSES)})""")
def r10_filter_options(spark, d):
    return reading.filter_options(_entries(spark, d), view(spark, d, "editions"))


@query(f"WITH {sql('editions', 'entries')} SELECT CAST(edition_date AS VARCHAR) AS edition_date, coalesce(candidate_count, 0) AS candidate, count(entry_id) AS published, count(entry_id) AS selected FROM editions LEFT JOIN entries USING (edition_id) WHERE editions.published_at IS NOT NULL GROUP BY ALL")
def r11_edition_summary(spark, d):
    return reading.summary(view(spark, d, "editions"), view(spark, d, "entries")).select(dates.iso(F.col("edition_date")).alias("edition_date"), "candidate", "published", "selected")


@query(f"WITH {sql('sources')} SELECT id, health_status, coalesce(consecutive_failures, 0) AS failures, priority FROM sources")
def r13_source_health(spark, d):
    return reading.source_health(view(spark, d, "sources")).select("id", "health_status", F.coalesce("consecutive_failures", F.lit(0)).alias("failures"), "priority")


@query(f"""WITH {sql('editions')}, r AS (SELECT edition_date, edition_id * 10 AS run_id FROM editions WHERE edition_id % 2 = 0 UNION ALL SELECT edition_date, edition_id * 10 + 1 FROM editions WHERE edition_id % 4 = 0)
  SELECT CAST(e.edition_date AS VARCHAR) AS edition_date, coalesce(bool_or(status = 'published' AND published_at IS NOT NULL), false) AS public, max(run_id) AS draft_run, max(CASE WHEN edition_id % 5 = 0 THEN edition_id END) AS audit_run FROM editions e LEFT JOIN r USING (edition_date) GROUP BY 1""")
def r14_edition_status(spark, d):
    e = view(spark, d, "editions")
    draft = e.filter("edition_id % 2 = 0").selectExpr("edition_date", "edition_id * 10 AS run_id").unionByName(e.filter("edition_id % 4 = 0").selectExpr("edition_date", "edition_id * 10 + 1 AS run_id"))
    return reading.edition_status(e, draft, e.filter("edition_id % 5 = 0").selectExpr("edition_date", "edition_id AS run_id"), e).withColumn("edition_date", dates.iso(F.col("edition_date")))


@query(f"WITH {sql('entries')} SELECT edition_id, coalesce(nullif(topic, ''), 'none') AS label, min(display_order) AS first, count(*) AS n, string_agg(entry_id, ',' ORDER BY display_order, entry_id) AS ids FROM entries WHERE edition_id = 4 GROUP BY ALL")
def g23_by_label(spark, d):
    rows = view(spark, d, "entries").filter("edition_id = 4")
    return reading.by_label(rows, F.coalesce(F.when(F.col("topic") != "", F.col("topic")), F.lit("none"))).select(F.lit(4).cast("long").alias("edition_id"), "label", "first", "n", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query(f"WITH {sql('entries')} SELECT entry_id, CAST(row_number() OVER (PARTITION BY edition_id ORDER BY display_order // 2, event_key) AS INTEGER) AS display_order, coalesce(nullif(trim(title), ''), '(untitled)') AS title, coalesce(nullif(trim(original_title), ''), nullif(trim(title), '')) AS original_title FROM entries")
def w15_dense_order(spark, d):
    rows = view(spark, d, "entries").withColumn("display_order", F.floor(F.col("display_order") / 2))
    return publish.dense_order(rows, "edition_id").select("entry_id", "display_order", "title", "original_title")


# ---- events ------------------------------------------------------------------------------------

_URL = "CASE WHEN item_id % 5 = 0 THEN CASE WHEN item_id % 7 = 0 THEN 'https://src.org/' || item_id END WHEN item_id % 5 = 1 THEN 'https://github.com/Own/Repo' || (item_id % 20) ELSE 'https://ex.org/p' || (item_id % 80) || '?b=1' END"
_KEYS = f"""k0 AS (SELECT *, lower(replace(external_id, ' ', '')) AS ext, {_URL} AS link FROM items),
  k1 AS (SELECT *, coalesce(ext LIKE 'github_release:%' OR ext LIKE 'github_repo:%', false) AS alone, item_id % 5 = 1 AS root FROM k0),
  kk AS (SELECT *, list_filter(['external:' || ext, CASE WHEN NOT alone AND NOT (root AND ext IS NOT NULL) THEN 'url:' || link END], lambda x: x IS NOT NULL) AS keys FROM k1)"""


@query(f"""WITH {sql('items')}, {_KEYS} SELECT item_id, array_to_string(keys, '|') AS keys, concat_ws('|', CASE WHEN root THEN 'github_repo_root:' || lower(link) END, CASE WHEN ext LIKE 'github_release:%' THEN 'url:' || link END) AS hints,
  coalesce(keys[1], 'item:' || item_id) AS event_key FROM kk WHERE item_id > 0""")
def e04_event_key(spark, d):
    c = F.col
    url = events.url_of(c("canonical_url"), c("source_url"))
    rows = view(spark, d, "items").filter("item_id > 0")
    rows = rows.select("item_id", "title", entities.identity_keys(c("external_id"), url).alias("keys"), events.related_hints(c("external_id"), url).alias("hints"))
    return rows.select("item_id", F.array_join("keys", "|").alias("keys"), F.array_join("hints", "|").alias("hints"), events.first_key(c("keys"), c("item_id"), c("title")).alias("event_key"))


_CLAIMS = "SELECT CAST(l_suppkey % 40 AS INTEGER) AS position, 'e' || CAST(l_suppkey % 40 AS STRING) AS event_key, l_orderkey AS item_id FROM lineitem"


@query(f"""WITH a AS ({_CLAIMS}), f AS (SELECT item_id, min(position) AS p FROM a GROUP BY 1) SELECT DISTINCT 'kept' AS what, event_key, a.item_id, event_key AS owner FROM a JOIN f ON a.item_id = f.item_id AND position = p
  UNION ALL SELECT 'dropped', event_key, a.item_id, 'e' || p FROM a JOIN f ON a.item_id = f.item_id AND position <> p""")
def e06_first_claims(spark, d):
    kept, dropped = events.first_claims(table(spark, d, "lineitem").selectExpr("CAST(l_suppkey % 40 AS INT) AS position", "'e' || CAST(l_suppkey % 40 AS STRING) AS event_key", "l_orderkey AS item_id"))
    return kept.select(F.lit("kept").alias("what"), "event_key", "item_id", F.col("event_key").alias("owner")).unionByName(dropped.select(F.lit("dropped").alias("what"), "event_key", "item_id", "owner"))


_DRAFT = "CAST(floor(item_id / 3) AS BIGINT)"
_PUB = "CASE CAST(substr(draft_key, 2) AS INT) % 4 WHEN 0 THEN 'needs_review' WHEN 1 THEN 'Candidate' WHEN 2 THEN 'rejected' ELSE 'candidate' END"


@query(f"""WITH RECURSIVE {sql('items')}, {_KEYS}, mem AS (SELECT 'd' || ({_DRAFT}) AS draft_key, item_id, keys FROM kk), dr AS (SELECT DISTINCT draft_key, lower({_PUB}) AS pub FROM mem),
  ke AS (SELECT DISTINCT draft_key, unnest(keys) AS k FROM mem JOIN dr USING (draft_key) WHERE pub <> 'rejected'), reach AS (SELECT DISTINCT draft_key AS a, draft_key AS b FROM dr UNION SELECT r.a, y.draft_key FROM reach r JOIN ke x ON r.b = x.draft_key JOIN ke y ON x.k = y.k),
  sz AS (SELECT draft_key, pub, count(*) AS n FROM mem JOIN dr USING (draft_key) GROUP BY ALL)
  SELECT a AS draft_key, arg_min(b, (CASE pub WHEN 'candidate' THEN 0 WHEN 'needs_review' THEN 1 ELSE 2 END, -n, b)) AS "into" FROM reach JOIN sz ON b = draft_key GROUP BY 1""")
def w10_merged_drafts(spark, d):
    items = view(spark, d, "items")
    members = items.selectExpr(f"'d' || CAST({_DRAFT} AS STRING) AS draft_key", "item_id")
    drafts = members.select("draft_key").distinct().selectExpr("draft_key", f"{_PUB} AS publishability")
    return events.merged_drafts(drafts, members, items)


@query(f"""WITH {sql('items')}, {_KEYS}, mem AS (SELECT item_id // 12 AS draft_id, item_id, keys FROM kk WHERE item_id % 3 <> 0), free AS (SELECT item_id, unnest(keys) AS k FROM kk WHERE item_id % 3 = 0), mk AS (SELECT draft_id, unnest(keys) AS k FROM mem),
  res AS (SELECT item_id, min(draft_id) AS draft_id FROM free JOIN mk USING (k) GROUP BY 1), al AS (SELECT draft_id, item_id, false AS r FROM mem UNION ALL SELECT draft_id, item_id, true FROM res),
  f AS (SELECT al.*, i.*, coalesce(published_at, captured_at) AS t_at, CASE WHEN lower(source_group) IN ('official_blog', 'official_research', 'x_official', 'github_release') THEN 0 WHEN content_class = 'news_media' THEN 1 WHEN content_class = 'project_tool' THEN 2 ELSE 3 END AS cr FROM al JOIN items i USING (item_id))
  SELECT draft_id, arg_min(item_id, (cr, -b1_priority, -epoch_us(t_at), item_id)) AS primary_item_id, string_agg(item_id, ',' ORDER BY r, item_id) AS item_ids, CAST(max(b1_priority) AS INTEGER) AS display_score, epoch_us(min(t_at)) AS first_seen, epoch_us(max(t_at)) AS last_seen,
    CASE WHEN draft_id >= 45 THEN 'agent:' || draft_id ELSE 'dk' || draft_id END AS event_key, list_aggregate(list_sort(list_distinct(list('w' || (item_id % 4)))), 'string_agg', ',') AS words FROM f GROUP BY draft_id""")
def j12_materialised(spark, d):
    items = view(spark, d, "items")
    members = items.filter("item_id % 3 <> 0").selectExpr("CAST(floor(item_id / 12) AS BIGINT) AS draft_id", "item_id")
    drafts = members.select("draft_id").distinct().selectExpr("draft_id", "'dk' || CAST(draft_id % 45 AS STRING) AS draft_key", "'A Title' AS title")
    reviews = items.selectExpr("item_id", "array(concat('w', item_id % 4), ' ', NULL) AS keywords", "array(named_struct('name', 'n', 'type', 'company')) AS entities")
    out = events.materialised(drafts, members, items, items.filter("item_id % 3 = 0"), reviews)
    ids = F.array_join(F.transform("item_ids", lambda x: x.cast("string")), ",")
    return out.select("draft_id", "primary_item_id", ids.alias("item_ids"), "display_score", F.unix_micros("first_seen_at").alias("first_seen"), F.unix_micros("last_seen_at").alias("last_seen"), "event_key", F.array_join(F.array_sort("keywords"), ",").alias("words"))


@query(f"""WITH {sql('items')}, {_KEYS}, p AS (SELECT item_id // 4 AS draft_id, min(item_id) AS lead FROM kk GROUP BY 1)
  SELECT draft_id, k.item_id, CASE WHEN k.item_id = lead THEN 'primary' WHEN list_has_any(k.keys, l.keys) THEN 'duplicate' ELSE 'related' END AS relation FROM kk k JOIN p ON k.item_id // 4 = draft_id JOIN kk l ON l.item_id = lead""")
def e10_relations(spark, d):
    items = view(spark, d, "items")
    ev = items.groupBy(F.floor(F.col("item_id") / 4).alias("draft_id")).agg(F.min("item_id").alias("primary_item_id"), F.collect_set("item_id").alias("item_ids"))
    return events.relations(ev, items)


@query("""WITH e AS (SELECT o_custkey AS k, count(*) AS n, CASE o_custkey % 3 WHEN 0 THEN 'repeat' WHEN 1 THEN 'updated' END AS nov, CASE o_custkey % 4 WHEN 0 THEN 'needs_review' WHEN 1 THEN 'Candidate' ELSE 'rejected' END AS st FROM orders GROUP BY 1)
  SELECT CAST(sum(n - 1) AS BIGINT) AS merged, count(*) FILTER (WHERE nov = 'repeat') AS repeats, count(*) FILTER (WHERE nov = 'updated') AS updated, count(*) FILTER (WHERE nov IS NULL) AS events, count(*) FILTER (WHERE lower(st) IN ('candidate', 'needs_review')) AS candidates, count(*) FILTER (WHERE st = 'needs_review') AS unresolved FROM e""")
def g26_cluster_result(spark, d):
    e = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("item_ids"))
    return events.result_counts(e.selectExpr("item_ids", "CASE o_custkey % 3 WHEN 0 THEN 'repeat' WHEN 1 THEN 'updated' END AS novelty_status", "CASE o_custkey % 4 WHEN 0 THEN 'needs_review' WHEN 1 THEN 'Candidate' ELSE 'rejected' END AS review_state"))


@query("""WITH m AS (SELECT o_custkey AS position, CASE WHEN o_custkey % 10 = 0 THEN ' ' ELSE 'k' || (o_custkey % 90) END AS k, o_orderkey % 900 AS item FROM orders WHERE o_custkey % 25 <> 1), d AS (SELECT DISTINCT position, k FROM m), e AS (SELECT DISTINCT o_custkey AS position, 'k' || (o_custkey % 90) AS k FROM orders WHERE o_custkey % 25 = 1),
  k2 AS (SELECT * FROM d UNION ALL SELECT * FROM e)
  SELECT 'draft_key_required' AS error, CAST(position AS VARCHAR) AS what FROM k2 WHERE k = ' ' UNION ALL SELECT 'duplicate_draft_key', k FROM k2 WHERE k <> ' ' GROUP BY k HAVING count(*) > 1 UNION ALL SELECT 'draft_without_items', CAST(position AS VARCHAR) FROM e
  UNION ALL SELECT 'item_in_several_drafts', CAST(item AS VARCHAR) FROM m GROUP BY item HAVING count(DISTINCT position) > 1""")
def e14_draft_errors(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("position")).agg(F.collect_list(F.col("o_orderkey") % 900).alias("ids"))
    rows = o.withColumn("item_ids", F.when(F.col("position") % 25 != 1, F.col("ids"))).withColumn("draft_key", F.when((F.col("position") % 10 == 0) & (F.col("position") % 25 != 1), " ").otherwise(F.concat(F.lit("k"), (F.col("position") % 90).cast("string"))))
    return events.draft_errors(rows)


_EVIDENCE = "event_id AS evidence_id, CASE WHEN event_id % 4 = 0 THEN event_id % 7 END AS draft_id, CASE event_id % 3 WHEN 0 THEN 'event_key: dk' || CAST(event_id % 40 AS STRING) || chr(10) || 'claim ' || CAST(event_id AS STRING) WHEN 1 THEN 'event_key:dk' || CAST(event_id % 40 AS STRING) ELSE 'plain' END AS claim"


@query(f"""WITH e AS (SELECT {_EVIDENCE}, event_id % 40 AS k, event_id % 3 AS kind FROM events)
  SELECT evidence_id, CASE WHEN draft_id IS NOT NULL THEN draft_id WHEN kind < 2 AND k < 30 THEN k END AS draft_id, CASE WHEN draft_id IS NULL AND kind = 0 AND k < 30 THEN 'claim ' || evidence_id WHEN draft_id IS NULL AND kind = 1 AND k < 30 THEN NULL ELSE claim END AS claim FROM e""")
def j13_attached_evidence(spark, d):
    e = table(spark, d, "events").selectExpr(*_split(_EVIDENCE))
    drafts = spark.range(30).selectExpr("id AS draft_id", "'dk' || CAST(id AS STRING) AS draft_key")
    return events.attached_evidence(e, drafts)


def _split(columns: str) -> list[str]:
    """Columns of a select list whose expressions hold no comma outside of their names."""
    return columns.split(", ")


@query(f"""WITH e AS (SELECT {_EVIDENCE} FROM events) SELECT evidence_id, CASE WHEN draft_id IN (1, 3, 5) THEN draft_id + 100 END AS draft_id, claim FROM e""")
def t15_carried_evidence(spark, d):
    e = table(spark, d, "events").selectExpr(*_split(_EVIDENCE))
    old = spark.range(7).selectExpr("id AS draft_id", "'k' || CAST(id AS STRING) AS draft_key")
    return events.carried_evidence(e, old, old.filter("draft_id % 2 = 1").selectExpr("draft_id + 100 AS draft_id", "draft_key"))


@query("""WITH e AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN NULL ELSE 'dk' || (page_id % 40) END AS k, page_id % 40 AS n, CASE WHEN page_id % 5 = 0 THEN 'relative/x' ELSE 'https://W' || page_id || '.org:8080/p' END AS u, trim(substr(html, 1, 5000), ' ' || chr(9) || chr(10) || chr(13)) AS x FROM pages)
  SELECT CASE WHEN k IS NOT NULL AND n < 30 THEN n END AS draft_id, u AS final_url, 'w' || page_id || '.org' AS host, sha256(substr(x, 1, 4000)) AS content_hash, CASE WHEN k IS NOT NULL AND n >= 30 THEN 'event_key:' || k || chr(10) || 'c' ELSE 'c' END AS claim, 'recorded' AS status FROM e WHERE page_id % 5 <> 0""")
def m11_new_evidence(spark, d):
    found = table(spark, d, "pages").selectExpr("CASE WHEN page_id % 4 <> 0 THEN ' dk' || CAST(page_id % 40 AS STRING) END AS draft_key", "CASE WHEN page_id % 5 = 0 THEN 'relative/x' ELSE 'https://W' || CAST(page_id AS STRING) || '.org:8080/p' END AS url", "' ' AS final_url", "'t' AS title", "substr(html, 1, 5000) AS excerpt", "' c ' AS claim", "'' AS status")
    drafts = spark.range(30).selectExpr("id AS draft_id", "'dk' || CAST(id AS STRING) AS draft_key")
    return events.new_evidence(found, drafts).select("draft_id", "final_url", "host", "content_hash", "claim", "status")


@query(f"""WITH {sql('items')}, {_KEYS}, x AS (SELECT 'k' || (item_id % 33) AS event_key, item_id % 9 AS day, unnest(keys) AS identity FROM kk), f AS (SELECT identity, event_key, min(day) AS d FROM x GROUP BY ALL)
  SELECT identity, string_agg(event_key, ',' ORDER BY d, event_key) AS event_keys FROM f GROUP BY 1""")
def j11_history_index(spark, d):
    rows = view(spark, d, "items").select(F.concat(F.lit("k"), (F.col("item_id") % 33).cast("string")).alias("event_key"), (F.col("item_id") % 9).alias("edition_date"), "external_id", events.url_of(F.col("canonical_url"), F.col("source_url")).alias("url"))
    return events.history_index(rows).withColumn("event_keys", F.array_join("event_keys", ","))


@query("SELECT count(DISTINCT l_orderkey) AS covered FROM lineitem WHERE l_orderkey % 3 = 0")
def g21_covered(spark, d):
    plan = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.collect_set("l_orderkey").alias("item_ids"))
    return events.covered(plan, table(spark, d, "orders").filter("o_orderkey % 3 = 0").selectExpr("o_orderkey AS item_id"))


# ---- packages and records ----------------------------------------------------------------------

_PACK = {
    "event_id": "doc_id", "title": "lang", "summary_cn": "CASE WHEN doc_id % 5 <> 0 THEN source END", "topic": "lang", "source_group": "CASE WHEN doc_id % 3 <> 0 THEN ' tech ' END", "review_state": "CASE WHEN doc_id % 4 <> 0 THEN 'candidate' END",
    "novelty_status": "CASE doc_id % 5 WHEN 0 THEN 'New' WHEN 1 THEN 'updated' WHEN 2 THEN 'repeat' WHEN 3 THEN 'odd' END", "family": "CASE WHEN doc_id % 2 = 0 THEN 'fam' END", "pub": "CASE doc_id % 3 WHEN 0 THEN 'rejected' WHEN 1 THEN '' END", "hist": "CASE WHEN doc_id % 7 = 0 THEN ' uncertain ' END",
}


@query(f"""WITH e AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _PACK.items())} FROM documents)
  SELECT event_id, title, coalesce(summary_cn, '') AS summary_cn, coalesce(family, '') AS event_family_key, coalesce(nullif(pub, ''), review_state, '') AS publishability, coalesce(trim(hist), CASE novelty_status WHEN 'New' THEN 'new' WHEN 'updated' THEN 'meaningful_update' WHEN 'repeat' THEN 'repeat' ELSE '' END) AS history_status, topic,
    CASE WHEN event_id % 2 = 0 THEN 'g1|g2' ELSE coalesce(trim(source_group), '') END AS source_groups, CASE WHEN event_id % 3 = 0 THEN 'candidate_without_facts' ELSE '' END AS eligibility_blockers, CASE WHEN event_id % 4 = 0 THEN 'thin|mine|late' ELSE 'thin|late' END AS editorial_caveats FROM e""")
def p26_package(spark, d):
    rows = table(spark, d, "documents").selectExpr(*(f"{v} AS {k}" for k, v in _PACK.items()))
    groups = F.expr("CASE WHEN event_id % 2 = 0 THEN array('g1', ' g2', 'g1', '') ELSE CAST(array() AS ARRAY<STRING>) END")
    flags = F.expr("filter(array('needs_review', 'thin', CASE WHEN event_id % 3 = 0 THEN 'candidate_without_facts' END, 'thin', CASE WHEN event_id % 4 = 0 THEN 'mine' END), x -> x IS NOT NULL)")
    draft = F.struct(F.col("family").alias("event_family_key"), F.array().cast("array<struct<claim:string>>").alias("facts"), F.col("pub").alias("publishability"), F.col("hist").alias("history_status"), F.expr("array('thin', 'late', 'search_not_configured')").alias("caveats"))
    out = records.package(rows.withColumns({"source_groups": groups, "risk_flags": flags, "draft": draft})).drop("facts")
    return out.withColumns({c: F.array_join(c, "|") for c in ("source_groups", "eligibility_blockers", "editorial_caveats")})


@query("""WITH m AS (SELECT doc_id // 30 AS event_id, doc_id AS item_id, source, lang FROM documents), p AS (SELECT event_id, min(item_id) AS lead FROM m GROUP BY 1)
  SELECT event_id, 'key' || event_id AS event_key, CAST(event_id + 1 AS INTEGER) AS display_order, CAST(event_id * 2 AS DOUBLE) AS display_score, CASE WHEN event_id % 3 = 0 THEN 'new' ELSE 'unknown' END AS kind, CASE WHEN event_id % 2 = 0 THEN 'top' ELSE 'selected' END AS reason_code, count(*) AS refs,
    string_agg(item_id, ',' ORDER BY item_id) AS ref_items, max(CASE WHEN item_id = lead THEN item_id END) AS lead_item, count(*) FILTER (WHERE item_id % 2 = 0) AS audits, CASE WHEN bool_or(item_id % 3 = 0) AND bool_or(item_id % 3 <> 0) THEN 'candidate,new' WHEN bool_or(item_id % 3 = 0) THEN 'new' ELSE 'candidate' END AS member_statuses FROM m JOIN p USING (event_id) GROUP BY event_id""")
def p27_records(spark, d):
    docs = table(spark, d, "documents")
    m = docs.selectExpr("CAST(floor(doc_id / 30) AS BIGINT) AS event_id", "doc_id AS item_id", "source AS source_id", "CAST(NULL AS STRING) AS source_group", "CAST(NULL AS STRING) AS source_url", "CAST(NULL AS STRING) AS source_title", "'related' AS match_type", "100 AS match_confidence")
    lead = m.groupBy("event_id").agg(F.min("item_id").alias("lead"))
    m = m.join(lead, "event_id").withColumn("is_primary", F.col("item_id") == F.col("lead")).drop("lead")
    items = docs.selectExpr("doc_id AS item_id", "lang AS title", "CAST(NULL AS STRING) AS canonical_url", "lang AS summary", "CAST(NULL AS STRING) AS summary_cn", "CAST(NULL AS STRING) AS content_text", "'full' AS content_depth", "CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'candidate' END AS status", "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * CAST(doc_id AS INT) AS published_at", "CAST(NULL AS TIMESTAMP) AS captured_at")
    sources = docs.select("source").distinct().selectExpr("source AS id", "upper(source) AS name", "'grp' AS source_group")
    screens = docs.filter("doc_id % 2 = 0").selectExpr("doc_id AS item_id", "'pass' AS decision", "'' AS reason_code", "90 AS confidence")
    numbers = docs.selectExpr("CAST(floor(doc_id / 30) AS BIGINT) AS id").distinct()
    ev = numbers.selectExpr("id AS event_id", "'key' || CAST(id AS STRING) AS event_key", "id * 2 AS display_score", "'t' AS topic", "'c' AS content_class", "CAST(NULL AS STRING) AS source_group", "array('s') AS source_ids", "CAST(NULL AS ARRAY<STRING>) AS source_groups", "'T' AS title", "'S' AS summary_cn", "'u' AS canonical_url", "CASE id % 3 WHEN 0 THEN 'New' WHEN 1 THEN 'odd' END AS novelty_status", "array('f') AS risk_flags", "array('k') AS keywords", "'candidate' AS review_state", "CAST(NULL AS INT) AS resolution_confidence", "CAST(NULL AS TIMESTAMP) AS first_seen_at", "CAST(NULL AS TIMESTAMP) AS last_seen_at")
    chosen = numbers.selectExpr("id AS event_id", "CAST(id + 1 AS INT) AS display_order", "CASE WHEN id % 2 = 0 THEN 'top' ELSE '' END AS reason_code", "' why ' AS reason")
    out = records.records(ev, m, items, sources, screens, chosen)
    hours = ((F.unix_micros("published_at") - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / F.lit(3_600_000_000)).cast("long")
    return out.select("event_id", "event_key", "display_order", "display_score", "provenance.kind", "reason_code", F.size("source_refs").cast("long").alias("refs"), F.array_join(F.transform("source_refs", lambda r: r["item_id"].cast("string")), ",").alias("ref_items"), hours.alias("lead_item"), F.size("screen_audit").cast("long").alias("audits"), F.array_join("member_statuses", ",").alias("member_statuses"))


@query(f"""WITH {sql('items')}, {_KEYS}, a AS (SELECT item_id, CASE WHEN b1_priority >= 60 THEN 'active' ELSE 'filtered' END AS bucket, CASE WHEN item_id % 3 = 0 THEN item_id END AS rank FROM items)
  SELECT a.item_id AS id, bucket, rank, CASE WHEN a.item_id % 2 = 0 THEN 'r' || a.item_id ELSE substr(title, 1, 5) END AS summary_cn, array_to_string(keys, '|') AS identity_keys, epoch_us(coalesce(published_at, captured_at)) AS at, least(16000, length(coalesce(nullif(content_text, ''), substr(title, 1, 5), title, ''))) AS body FROM a JOIN (SELECT kk.*, text AS content_text FROM kk JOIN documents ON doc_id = item_id) k USING (item_id)""")
def p29_candidates(spark, d):
    items = view(spark, d, "items").join(table(spark, d, "documents").selectExpr("doc_id AS item_id", "text AS content_text"), "item_id").withColumn("summary", F.substring("title", 1, 5)).drop("source_group")
    adm = items.selectExpr("item_id", "CASE WHEN b1_priority >= 60 THEN 'active' ELSE 'filtered' END AS decision", "CASE WHEN item_id % 3 = 0 THEN item_id END AS rank", "b1_priority AS guarded_score")
    reviews = items.filter("item_id % 2 = 0").selectExpr("item_id", "'r' || CAST(item_id AS STRING) AS summary_cn", "'t' AS topic", "array('k') AS keywords")
    out = records.candidates(adm, items, reviews, view(spark, d, "sources"), full=True)
    return out.select("id", "bucket", "rank", "summary_cn", F.array_join("identity_keys", "|").alias("identity_keys"), F.unix_micros("published_at").alias("at"), F.length("content_text").cast("long").alias("body"))


@query(f"""WITH {sql('items')} SELECT CAST(item_id AS VARCHAR) AS item_id, CASE WHEN trim(title) = '' OR item_id % 9 = 0 THEN 'item failed the structural prefilter' WHEN item_id % 4 = 3 THEN 'unknown source' END AS structural_error, CASE WHEN item_id % 4 <> 3 THEN 'name' END AS source_name FROM items""")
def p33_envelope(spark, d):
    rows = view(spark, d, "items").drop("source_group").withColumn("content_hash", F.when(F.col("item_id") % 9 != 0, "h")).withColumn("source_id", F.concat(F.lit("q"), (F.col("item_id") % 4).cast("string"))).withColumn("summary", F.col("title")).withColumn("content_text", F.col("title"))
    sources = spark.range(3).selectExpr("'q' || CAST(id AS STRING) AS id", "'name' AS name", "'g' AS source_group", "'c' AS content_class")
    return records.envelope(rows, sources).select("item_id", "structural_error", "source_name")


@query(f"WITH {sql('items')} SELECT item_id, CASE WHEN b1_priority >= 60 THEN 'active' ELSE 'filtered' END AS decision, CASE WHEN item_id % 2 = 0 THEN 't' END AS topic FROM items WHERE b1_priority >= 60 OR item_id % 10 = 0")
def j04_admissions(spark, d):
    items = view(spark, d, "items")
    adm = items.selectExpr("item_id", "CASE WHEN b1_priority >= 60 THEN 'active' WHEN item_id % 10 = 0 THEN 'filtered' ELSE 'reserve' END AS decision", "CASE WHEN item_id % 3 = 0 THEN item_id END AS rank")
    out = records.admissions_listed(adm, items.select("item_id", "source_id"), view(spark, d, "sources"), items.filter("item_id % 2 = 0").selectExpr("item_id", "'t' AS topic"), ("active", "filtered"))
    return out.select("item_id", "decision", "topic")


# ---- tasks and builds --------------------------------------------------------------------------

_STATUSES = ", ".join(f"count(*) FILTER (WHERE s = '{x}') AS {x}" for x in records.TASK_STATUSES)


@query(f"WITH {sql('tasks')}, t AS (SELECT *, CASE WHEN stage = 'export' AND status = 'running' THEN 'failed' ELSE status END AS s FROM tasks) SELECT run, stage, count(*) AS total, {_STATUSES} FROM t GROUP BY ALL")
def g25_task_counts(spark, d):
    return records.task_counts(view(spark, d, "tasks"), "partial")


@query(f"WITH {sql('tasks')}, t AS (SELECT *, status AS s FROM tasks), c AS (SELECT run, stage, count(*) AS total, count(*) FILTER (WHERE s = 'succeeded') AS ok, count(*) FILTER (WHERE s IN ('failed', 'retry_waiting', 'blocked')) AS bad FROM t GROUP BY ALL) SELECT run, stage, CAST(sum(total) AS BIGINT) AS total, CAST(sum(ok) AS BIGINT) AS succeeded, CAST(sum(bad) AS BIGINT) AS open FROM c GROUP BY ROLLUP (run, stage)")
def g07_stage_rollup(spark, d):
    c = records.task_counts(view(spark, d, "tasks"))
    return c.rollup("run", "stage").agg(F.sum("total").alias("total"), F.sum("succeeded").alias("succeeded"), F.sum(F.col("failed") + F.col("retry_waiting") + F.col("blocked")).alias("open"))


@query(f"""WITH {sql('tasks')}, e AS (SELECT run, stage, task_id, error_code FROM tasks WHERE error_code IS NOT NULL UNION ALL SELECT DISTINCT run, stage, -1, 'own' FROM tasks WHERE run % 5 = 0)
  SELECT run, stage, 'unknown' AS category, arg_min(error_code, task_id) AS code FROM e GROUP BY ALL""")
def p36_first_errors(spark, d):
    none = F.lit(None).cast("string")
    tasks = view(spark, d, "tasks").withColumns({"error_category": none, "error_message": none})
    stages = tasks.select("run", "stage").distinct().withColumns({"error_category": none, "error_message": none, "error_code": F.when(F.col("run") % 5 == 0, "own")})
    return records.first_errors(stages, tasks).select("run", "stage", "category", "code")


@query(f"""WITH {sql('tasks')}, t AS (SELECT *, CASE WHEN stage = 'screen' AND status = 'skipped' THEN CASE WHEN reason LIKE '%future%' THEN 'f' WHEN reason LIKE '%missing%' THEN 'm' ELSE 'o' END END AS why FROM tasks),
  a AS (SELECT run, count(*) FILTER (WHERE stage = 'screen') AS st, count(*) FILTER (WHERE stage = 'screen' AND status = 'skipped') AS sk, count(*) FILTER (WHERE why = 'o') AS o, count(*) FILTER (WHERE why = 'f') AS f, count(*) FILTER (WHERE why = 'm') AS m,
    count(*) FILTER (WHERE stage = 'screen' AND status = 'succeeded' AND lower(decision) IN ('pass', 'uncertain')) AS pass_, count(*) FILTER (WHERE stage = 'screen' AND status = 'succeeded' AND decision = 'reject') AS rej, count(*) FILTER (WHERE stage = 'screen' AND status IN ('failed', 'retry_waiting', 'blocked')) AS af,
    count(*) FILTER (WHERE stage = 'analyze' AND subject_type = 'item' AND status = 'succeeded' AND filtered) AS bf, count(*) FILTER (WHERE stage = 'analyze' AND subject_type = 'item' AND status = 'succeeded' AND NOT filtered) AS bg, count(*) FILTER (WHERE stage = 'analyze' AND status IN ('failed', 'retry_waiting', 'blocked')) AS ba,
    min(CASE WHEN stage = 'cluster' AND subject_type = 'run' AND status = 'succeeded' THEN task_id END) AS ct, min(CASE WHEN stage = 'cluster' AND subject_type = 'run' THEN task_id END) AS ce FROM t GROUP BY 1),
  i AS (SELECT user_id % 20 AS run, count(*) AS fr, count(*) FILTER (WHERE event_type = 'view') AS so, count(*) FILTER (WHERE event_type = 'signup') AS ca FROM events WHERE user_id % 4 <> 1 GROUP BY 1)
  SELECT a.run, CASE WHEN a.run % 2 = 0 THEN 500 ELSE coalesce(fr, 0) END AS fetched, coalesce(fr, 0) AS frozen, greatest(0, st - sk) AS within_stage_a_window, o + f + m AS time_excluded, o AS too_old, f AS future_timestamp, m AS missing_published_at, pass_ AS stage_a_pass, CASE WHEN coalesce(so, 0) > 0 THEN so ELSE rej END AS stage_a_excluded, af AS stage_a_failed,
    CASE WHEN bg + bf > 0 THEN bg + bf ELSE coalesce(ca, 0) END AS stage_b_analyzed, bf AS stage_b_structurally_filtered, ba AS stage_b_failed, coalesce(ct % 100, 0) AS stage_c_input_selected, coalesce(ct % 7 * 2, 0) AS stage_c_input_invalid_contract, CASE WHEN ce IS NULL THEN 0 ELSE 2 END AS stage_c_events FROM a LEFT JOIN i USING (run)""")
def g08_build_funnel(spark, d):
    t = view(spark, d, "tasks")
    n = F.col("task_id")
    result = F.struct("reason", "decision", "filtered", (n % 100).alias("selected_count"), F.lit(0).alias("below_min_score"), F.lit(0).alias("analysis_filtered"), (n % 7).alias("missing_item"), (n % 7).alias("missing_review"), F.array(n, n, n + 1).alias("event_ids"), F.lit(None).cast("array<bigint>").alias("candidate_event_ids"), F.lit(None).cast("array<bigint>").alias("selected"))
    items = table(spark, d, "events").filter("user_id % 4 <> 1").selectExpr("user_id % 20 AS run", "CASE event_type WHEN 'view' THEN 'screened_out' WHEN 'signup' THEN 'candidate' ELSE 'new' END AS status")
    runs = t.select("run").distinct()
    none = F.lit(None).cast("long")
    stages = runs.select("run", F.lit("fetch").alias("stage"), F.when(F.col("run") % 2 == 0, F.lit(500).cast("long")).alias("fetched"), none.alias("inserted"), none.alias("candidate_count"), none.alias("too_old"), none.alias("future_timestamp"), none.alias("missing_published_at"))
    out = records.funnel(runs, t.withColumn("result", result), items, stages)
    return out.select("run", "fetched", "frozen", "within_stage_a_window", "time_excluded", "too_old", "future_timestamp", "missing_published_at", "stage_a_pass", "stage_a_excluded", "stage_a_failed", "stage_b_analyzed", "stage_b_structurally_filtered", "stage_b_failed", "stage_c_input_selected", "stage_c_input_invalid_contract", "stage_c_events")


@query(f"""WITH {sql('tasks')} SELECT run, status, string_agg(task_id || ':' || coalesce(error_code, '-'), ',' ORDER BY task_id) AS sources FROM tasks WHERE status IN ('failed', 'blocked') GROUP BY ALL""")
def g18_source_details(spark, d):
    rows = view(spark, d, "tasks").select("run", "status", F.col("task_id").alias("source_id"), F.concat(F.col("error_code"), F.lit(": long")).alias("error"))
    out = records.source_details(rows, ("failed", "blocked"))
    return out.withColumn("sources", F.array_join(F.transform("sources", lambda s: F.concat(s["source_id"].cast("string"), F.lit(":"), F.coalesce(s["code"], F.lit("-")))), ","))


@query(f"""WITH {sql('tasks')} SELECT task_id, CASE WHEN status IN ('failed', 'retry_waiting', 'blocked') AND task_id % 2 = 0 THEN 'pending' ELSE status END AS status, CASE WHEN status IN ('failed', 'retry_waiting', 'blocked') AND task_id % 2 = 0 THEN NULL ELSE error_code END AS error_code,
  CASE WHEN status IN ('failed', 'retry_waiting', 'blocked') AND task_id % 2 = 0 THEN 0 ELSE attempt_count END AS attempt_count, CASE WHEN status = 'succeeded' THEN 'succeeded' ELSE 'pending' END AS after_reset FROM tasks""")
def t09_retry(spark, d):
    t = view(spark, d, "tasks").select("task_id", "status", "error_code", "attempt_count", "lease_expires_at")
    again = state.retried(t, blocked=True, ids=t.filter("task_id % 2 = 0"), reset_attempts=True).drop("lease_expires_at")
    return again.join(state.reset(t).select("task_id", F.col("status").alias("after_reset")), "task_id")


@query(f"""WITH {sql('tasks')}, n AS (SELECT *, list_position(['screen', 'analyze', 'cluster', 'export'], stage) AS p FROM tasks), live AS (SELECT DISTINCT run FROM n WHERE p > 2 AND status = 'running' AND (lease_expires_at IS NULL OR lease_expires_at > TIMESTAMP '{NOW}') AND run % 2 = 0)
  SELECT run, stage, count(*) AS tasks FROM n WHERE NOT (run % 2 = 0 AND p > 2 AND run NOT IN (SELECT run FROM live)) GROUP BY ALL""")
def t10_invalidated(spark, d):
    t = view(spark, d, "tasks")
    stages = t.select("run", "stage").distinct().withColumns({"lease_owner": F.lit(None).cast("string"), "lease_expires_at": F.lit(None).cast("timestamp")})
    rebuilt = stages.filter("run % 2 = 0 AND stage = 'analyze'").select("run", "stage")
    _, left, _ = state.invalidated(stages, t, rebuilt, ["screen", "analyze", "cluster", "export"], F.lit(NOW).cast("timestamp_ntz"))
    return left.groupBy("run", "stage").agg(F.count(F.lit(1)).alias("tasks"))


@query(f"""WITH {sql('tasks')} SELECT task_id, NOT (held AND task_id % 2 = 0) AS acquired, CASE WHEN held AND task_id % 2 = 0 THEN 'other' ELSE 'me' END AS lease_owner,
  CASE WHEN NOT (held AND task_id % 2 = 0) AND (status <> 'running' OR over) THEN 'running' ELSE status END AS status, attempt_count + CASE WHEN NOT (held AND task_id % 2 = 0) AND (status <> 'running' OR over) THEN 1 ELSE 0 END AS attempt_count
  FROM (SELECT *, coalesce(lease_expires_at > TIMESTAMP '{NOW}', false) AS held, coalesce(lease_expires_at <= TIMESTAMP '{NOW}', false) AS over FROM tasks)""")
def t06_stage_leases(spark, d):
    s = view(spark, d, "tasks").withColumns({"lease_owner": F.when(F.col("task_id") % 2 == 0, "other").otherwise("me"), "started_at": F.col("ts"), "finished_at": F.col("ts")})
    out = state.acquired(s, "me", F.lit(NOW).cast("timestamp_ntz"))
    return out.select("task_id", "acquired", "lease_owner", "status", "attempt_count")


@query(f"WITH {sql('tasks')} SELECT task_id FROM tasks WHERE status IN ('running', 'succeeded') AND subject_type = 'item' AND (status <> 'running' OR lease_expires_at IS NULL OR lease_expires_at > TIMESTAMP '{NOW}')")
def p13_listed_tasks(spark, d):
    return state.listed(view(spark, d, "tasks"), F.lit(NOW).cast("timestamp_ntz"), statuses=("running", "succeeded"), subject_type="item").select("task_id")


@query(f"WITH {sql('tasks')} SELECT task_id, true AS partial FROM tasks WHERE NOT (status = 'succeeded' AND fingerprint = 3) ORDER BY task_id LIMIT 50")
def w17_remaining(spark, d):
    left, more = state.remaining(view(spark, d, "tasks"), F.lit(3), 50)
    return left.select("task_id", more.alias("partial"))


@query("SELECT user_id, arg_min(props, (epoch_us(ts), props)) AS props, sha256(arg_min(props, (epoch_us(ts), props))) AS payload_hash FROM events WHERE event_type <> 'error' GROUP BY 1")
def t13_first_payload(spark, d):
    e = table(spark, d, "events").withColumn("props", F.when(F.col("event_type") != "error", F.col("props")))
    return state.first_payloads(e, "user_id", "ts", "props")


@query("""WITH h AS (SELECT conv_id, turn, substr(text, 1, 3) AS q, role = 'user' AS hit FROM conversations), f AS (SELECT conv_id, q, min(turn) AS t FROM h WHERE hit GROUP BY ALL), a AS (SELECT conv_id, count(*) FILTER (WHERE hit) AS searches, max(turn) AS last_sequence FROM h GROUP BY 1)
  SELECT conv_id AS session, CAST(searches AS INTEGER) AS searches, coalesce((SELECT string_agg(coalesce(q, ''), '|' ORDER BY t) FROM f WHERE f.conv_id = a.conv_id), '') AS queries, last_sequence FROM a""")
def t14_replayed(spark, d):
    steps = table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("sequence"), F.lit("tool_call").alias("kind"), F.when(F.col("role") == "user", "search_web").otherwise("read").alias("tool_name"), F.substring("text", 1, 3).alias("input"))
    return state.replayed(steps).withColumn("queries", F.array_join("queries", "|", ""))


@query("""WITH a AS (SELECT *, 's' || (user_id % 12) AS source_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'degraded' ELSE 'success' END AS st FROM events WHERE event_type <> 'signup'), r AS (SELECT *, sum(CASE WHEN st = 'failed' THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a),
  s AS (SELECT *, sum(CASE WHEN st = 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak, row_number() OVER (PARTITION BY source_id ORDER BY ts DESC, event_id DESC) AS n FROM r)
  SELECT source_id AS id, CASE st WHEN 'failed' THEN 'failed' WHEN 'degraded' THEN 'degraded' ELSE 'healthy' END AS health_status, CAST(streak AS BIGINT) AS consecutive_failures, CASE WHEN streak > 0 THEN epoch_us(ts) + CAST(least(86400, 60 * pow(2, streak - 1)) AS BIGINT) * 1000000 END AS backoff_until FROM s WHERE n = 1 UNION ALL SELECT 's99', 'unknown', 0, NULL""")
def t12_source_state(spark, d):
    log = table(spark, d, "events").select(F.concat(F.lit("s"), (F.col("user_id") % 12).cast("string")).alias("source_id"), F.col("event_id").alias("attempt_id"), F.col("ts").alias("at"), F.expr("CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'degraded' WHEN 'signup' THEN 'skipped' ELSE 'success' END").alias("status"))
    sources = spark.range(12).selectExpr("'s' || CAST(id AS STRING) AS id").unionByName(spark.range(1).selectExpr("'s99' AS id"))
    return state.source_state(sources, log).select("id", "health_status", "consecutive_failures", F.unix_micros(F.col("backoff_until").cast("timestamp")).alias("backoff_until"))


# ---- rows by key -------------------------------------------------------------------------------

@query(f"""WITH {sql('items')}, o AS (SELECT item_id, item_id % 10 AS event_id, 'old' AS match_type FROM items WHERE item_id % 3 <> 0), n AS (SELECT item_id, item_id % 7 + 100 AS event_id, CASE WHEN item_id % 4 = 0 THEN NULL ELSE 'new' END AS match_type FROM items WHERE item_id % 2 = 0)
  SELECT i.item_id, coalesce(n.event_id, o.event_id) AS event_id, coalesce(source_group, '') AS source_group, coalesce(canonical_url, source_url) AS source_url, CASE WHEN n.item_id IS NOT NULL THEN coalesce(n.match_type, 'deterministic') ELSE o.match_type END AS match_type, n.item_id IS NOT NULL AS is_primary FROM items i LEFT JOIN o USING (item_id) LEFT JOIN n ON n.item_id = i.item_id WHERE o.item_id IS NOT NULL OR n.item_id IS NOT NULL""")
def m05_event_members(spark, d):
    items = view(spark, d, "items")
    side = lambda rows, event, match, primary: rows.selectExpr(f"{event} AS event_id", "item_id", "CAST(NULL AS STRING) AS source_id", "CAST(NULL AS STRING) AS source_group", "CAST(NULL AS STRING) AS source_url", "CAST(NULL AS STRING) AS source_title", "'i' AS identity_key", f"{match} AS match_type", f"{primary} AS is_primary")
    out = state.event_members(side(items.filter("item_id % 3 <> 0"), "item_id % 10", "'old'", "false"), side(items.filter("item_id % 2 = 0"), "item_id % 7 + 100", "CASE WHEN item_id % 4 <> 0 THEN 'new' END", "true"), items)
    return out.select("item_id", "event_id", F.coalesce("source_group", F.lit("")).alias("source_group"), "source_url", "match_type", "is_primary")


@query(f"""WITH {sql('items')}, n AS (SELECT item_id % 6 AS run_id, item_id, CASE WHEN item_id = 14 THEN 'odd' WHEN item_id % 2 = 0 THEN 'active' ELSE 'filtered' END AS decision, CASE WHEN item_id % 5 = 0 THEN -3 END AS rank, item_id AS score FROM items WHERE item_id % 6 < 4), bad AS (SELECT run_id FROM n WHERE decision = 'odd')
  SELECT run_id, item_id, decision, CASE WHEN rank IS NOT NULL THEN 1 END AS rank, CAST(least(100, score) AS INTEGER) AS guarded_score FROM n WHERE run_id NOT IN (SELECT run_id FROM bad) UNION ALL SELECT item_id % 6, item_id, 'reserve', NULL, 7 FROM items WHERE item_id % 2 = 0 AND (item_id % 6 >= 4 OR item_id % 6 IN (SELECT run_id FROM bad))""")
def m06_replaced_admissions(spark, d):
    items = view(spark, d, "items")
    new = items.filter("item_id % 6 < 4").selectExpr("item_id % 6 AS run_id", "item_id", "CASE WHEN item_id = 14 THEN 'odd' WHEN item_id % 2 = 0 THEN 'active' ELSE ' ' END AS decision", "CASE WHEN item_id % 5 = 0 THEN -3 END AS rank", "CAST(item_id AS INT) AS guarded_score", "'c' AS reason_code", "CAST(NULL AS STRING) AS reason")
    old = items.filter("item_id % 2 = 0").selectExpr("item_id % 6 AS run_id", "item_id", "'reserve' AS decision", "CAST(NULL AS INT) AS rank", "7 AS guarded_score", "'' AS reason_code", "'' AS reason")
    out, _ = state.replaced_admissions(old, new, items.selectExpr("item_id", "item_id % 6 AS build_id"))
    return out.select("run_id", "item_id", "decision", "rank", "guarded_score")


@query("""SELECT o_custkey AS run_id, CASE WHEN o_custkey % 2 = 0 THEN 'completed' ELSE 'running' END AS status, CASE WHEN o_custkey % 2 = 0 THEN 5 ELSE 1 END AS fetched, 1 AS screened, CASE WHEN o_custkey % 2 = 0 THEN 9 ELSE 2 END AS selected, CASE WHEN o_custkey % 2 = 0 THEN 'why' END AS partial_reason FROM (SELECT DISTINCT o_custkey FROM orders)""")
def m08_finished_runs(spark, d):
    ids = table(spark, d, "orders").select(F.col("o_custkey").alias("run_id")).distinct()
    runs = ids.withColumns({"status": F.lit("running"), "finished_at": F.lit(None).cast("timestamp"), "selected": F.lit(2), "partial": F.lit(False), "partial_reason": F.lit(None).cast("string"), "error": F.lit(None).cast("string"), **{c: F.lit(1) for c in state.COUNTERS}})
    done = ids.filter("run_id % 2 = 0").selectExpr("run_id", "'completed' AS status", "5 AS fetched", "9 AS candidate", "' why ' AS partial_reason", "'e' AS error")
    return state.finished_runs(runs, done, F.lit(NOW).cast("timestamp")).select("run_id", "status", "fetched", "screened", "selected", "partial_reason")


@query(f"""WITH {sql('sources')} SELECT id, name, coalesce(source_group, 'general') AS source_group, CASE WHEN transport <> 'github' THEN 'atom' END AS feed_format, CASE WHEN transport = 'github' THEN 'search' END AS github_mode FROM sources""")
def m02_source_columns(spark, d):
    rows = view(spark, d, "sources").withColumns({"enabled": F.lit(True), "fetch_interval": F.lit(60), "default_limit": F.lit(5)})
    feed = F.when(F.col("transport") != "github", F.struct(F.lit("atom").alias("format"), F.lit("generic").alias("adapter")))
    git = F.when(F.col("transport") == "github", F.struct(F.lit("search").alias("mode"), *(F.lit(None).cast("string").alias(k) for k in ("query", "sort", "order", "pushed_days", "period"))))
    flat = state.source_columns(rows.withColumns({"feed": feed, "github": git}))
    back = state.source_specs(flat)
    return flat.join(back.select("id", F.col("feed.format").alias("feed_format_"), F.col("github.mode").alias("mode_")), "id").select("id", "name", "source_group", F.col("feed_format_").alias("feed_format"), F.col("mode_").alias("github_mode"))


# ---- projects, labels, dates -------------------------------------------------------------------

_PROJECT = """'o/R' || CAST(p_partkey AS STRING) AS full_name, CAST(p_size * 100 AS STRING) AS stars, CASE WHEN p_size % 2 = 0 THEN 'Go' WHEN p_size % 3 = 0 THEN 'Rust' END AS language, p_size % 9 = 0 AS archived"""


def _projects(spark, d):
    rows = table(spark, d, "part").withColumn("metrics", F.expr("map_filter(map('full_name', 'o/R' || CAST(p_partkey AS STRING), 'stars', CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size * 100 AS STRING) END, 'language', CASE WHEN p_size % 2 = 0 THEN 'Go' WHEN p_size % 3 = 0 THEN 'Rust' END, 'trending_period', CASE WHEN p_size % 4 = 0 THEN 'weekly' END, 'stars_since', CAST(p_size AS STRING)), (k, v) -> v IS NOT NULL)"))
    payload = F.expr("map('stargazers_count', '1.5k', 'archived', CASE WHEN p_size % 9 = 0 THEN 'true' ELSE 'false' END, 'license', CASE WHEN p_size % 5 = 0 THEN '{\"spdx_id\": \"MIT\"}' END, 'github_item_type', 'repository')")
    ai = F.struct(F.lit("success").alias("status"), (F.col("p_partkey") % 11 != 0).alias("keep"), F.lit(None).cast("string").alias("summary_cn"), F.expr("array('ai_flag', 'missing_license')").alias("risk_flags"))
    cols = {"content_class": F.when(F.col("p_partkey") % 13 != 0, "project_tool").otherwise("news_media"), "source_id": F.lit("x"), "source_transport": F.lit("feed"), "external_id": F.lit(None).cast("string"), "id": F.col("p_partkey"), "url": F.lit(None).cast("string"), "title": F.col("p_name"), "summary": F.col("p_type"), "content_text": F.lit(None).cast("string"), "status": F.lit("new"), "published_at": F.lit(None).cast("string"), "raw_payload": payload, "ai": ai}
    return projects.project_rows(rows.withColumns(cols))


_PROJECTS_SQL = """p AS (SELECT p_partkey AS item_id, p_type AS summary, p_size, 'o/R' || p_partkey AS repo_full_name, CASE WHEN p_partkey % 5 <> 0 THEN p_size * 100 ELSE 1500 END AS stars, CASE WHEN p_size % 2 = 0 THEN 'Go' WHEN p_size % 3 = 0 THEN 'Rust' END AS language, p_size % 9 = 0 AS archived, p_size % 5 = 0 AS licensed, CASE WHEN p_size % 4 = 0 THEN p_size ELSE 0 END AS weekly
  FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 13 <> 0)"""


@query(f"""WITH {_PROJECTS_SQL} SELECT item_id, repo_full_name, CAST(stars AS BIGINT) AS stars, language, CASE WHEN licensed THEN 'MIT' END AS license_name, concat_ws(',', CASE WHEN archived THEN 'archived_repository' END, CASE WHEN NOT licensed THEN 'missing_license' END, 'ai_flag', CASE WHEN licensed THEN 'missing_license' END) AS flags, CAST(weekly AS BIGINT) AS weekly FROM p
  WHERE lower(repo_full_name || ' ' || summary || ' ' || coalesce(language, '') || CASE WHEN licensed THEN ' MIT' ELSE '' END) LIKE '%go%' AND language = 'Go' AND stars >= 800 AND NOT archived ORDER BY weekly DESC, stars DESC, item_id LIMIT 40""")
def p19_projects(spark, d):
    rows = projects.ordered(projects.filtered(_projects(spark, d), query="GO", language="go", min_stars=800, archived=False), 40)
    return rows.select("item_id", "repo_full_name", "stars", "language", "license_name", F.array_join("risk_flags", ",").alias("flags"), projects.since(F.col("trending"), "weekly").alias("weekly"))


@query(f"WITH {_PROJECTS_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE NOT archived) AS active, count(*) FILTER (WHERE archived) AS archived, count(*) AS risky, CAST(max(stars) AS BIGINT) AS max_stars, (SELECT string_agg(language, ',' ORDER BY language) FROM (SELECT DISTINCT language FROM p WHERE language IS NOT NULL)) AS languages FROM p")
def r12_project_stats(spark, d):
    rows = _projects(spark, d)
    names = projects.languages(rows).agg(F.array_join(F.array_sort(F.collect_list("language")), ",").alias("languages"))
    return projects.stats(rows).crossJoin(names)


@query("""SELECT doc_id AS item_id, CASE WHEN doc_id % 3 = 0 THEN greatest(doc_id, 500) ELSE doc_id END AS stars, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN substr(text, 1, 16000) END ELSE 'metrics' END IS NOT NULL AS has_content,
  CASE WHEN doc_id % 3 = 0 THEN 'about ' || doc_id ELSE 'old' END AS summary, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 5 = 0 THEN 'partial' ELSE 'success' END END AS status FROM documents WHERE trim(text) <> ''""")
def m10_enriched(spark, d):
    docs = table(spark, d, "documents").filter("trim(text) <> ''")
    items = docs.selectExpr("doc_id AS item_id", "map('stars', CAST(doc_id AS STRING)) AS metrics", "'metrics' AS content_text", "'old' AS summary")
    found = docs.filter("doc_id % 3 = 0").selectExpr("doc_id AS item_id", "map('stargazers_count', '500', 'description', ' about ' || CAST(doc_id AS STRING), 'secret', 'x') AS metadata", "CASE WHEN doc_id % 2 = 0 THEN text END AS readme_text", "true AS readme_checked", "CASE WHEN doc_id % 5 = 0 THEN array('e') ELSE CAST(array() AS ARRAY<STRING>) END AS errors")
    out = projects.enriched(items, found)
    return out.select("item_id", F.try_element_at("metrics", F.lit("stars")).cast("long").alias("stars"), F.col("content_text").isNotNull().alias("has_content"), "summary", F.try_element_at("metrics", F.lit("github_enrichment_status")).alias("status"))


@query(f"""WITH {sql('sources')} SELECT id, CASE content_class WHEN 'official_model_company' THEN '官方发布' WHEN 'news_media' THEN '媒体报道' WHEN 'project_tool' THEN '项目 / 工具' ELSE '社区线索' END AS class_label, CASE source_group WHEN 'official_blog' THEN '官方博客' WHEN 'tech_media' THEN '科技媒体' WHEN 'github_release' THEN 'GitHub Releases' WHEN 'reddit_fixed' THEN 'Reddit' WHEN 'X_Official' THEN 'X Official' ELSE '未标注来源' END AS group_label,
  CASE transport WHEN 'feed' THEN 'RSS/Atom' WHEN 'rsshub' THEN 'RSSHub' ELSE 'GitHub' END AS transport_label FROM sources""")
def f19_labels(spark, d):
    c = F.col
    return view(spark, d, "sources").select("id", text.label(c("content_class"), "content_class").alias("class_label"), text.label(c("source_group"), "source_group").alias("group_label"), text.label(c("transport"), "transport").alias("transport_label"))


@query("""WITH x AS (SELECT event_id, ts + INTERVAL 8 HOUR AS l FROM events) SELECT event_id, strftime(l, '%Y-%m-%d %H:%M') AS shown, year(l) || '年' || month(l) || '月' || day(l) || '日 ' || ['星期一', '星期二', '星期三', '星期四', '星期五', '星期六', '星期日'][isodow(l)] AS full_date, strftime(l, '%Y-%m-%d') <> '2024-01-15' AS historical FROM x""")
def f55_dates(spark, d):
    at = F.col("ts").cast("timestamp")
    day = F.date_format(F.from_utc_timestamp(at, dates.ZONE), "yyyy-MM-dd")
    return table(spark, d, "events").select("event_id", dates.shown(at).alias("shown"), dates.full_date(day).alias("full_date"), dates.is_historical(day, F.lit(NOW).cast("timestamp")).alias("historical"))


@query("SELECT event_id, epoch_us(date_trunc('second', ts)) - CASE event_id % 4 WHEN 2 THEN 7200000000 ELSE 0 END AS at FROM events WHERE event_id % 4 <> 3 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 4 = 3")
def f50_parsed_times(spark, d):
    at = F.col("ts").cast("timestamp")
    iso, mail = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(at, "EEE, d MMM yyyy HH:mm:ss")
    i = F.col("event_id") % 4
    raw = F.when(i == 0, iso).when(i == 1, F.concat(mail, F.lit(" GMT"))).when(i == 2, F.concat(mail, F.lit(" +0200"))).otherwise("soon")
    return table(spark, d, "events").select("event_id", F.unix_micros(dates.parsed(F.lit("not a date"), raw)).alias("at"))


@query(f"WITH {sql('tasks')}, x AS (SELECT DISTINCT run FROM tasks) SELECT event_id, CAST(row_number() OVER (ORDER BY event_id % 3 <> 0, event_id % 5 > 1, event_id * 29 % 101 DESC, event_id) AS INTEGER) AS place FROM events ORDER BY 2 LIMIT 25")
def w09_search_first(spark, d):
    e = table(spark, d, "events").selectExpr("event_id", "CASE WHEN event_id % 3 = 0 THEN 'needs_review' ELSE 'candidate' END AS review_state", "CASE event_id % 5 WHEN 0 THEN 'uncertain' WHEN 1 THEN 'repeat' ELSE 'new' END AS novelty_status", "event_id * 29 % 101 AS display_score")
    first = ranking.search_first(e, 25)
    order = F.struct((F.col("review_state") != "needs_review").cast("int"), (~F.col("novelty_status").isin("uncertain", "repeat")).cast("int"), -F.col("display_score"), "event_id")
    ids = first.agg(F.array_sort(F.collect_list(order)).alias("o")).select(F.posexplode("o").alias("p", "o"))
    return ids.select("o.event_id", (F.col("p") + 1).alias("place"))


@query(f"""WITH {sql('items')}, v AS (SELECT item_id, trim(title) <> '' AND item_id % 6 <> 0 AS fine FROM items) SELECT item_id, CASE WHEN fine THEN 'valid' ELSE 'reject' END AS what, CASE WHEN NOT fine THEN 100 END AS confidence FROM v""")
def p05_structural_rejects(spark, d):
    rows = view(spark, d, "items").withColumn("content_hash", F.when(F.col("item_id") % 6 != 0, "h").otherwise(" "))
    valid, rejects = policy.structural_rejects(rows)
    return valid.select("item_id", F.lit("valid").alias("what"), F.lit(None).cast("int").alias("confidence")).unionByName(rejects.select("item_id", F.col("decision").alias("what"), "confidence"))
