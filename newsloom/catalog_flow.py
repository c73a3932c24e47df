"""Queries of the parts that work through logs, captures and plans: evaluation, claims, and what is built on them."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import functions as F

from .catalog import query
from .functions import addresses, freeform
from .operators import captures, claims, evaluation, planning, policy, ranking, state
from .plans import bundle, keyed, requests, scope
from .sources import articles, entries
from .tables import shared_folder, table


# ---- evaluation ----------------------------------------------------------------------------------

def _judged(row: dict) -> dict:
    """Stands in for a model: fails on texts without words, and answers some in a form that isn't asked for."""
    text = (row["text"] or "").strip(" ")
    if not text:
        raise ValueError("no text")
    return {"n": len(text), "verdict": "long" if len(text) > 500 else "short"} if len(text) % 5 else {"n": "many"}


@query("""WITH t AS (SELECT doc_id, trim(coalesce(text, ''), ' ') AS x FROM documents)
  SELECT doc_id, CASE WHEN x = '' THEN 'ValueError' WHEN length(x) % 5 = 0 THEN 'InvalidResult' END AS error, CASE WHEN length(x) % 5 <> 0 THEN length(x)::BIGINT END AS n,
    CASE WHEN length(x) % 5 <> 0 THEN CASE WHEN length(x) > 500 THEN 'long' ELSE 'short' END END AS verdict FROM t""")
def u09_isolated(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text")
    out = evaluation.evaluated(rows, ["text"], _judged, "n long, verdict string", folder=f"{shared_folder(spark)}/evaluation-{uuid.uuid4().hex}", every=1000)
    return out.select("doc_id", F.col("outcome.error.code").alias("error"), F.col("outcome.result.n").alias("n"), F.col("outcome.result.verdict").alias("verdict"))


# ---- claims --------------------------------------------------------------------------------------

_LOG = {
    "seq": "event_id", "task": "'u' || CAST(user_id AS STRING)", "kind": "CASE event_type WHEN 'click' THEN 'heartbeat' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' ELSE 'claim' END", "owner": "'w' || CAST(event_id % 2 AS STRING)",
    "seconds": "CAST((1 + event_id % 20) * 3600 AS INT)", "input": "CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END", "force": "event_id % 5 = 0", "retryable": "event_id % 2 = 0", "code": "'e' || CAST(event_id % 7 AS STRING)",
}
_WAIT = 40_000


def _requests(spark, d):
    none = {"stage": "CAST(NULL AS STRING)", "config": "CAST(NULL AS STRING)", "stage_lease": "false", "result": "CAST(NULL AS STRING)", "retry_after": f"CAST({_WAIT} AS DOUBLE)"}
    return table(spark, d, "events").selectExpr(*(f"{v} AS {k}" for k, v in (_LOG | none).items()), "unix_micros(CAST(ts AS TIMESTAMP)) AS at")


_FOLD = f"""WITH RECURSIVE log AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _LOG.items())}, epoch_us(ts) AS at_, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
st AS (
  SELECT task, 0::BIGINT AS rn, NULL::BIGINT AS seq, '' AS outcome, 'pending' AS status, NULL::VARCHAR AS owner, NULL::BIGINT AS expires, NULL::BIGINT AS due, 0::BIGINT AS attempts, NULL::VARCHAR AS input, NULL::VARCHAR AS code,
    NULL::VARCHAR AS a, NULL::BIGINT AS began, NULL::BIGINT AS ended, NULL::VARCHAR AS pre_a, NULL::BIGINT AS pre_ended, 0::BIGINT AS pre_no, NULL::BIGINT AS pre_began FROM log GROUP BY task
  UNION ALL
  SELECT task, rn, seq, outcome, CASE outcome WHEN 'claimed' THEN 'running' WHEN 'completed' THEN 'succeeded' WHEN 'retry_waiting' THEN outcome WHEN 'blocked' THEN outcome ELSE status END,
    CASE WHEN outcome = 'claimed' THEN l_owner WHEN outcome IN ('completed', 'retry_waiting', 'blocked') THEN NULL ELSE owner END, CASE WHEN outcome IN ('claimed', 'renewed') THEN at_ + seconds * 1000000::BIGINT WHEN outcome IN ('completed', 'retry_waiting', 'blocked') THEN NULL ELSE expires END,
    CASE WHEN outcome = 'retry_waiting' THEN at_ + {_WAIT} * 1000000::BIGINT WHEN outcome IN ('claimed', 'completed', 'blocked') THEN NULL ELSE due END, attempts + CASE WHEN outcome = 'claimed' THEN 1 ELSE 0 END, CASE WHEN outcome = 'claimed' THEN coalesce(l_input, input) ELSE input END,
    CASE WHEN outcome IN ('claimed', 'completed') THEN NULL WHEN outcome IN ('retry_waiting', 'blocked') THEN l_code ELSE code END,
    CASE WHEN outcome = 'claimed' THEN 'running' WHEN outcome = 'completed' AND attempts > 0 THEN 'succeeded' WHEN outcome IN ('retry_waiting', 'blocked') AND a = 'running' THEN outcome ELSE a END,
    CASE WHEN outcome = 'claimed' THEN at_ ELSE began END, CASE WHEN outcome = 'claimed' THEN NULL WHEN outcome = 'completed' AND attempts > 0 THEN at_ WHEN outcome IN ('retry_waiting', 'blocked') AND a = 'running' THEN at_ ELSE ended END, a, ended, attempts, began
  FROM (SELECT *, CASE WHEN kind = 'claim' THEN CASE WHEN status = 'succeeded' AND (l_input IS NULL OR l_input IS NOT DISTINCT FROM input) AND NOT force THEN 'reusable' WHEN status = 'running' THEN 'leased' WHEN status = 'blocked' AND NOT force THEN 'closed' WHEN due > at_ AND status = 'retry_waiting' THEN 'not_due' ELSE 'claimed' END
      WHEN status = 'retry_waiting' AND code = 'lease_expired' THEN 'lease_lost' WHEN kind = 'heartbeat' THEN CASE WHEN status <> 'running' OR owner IS DISTINCT FROM l_owner THEN 'not_owner' ELSE 'renewed' END
      WHEN owner IS NOT NULL AND owner <> l_owner THEN 'not_owner' WHEN kind = 'complete' THEN 'completed' WHEN retryable THEN 'retry_waiting' ELSE 'blocked' END AS outcome
    FROM (SELECT task, rn, seq, kind, at_, seconds, force, retryable, l_owner, l_input, l_code, attempts, input, began, CASE WHEN x THEN 'retry_waiting' ELSE status END AS status, CASE WHEN x THEN NULL ELSE owner END AS owner, CASE WHEN x THEN NULL ELSE expires END AS expires, CASE WHEN x THEN NULL ELSE due END AS due,
        CASE WHEN x THEN 'lease_expired' ELSE code END AS code, CASE WHEN x THEN 'retry_waiting' ELSE a END AS a, CASE WHEN x THEN expires ELSE ended END AS ended
      FROM (SELECT p.* EXCLUDE (rn, seq, outcome), l.rn, l.seq, l.kind, l.at_, l.seconds, l.force, l.retryable, l.owner AS l_owner, l.input AS l_input, l.code AS l_code, coalesce(p.status = 'running' AND p.expires <= l.at_, false) AS x FROM st p JOIN log l ON l.task = p.task AND l.rn = p.rn + 1))))"""


@query(f"{_FOLD} SELECT seq, task, outcome, status, owner AS lease_owner, expires AS lease_expires_at, due AS next_retry_at, code AS error_code, attempts::INTEGER AS attempt_no FROM st WHERE rn > 0")
def t05_claims(spark, d):
    return claims.folded(_requests(spark, d)).filter("kind <> 'expire'").select("seq", "task", "outcome", "status", "lease_owner", "lease_expires_at", "next_retry_at", "error_code", "attempt_no")


@query(f"""{_FOLD}, each AS (SELECT task, attempts AS no, a, began, ended, rn, 1 AS k FROM st UNION ALL SELECT task, pre_no, pre_a, pre_began, pre_ended, rn, 0 FROM st)
  SELECT task, no::INTEGER AS attempt_no, arg_max(a, (rn, k)) AS attempt_status, any_value(began) AS started_at, arg_max(CASE WHEN a <> 'running' THEN ended ELSE -1 END, (rn, k)) AS finished_at FROM each WHERE no > 0 GROUP BY 1, 2""")
def t18_attempts(spark, d):
    """One row an attempt, as it ended; one that is still running ends at -1."""
    return claims.attempts(claims.folded(_requests(spark, d))).withColumn("finished_at", F.coalesce("finished_at", F.lit(-1)))


# ---- plans ---------------------------------------------------------------------------------------

_PLAN = {
    "plan": "'p' || CAST(CAST(floor(doc_id / 50) AS BIGINT) AS STRING)", "position": "CAST(doc_id % 50 AS INT)", "event_key": "CASE WHEN doc_id % 50 % 17 = 5 THEN '' WHEN doc_id % 50 % 13 = 7 THEN 'k' || CAST(doc_id % 50 - 1 AS STRING) ELSE 'k' || CAST(doc_id % 50 AS STRING) END",
    "i1": "doc_id % 50 * 3 + 1", "i2": "doc_id % 50 * 3 + 2", "i3": "CASE WHEN doc_id % 50 % 4 = 1 THEN doc_id % 50 * 3 + 5 WHEN doc_id % 50 % 11 = 3 THEN 777 END",
    "publishability": "CASE doc_id % 50 % 5 WHEN 0 THEN 'needs_review' WHEN 1 THEN 'rejected' WHEN 2 THEN 'Candidate' WHEN 3 THEN 'odd' ELSE 'candidate' END", "history_status": "CASE doc_id % 50 % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'uncertain' ELSE 'meaningful_update' END",
    "prior_event_key": "CASE doc_id % 50 % 19 WHEN 2 THEN 'h1' WHEN 4 THEN 'zz' END", "fact": "CASE WHEN doc_id % 50 % 6 = 0 THEN 0 WHEN doc_id % 50 % 23 = 9 THEN 2 ELSE 1 END", "caveat": "CASE WHEN doc_id % 50 % 2 = 0 THEN 'x' END", "ident": "'i' || CAST(doc_id % 50 % 12 AS STRING)",
}


def _prepared(spark, d):
    rows = table(spark, d, "documents").selectExpr(*(f"{v} AS {k}" for k, v in _PLAN.items()))
    facts = "CASE fact WHEN 0 THEN array() WHEN 1 THEN array(named_struct('claim', concat('c', i1 % 2), 'supporting_item_ids', array(i1))) ELSE array(named_struct('claim', 'c', 'supporting_item_ids', array(9999L))) END"
    events = rows.selectExpr("plan", "position", "event_key", "array(i1, i2, i3) AS item_ids", "event_key AS title", "publishability", "history_status", "prior_event_key", f"CAST({facts} AS {planning.FACTS}) AS facts", "CASE WHEN caveat IS NOT NULL THEN array(caveat) END AS caveats", "CAST(NULL AS STRING) AS split_reason", "concat('f', position) AS event_family_key")
    items = rows.selectExpr("plan", "i1 AS item_id", "true AS active", "array(ident) AS identities").unionByName(rows.selectExpr("plan", "i2 AS item_id", "false AS active", "CAST(array() AS array<string>) AS identities"))
    plans = rows.select("plan").distinct()
    history, index = plans.selectExpr("plan", "explode(array('h1', 'h3')) AS event_key"), plans.selectExpr("plan", "'i3' AS identity", "array('h3', 'h1') AS event_keys")
    return planning.prepared(events, items, history, index)


_PREPARED = f"""WITH RECURSIVE ev AS (SELECT *, list_filter([i1, i2, i3], lambda x: x IS NOT NULL) AS ids FROM (SELECT {', '.join(f'{v} AS {k}' for k, v in _PLAN.items())} FROM documents)),
known AS (SELECT plan, i1 AS item FROM ev UNION SELECT plan, i2 FROM ev),
outs AS (SELECT plan, position, string_agg(item, ',' ORDER BY item) AS outside FROM (SELECT plan, position, unnest(ids) AS item FROM ev) e WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.plan = e.plan AND k.item = e.item) GROUP BY 1, 2),
ch AS (SELECT ev.*, outside, CASE WHEN event_key = '' THEN 'event_key_missing' WHEN position > min(position) OVER (PARTITION BY plan, event_key) THEN 'event_key_twice' WHEN outside IS NOT NULL THEN 'items_outside' END AS early FROM ev LEFT JOIN outs USING (plan, position)),
el AS (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY position) AS rn FROM ch WHERE early IS NULL),
cl AS (SELECT plan, 0::BIGINT AS rn, []::BIGINT[] AS had, []::VARCHAR[] AS owners, NULL::BIGINT AS taken, NULL::VARCHAR AS owner FROM ch GROUP BY plan
  UNION ALL SELECT plan, rn, list_concat(had, ids[1:coalesce(hit - 1, len(ids))]), list_concat(owners, list_transform(ids[1:coalesce(hit - 1, len(ids))], lambda x: event_key)), ids[hit], owners[list_position(had, ids[hit])]
  FROM (SELECT c.plan, e.rn, c.had, c.owners, e.ids, e.event_key, list_min(list_filter(range(1, len(e.ids) + 1), lambda k: list_contains(c.had, e.ids[k]))) AS hit FROM cl c JOIN el e ON e.plan = c.plan AND e.rn = c.rn + 1)),
ac AS (SELECT el.*, taken, owner, CASE WHEN prior_event_key IS NULL AND ident = 'i3' THEN 'h3' ELSE prior_event_key END AS p FROM el JOIN cl USING (plan, rn)),
ju AS (SELECT *, CASE WHEN p = 'zz' THEN 'uncertain' WHEN p IS NOT NULL THEN CASE WHEN history_status = 'meaningful_update' AND fact > 0 THEN 'meaningful_update' ELSE 'repeat' END WHEN history_status = 'meaningful_update' THEN 'uncertain' ELSE history_status END AS hs,
  CASE WHEN p = 'zz' THEN 'prior_event_outside_history_window' WHEN p IS NULL AND history_status = 'meaningful_update' THEN 'history_match_not_found' END AS hf, CASE WHEN publishability = 'odd' THEN 'needs_review' ELSE lower(publishability) END AS pb FROM ac WHERE taken IS NULL AND fact < 2),
pr AS (SELECT *, CASE WHEN hs = 'repeat' THEN 'rejected' WHEN pb = 'candidate' AND fact = 0 THEN 'needs_review' ELSE pb END AS pub, list_filter([caveat, hf, CASE WHEN publishability = 'odd' THEN 'invalid_publishability' END,
  CASE WHEN hs = 'repeat' THEN 'confirmed_repeat_without_material_change' WHEN pb = 'candidate' AND fact = 0 THEN 'candidate_without_facts' WHEN pb = 'needs_review' THEN 'uncertain_event_core' END], lambda x: x IS NOT NULL) AS caveats,
  CASE WHEN fact = 1 THEN ['c' || (i1 % 2) || ':' || i1] ELSE []::VARCHAR[] END AS facts, CASE WHEN p = 'zz' THEN NULL ELSE p END AS prior FROM ju),
ln AS (SELECT *, CASE pub WHEN 'candidate' THEN 0 ELSE 1 END AS rank, row_number() OVER (PARTITION BY plan, ident ORDER BY position) AS k FROM pr WHERE pub <> 'rejected'),
mg AS (SELECT plan, ident, k, position, event_key, ids, pub, hs, prior, facts, caveats, rank FROM ln WHERE k = 1
  UNION ALL SELECT g.plan, g.ident, e.k, g.position, CASE WHEN f THEN g.event_key ELSE e.event_key END, CASE WHEN f THEN list_concat(g.ids, e.ids) ELSE list_concat(e.ids, g.ids) END, CASE WHEN f THEN g.pub ELSE e.pub END, CASE WHEN f THEN g.hs ELSE e.hs END, CASE WHEN f THEN g.prior ELSE e.prior END,
    CASE WHEN f THEN list_concat(g.facts, e.facts) ELSE list_concat(e.facts, g.facts) END, list_concat(CASE WHEN f THEN list_concat(g.caveats, list_filter(e.caveats, lambda x: NOT list_contains(g.caveats, x))) ELSE list_concat(e.caveats, list_filter(g.caveats, lambda x: NOT list_contains(e.caveats, x))) END,
    ['merged exact-identity event ' || CASE WHEN f THEN e.event_key || ' into ' || g.event_key ELSE g.event_key || ' into ' || e.event_key END]), CASE WHEN f THEN g.rank ELSE e.rank END
  FROM (SELECT g, e, (g.rank, -len(g.ids), g.event_key) <= (e.rank, -len(e.ids), e.event_key) AS f FROM mg g JOIN ln e ON g.plan = e.plan AND g.ident = e.ident AND e.k = g.k + 1)),
fi AS (SELECT * EXCLUDE (rank, k) FROM mg m WHERE k = (SELECT max(k) FROM ln WHERE ln.plan = m.plan AND ln.ident = m.ident) UNION ALL SELECT plan, ident, position, event_key, ids, pub, hs, prior, facts, caveats FROM pr WHERE pub = 'rejected')"""


@query(f"{_PREPARED} SELECT plan, position, event_key, array_to_string(ids, ',') AS item_ids, pub AS publishability, hs AS history_status, prior AS prior_event_key, array_to_string(facts, ',') AS facts, array_to_string(caveats, '|') AS caveats FROM fi")
def e05_prepared(spark, d):
    out, _ = _prepared(spark, d)
    facts = F.transform("facts", lambda f: F.concat(f["claim"], F.lit(":"), F.get(f["supporting_item_ids"], F.lit(0)).cast("string")))
    return out.select("plan", "position", "event_key", F.array_join(F.col("item_ids").cast("array<string>"), ",").alias("item_ids"), "publishability", "history_status", "prior_event_key", F.array_join(facts, ",").alias("facts"), F.array_join("caveats", "|").alias("caveats"))


@query(f"""{_PREPARED} SELECT plan, position, early AS error, CASE early WHEN 'event_key_missing' THEN position::VARCHAR WHEN 'items_outside' THEN outside ELSE event_key END AS what FROM ch WHERE early IS NOT NULL
  UNION ALL SELECT plan, position, 'item_taken', taken || ':' || owner FROM ac WHERE taken IS NOT NULL UNION ALL SELECT plan, position, 'fact', event_key || ':fact_of_others' FROM ac WHERE taken IS NULL AND fact = 2
  UNION ALL SELECT plan, NULL, 'not_covered', string_agg(i1, ',' ORDER BY i1) FROM ev WHERE NOT EXISTS (SELECT 1 FROM fi WHERE fi.plan = ev.plan AND list_contains(fi.ids, ev.i1)) GROUP BY plan""")
def e06_plan_errors(spark, d):
    return _prepared(spark, d)[1]


# ---- pages ---------------------------------------------------------------------------------------

_DECODED = "replace(regexp_replace(regexp_replace(array_to_string(list_filter(list_transform(regexp_split_to_array({0}, '<[^>]*>'), lambda r: trim(regexp_replace(r, '\\s+', ' ', 'g'))), lambda r: r <> ''), ' '), '&quot;', '\"', 'g'), '&amp;?', '&', 'g'), chr(0), '')"
_BLOCK_SQL = f"regexp_replace({_DECODED}, '\\s+([,.;:!?])', '\\1', 'g')"


@query(f"""WITH p AS (SELECT page_id, string_split(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<p>') AS parts FROM pages),
  b AS (SELECT page_id, k, CASE WHEN k = 1 THEN parts[1] WHEN starts_with(parts[k], '<b>') THEN array_to_string(parts[k:], '<p>') ELSE split_part(parts[k], '</p>', 1) END AS inner_html FROM (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM p)),
  t AS (SELECT page_id, k, {_BLOCK_SQL.format('inner_html')} AS block FROM b)
  SELECT page_id, string_agg(block, chr(10) || chr(10) ORDER BY k) AS article FROM t WHERE block <> '' GROUP BY 1""")
def s13_articles(spark, d):
    """Paragraphs without an end hold those after them, as in the pages' tree."""
    landed = table(spark, d, "pages").select("page_id", F.lit("nvidia_ai_blog").alias("source_id"), F.col("html").alias("body"))
    return articles.bodies(landed).select("page_id", "article")


@query(f"""WITH l AS (SELECT page_id, unnest(range(1, 4)) AS position, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS hrefs, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS titles FROM pages),
  a AS (SELECT 'https://l.org' || regexp_extract_all(html, '<a href="([^"]*)">', 1)[1] AS url, min(page_id) AS page_id FROM pages GROUP BY 1), h AS (SELECT a.url, {_BLOCK_SQL.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS head FROM a JOIN pages USING (page_id))
  SELECT l.page_id, position, url, {_DECODED.format('titles[position]')} AS title, head FROM l JOIN h ON 'https://l.org' || hrefs[position] = url WHERE position <= len(hrefs)""")
def s06_listed_articles(spark, d):
    """Pages as listings of their first three links; as articles each page under the address of its own first link, the first page of an address."""
    pages = table(spark, d, "pages")
    listings = pages.select(F.col("page_id").cast("string").alias("source_id"), F.lit("https://l.org/x").alias("url"), F.col("html").alias("body"))
    own = F.concat(F.lit("https://l.org"), F.regexp_extract("html", '<a href="([^"]*)">', 1))
    landed = pages.groupBy(own.alias("url")).agg(F.min_by("html", "page_id").alias("body"))
    out = articles.listed_articles(listings, landed, "nav a[href]", 3)
    return out.select(F.col("source_id").cast("long").alias("page_id"), "position", "url", "title", F.substring_index("content", "\n\n", 1).alias("head"))


# ---- captures ------------------------------------------------------------------------------------

_CAPTURE = {
    "seq": "event_id", "source_id": "'s' || CAST(user_id AS STRING)", "external_id": "CASE event_id % 4 WHEN 0 THEN 'github_repo:o/r' || CAST(event_id % 3 AS STRING) WHEN 1 THEN 'e' || CAST(event_id % 5 AS STRING) END", "content_hash": "'h' || CAST(event_id % 9 AS STRING)",
    "title": "'t' || CAST(event_id % 2 AS STRING)", "content_class": "CASE WHEN event_id % 4 = 0 THEN 'project_tool' ELSE 'news_media' END", "stars": "event_id * 7 % 50",
}


def _applied(spark, d):
    rows = table(spark, d, "events").selectExpr(*(f"{v} AS {k}" for k, v in _CAPTURE.items()), "ts AS at")
    none = {c: "CAST(NULL AS TIMESTAMP)" if c.endswith("_at") else "CAST(NULL AS STRING)" for c in ("summary", "content_text", "content_depth", "canonical_url", "published_at", "discovered_at", "original_title", "source_url", "raw_payload")}
    rows = rows.selectExpr("*", "'b' AS build", "concat('{\"stars\": ', stars, '}') AS metrics", *(f"{v} AS {c}" for c, v in none.items())).drop("stars").withColumn("at", F.col("at").cast("timestamp"))
    return captures.applied(spark.createDataFrame([], captures.ITEM), rows, spark.createDataFrame([], "id string, content_class string"))


_APPLIED = f"""WITH RECURSIVE cap AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY at_, seq) AS rn, CASE WHEN content_class = 'project_tool' THEN sha256(external_id) ELSE content_hash END AS h FROM (SELECT {', '.join(f'{v} AS {k}' for k, v in _CAPTURE.items())}, ts AS at_ FROM events)),
st AS (SELECT source_id, 0::BIGINT AS rn, NULL::BIGINT AS seq, NULL::BIGINT AS item, false AS inserted, false AS material, []::STRUCT(item BIGINT, ext VARCHAR, hash VARCHAR, title VARCHAR, cls VARCHAR, stars BIGINT)[] AS items FROM cap GROUP BY 1
  UNION ALL SELECT source_id, rn, seq, coalesce(items[k].item, seq), k IS NULL, k IS NOT NULL AND (fresh OR items[k].title <> title OR items[k].cls <> cls),
    CASE WHEN k IS NULL THEN list_append(items, struct_pack(item := seq, ext := ext, hash := h, title := title, cls := cls, stars := stars))
      ELSE list_transform(items, lambda x, i: CASE WHEN i = k THEN struct_pack(item := x.item, ext := x.ext, hash := CASE WHEN fresh AND NOT owned THEN h ELSE x.hash END, title := title, cls := cls, stars := CASE WHEN cls = 'project_tool' THEN greatest(x.stars, stars) ELSE stars END) ELSE x END) END
  FROM (SELECT *, cls <> 'project_tool' AND items[k].hash <> h AS fresh, list_contains(list_transform(items, lambda x: x.hash), h) AS owned
    FROM (SELECT s.source_id, c.rn, c.seq, s.items, c.external_id AS ext, c.h, c.title, c.content_class AS cls, c.stars, coalesce(CASE WHEN c.external_id IS NOT NULL THEN nullif(list_position(list_transform(s.items, lambda x: x.ext), c.external_id), 0) END, nullif(list_position(list_transform(s.items, lambda x: x.hash), c.h), 0)) AS k
      FROM st s JOIN cap c ON c.source_id = s.source_id AND c.rn = s.rn + 1)))"""


@query(f"{_APPLIED} SELECT source_id, i.item, i.ext AS external_id, i.hash AS content_hash, i.title, i.cls AS content_class, i.stars FROM (SELECT source_id, unnest(items) AS i FROM st s WHERE rn = (SELECT max(rn) FROM cap WHERE cap.source_id = s.source_id))")
def m01_two_key_items(spark, d):
    return _applied(spark, d)[0].select("source_id", "item", "external_id", "content_hash", "title", "content_class", F.get_json_object("metrics", "$.stars").cast("long").alias("stars"))


@query(f"{_APPLIED} SELECT source_id, seq, item, inserted, material FROM st WHERE rn > 0")
def f63_capture_outcomes(spark, d):
    return _applied(spark, d)[1].select("source_id", "seq", "item", "inserted", "material")


# ---- scopes --------------------------------------------------------------------------------------

@query("SELECT d.source, count(*) AS documents, count(*) FILTER (WHERE doc_id % 3 = 0) AS members, sum(length(coalesce(text, '')))::BIGINT AS characters FROM documents d GROUP BY 1")
def t02_frozen_read(spark, d):
    """A build frozen over the documents, read through its manifest."""
    root = f"{shared_folder(spark)}/builds-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents")
    kept = scope.freeze(spark, root, "b", {"documents": f"{d}/documents.parquet"}, docs.filter("doc_id % 3 = 0").selectExpr("doc_id AS item_id", "source AS source_id"), datetime(2024, 1, 15, tzinfo=timezone.utc))
    rows = kept.table("documents").join(kept.members().select(F.col("item_id").alias("doc_id"), F.lit(1).alias("m")), "doc_id", "left")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count("m").alias("members"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("characters"))


@query("""SELECT doc_id AS item_id, CASE WHEN doc_id % 11 = 0 THEN 'item_missing' WHEN doc_id % 7 = 0 THEN 'other_build' WHEN doc_id % 3 = 0 THEN 'scope_frozen' ELSE 'attached' END AS outcome FROM documents""")
def t02_late_members(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    items = docs.filter("doc_id % 11 <> 0").selectExpr("doc_id AS item_id", "CASE WHEN doc_id % 7 = 0 THEN 'a' ELSE 'b' END AS build")
    fine, refused = scope.admitted(docs.selectExpr("doc_id AS item_id", "'fetched' AS status"), items, docs.filter("doc_id % 3 <> 0").selectExpr("doc_id AS item_id"), "b")
    return fine.select("item_id", F.lit("attached").alias("outcome")).unionByName(refused.withColumnRenamed("reason", "outcome"))


@query("""SELECT e.event_id AS item_id, CASE WHEN event_type = 'error' THEN 'not_succeeded' WHEN e.event_id % 5 = 0 OR d.doc_id IS NULL THEN 'out_of_scope' WHEN e.event_id % 4 = 1 THEN 'stale' ELSE 'current' END AS outcome FROM events e LEFT JOIN documents d ON d.doc_id = e.event_id""")
def j10_current_results(spark, d):
    items = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.sha2(F.concat("lang", F.col("doc_id").cast("string")), 256).alias("fingerprint"))
    results = table(spark, d, "events").selectExpr("event_id AS item_id", "CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS status").join(items, "item_id", "left")
    asked = F.when(F.col("item_id") % 4 == 1, "old").when(F.col("item_id") % 4 == 2, None).otherwise(F.col("fingerprint"))
    fine, out = scope.current(results.select("item_id", "status", asked.alias("input_fingerprint")), items.filter("item_id % 5 <> 0"), items)
    return fine.select("item_id", F.lit("current").alias("outcome")).unionByName(out.withColumnRenamed("reason", "outcome"))


@query("""WITH s AS (SELECT doc_id AS subject, CASE WHEN doc_id % 4 <> 0 THEN lang END AS input, 'c' || (doc_id % 2) AS config FROM documents), r AS (SELECT event_id AS subject, CASE WHEN event_id % 3 = 0 THEN 'en' ELSE 'de' END AS input, 'c' || (event_id % 6 // 3) AS config FROM events WHERE event_type <> 'error')
  SELECT subject FROM s WHERE subject % 13 = 0 OR NOT EXISTS (SELECT 1 FROM r WHERE r.subject = s.subject AND (s.input IS NULL OR s.input = r.input) AND s.config = r.config)""")
def t04_to_run(spark, d):
    subjects = table(spark, d, "documents").selectExpr("doc_id AS subject", "CASE WHEN doc_id % 4 <> 0 THEN lang END AS input", "concat('c', doc_id % 2) AS config")
    results = table(spark, d, "events").selectExpr("event_id AS subject", "CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS status", "CASE WHEN event_id % 3 = 0 THEN 'en' ELSE 'de' END AS input", "concat('c', CAST(floor(event_id % 6 / 3) AS INT)) AS config")
    return scope.to_run(subjects, results, subjects.filter("subject % 13 = 0")).select("subject")


# ---- dates ---------------------------------------------------------------------------------------

_AS = [("EEE, dd MMM yyyy HH:mm:ss 'GMT'", "second"), ("MMMM dd, yyyy 'at' hh:mm a", "minute"), ("dd-MMM-yy HH:mm", "minute"), ("yyyyMMdd'T'HHmmss", "second"), ("MM/dd/yyyy", "day"), ("EEE MMM dd HH:mm:ss 'UTC' yyyy", "second"), ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:00'", "microseconds"), ("'no date'", None)]


@query(f"SELECT event_id, CASE event_id % 8 {' '.join(f'''WHEN {i} THEN epoch_us({f'date_trunc({unit!r}, ts)' if unit else 'NULL::TIMESTAMP'}){' - 7200000000' if i == 6 else ''}''' for i, (_, unit) in enumerate(_AS))} END AS at FROM events")
def f50_freeform(spark, d):
    """Times written in eight ways, read back to what each of them says."""
    ts, form = F.col("ts").cast("timestamp"), F.lit(None).cast("string")
    for i, (pattern, _) in enumerate(_AS):
        form = F.when(F.col("event_id") % 8 == i, F.date_format(ts, pattern)).otherwise(form)
    return table(spark, d, "events").select("event_id", F.unix_micros(freeform.parsed(form, F.lit("2024-05-31").cast("timestamp"))).alias("at"))


# ---- addresses -----------------------------------------------------------------------------------

_QUAD = "CAST(l_orderkey * 37 % 256 AS STRING) || '.' || CAST(l_partkey % 256 AS STRING) || '.' || CAST(l_suppkey % 256 AS STRING) || '.' || CAST(l_linenumber AS STRING)"
_HOSTS = f"""CASE l_orderkey % 5 WHEN 0 THEN {_QUAD} WHEN 1 THEN '[::ffff:' || {_QUAD} || ']:80' WHEN 2 THEN '[2001:db8::' || CAST(l_linenumber AS STRING) || ']' WHEN 3 THEN '[2606:4700:' || CAST(l_partkey % 1000 AS STRING) || '::]' ELSE 'h' || CAST(l_suppkey AS STRING) || '.org' END"""
_FOUR = " OR ".join(f"(n BETWEEN {int(n[0])} AND {int(n[-1])})" for n in map(addresses.ipaddress.ip_network, addresses.CLOSED4))


@query(f"""WITH h AS (SELECT l_orderkey, l_linenumber, {_HOSTS} AS host, l_orderkey % 5 AS k, (l_orderkey * 37 % 256) * 16777216 + (l_partkey % 256) * 65536 + (l_suppkey % 256) * 256 + l_linenumber AS n FROM lineitem)
  SELECT l_orderkey, l_linenumber, CASE WHEN k = 0 AND ({_FOUR}) AND n NOT IN (3221225481, 3221225482) OR k IN (1, 2) THEN NULL ELSE 'http://' || host || '/' END AS url FROM h""")
def p23_public_urls(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{_HOSTS} AS host")
    return rows.select("l_orderkey", "l_linenumber", addresses.public_url(F.concat(F.lit("HTTP://"), "host", F.lit("#x"))).alias("url"))


# ---- bundles and look-ups ------------------------------------------------------------------------

@query("SELECT lang, count(*) AS n_lines, sum(strlen('{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\"}') + 1)::BIGINT AS bytes FROM documents GROUP BY 1")
def k05_bundle(spark, d):
    """A bundle of a table for each language, as its manifest has it, with the lines that are in its files."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    langs = [r.lang for r in docs.select("lang").distinct().collect()]
    root = f"{shared_folder(spark)}/bundles-{uuid.uuid4().hex}"
    bundle.write(spark, root, {"about.md": "documents by language\n"}, {lang: docs.filter(F.col("lang") == lang) for lang in langs})
    made = bundle.current(spark, root)
    told = spark.createDataFrame([(n, f["bytes"]) for n, f in made.files.items() if "parts" in f], "lang string, bytes long")
    lines = spark.read.schema("doc_id long, lang string").json([f"{made.path}/{lang}" for lang in langs])
    return lines.groupBy("lang").agg(F.count("doc_id").alias("n_lines")).join(told, "lang")


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents WHERE source IN (SELECT source FROM documents WHERE doc_id IN (3, 11, 42))")
def r18_children(spark, d):
    """Of the sources of three documents, looked up by id, the documents in order, looked up by source."""
    root = f"{shared_folder(spark)}/keyed-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").select("doc_id", "source")
    keyed.write(docs, f"{root}/by_id", "doc_id", buckets=8)
    keyed.write(docs, f"{root}/by_source", "source", order=["doc_id"], buckets=8)
    sources = sorted({r.source for r in keyed.look_up(spark, f"{root}/by_id", "doc_id", [3, 11, 42], buckets=8).collect()})
    return ranking.ranked(keyed.look_up(spark, f"{root}/by_source", "source", sources, buckets=8), [F.col("doc_id")], "place", ["source"])


# ---- entries, requests, failures, rows by key ----------------------------------------------------

@query("""WITH x AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position FROM documents)
  SELECT x.source AS source_id, x.position::INTEGER AS position, 'id' || x.doc_id AS external_id, CASE WHEN x.doc_id % 7 = 0 THEN '(untitled)' ELSE 'T & ' || x.doc_id END AS title, 'https://e.org/' || x.doc_id AS link, CASE x.doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B C' END AS author,
    CASE WHEN x.doc_id % 5 <> 0 THEN epoch_us(TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * x.doc_id::INT) END AS at, CASE WHEN x.doc_id % 2 = 0 THEN 'full' ELSE 'summary' END AS content_depth, json_extract_string('{"lang": "' || d.lang || '"}', '$.lang') AS payload_lang,
    sha256(lower(CASE WHEN x.doc_id % 7 = 0 THEN '(untitled)' ELSE 'T & ' || x.doc_id END) || chr(10) || 'https://e.org/' || x.doc_id || chr(10) || 's' || x.doc_id || chr(10) || CASE WHEN x.doc_id % 2 = 0 THEN '<p>c</p>' ELSE '' END) AS content_hash FROM x JOIN documents d USING (doc_id) WHERE position <= 40""")
def s03_feed_entries(spark, d):
    """Documents written as the entries of a feed a source, read again: the first forty of each."""
    i = F.col("doc_id")
    n = i.cast("string")
    tag = lambda name, *parts: F.concat(F.lit(f"<{name}>"), *parts, F.lit(f"</{name}>"))
    at = F.timestamp_micros(F.unix_micros(F.lit("2024-01-01").cast("timestamp")) + i * 60_000_000)
    date = F.when(i % 5 == 0, "soon").when(i % 5 == 1, F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise(F.date_format(at, "MMMM d, yyyy h:mm a"))
    who = F.when(i % 3 == 0, "<author><name>A</name><email>a@b.c</email></author>").when(i % 3 == 1, "<author>B C</author>").otherwise("")
    body = F.when(i % 2 == 0, '<c:encoded xmlns:c="c">&lt;p&gt;c&lt;/p&gt;</c:encoded>').otherwise("")
    title = F.when(i % 7 == 0, "<title> </title>").otherwise(tag("title", F.lit("T &amp; "), n))
    entry = tag("item", tag("guid", F.lit("id"), n), title, tag("link", F.lit("https://e.org/"), n), who, tag("description", F.lit("s"), n), body, tag("pubDate", date), tag("lang", F.col("lang")))
    docs = table(spark, d, "documents").select("doc_id", "lang", F.col("source").alias("source_id"), entry.alias("entry"))
    feeds = docs.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "entry"))), lambda x: x["entry"]).alias("entries"))
    landed = feeds.select("source_id", F.concat(F.lit("<rss><channel>"), F.array_join("entries", ""), F.lit("</channel></rss>")).alias("body"), F.lit(40).alias("item_limit"))
    out = entries.parsed(landed, F.lit("2024-05-31").cast("timestamp"))
    return out.select("source_id", "position", "external_id", "title", "link", "author", F.unix_micros("published_at").alias("at"), "content_depth", F.get_json_object("raw_payload", "$.lang").alias("payload_lang"), "content_hash")


@query("""WITH e AS (SELECT doc_id // 20 AS run_id, doc_id, '{"event_id":' || doc_id || ',"title":"' || lang || '"' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ',"topic":"' || source || '"' END || '}' AS j FROM documents),
  b AS (SELECT run_id, count(*) AS n_events, '{"max_selected":15,"candidate_events":[' || string_agg(j, ',' ORDER BY doc_id DESC) || ']}' AS body FROM e GROUP BY 1) SELECT run_id, n_events, sha256(body) AS body_sha256, strlen(body)::BIGINT AS body_bytes FROM b""")
def u11_requests(spark, d):
    rows = table(spark, d, "documents").selectExpr("CAST(floor(doc_id / 20) AS BIGINT) AS run_id", "-doc_id AS display_order", "doc_id AS event_id", "lang AS title", "CASE WHEN doc_id % 3 <> 0 THEN source END AS topic")
    return requests.selection_requests(rows, ["event_id", "title", "topic"]).drop("body")


_FAILED = {
    "status": "CASE event_id % 9 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 401 WHEN 3 THEN 422 WHEN 4 THEN 404 END", "code": "CASE event_id % 7 WHEN 0 THEN 'rate limit' WHEN 1 THEN 'E' || CAST(event_id % 3 AS STRING) WHEN 2 THEN 'Bad Gateway' END",
    "message": "CASE event_id % 5 WHEN 0 THEN 'Request TIMED OUT' WHEN 1 THEN 'invalid JSON here' WHEN 2 THEN 'no auth' WHEN 3 THEN 'odd' END", "kind": "CASE event_id % 11 WHEN 0 THEN 'TimeoutError' WHEN 1 THEN 'ValueError' WHEN 2 THEN 'ProviderRetryExhausted' END",
}


@query(f"""WITH e AS (SELECT event_id, {', '.join(f'{v} AS {k}' for k, v in _FAILED.items())} FROM events), s AS (SELECT *, lower(coalesce(code, '') || ' ' || coalesce(message, '')) AS said FROM e),
  f AS (SELECT *, coalesce(kind = 'ProviderRetryExhausted', false) AS gone, coalesce(status = 429 OR status >= 500, false) OR said LIKE '%rate limit%' OR said LIKE '%bad gateway%' AS again, coalesce(kind = 'TimeoutError', false) OR said LIKE '%timed out%' AS slow, coalesce(status BETWEEN 400 AND 499, false) AS refused, said LIKE '%invalid json%' AS schema FROM s)
  SELECT event_id, NOT gone AND (again OR slow) AS retryable, CASE WHEN gone THEN 'provider_retry_exhausted' WHEN again OR slow THEN 'provider_retryable' WHEN refused AND schema THEN 'schema' WHEN refused AND (status = 401 OR said LIKE '%auth%') THEN 'provider_auth' WHEN refused THEN 'provider_blocked' WHEN coalesce(kind = 'ValueError', false) OR schema THEN 'schema' ELSE 'provider_blocked' END AS category,
    CASE WHEN gone THEN coalesce(code, 'retry_exhausted') WHEN again THEN coalesce(status::VARCHAR, code, 'provider_retryable') WHEN slow THEN coalesce(code, status::VARCHAR, 'timeout') WHEN refused THEN status::VARCHAR WHEN coalesce(kind = 'ValueError', false) OR schema THEN coalesce(code, kind, 'schema_error') ELSE coalesce(code, kind, 'provider_error') END AS code FROM f""")
def p30_failure_class(spark, d):
    rows = table(spark, d, "events").selectExpr("event_id", *(f"{v} AS {k}" for k, v in _FAILED.items()))
    again, category, code = policy.failure_class(F.col("status"), F.col("code"), F.col("message"), F.col("kind"), F.lit(False))
    return rows.select("event_id", again.alias("retryable"), category.alias("category"), code.alias("code"))


@query("""WITH n AS (SELECT user_id AS item_id, arg_max(event_type, (value, event_id)) AS status FROM events WHERE event_type <> 'view' GROUP BY 1), o AS (SELECT DISTINCT user_id AS item_id FROM events UNION SELECT -1)
  SELECT o.item_id, coalesce(n.status, 'old') AS status FROM o LEFT JOIN n USING (item_id)""")
def m07_status_updates(spark, d):
    """Of a key's several changes the last by value counts."""
    e = table(spark, d, "events").select(F.col("user_id").alias("item_id"), F.col("event_type").alias("status"), "value", "event_id")
    rows = e.select("item_id").distinct().unionByName(spark.range(1).select((F.col("id") - 1).alias("item_id"))).withColumn("status", F.lit("old"))
    return state.with_status(rows, e.filter("status <> 'view'"), "item_id", ["value", "event_id"])


@query("""WITH o AS (SELECT doc_id AS item_id, 'old' AS decision FROM documents), n AS (SELECT event_id % 700 AS item_id, arg_max(event_type, event_id) AS decision FROM events GROUP BY 1) SELECT coalesce(o.item_id, n.item_id) AS item_id, coalesce(n.decision, o.decision) AS decision FROM o FULL JOIN n USING (item_id)""")
def m03_screen_rows(spark, d):
    old = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.lit("old").alias("decision"), F.lit(-1).cast("long").alias("at"))
    new = table(spark, d, "events").select((F.col("event_id") % 700).alias("item_id"), F.col("event_type").alias("decision"), F.col("event_id").alias("at"))
    return state.last_rows(old, new, ["item_id"], ["at"]).select("item_id", "decision")


@query("""WITH a AS (SELECT user_id AS source_id, event_id, event_id * 1000000::BIGINT AS t, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped' WHEN 'click' THEN 'degraded' ELSE 'success' END AS status FROM events WHERE event_id % 4 <> 0), k AS (SELECT *, sum(CASE WHEN status = 'failed' THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY t, event_id) AS run FROM a WHERE status <> 'skipped'),
  l AS (SELECT source_id, arg_max(status, event_id) AS status, arg_max(run, event_id) AS run FROM k GROUP BY 1)
  SELECT s.user_id AS id, CASE l.status WHEN 'failed' THEN 'failed' WHEN 'degraded' THEN 'degraded' WHEN 'success' THEN 'healthy' ELSE 'unknown' END AS health_status, coalesce((SELECT count(*) FROM k WHERE k.source_id = l.source_id AND k.run = l.run AND k.status = 'failed'), 0) AS consecutive_failures FROM (SELECT DISTINCT user_id FROM events) s LEFT JOIN l ON l.source_id = s.user_id""")
def t19_finished_fetches(spark, d):
    """Attempts with results for all but each fourth, which are still going."""
    e = table(spark, d, "events")
    open_ = {"items_fetched": "0L", "http_status": "CAST(NULL AS INT)", "error_code": "CAST(NULL AS STRING)", "error_message": "CAST(NULL AS STRING)", "finished_at": "CAST(NULL AS TIMESTAMP)"}
    rows = e.selectExpr("user_id AS source_id", "event_id AS attempt_id", "'running' AS status", *(f"{v} AS {k}" for k, v in open_.items()))
    done = e.filter("event_id % 4 <> 0").selectExpr("event_id AS attempt_id", "CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped' WHEN 'click' THEN 'degraded' ELSE 'success' END AS status", "1L AS items_fetched", "200 AS http_status", "CASE WHEN event_type = 'error' THEN 'e: x' END AS error")
    sources = e.select(F.col("user_id").alias("id")).distinct()
    _, out = state.finished_fetches(sources, rows, done, F.timestamp_micros(F.col("attempt_id") * 1_000_000))
    return out.select("id", "health_status", "consecutive_failures")
