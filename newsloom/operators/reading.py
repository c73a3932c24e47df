"""The read side: published editions and their report entries, filtered, paged, flattened.

Tables: editions (edition_id, edition_date, status, published_at, candidate_count, updated_at); entries (entry_id,
edition_id, event_key, display_order, title, original_title, summary, url, display_score, topic, content_class,
source_group, source_ids array, risk_flags array, keywords array, published_at, reason, refs array of structs: item_id,
source_id, source_name, source_group, source_url, title, is_primary, match_type, ai_summary, source_summary,
content_text, content_depth); sources (id, name, transport, source_group, content_class, url, account_url, priority,
health_status, consecutive_failures).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls
from . import views
from .ranking import top

# Classes and topics that filters offer.
CONTENT_CLASSES = ("official_model_company", "news_media", "project_tool", "community_social")
NO_TOPIC, NO_GROUP = "未分类", "general"
FLAG_JOIN = "；"


def published(editions: DataFrame) -> DataFrame:
    """Editions whose report is out: status and time both say so."""
    return editions.filter((F.col("status") == "published") & F.col("published_at").isNotNull())


def edition_rows(editions: DataFrame, entries: DataFrame) -> DataFrame:
    """(edition_id, edition_date, selected_items, candidate_items, published_at), newest first: editions with a time, each
    with its number of entries. Entries are counted before the join."""
    counts = entries.groupBy("edition_id").agg(F.count(F.lit(1)).alias("selected_items"))
    rows = editions.filter("published_at is not null").join(counts, "edition_id", "left")
    rows = rows.select("edition_id", "edition_date", F.coalesce("selected_items", F.lit(0)).alias("selected_items"), F.coalesce("candidate_count", F.lit(0)).alias("candidate_items"), "published_at")
    return rows.orderBy(F.desc("edition_date"), F.desc("published_at"))


def resolved(editions: DataFrame, date: str | None = None) -> DataFrame:
    """The edition of an ISO date, or without one the newest; one row, or none (also where the text is no date)."""
    rows = editions.filter("published_at is not null")
    if date is not None:
        rows = rows.filter(F.col("edition_date") == F.trim(F.lit(date)).try_cast("date"))
    return rows.orderBy(F.desc("edition_date"), F.desc("published_at")).limit(1)


def summary(editions: DataFrame, entries: DataFrame) -> DataFrame:
    """An edition's funnel as the public sees it."""
    return edition_rows(editions, entries).select("edition_date", F.col("candidate_items").alias("candidate"), F.col("selected_items").alias("published"), F.col("selected_items").alias("selected"), F.lit("published").alias("status"))


def selected(entries: DataFrame, edition: DataFrame, *, topic: str | None = None, category: str | None = None, source_group: str | None = None, content_class: str | None = None, query: str | None = None) -> DataFrame:
    """Entries of a (published) edition that pass the filters given; edition: one row. A category is a topic or a class."""
    rows = entries.join(F.broadcast(published(edition).select("edition_id").limit(1)), "edition_id", "left_semi")
    known = lambda t: t.strip().casefold()  # noqa: E731  topics are stored lower-cased
    if topic:
        rows = rows.filter(F.col("topic").isin(topic, known(topic)))
    if category:
        rows = rows.filter(F.col("topic").isin(category, known(category)) | (F.col("content_class") == category))
    if source_group:
        rows = rows.filter(F.col("source_group") == source_group)
    if content_class:
        rows = rows.filter(F.col("content_class") == content_class)
    if query and query.strip():
        rows = views.search(rows, query.strip(), ["title", "original_title", "summary", "url"])
    return rows


def paged(rows: DataFrame, limit: int = 30, offset: int = 0) -> DataFrame:
    """Entries by display order, 1 to 1000 of them."""
    return top(rows, [F.asc("display_order"), F.asc("entry_id")], limit, offset)


def primary_ref(refs: Column) -> Column:
    """The first reference flagged, else the first."""
    return F.coalesce(F.get(F.filter(refs, lambda r: F.coalesce(r["is_primary"], F.lit(False))), F.lit(0)), F.get(refs, F.lit(0)))


def public_refs(refs: Column) -> Column:
    """References whose source url is null unless it is a public one."""
    return F.transform(refs, lambda r: r.withField("source_url", urls.public_or_null(text.trimmed_or_null(r["source_url"]))))


def event_view(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Entries as events: name and group of the primary reference, its source, or the first source id stand for the source."""
    known = sources.select(F.col("id").alias("_sid"), F.col("name").alias("_name"), "transport", F.col("url").alias("_url"), "account_url")
    rows = rows.withColumn("refs", public_refs(F.col("refs"))).withColumn("_p", primary_ref(F.col("refs")))
    rows = rows.join(known, F.col("_p.source_id") == F.col("_sid"), "left")
    t = text.trimmed_or_null
    return rows.select(
        F.col("entry_id").alias("event_id"), "display_order", "title", F.coalesce(F.when(F.col("original_title") != "", F.col("original_title")), F.col("title")).alias("original_title"), "summary", urls.public_or_null(F.col("url")).alias("url"),
        F.coalesce("display_score", F.lit(0.0)).alias("display_score"), "topic", "content_class", F.coalesce(t(F.col("_p.source_name")), F.col("_name"), F.get("source_ids", F.lit(0))).alias("source_name"),
        F.coalesce(t(F.col("_p.source_group")), F.col("source_group")).alias("source_group"), "source_ids", "risk_flags", "published_at", "keywords", "reason", "refs",
        F.coalesce(t(F.col("_p.source_id")), F.when(F.col("_p").isNull(), F.get("source_ids", F.lit(0)))).alias("source_id"), F.col("transport").alias("source_transport"),
        F.coalesce(F.col("_p.source_url"), urls.public_or_null(F.col("_url"))).alias("source_url"), urls.public_or_null(F.col("account_url")).alias("account_url"),
    )


def cards(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Entries as cards: the score rounded half to even, flags as one note."""
    note = F.when(F.size("risk_flags") > 0, F.array_join("risk_flags", FLAG_JOIN))
    kept = ("title", "summary", "reason", "url", "content_class", "source_name", "source_group", "topic", "published_at", "source_id", "source_transport", "source_url", "account_url")
    return event_view(rows, sources).select(F.col("event_id").alias("id"), "display_order", F.bround("display_score", 0).cast("int").alias("display_score"), note.alias("risk_note"), F.lit("selected").alias("status"), *kept)


def members(rows: DataFrame) -> DataFrame:
    """Every reference of the entries: one without an item id gets a negative one of its entry and place."""
    each = rows.select("*", F.posexplode("refs").alias("_pos", "r"))
    t = text.trimmed_or_null
    item = F.coalesce(F.col("r.item_id").cast("long"), -(F.col("entry_id") * 1000 + F.col("_pos") + 1))
    url = urls.public_or_null(t(F.col("r.source_url")))
    return each.select(
        "entry_id", "display_order", F.col("_pos").alias("position"), item.alias("item_id"), F.coalesce(t(F.col("r.title")), F.when(F.col("original_title") != "", F.col("original_title")), F.col("title")).alias("title"),
        F.when(t(F.col("r.ai_summary")).isNotNull(), text.plain(F.col("r.ai_summary"))).alias("summary"), F.coalesce(url, urls.public_or_null(F.col("url"))).alias("url"), "published_at", t(F.col("r.source_id")).alias("source_id"), t(F.col("r.source_name")).alias("source_name"),
        F.coalesce(t(F.col("r.source_group")), F.col("source_group")).alias("source_group"), url.alias("source_url"), F.coalesce(F.col("r.is_primary"), F.lit(False)).alias("is_primary"), t(F.col("r.match_type")).alias("match_type"), F.col("topic").alias("review_topic"),
        F.when(t(F.col("r.content_text")).isNotNull(), text.plain(F.col("r.content_text"))).alias("content_text"), t(F.col("r.content_depth")).alias("content_depth"),
    )


def in_entry_order(rows: DataFrame) -> list[Column]:
    """The order of members within an entry: the primary first, then by item."""
    return [F.asc("display_order"), F.asc("entry_id"), (~F.col("is_primary")).cast("int").asc(), F.asc("item_id")]


def all_dynamics(rows: DataFrame, limit: int = 30, offset: int = 0) -> DataFrame:
    """The members of all entries, each item once (as its first entry has it), by item, with the total; one page."""
    flat = members(rows)
    cols = F.struct(*flat.columns)
    key = F.struct("display_order", "entry_id", (~F.col("is_primary")).cast("int"), "position")
    once = flat.groupBy(F.col("item_id").alias("_item")).agg(F.min_by(cols, key).alias("r")).select("r.*")
    total = once.agg(F.count(F.lit(1)).alias("total"))
    return top(once, [F.asc("item_id")], limit, offset).crossJoin(F.broadcast(total))


def detail(rows: DataFrame, sources: DataFrame, event_id: int) -> tuple[DataFrame, DataFrame]:
    """(the event, its members in order) of one entry."""
    one = rows.filter(F.col("entry_id") == event_id)
    flat = members(one)
    return event_view(one, sources), flat.orderBy(*in_entry_order(flat))


def search(rows: DataFrame, sources: DataFrame, limit: int = 8) -> DataFrame:
    """Cards of found entries as results, 1 to 20 of them; `rows` are selected by the query."""
    found = cards(paged(rows, min(max(limit, 1), 20)), sources)
    badges = F.array_compact(F.array(F.lit("selected"), F.when(F.col("content_class") != "", F.col("content_class")), F.when(F.col("source_group") != "", F.col("source_group"))))
    return found.select(F.lit("event").alias("result_type"), "id", "title", "summary", "url", "source_name", F.col("display_score").alias("score"), badges.alias("badges"), "published_at", "topic", "display_order")


def dashboard(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts by topic, else class; counts by group) of an edition's entries (the first 1000)."""
    shown = paged(rows, 1000)
    filled = lambda *c: F.coalesce(*(F.when(F.col(x) != "", F.col(x)) for x in c[:-1]), F.lit(c[-1]))
    return views.facets(shown, filled("topic", "content_class", NO_TOPIC)), views.facets(shown, filled("source_group", NO_GROUP))


def filter_options(entries: DataFrame, editions: DataFrame) -> DataFrame:
    """(kind, value): groups and classes that published entries have, and the fixed classes; distinct, in order."""
    out = entries.join(published(editions).select("edition_id"), "edition_id", "left_semi")
    pairs = out.select(F.explode(F.array(F.struct(F.lit("source_group").alias("kind"), F.col("source_group").alias("value")), F.struct(F.lit("content_class").alias("kind"), F.col("content_class").alias("value")))).alias("p")).select("p.*")
    fixed = entries.sparkSession.createDataFrame([("content_class", c) for c in CONTENT_CLASSES], "kind string, value string")
    return pairs.filter("value <> ''").unionByName(fixed).distinct().orderBy("kind", "value")


def source_rows(sources: DataFrame, entries: DataFrame, editions: DataFrame) -> DataFrame:
    """Sources by priority and name, each with the number of published entries that cite it (once an entry)."""
    out = entries.join(published(editions).select("edition_id"), "edition_id", "left_semi")
    counts = out.select(F.explode(F.array_distinct("source_ids")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("item_count"))
    rows = sources.join(counts, "id", "left")
    kept = [urls.public_or_null(F.col(c)).alias(c) if c.endswith("url") else F.coalesce("consecutive_failures", F.lit(0)).cast("int").alias(c) if c == "consecutive_failures" else F.col(c) for c in ("id", "name", "transport", "source_group", "content_class", "url", "account_url", "health_status", "consecutive_failures", "priority")]
    return rows.select(*kept, F.coalesce("item_count", F.lit(0)).alias("item_count")).orderBy("priority", "name")


def source_health(sources: DataFrame, source_id: str | None = None) -> DataFrame:
    rows = sources if source_id is None else sources.filter(F.col("id") == source_id)
    return rows.orderBy("priority", "id")


def by_label(rows: DataFrame, label: Column) -> DataFrame:
    """(label, first, n, ids): groups in the order in which their first row is shown."""
    groups = rows.groupBy(label.alias("label")).agg(F.min("display_order").alias("first"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("display_order", "entry_id"))).alias("ids"))
    return groups.withColumn("ids", F.transform("ids", lambda x: x["entry_id"])).orderBy("first", "label")


def edition_status(editions: DataFrame, drafts: DataFrame, audits: DataFrame, dates: DataFrame) -> DataFrame:
    """(edition_date, public, draft, audit): whether each date has a published edition, a draft run, an audited run (the latest)."""
    has = lambda rows, name: rows.groupBy("edition_date").agg(F.max("run_id").alias(name))
    out = dates.select("edition_date").distinct().join(published(editions).select("edition_date", F.lit(True).alias("public")).distinct(), "edition_date", "left")
    out = out.join(has(drafts, "draft_run"), "edition_date", "left").join(has(audits, "audit_run"), "edition_date", "left")
    return out.withColumn("public", F.coalesce("public", F.lit(False)))
