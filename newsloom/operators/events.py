"""Events out of drafts: keys, merges, assignments, materialisation, evidence.

Tables: items (item_id, external_id, canonical_url, source_url, title, published_at, captured_at, content_class,
source_id, source_group, b1_priority); drafts (draft_id, draft_key, title, publishability, ...); draft members
(draft_key, item_id). Identities are exploded once and joined by equality; nothing compares every pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls
from ..functions.freeform import let
from ..tables import settle
from . import ranking
from .entities import components, identity_keys

# Which of two merged events survives.
PUBLISHABILITY_RANK = {"candidate": 0, "needs_review": 1, "rejected": 2}


def url_of(item_url: Column, source_url: Column) -> Column:
    return F.coalesce(F.when(item_url != "", item_url), F.when(source_url != "", source_url))


def related_hints(external: Column, url: Column) -> Column:
    """Hints of relatedness that never merge: a repository's page, and a release's url."""

    def hints(x: Column) -> Column:
        root = x["link"].rlike(r"^(?i)https?://(www\.)?github\.com/[^/]+/[^/]+/?$")
        return F.array_distinct(F.array_compact(F.array(F.when(root, F.concat(F.lit("github_repo_root:"), F.lower(F.regexp_replace(x["link"], "/+$", "")))), F.when(x["ext"].startswith("github_release:") & x["link"].isNotNull(), F.concat(F.lit("url:"), x["link"])))))

    return let(F.struct(text.external_id(external).alias("ext"), urls.event_url(url).alias("link")), hints)


def event_key(external: Column, url: Column, item_id: Column, title: Column) -> Column:
    """The first identity, else the item, else the title, else unknown."""
    return first_key(identity_keys(external, url), item_id, title)


def first_key(keys: Column, item_id: Column, title: Column) -> Column:
    """The same of identities that are known."""
    named = text.event_title(title)
    return F.coalesce(F.get(keys, F.lit(0)), F.when(item_id > 0, F.concat(F.lit("item:"), item_id.cast("string"))), F.when(named != "", F.concat(F.lit("title:"), named)), F.lit("item:unknown"))


def identities(items: DataFrame) -> DataFrame:
    """(item_id, identity), one row an identity."""
    return items.select("item_id", F.explode(identity_keys(F.col("external_id"), url_of(F.col("canonical_url"), F.col("source_url")))).alias("identity"))


def merged_drafts(drafts: DataFrame, members: DataFrame, items: DataFrame) -> DataFrame:
    """(draft_key, into): publishable drafts that share an identity, directly or through others, go into one: the most
    publishable, then the largest, then the smallest key. Rejected drafts stay by themselves.

    Connected components over identities (which combine before they shuffle) instead of pairwise merging.
    """
    open_ = drafts.filter(F.lower("publishability") != "rejected").select("draft_key")
    edges = members.join(open_, "draft_key").join(identities(items), "item_id").select("draft_key", "identity").distinct()
    comp = components(edges, "draft_key", "identity")
    sizes = members.groupBy("draft_key").agg(F.count_distinct("item_id").alias("n"))
    rank = F.lit(9)
    for k, v in PUBLISHABILITY_RANK.items():
        rank = F.when(F.lower("publishability") == k, v).otherwise(rank)
    rows = drafts.join(comp, "draft_key", "left").join(sizes, "draft_key", "left").select("draft_key", F.coalesce("component", "draft_key").alias("c"), F.struct(rank.alias("r"), (-F.coalesce("n", F.lit(0))).alias("n"), "draft_key").alias("k"))
    best = rows.groupBy("c").agg(F.min("k").alias("k")).select("c", F.col("k.draft_key").alias("into"))
    return rows.join(best, "c").select("draft_key", "into")


def first_claims(assignments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) of (position, event_key, item_id): an item belongs to the first event that names it; the others lose
    it, and so does an event that loses all its items."""
    owner = assignments.groupBy("item_id").agg(F.min(F.struct("position", "event_key")).alias("o"))
    rows = assignments.join(owner, "item_id").select("position", "event_key", "item_id", F.col("o.event_key").alias("owner"), (F.col("o.position") == F.col("position")).alias("own"))
    return rows.filter("own").select("position", "event_key", "item_id").distinct(), rows.filter("not own").select("event_key", "item_id", "owner")


def with_reserves(members: DataFrame, items: DataFrame, reserves: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(draft_id, item_id, reserve): members (draft_id, item_id), and reserve items in no draft that share an identity with
    one, each in the first draft by id. keys: the items' identities, where they are known."""
    free = reserves.select("item_id").join(members.select("item_id"), "item_id", "left_anti")
    own = members.select("draft_id", "item_id")
    keys = identities(items) if keys is None else keys
    # the first draft of an identity is found before reserves join it: one row an identity
    first = own.join(keys, "item_id").groupBy("identity").agg(F.min("draft_id").alias("draft_id"))
    added = free.join(keys, "item_id").join(first, "identity").groupBy("item_id").agg(F.min("draft_id").alias("draft_id"))
    return own.withColumn("reserve", F.lit(False)).unionByName(added.select("draft_id", "item_id", F.lit(True).alias("reserve")))


_UNITED = ("source_ids", "source_groups", "identity_keys", "keywords", "entities")


def materialised(drafts: DataFrame, members: DataFrame, items: DataFrame, reserves: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """One event a draft: key (a repeated one becomes agent:draft), primary item, members, highest score, earliest and latest
    time; and united in member order, first seen first: sources, groups, identities, keywords, entities.
    drafts: (draft_id, draft_key, title); members: (draft_id, item_id); reviews: (item_id, keywords: array<string>, entities:
    array<struct<name, type>>), an item at most once.

    Identities are worked out once. Each united value keeps its least place by a grouping that combines before it shuffles; only
    distinct values are gathered in arrays. Of members themselves an event gathers the ids.
    """
    located = url_of(F.col("canonical_url"), F.col("source_url"))
    keyed = settle(items.select("item_id", identity_keys(F.col("external_id"), located).alias("keys")))
    who = with_reserves(members, items, reserves, keyed.select("item_id", F.explode("keys").alias("identity")))
    none = F.array().cast("array<string>")
    rows = who.join(items, "item_id").join(keyed, "item_id")
    if reviews is not None:
        words = reviews.select("item_id", F.coalesce("keywords", none).alias("_words"), F.transform(F.coalesce("entities", F.array().cast("array<struct<name:string,type:string>>")), lambda e: F.to_json(e)).alias("_names"))
        rows = rows.join(words, "item_id", "left")
    else:
        rows = rows.withColumns({"_words": none, "_names": none})
    rows = settle(rows)
    at = F.coalesce("published_at", "captured_at")
    lead = ranking.primary_key(F.col("source_group"), F.col("content_class"), F.col("b1_priority"), F.col("published_at"), F.col("captured_at"), F.col("item_id"))
    main = F.struct("item_id", "content_class", "source_group", "keys", "title")
    order = F.struct("reserve", "item_id")
    found = rows.groupBy("draft_id").agg(F.min_by(main, lead).alias("p"), F.transform(F.array_sort(F.collect_list(order)), lambda x: x["item_id"]).alias("item_ids"), F.max(F.coalesce("b1_priority", F.lit(0))).alias("display_score"), F.min(at).alias("first_seen_at"), F.max(at).alias("last_seen_at"))
    lists = {"source_ids": F.array("source_id"), "source_groups": F.array("source_group"), "identity_keys": F.col("keys"), "keywords": F.coalesce("_words", none), "entities": F.coalesce("_names", none)}
    marked = lambda kind, v: F.transform(v, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x.alias("v")))
    values = F.concat(*(marked(k, v) for k, v in lists.items()))
    each = rows.select("draft_id", order.alias("o"), F.explode(values).alias("x")).filter("x.v is not null and trim(x.v) <> ''").groupBy("draft_id", F.col("x.kind").alias("kind"), F.col("x.v").alias("v")).agg(F.min(F.struct("o", "x.i")).alias("place"))
    gathered = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("place", "v")))), lambda x: x["v"]).alias(k)
    united = each.groupBy("draft_id").agg(*map(gathered, _UNITED))
    out = found.join(united, "draft_id", "left").join(drafts.select("draft_id", "draft_key", F.col("title").alias("draft_title")), "draft_id")
    named = text.event_title(F.col("p.title"))
    first = F.coalesce(text.trimmed_or_null(F.col("draft_key")), F.get("p.keys", F.lit(0)), F.when(F.col("p.item_id") > 0, F.concat(F.lit("item:"), F.col("p.item_id").cast("string"))), F.when(named != "", F.concat(F.lit("title:"), named)), F.lit("item:unknown"))
    out = settle(out.withColumn("event_key", first))
    firsts = out.groupBy("event_key").agg(F.min("draft_id").alias("_first"))
    out = out.join(firsts, "event_key").withColumn("event_key", F.when(F.col("draft_id") == F.col("_first"), F.col("event_key")).otherwise(F.concat(F.lit("agent:"), F.col("draft_id").cast("string"))))
    listed = [F.coalesce(k, none).alias(k) for k in _UNITED[:4]]
    names = F.transform(F.coalesce("entities", none), lambda e: F.from_json(e, "struct<name:string,type:string>")).alias("entities")
    return out.select("draft_id", "event_key", F.col("draft_title").alias("title"), text.event_title(F.col("draft_title")).alias("normalized_title"), F.col("p.item_id").alias("primary_item_id"), F.col("p.content_class").alias("content_class"), F.col("p.source_group").alias("source_group"), "item_ids", *listed, names, "display_score", "first_seen_at", "last_seen_at")


def relations(events: DataFrame, items: DataFrame) -> DataFrame:
    """(draft_id, item_id, relation): primary; duplicate where an identity is shared with the primary; else related."""
    keys = items.select("item_id", identity_keys(F.col("external_id"), url_of(F.col("canonical_url"), F.col("source_url"))).alias("keys"))
    each = events.select("draft_id", F.col("primary_item_id"), F.explode("item_ids").alias("item_id")).join(keys, "item_id")
    lead = keys.select(F.col("item_id").alias("primary_item_id"), F.col("keys").alias("lead"))
    relation = F.when(F.col("item_id") == F.col("primary_item_id"), "primary").when(F.arrays_overlap("keys", "lead"), "duplicate").otherwise("related")
    return each.join(lead, "primary_item_id").select("draft_id", "item_id", relation.alias("relation"))


def result_counts(events: DataFrame) -> DataFrame:
    """(merged, repeats, updated, events, candidates, unresolved) over (item_ids, novelty_status, review_state)."""
    novelty = F.coalesce("novelty_status", F.lit("uncertain"))
    return events.agg(
        F.coalesce(F.sum(F.greatest(F.size("item_ids") - 1, F.lit(0))), F.lit(0)).alias("merged"), F.count_if(novelty == "repeat").alias("repeats"), F.count_if(novelty == "updated").alias("updated"), F.count_if(~novelty.isin("repeat", "updated")).alias("events"),
        F.count_if(F.lower("review_state").isin("candidate", "needs_review")).alias("candidates"), F.count_if(F.col("review_state") == "needs_review").alias("unresolved"),
    )


def draft_errors(members: DataFrame) -> DataFrame:
    """(error, what): drafts without a key, repeated keys, drafts without items, items in several drafts.
    members: (position, draft_key, item_ids)."""
    keyless = members.filter(F.coalesce(F.trim("draft_key"), F.lit("")) == "").select(F.lit("draft_key_required").alias("error"), F.col("position").cast("string").alias("what"))
    keyed = members.filter(F.coalesce(F.trim("draft_key"), F.lit("")) != "")
    twice = keyed.groupBy("draft_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("duplicate_draft_key").alias("error"), F.col("draft_key").alias("what"))
    empty = members.filter(F.coalesce(F.size("item_ids"), F.lit(0)) <= 0).select(F.lit("draft_without_items").alias("error"), F.col("position").cast("string").alias("what"))
    shared = members.select("position", F.explode(F.array_distinct("item_ids")).alias("item_id")).groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("item_in_several_drafts").alias("error"), F.col("item_id").cast("string").alias("what"))
    return keyless.unionByName(twice).unionByName(empty).unionByName(shared)


def positive_ids(values: Column, limit: int = 40) -> Column:
    """Whole positive ids out of texts or numbers: distinct, in order, `limit` at most."""
    ids = F.transform(values, lambda x: x.try_cast("bigint"))
    return F.slice(F.array_distinct(F.filter(ids, lambda i: i > 0)), 1, limit)


def strict_ids(text_: Column) -> tuple[Column, Column]:
    """(ids, error) of a JSON list of ids: it must hold positive whole numbers only, none twice."""
    raw = F.from_json(text_, "array<string>")
    whole = F.forall(raw, lambda x: F.coalesce(x.rlike("^[1-9][0-9]*$"), F.lit(False)))
    error = F.when(raw.isNull(), "not_a_list").when(~whole, "not_a_positive_id").when(F.size(F.array_distinct(raw)) < F.size(raw), "duplicate_id")
    return F.when(error.isNull(), F.transform(raw, lambda x: x.cast("bigint"))), error


def attached_evidence(evidence: DataFrame, drafts: DataFrame) -> DataFrame:
    """Evidence without a draft whose claim begins with event_key:KEY gets that draft, and the rest of its claim.
    evidence: (evidence_id, draft_id, claim); drafts: (draft_id, draft_key)."""
    claim = F.trim(F.coalesce("claim", F.lit("")))
    key = F.when(F.col("draft_id").isNull() & claim.startswith("event_key:"), F.trim(F.substring(F.substring_index(claim, "\n", 1), 11, 1_000_000)))
    rest = F.when(F.contains(claim, F.lit("\n")), F.substring(claim, F.instr(claim, "\n") + 1, F.length(claim)))
    rows = evidence.withColumns({"_key": key, "_rest": F.when(rest != "", rest)}).join(drafts.select(F.col("draft_id").alias("_draft"), F.col("draft_key").alias("_key")), "_key", "left")
    found = F.col("_draft").isNotNull()
    return rows.select("evidence_id", F.coalesce("draft_id", "_draft").alias("draft_id"), F.when(found, F.col("_rest")).otherwise(F.col("claim")).alias("claim"))


def carried_evidence(evidence: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Evidence of drafts that are replaced goes to the new draft of the same key, else it has none."""
    keys = old.select("draft_id", "draft_key").join(new.select(F.col("draft_id").alias("_new"), "draft_key"), "draft_key").select("draft_id", "_new")
    return evidence.join(keys, "draft_id", "left").withColumn("draft_id", F.col("_new")).select(*evidence.columns)


def evidence_events(evidence: DataFrame, events: DataFrame) -> DataFrame:
    """Evidence with the event of its draft. events: (draft_id, event_id)."""
    return evidence.join(events.select("draft_id", "event_id"), "draft_id", "left")


def new_evidence(found: DataFrame, drafts: DataFrame) -> DataFrame:
    """Evidence rows from search results (draft_key, url, final_url, title, excerpt, claim, status): excerpts cut at 4000 and
    hashed, host of the final url; a key without a draft stays in the claim. Relative urls give no row."""
    given = lambda c: text.trimmed_or_null(F.col(c))
    final = F.coalesce(given("final_url"), given("url"))
    excerpt = F.when(given("excerpt").isNotNull(), F.substring(given("excerpt"), 1, 4000))
    rows = found.withColumns({"host": urls.host(final), "_final": final, "_excerpt": excerpt, "_key": given("draft_key")}).filter("host is not null")
    rows = rows.join(drafts.select("draft_id", F.col("draft_key").alias("_key")), "_key", "left")
    prefix = F.concat(F.lit("event_key:"), F.col("_key"))
    claim = F.when(F.col("_key").isNotNull() & F.col("draft_id").isNull(), F.concat_ws("\n", prefix, given("claim"))).otherwise(given("claim"))
    return rows.select("draft_id", F.coalesce(given("url"), F.col("_final")).alias("url"), F.col("_final").alias("final_url"), "host", given("title").alias("title"), F.col("_excerpt").alias("excerpt"), F.sha2("_excerpt", 256).alias("content_hash"), claim.alias("claim"), F.coalesce(given("status"), F.lit("recorded")).alias("status"))


def history_index(entries: DataFrame) -> DataFrame:
    """(identity, event_keys): identities of published entries' references, with the events that have them, oldest first.
    entries: (event_key, edition_date, external_id, url)."""
    rows = entries.select("event_key", "edition_date", F.explode(identity_keys(F.col("external_id"), F.col("url"))).alias("identity"))
    first = rows.groupBy("identity", "event_key").agg(F.min("edition_date").alias("d"))
    return first.groupBy("identity").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "event_key"))), lambda x: x["event_key"]).alias("event_keys"))


def covered(events: DataFrame, active: DataFrame) -> DataFrame:
    """How many active items a plan's events cover. events: (item_ids)."""
    return events.select(F.explode("item_ids").alias("item_id")).join(active.select("item_id"), "item_id", "left_semi").agg(F.count_distinct("item_id").alias("covered"))
