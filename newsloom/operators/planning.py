"""Plans of events, checked and merged: what a plan proposes becomes prepared events and errors.

Tables: events (plan, position, event_key, item_ids: array<bigint>, title, publishability, history_status, prior_event_key,
facts: array<struct<claim, supporting_item_ids>>, caveats: array<string>, split_reason, event_family_key); admissions (plan, item_id,
active, identities: array<string>); history (plan, event_key) of the window; index (plan, identity, event_keys: oldest first);
searched (plan, event_key). All plans of the tables are worked on at once.

An event claims its items in their order up to the first that an earlier event has claimed; it is refused there, but what
it claimed before stays claimed. So claims depend on refused events: claims are assumed whole, cut where an earlier
claim stands, and assumed anew until nothing changes. A round settles every event whose earlier ones are settled.

Events that share an identity, directly or through others, are merged in order of their positions. Components are found
by grouping; only the ordered union of members, facts and caveats within one is a fold. Where an event meets several
earlier ones, they are merged in order of position (the first of them takes in the event).

Defined cases: null arrays are empty; a null item id or one below 1 doesn't count, ids count once, 40 at most; a null or
blank key is missing; positions of a plan must differ; plans without events give only what isn't covered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..tables import settle
from . import policy
from .entities import components, family_splits
from .events import PUBLISHABILITY_RANK, positive_ids
from .folds import folded

KEY = ["plan", "position"]
FACTS = "array<struct<claim:string,supporting_item_ids:array<bigint>>>"
EVENT = f"plan string, position int, event_key string, item_ids array<bigint>, title string, publishability string, history_status string, prior_event_key string, facts {FACTS}, caveats array<string>, split_reason string, event_family_key string"
_COLUMNS = [c.split()[0] for c in EVENT.split(", ")]


def _error(rows: DataFrame, code: str, what: Column) -> DataFrame:
    return rows.select("plan", "position", F.lit(code).alias("error"), what.cast("string").alias("what"))


def claimed(events: DataFrame, admissions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted events with their own keys and ids, errors: plan, position, error, what)."""
    rows = settle(events.withColumns({"event_key": text.trimmed_or_null(F.col("event_key")), "item_ids": positive_ids(F.coalesce("item_ids", F.array().cast("array<bigint>")))}))
    firsts = rows.filter("event_key is not null").groupBy("plan", "event_key").agg(F.min("position").alias("_first"))
    rows = rows.join(firsts, ["plan", "event_key"], "left")
    early = F.when(F.col("event_key").isNull(), "event_key_missing").when(F.col("position") > F.col("_first"), "event_key_twice").when(F.size("item_ids") == 0, "items_missing")
    known = admissions.select("plan", "item_id", F.lit(True).alias("_known")).distinct()
    listed = rows.filter(early.isNull()).select(*KEY, F.posexplode("item_ids").alias("at", "item_id")).join(known, ["plan", "item_id"], "left")
    outside = listed.filter("_known is null").groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "item_id"))), lambda x: x["item_id"]).alias("_outside"))
    rows = settle(rows.join(outside, KEY, "left").withColumn("_error", F.coalesce(early, F.when(F.col("_outside").isNotNull(), "items_outside"))))
    claims = settle(listed.join(rows.filter("_error is null").select(*KEY), KEY, "left_semi").select(*KEY, "at", "item_id"))
    cut = None
    while True:
        standing = claims if cut is None else claims.join(cut, KEY, "left").filter("_cut is null or at < _cut").drop("_cut", "_by", "_item")
        owners = standing.groupBy("plan", "item_id").agg(F.min("position").alias("_by"))
        new = claims.join(owners, ["plan", "item_id"]).filter("_by < position").groupBy(*KEY).agg(F.min(F.struct("at", "_by", "item_id")).alias("c"))
        new = settle(new.select(*KEY, F.col("c.at").alias("_cut"), F.col("c._by").alias("_by"), F.col("c.item_id").alias("_item")))
        same = cut is not None and new.select(*KEY, "_cut", "_by").exceptAll(cut.select(*KEY, "_cut", "_by")).isEmpty() and cut.select(*KEY, "_cut").exceptAll(new.select(*KEY, "_cut")).isEmpty()
        cut = new
        if same or new.isEmpty():
            break
    owner = rows.select("plan", F.col("position").alias("_by"), F.col("event_key").alias("_owner"))
    taken = cut.join(owner, ["plan", "_by"])
    what = F.when(F.col("_error") == "event_key_missing", F.col("position").cast("string")).when(F.col("_error") == "items_outside", F.array_join(F.col("_outside").cast("array<string>"), ",")).otherwise(F.col("event_key"))
    errors = rows.filter("_error is not null").select(*KEY, F.col("_error").alias("error"), what.alias("what")).unionByName(_error(taken, "item_taken", F.concat_ws(":", F.col("_item").cast("string"), "_owner")))
    fine = rows.filter("_error is null").join(cut.select(*KEY), KEY, "left_anti")
    return fine.select(*events.columns), errors


def _fact_error(facts: Column, ids: Column) -> Column:
    def bad(f: Column) -> Column:
        support = positive_ids(f["supporting_item_ids"])
        return F.when(text.trimmed_or_null(f["claim"]).isNull(), "fact_without_claim").when(F.exists(support, lambda i: ~F.array_contains(ids, i)), "fact_of_others").when(F.coalesce(F.size(support), F.lit(0)) <= 0, "fact_without_support")

    return F.get(F.filter(F.transform(facts, bad), lambda e: e.isNotNull()), F.lit(0))


def judged(events: DataFrame, admissions: DataFrame, history: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events with their history, publishability and caveats applied, errors of facts)."""
    rows = events.withColumn("facts", F.coalesce("facts", F.array().cast(FACTS)))
    wrong = _fact_error(F.col("facts"), F.col("item_ids"))
    rows = settle(rows.withColumn("_wrong", wrong))
    keys = rows.select(*KEY, F.posexplode("item_ids").alias("at", "item_id")).join(admissions.select("plan", "item_id", F.posexplode("identities").alias("k", "identity")), ["plan", "item_id"])
    prior = keys.join(index, ["plan", "identity"]).groupBy(*KEY).agg(F.min_by(F.get("event_keys", F.lit(0)), F.struct("at", "k")).alias("_exact"))
    known = history.select("plan", F.col("event_key").alias("_asked"), F.lit(True).alias("_in")).distinct()
    rows = rows.withColumn("_asked", text.trimmed_or_null(F.col("prior_event_key"))).join(known, ["plan", "_asked"], "left").join(prior, KEY, "left")
    clean = F.transform("facts", lambda f: F.struct(text.trimmed_or_null(f["claim"]).alias("claim"), positive_ids(f["supporting_item_ids"]).alias("supporting_item_ids")))
    status, before, flag = policy.history(F.col("history_status"), F.col("_asked"), F.col("_in"), F.col("_exact"), F.size("facts") > 0)
    state, flags = policy.publishability(F.col("publishability"), policy.novelty_of(F.col("_status")), F.size("facts"))
    rows = rows.withColumns({"_status": status, "_before": before, "_flag": flag}).withColumns({"_state": state, "_flags": flags})
    given = F.filter(F.transform(F.coalesce("caveats", F.array().cast("array<string>")), text.trimmed_or_null), lambda x: x.isNotNull())
    caveats = F.array_distinct(F.concat(given, F.array_compact(F.array("_flag")), "_flags"))
    out = rows.filter("_wrong is null").withColumns({"facts": clean.cast(FACTS), "caveats": caveats, "publishability": F.col("_state"), "history_status": F.col("_status"), "prior_event_key": F.col("_before")})
    title = F.coalesce(text.trimmed_or_null(F.col("title")), F.concat(F.lit("event-"), F.col("event_key")))
    family = text.family_key(F.coalesce(F.when(F.col("event_family_key") != "", F.col("event_family_key")), F.col("event_key")))
    return out.withColumns({"title": title, "event_family_key": family, "split_reason": text.trimmed_or_null(F.col("split_reason"))}).select(*_COLUMNS), _error(rows.filter("_wrong is not null"), "fact", F.concat_ws(":", "event_key", "_wrong"))


def _prefer(a: dict, b: dict) -> tuple[dict, dict]:
    """(who survives, who is taken in): the most publishable, then the larger, then the smaller key."""
    rank = lambda e: (PUBLISHABILITY_RANK.get((e["publishability"] or "").lower(), 9), -len(e["item_ids"]), e["event_key"])
    return (a, b) if rank(a) <= rank(b) else (b, a)


def _merge(a: dict, b: dict) -> dict:
    """Two groups as one at the earlier position: the survivor's values, and both's members, facts and caveats in its order."""
    lead, other = _prefer(a["event"], b["event"])
    note = f"merged exact-identity event {other['event_key']} into {lead['event_key']}"
    united = {c: lead[c] + [x for x in other[c] if x not in lead[c]] for c in ("item_ids", "facts", "caveats")}
    united["caveats"] = [*united["caveats"], *([note] if note not in united["caveats"] else [])]
    return {"at": min(a["at"], b["at"]), "keys": a["keys"] | b["keys"], "event": lead | united}


def _step(groups: list[dict], r: dict) -> tuple[list[dict], list[dict]]:
    event = {c: r[c] for c in _COLUMNS}
    new = {"at": r["position"], "keys": set(r["identities"]), "event": event}
    met = sorted((g for g in groups if g["keys"] & new["keys"]), key=lambda g: g["at"])
    for g in met:
        new = _merge(new, g) if g["at"] > new["at"] else _merge(g, new)
    return [*(g for g in groups if g not in met), new], []


def merged(events: DataFrame, admissions: DataFrame) -> DataFrame:
    """Events with those that share an identity made one; rejected ones have none. The fold keeps one component's events."""
    rows = settle(events)
    keys = rows.filter("publishability <> 'rejected'").select(*KEY, F.explode("item_ids").alias("item_id")).join(admissions.select("plan", "item_id", F.explode("identities").alias("identity")), ["plan", "item_id"])
    node = F.struct("plan", "position")
    found = components(keys.select(node.alias("node"), F.struct("plan", "identity").alias("identity")), "node", "identity").select("node.*", F.col("component.position").alias("component"))
    listed = keys.groupBy(*KEY).agg(F.collect_set("identity").alias("identities"))
    linked = rows.join(found, KEY).join(listed, KEY)
    end = lambda groups, _: [g["event"] | {"position": g["at"]} for g in groups]
    return folded(linked, ["plan", "component"], ["position"], list, _step, end, EVENT).unionByName(rows.join(found.select(*KEY), KEY, "left_anti").select(*_COLUMNS))


def prepared(events: DataFrame, admissions: DataFrame, history: DataFrame, index: DataFrame, searched: DataFrame | None = None, *, fill: bool = False, reason: str = "needs_review") -> tuple[DataFrame, DataFrame]:
    """(events, errors) of all plans. A plan with errors is refused as a whole, unless `fill`: then active items that no event
    covers become events of their own, to be reviewed, and nothing is an error. searched: where given, events to be
    reviewed must have been searched for."""
    accepted, wrong = claimed(events, admissions)
    rows, bad = judged(accepted, admissions, history, index)
    out = settle(merged(rows, admissions))
    covered = out.select("plan", F.explode("item_ids").alias("item_id")).distinct()
    left = admissions.filter("active").select("plan", "item_id").distinct().join(covered, ["plan", "item_id"], "left_anti")
    if fill:
        name = F.concat(F.lit("unresolved-"), F.col("item_id").cast("string"))
        none = F.lit(None).cast("string")
        alone = left.select("plan", F.lit(None).cast("int").alias("position"), name.alias("event_key"), F.array("item_id").alias("item_ids"), name.alias("title"), F.lit("needs_review").alias("publishability"), F.lit("uncertain").alias("history_status"), none.alias("prior_event_key"), F.array().cast(FACTS).alias("facts"), F.array_distinct(F.array(F.lit("needs_review"), F.lit(reason))).alias("caveats"), none.alias("split_reason"), text.family_key(name).alias("event_family_key"))
        return out.unionByName(alone), wrong.filter("false")
    no = F.lit(None).cast("int").alias("position")
    errors = wrong.unionByName(bad).unionByName(left.groupBy("plan").agg(F.array_sort(F.collect_list("item_id")).alias("i")).select("plan", no, F.lit("not_covered").alias("error"), F.array_join(F.col("i").cast("array<string>"), ",").alias("what")))
    splits = family_splits(out, scope=("plan",))
    errors = errors.unionByName(splits.select("plan", no, F.lit("family_split").alias("error"), F.concat(F.col("event_family_key"), F.lit(":"), F.array_join("events", ",")).alias("what")))
    if searched is not None:
        unsought = out.filter("publishability = 'needs_review'").join(searched, ["plan", "event_key"], "left_anti")
        errors = errors.unionByName(_error(unsought, "search_required", F.col("event_key")))
    return out, errors
