"""Entity resolution: dedup by two keys, identity keys, connected merge, splits, partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls
from ..functions.freeform import let
from ..tables import settle, with_hot


def two_key_dedup(df: DataFrame, scope: list[str], external: str, content: str, order: str) -> DataFrame:
    """The first row by `order` of each external id, and of what is left or has none the first of each content hash.

    Grouped minima instead of windows: they combine before the shuffle, so a hot key is no hot task.
    """
    cols = F.struct(order, *[c for c in df.columns if c != order])
    with_id = df.filter(F.col(external).isNotNull()).groupBy(*scope, external).agg(F.min_by(cols, F.col(order)).alias("r")).select("r.*")
    rest = with_id.unionByName(df.filter(F.col(external).isNull()))
    return rest.groupBy(*scope, content).agg(F.min_by(cols, F.col(order)).alias("r")).select("r.*").select(*df.columns)


def identity_keys(external: Column, url: Column) -> Column:
    """Strong identities: external:…, url:…; a release or repository id stands alone; a bare repository page is none beside an id."""

    def keys(x: Column) -> Column:
        alone = x["ext"].startswith("github_release:") | x["ext"].startswith("github_repo:")
        root = x["link"].rlike(r"^(?i)https?://(www\.)?github\.com/[^/]+/[^/]+/?$") & x["ext"].isNotNull()
        return F.array_compact(F.array(F.concat(F.lit("external:"), x["ext"]), F.when(~F.coalesce(alone, F.lit(False)) & ~F.coalesce(root, F.lit(False)), F.concat(F.lit("url:"), x["link"]))))

    return let(F.struct(text.external_id(external).alias("ext"), urls.event_url(url).alias("link")), keys)


def components(edges: DataFrame, node: str, key: str) -> DataFrame:
    """(node, component): the smallest node reachable through shared keys.

    Labels take the minimum over each key and over each node's keys in turn, then jump to their label's label; rounds
    grow with the logarithm of a chain's length. All steps are groupings with partial aggregation, so a key that very
    many nodes share stays one row; each round is checkpointed.
    """
    pairs = settle(edges.select(F.col(node).alias("node"), F.col(key).alias("key")).filter("key is not null").distinct())
    label = settle(edges.select(F.col(node).alias("node"), F.col(node).alias("component")).distinct())
    while True:
        told = pairs.join(label, "node")
        least = told.groupBy("key").agg(F.min("component").alias("least"))
        near = with_hot(pairs, least, "key").groupBy("node").agg(F.min("least").alias("least"))
        step = settle(label.join(near, "node", "left").select("node", F.col("component").alias("was"), F.least("component", F.coalesce("least", "component")).alias("component")))
        # every component is a node, so each finds its own
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("top"))
        new = settle(with_hot(step, jump, "component").select("node", "was", F.least("component", "top").alias("component")))
        label = new.select("node", "component")
        if new.filter("was <> component").isEmpty():
            return label.withColumnRenamed("node", node)


def split_identities(members: DataFrame, identity: str, event: str) -> DataFrame:
    """Identities in more than one event."""
    return members.groupBy(identity).agg(F.count_distinct(event).alias("n_events")).filter("n_events > 1")


# The reasons for which one family may have several events.
SPLIT_REASONS = (
    "different_model_or_major_version", "separate_time_window_actionable", "independent_security_policy_or_breaking_change",
    "platform_released_independent_product", "standalone_pricing_quota_access_change",
)


def family_splits(events: DataFrame, reasons: tuple[str, ...] = SPLIT_REASONS, scope: tuple[str, ...] = ()) -> DataFrame:
    """(event_family_key, n, events): families with several publishable events of which at least one has no allowed reason;
    the events without one, in order. events: (event_key, event_family_key, publishability, split_reason), and the columns
    of `scope`, within which families count."""
    family = text.family_key(F.coalesce(F.when(F.col("event_family_key") != "", F.col("event_family_key")), F.col("event_key")))
    rows = events.filter(F.lower("publishability").isin("candidate", "needs_review")).select(*scope, family.alias("event_family_key"), "event_key", F.coalesce(F.trim("split_reason").isin(*reasons), F.lit(False)).alias("fine"))
    found = rows.groupBy(*scope, "event_family_key").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(~F.col("fine"), F.col("event_key")))).alias("events"))
    return found.filter((F.col("n") > 1) & (F.size("events") > 0))


def first_record(df: DataFrame, keys: list[Column], order: str) -> DataFrame:
    """The first row of each key, the key being the first of `keys` that isn't null or empty."""
    k = F.coalesce(*(F.when(c != "", c) for c in keys))
    cols = F.struct(*df.columns)
    return df.withColumn("_k", k).groupBy("_k").agg(F.min_by(cols, F.col(order)).alias("r")).select("r.*")


def partition_errors(candidates: DataFrame, chosen: DataFrame, rest: DataFrame, key: str) -> DataFrame:
    """(key, error): rows in both parts, in neither, or outside of the candidates."""
    marks = candidates.select(key, F.lit(1).alias("c"), F.lit(0).alias("s"), F.lit(0).alias("u"))
    marks = marks.unionByName(chosen.select(key, F.lit(0).alias("c"), F.lit(1).alias("s"), F.lit(0).alias("u"))).unionByName(rest.select(key, F.lit(0).alias("c"), F.lit(0).alias("s"), F.lit(1).alias("u")))
    sums = marks.groupBy(key).agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.sum("u").alias("u"))
    error = F.when(F.col("c") == 0, "unknown").when(F.col("s") + F.col("u") > 1, "twice").when(F.col("s") + F.col("u") == 0, "missing")
    return sums.select(key, error.alias("error")).filter("error is not null")


def autofilled(members: DataFrame, active: DataFrame, item: str, event: str) -> DataFrame:
    """(item, event, state): given memberships, and every active item without one as an event of its own, to be reviewed."""
    alone = active.select(item).join(members.select(item), item, "left_anti")
    return members.select(item, event, F.lit("candidate").alias("state")).unionByName(alone.select(item, F.concat(F.lit("auto:"), F.col(item).cast("string")).alias(event), F.lit("needs_review").alias("state")))


def verified_evidence(evidence: DataFrame, order: str, cap: int = 600) -> DataFrame:
    """Verified rows with a url, the first of each (event, url, host, claim); excerpts cut."""
    trim = lambda c: F.coalesce(F.trim(c), F.lit(""))
    url = trim(F.coalesce(F.when(F.col("final_url") != "", F.col("final_url")), F.col("url")))
    rows = evidence.filter(F.lower(F.trim("status")) == "verified").select("event", order, url.alias("url"), trim("host").alias("host"), trim("claim").alias("claim"), F.substring(trim("excerpt"), 1, cap).alias("excerpt")).filter("url <> ''")
    return rows.groupBy("event", "url", "host", "claim").agg(F.min_by("excerpt", order).alias("excerpt"))
