"""Rankings: windows over keys, and top-k without one where no key divides the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Order of classes in admission; of groups, then classes, among an event's members.
CLASS_RANK = {"official_model_company": 0, "project_tool": 1, "news_media": 2, "community_social": 3}
FIRST_GROUPS = ("official_blog", "official_research", "x_official", "github_release")
PRIMARY_RANK = {"news_media": 1, "project_tool": 2, "community_social": 3}


def rank_of(value: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(len(ranks))
    for k, v in ranks.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def primary_rank(group: Column, content_class: Column) -> Column:
    """An official group comes first whatever the class; of others news, projects, social, then the rest."""
    other = F.lit(4)
    for k, v in PRIMARY_RANK.items():
        other = F.when(F.lower(content_class) == k, v).otherwise(other)
    return F.when(F.coalesce(F.lower(group).isin(*FIRST_GROUPS), F.lit(False)), 0).otherwise(other)


def primary_key(group: Column, content_class: Column, priority: Column, published_at: Column, captured_at: Column, item_id: Column) -> Column:
    """The least of an event's members by this key is its primary: rank, priority, latest time (published, else captured), id."""
    at = F.coalesce(F.unix_micros(F.coalesce(published_at, captured_at)), F.lit(0))
    return F.struct(primary_rank(group, content_class).alias("r"), (-F.coalesce(priority, F.lit(0))).alias("p"), (-at).alias("t"), item_id.alias("i"))


def ranked(df: DataFrame, order: list[Column], name: str, by: list[str] | None = None) -> DataFrame:
    """1..n in `order`, within `by` where given.

    Over a whole table a window would be one task: rows are range-partitioned by the order instead, numbered within
    partitions, and shifted by the counts of the partitions before (one small row each).
    """
    if by:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    from ..tables import settle

    dealt = settle(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.alias("x").join(sizes.alias("y"), F.col("y._p") < F.col("x._p"), "left").groupBy("x._p").agg(F.coalesce(F.sum("y._n"), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return dealt.withColumn(name, own).join(F.broadcast(before), "_p").withColumn(name, (F.col(name) + F.col("_before")).cast("int")).drop("_p", "_before")


def top(df: DataFrame, order: list[Column], k: int, offset: int = 0) -> DataFrame:
    """A page of k rows (1..1000): partial top-k in every task, one merge of those."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, min(1000, k)))


def search_first(events: DataFrame, n: int) -> DataFrame:
    """The first n events to verify by search: those to review, then those of unsure novelty, then by score; ties by id."""
    order = [(F.col("review_state") != "needs_review").cast("int"), (~F.col("novelty_status").isin("uncertain", "repeat")).cast("int"), F.desc("display_score"), F.asc("event_id")]
    return events.orderBy(*order).limit(max(0, n))


def failure_streaks(attempts: DataFrame, key: str, at: str, tie: str, failed: Column) -> DataFrame:
    """Per row the number of failures in a row up to it, within `key`; a success makes it 0."""
    w = Window.partitionBy(key).orderBy(at, tie)
    runs = attempts.withColumn("_run", F.sum((~failed).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.withColumn("streak", F.sum(failed.cast("int")).over(Window.partitionBy(key, "_run").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0))).drop("_run")
