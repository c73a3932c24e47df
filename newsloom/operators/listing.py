"""Listings and nested rows: counts beside their rows, events with their members, feeds, lists in order, scopes, sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranking
from .ranking import top


def counted(rows: DataFrame, many: DataFrame, key: str, name: str = "n") -> DataFrame:
    """rows with how many of `many` have their key, 0 without; counted before it is joined."""
    n = many.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return rows.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def looked_up(rows: DataFrame, key: str, many: DataFrame, many_key: str, columns: list[str]) -> DataFrame:
    """rows with columns of what their key names, null where it names nothing: many has one row a key."""
    side = many.select(F.col(many_key).alias("_k"), *columns)
    return rows.join(side, rows[key] == F.col("_k"), "left").drop("_k")


def nested_members(events: DataFrame, members: DataFrame, items: DataFrame, *, order: list[str], fields: list[str], evidence: DataFrame | None = None, evidence_order: list[str] | None = None) -> DataFrame:
    """One row an event: its columns, `members` (array of structs of `order` and `fields`, in order; members whose item is missing
    are left out), `n_members`, and `evidence` likewise. Each to-many side is gathered by itself before it joins, so that
    none multiplies another; events without any have empty arrays.

    events: (event_id, …); members: (event_id, item_id, …); items: (item_id, …), with what is looked up for items in its columns."""
    kept = F.struct(*order, *fields)
    inner = members.join(items, "item_id").groupBy("event_id").agg(F.array_sort(F.collect_list(kept)).alias("members"))
    out = events.join(inner, "event_id", "left")
    out = out.withColumn("members", F.coalesce("members", F.array().cast(out.schema["members"].dataType))).withColumn("n_members", F.size("members").cast("long"))
    if evidence is None:
        return out
    told = evidence.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct(*(evidence_order or []), *(c for c in evidence.columns if c != "event_id" and c not in (evidence_order or []))))).alias("evidence"))
    out = out.join(told, "event_id", "left")
    return out.withColumn("evidence", F.coalesce("evidence", F.array().cast(out.schema["evidence"].dataType)))


def member_feed(members: DataFrame, *, item: str, score: str, first: list[str], limit: int, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(page, total): each item once, as its first row by `first` has it; by falling score, then item."""
    once = members.groupBy(F.col(item).alias("_item")).agg(F.min_by(F.struct(*members.columns), F.struct(*first)).alias("r")).select("r.*")
    return top(once, [F.desc(score), F.asc(item)], limit, offset), once.agg(F.count(F.lit(1)).alias("total"))


def in_list_order(rows: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with `place`, missing keys) of an ordered list of keys: ids (position, key). A key counts at its first place; the
    list's keys that no row has come back, for the caller to refuse. ids: a list, small beside the rows."""
    wanted = ids.groupBy(key).agg(F.min("position").alias("place"))
    found = rows.join(wanted, key)
    return found, wanted.join(rows.select(key).distinct(), key, "left_anti").select(key, "place")


def scoped(rows: DataFrame, scope: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the scope has."""
    return rows.join(scope.select(*keys).distinct(), keys, "left_semi")


def uncovered(rows: DataFrame, covered: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys nothing covers."""
    return rows.join(covered.select(*keys).distinct(), keys, "left_anti")


def next_numbers(new: DataFrame, old: DataFrame, by: str, number: str, order: list[Column]) -> DataFrame:
    """new rows with the numbers that follow the largest of their `by`, from 1 where there is none, in order."""
    last = old.groupBy(by).agg(F.max(number).alias("_last"))
    placed = ranking.ranked(new, order, "_i", [by])
    return placed.join(last, by, "left").withColumn(number, F.coalesce("_last", F.lit(0)) + F.col("_i")).drop("_last", "_i")


def fetch_totals(stats: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sums of fetched, inserted and skipped items over sources, the sources, and those that failed or are degraded.
    stats: one row a source: (status, items_fetched, items_inserted, items_skipped)."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    status = F.lower("status")
    out = [F.count(F.lit(1)).alias("sources"), total("items_fetched").alias("fetched"), total("items_inserted").alias("inserted"), total("items_skipped").alias("skipped"), F.count_if(status == "failed").alias("failed"), F.count_if(status == "degraded").alias("degraded")]
    return stats.groupBy(*by).agg(*out) if by else stats.agg(*out)


def united(rows: DataFrame, by: str, value: str, order: list[str]) -> DataFrame:
    """(by, values): distinct values in order of their first rows; least places combine before they shuffle."""
    first = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.min(F.struct(*order)).alias("_o"))
    return first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", value))), lambda x: x[value]).alias("values"))
