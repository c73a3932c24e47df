"""Read views: facets, search, pages, editions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import top


def facets(df: DataFrame, label: Column) -> DataFrame:
    return df.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")


def search(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Case-insensitive %query% over the columns; wildcards in the query stay wildcards."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).ilike(f"%{query}%"), F.lit(False))
    return df.filter(out)


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One row more than the page tells whether a next one exists."""
    return top(df, order, min(limit, 999) + 1, offset)


def last_editions(entries: DataFrame, date: str, n: int = 7) -> DataFrame:
    """Entries of the latest n dates: the dates come from a small distinct list, no window over all rows."""
    days = entries.select(date).distinct().orderBy(F.desc(date)).limit(n)
    return entries.join(F.broadcast(days), date, "left_semi")


def candidate_matches(df: DataFrame, words: str) -> DataFrame:
    """Candidates that hold every word of the query in title, summaries, body, keywords or entity names. Columns keywords and
    entities (array of struct with name) may be null."""
    return _matches(df, words, ["title", "summary", "content_text", "summary_cn"])


def history_matches(df: DataFrame, words: str) -> DataFrame:
    """The same over published events: title, summary, keywords, entity names."""
    return _matches(df, words, ["title", "summary"])


def _matches(df: DataFrame, words: str, columns: list[str]) -> DataFrame:
    names = F.transform(F.coalesce("entities", F.array().cast("array<struct<name:string>>")), lambda e: F.coalesce(e["name"], F.lit("")))
    hay = F.lower(F.concat_ws(" ", *columns, "keywords", names))
    out = F.lit(True)
    for w in words.casefold().split():
        out = out & F.contains(hay, F.lit(w))
    return df.filter(out)


def status_counts(df: DataFrame, column: str = "status") -> DataFrame:
    """Rows by status; rows without one aren't counted."""
    return df.filter(F.coalesce(F.col(column) != "", F.lit(False))).groupBy(F.col(column).alias("status")).agg(F.count(F.lit(1)).alias("n")).orderBy("status")


def children(df: DataFrame, key: str, value: object, order: list[str]) -> DataFrame:
    """The rows of one parent in their order: steps of a session, attempts of a task, members of an event."""
    return df.filter(F.col(key) == F.lit(value)).orderBy(*order)


def event_of_item(events: DataFrame, members: DataFrame, item_id: int) -> DataFrame:
    """The event that an item is in: the one with the smallest id."""
    return events.join(members.filter(F.col("item_id") == item_id).select("event_id").distinct(), "event_id", "left_semi").orderBy("event_id").limit(1)


# What users call the stages.
STAGES = {"fetch": "fetch", "a": "screen", "stage_a": "screen", "screen": "screen", "b": "analyze", "stage_b": "analyze", "analyze": "analyze", "c": "cluster", "stage_c": "cluster", "cluster": "cluster", "d": "stage_d", "stage_d": "stage_d", "export": "export"}


def stage_name(value: Column) -> Column:
    """A stage's own name; null for what is no stage."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in STAGES.items() for x in kv)), F.replace(F.lower(F.trim(value)), F.lit("-"), F.lit("_")))


def within_build(df: DataFrame, build_id: int) -> DataFrame:
    return df.filter(F.col("build_id") == build_id)
