"""JSON, maps and arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names under which a metric may come, first wins.
ALIASES = {
    "stars": ("stars", "stargazers_count", "star_count"),
    "forks": ("forks", "forks_count"),
    "votes": ("votes", "upvotes", "votes_count"),
    "comments": ("comments", "comments_count", "comment_count"),
}


def decoded_map(text: Column) -> Column:
    """A JSON object as map; malformed or other JSON as an empty one."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def decoded_strings(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def first_alias(metric: str, *maps: Column) -> Column:
    """The first alias that any of the maps holds, alias by alias within a map."""
    return F.coalesce(*(F.try_element_at(m, F.lit(a)) for m in maps for a in ALIASES.get(metric, (metric,))))


def merged(left: Column, right: Column) -> Column:
    """Shallow merge, the right side wins."""
    kept = F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k))
    return F.map_concat(kept, right)


def is_true(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true", "yes", "on"), F.lit(False))


def without_internal_keys(m: Column) -> Column:
    return F.map_filter(m, lambda k, _: ~((F.lower(k) == "run_id") | F.lower(k).endswith("_run_id")))
