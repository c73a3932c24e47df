"""Scores and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The score's weights, in twentieths.
WEIGHTS = {"audience_relevance": 9, "material_change": 1, "impact_scope": 5, "independent_news_value": 4, "specificity": 1}


def clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def weighted_score(components: dict[str, Column]) -> Column:
    """Five components to 0-100: exact in integers, then rounded half to even."""
    total = sum((F.coalesce(components[k].cast("long"), F.lit(0)) * w for k, w in WEIGHTS.items()), F.lit(0).cast("long"))
    return clamp(F.bround(total / F.lit(20), 0).cast("int"), 0, 100)


def suffixed(text: Column) -> Column:
    """A number with commas and a k or m suffix, as double; null where it is none."""
    bare = F.lower(F.regexp_replace(F.trim(text), ",", ""))
    factor = F.when(bare.endswith("k"), 1e3).when(bare.endswith("m"), 1e6).otherwise(1.0)
    return F.regexp_replace(bare, "[km]$", "").try_cast("double") * factor


def thousands(value: Column) -> Column:
    """With commas; 0 and null as a dash."""
    return F.when(F.coalesce(value, F.lit(0)) == 0, "-").otherwise(F.format_number(value.cast("long"), 0))


def bounded_int(text: Column, low: int, high: int, default: int) -> Column:
    """A text's number, cut to whole and into bounds; the default where it is none."""
    return clamp(F.coalesce(text.try_cast("double").cast("long"), F.lit(default)), low, high)
