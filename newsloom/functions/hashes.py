"""Identity and content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def identity_hash(external_id: Column, url: Column, title: Column, content: Column) -> Column:
    """sha-256 of the first of: external id, url, lower-cased title and content on two lines."""
    given = lambda c: F.when(c != "", c)
    return F.sha2(F.coalesce(given(external_id), given(url), F.concat(F.lower(F.coalesce(title, F.lit(""))), F.lit("\n"), F.coalesce(content, F.lit("")))), 256)


def joined_hash(*parts: Column, sep: str = "\n") -> Column:
    """sha-256 of the parts, null as empty, joined."""
    return F.sha2(F.concat_ws(sep, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def short_id(*parts: Column) -> Column:
    """The first 24 hex digits."""
    return F.substring(joined_hash(*parts), 1, 24)


def feed_hash(title: Column, link: Column, summary: Column, content: Column) -> Column:
    """Content hash of a feed entry: lower-cased title, link, summary, content, on lines."""
    return joined_hash(F.lower(title), link, summary, content)


def item_fingerprint(content_hash: Column, *parts: Column) -> Column:
    """sha-256 of the content hash, or where there is none of the parts joined by bars."""
    joined = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.sha2(F.coalesce(F.when(content_hash != "", content_hash), joined), 256)


def stable_json(fields: dict[str, Column]) -> Column:
    """A JSON object with its keys in order, null values left out."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))))


def policy_fingerprint(fields: dict[str, Column]) -> Column:
    """sha-256 of settings as JSON with keys in order: the same settings, the same fingerprint."""
    return F.sha2(stable_json(fields), 256)
