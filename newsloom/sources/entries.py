"""Feed entries with all their fields: author, content, payload, dates in any form, and what their source makes of them.

A landed document is parsed once, in Arrow batches; what is derived from the raw fields are columns. Defined cases: what is
no XML has no entries; blank fields are null; an entry without a title is (untitled); without a date that can be read its time is null.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import freeform, hashes, text
from . import tree

RAW = {"position": pa.int32(), "external_id": pa.string(), "title": pa.string(), "link": pa.string(), "author": pa.string(), "summary": pa.string(), "content": pa.string(), "dates": pa.list_(pa.string()), "payload": pa.string()}
_DDL = "position int, external_id string, title string, link string, author string, summary string, content string, dates array<string>, payload string"
_DATES = (("published", "pubDate", "issued"), ("updated", "modified"), ("created",), ("date",))


def _entry(e, position: int) -> dict:
    """An element's raw fields. Its payload holds each child's text by name, and lists where names repeat."""
    name = lambda c: c.tag.rsplit("}", 1)[-1]
    inside = lambda c: "".join(c.itertext()).strip()
    children = list(e)
    first = lambda *names: next((t for n in names for c in children if name(c) == n and (t := inside(c))), None)
    links = [c.get("href") for c in children if name(c) == "link" and c.get("rel", "alternate") == "alternate"] + [inside(c) for c in children if name(c) == "link"] + [c.get("href") for c in children if name(c) == "link"]
    people = [c for c in children if name(c) in ("author", "creator")]
    named = [inside(x) for p in people for k in ("name", "email") for x in p if name(x) == k] + [inside(p) for p in people if not len(p)]
    values: dict[str, list[str]] = {}
    for c in children:
        values.setdefault(name(c), []).append(inside(c) or c.get("href") or "")
    link = next((x.strip() for x in links if x and x.strip()), None)
    return {
        "position": position, "external_id": first("id", "guid") or link, "title": first("title"), "link": link, "author": next((p for p in named if p), None), "summary": first("summary", "description"), "content": first("encoded", "content"),
        "dates": [d for names in _DATES if (d := first(*names))], "payload": json.dumps({k: v if len(v) > 1 else v[0] for k, v in values.items()}, ensure_ascii=False, sort_keys=True),
    }


def _entries(body: str | None) -> list[dict]:
    import xml.etree.ElementTree as E

    try:
        root = E.fromstring(body or "")
    except E.ParseError:
        return []
    found = [e for e in root.iter() if e.tag.rsplit("}", 1)[-1] in ("item", "entry")]
    return [_entry(e, i) for i, e in enumerate(found, 1)]


def parsed(landed: DataFrame, now: Column, limit: str = "item_limit") -> DataFrame:
    """(source_id, position, external_id, title, link, author, published_at, raw_summary, raw_content, content_depth, raw_payload, content_hash) of
    the first entries of each document, in feed order. landed: (source_id, body, item_limit)."""
    kind = landed.schema["source_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, body in enumerate(batch.column(1).to_pylist()):
                rows = _entries(body)[: max(0, batch.column(2)[i].as_py() or 0)]
                if rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(rows))), *(pa.array([r[c] for r in rows], t) for c, t in RAW.items())], names=["source_id", *RAW])

    raw = landed.select("source_id", "body", limit).mapInArrow(run, f"source_id {kind}, {_DDL}")
    title = F.coalesce("title", F.lit("(untitled)"))
    at = F.coalesce(*(freeform.parsed(F.get("dates", F.lit(i)), now) for i in range(len(_DATES))))
    depth = F.when(F.col("content").isNotNull(), "full").when(F.col("summary").isNotNull(), "summary").otherwise("missing")
    return raw.select("source_id", "position", "external_id", title.alias("title"), "link", "author", at.alias("published_at"), F.col("summary").alias("raw_summary"), F.col("content").alias("raw_content"), depth.alias("content_depth"), F.col("payload").alias("raw_payload"), hashes.feed_hash(title, F.col("link"), F.col("summary"), F.col("content")).alias("content_hash"))


def html_text(rows: DataFrame, column: str) -> DataFrame:
    """rows with the column as readable text: blocks of a page's elements, else all its text; plain text keeps its lines, one empty
    one between paragraphs at most. Blank is null."""
    value = F.col(column)
    tagged = value.rlike(r"<\s*/?[A-Za-z][^>]*>")
    out = tree.with_tree(rows.withColumn("_html", F.when(tagged, value)), "_html", "_tree")
    t = F.col("_tree")
    lines = F.transform(F.split(F.regexp_replace(text.unescaped(value), "\r\n?", "\n"), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\f\x0b]+", " ")))
    plain = text.trimmed_or_null(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))
    shown = F.when(tagged, F.coalesce(tree.block_text(t, tree.whole(t)), text.trimmed_or_null(tree.text(t, tree.whole(t))))).otherwise(plain)
    return out.withColumn(column, shown).drop("_html", "_tree")


# Sources whose entries' contents aren't theirs, and one whose summaries are its contents.
SUMMARY_ONLY, SUMMARY_IS_CONTENT = ("google_blog_ai", "openai_news"), ("linux_do_hot",)


def domain_items(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """Entries as items by their source's rules: contents as readable text; of some sources the summary alone counts; of others, and of
    all that come by RSSHub, it is the content. sources: (id, transport)."""
    rows = entries.join(sources.select(F.col("id").alias("source_id"), "transport"), "source_id", "left")
    swapped = F.coalesce((F.col("transport") == "rsshub") | F.col("source_id").isin(*SUMMARY_IS_CONTENT), F.lit(False))
    bare = F.col("source_id").isin(*SUMMARY_ONLY) & ~swapped
    rows = html_text(rows.withColumn("content", F.when(swapped, F.col("raw_summary")).when(bare, None).otherwise(F.col("raw_content"))), "content")
    has = F.col("content").isNotNull()
    depth = F.when(has, "full").when(swapped | F.col("raw_summary").isNull(), "missing").otherwise("summary")
    return rows.select("source_id", "position", "external_id", "title", F.col("link").alias("url"), "author", "published_at", F.col("raw_summary").alias("summary"), "content", depth.alias("content_depth"), "raw_payload", "content_hash")
