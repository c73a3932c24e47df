"""Line dedup by site-relative frequency.

A line is boilerplate on a host when the share of the host's pages that contain it exceeds `max_ratio`; every
copy of it on that host goes. Lines are compared with surrounding spaces trimmed; blank lines are kept and never
counted. Hosts with fewer than `min_pages` pages keep all their lines, since a share of very few pages says nothing.

By default every row is a page. With `copies`, a class of copies or near copies is one page of a host, in a line's count
and in the host's total, so that a text which only its own copies share isn't boilerplate.

Defined cases: a null text stays null; an empty text stays empty; a null host is a host of its own; repeated rows
are pages of their own (with `copies` one page); an empty table gives an empty table; other columns pass through untouched,
whatever their names, but that with `counts` columns named n_lines or n_dropped are replaced.
With `copies`, rows without a class share a page with rows of the same text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAX_RATIO = 0.05
MIN_PAGES = 20
#: The boilerplate table is broadcast up to so many entries; beyond it only hosts with more than a `HEAVY`-th of all pages
#: are (at most `HEAVY` of them), so that no host's pages meet in one task, and the others join by host.
BROADCAST_LINES, HEAVY = 200_000, 1000


def _key(line: Column) -> Column:
    """96 bits that stand for a trimmed line."""
    text = F.trim(line)
    return F.struct(F.xxhash64(text).alias("a"), F.hash(text).alias("b"))


def boilerplate(docs: DataFrame, *, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, copies: DataFrame | None = None) -> DataFrame:
    """(_host, _pages, _drop): per host its pages and the keys of the lines on more than `max_ratio` of its pages.

    A host's list holds at most (lines a page) / max_ratio entries, whatever the number of pages.
    Counts are combined before the shuffle, so a host with a third of all rows isn't a hot key. copies: (doc_id,
    same: xxhash64 of the text, class), distinct; a class is made distinct by host and line first, which is combined before the shuffle too.
    """
    keys = F.array_distinct(F.transform(F.filter(F.split(F.col(text), "\n"), lambda x: F.trim(x) != ""), _key))
    if copies is None:
        pages = docs.select(F.col(host).alias("_host"))
        # exploded as it is: of a named array Spark would infer a size filter that works out the keys twice
        lines = docs.select(F.col(host).alias("_host"), F.explode(keys).alias("_k")).select("_host", "_k.a", "_k.b")
    else:
        doc_id, same = common.pair(docs, text=text)
        rows = docs.select(F.col(host).alias("_host"), keys.alias("_keys"), doc_id.cast("long").alias("_id"), same.alias("_same"))
        named = copies.select(F.col("doc_id").alias("_i"), F.col("same").alias("_s"), F.col("class").alias("_class"))
        rows = rows.join(named, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_same") == F.col("_s")), "left")
        rows = rows.select("_host", "_keys", F.col("_class").isNull().alias("_lone"), F.coalesce("_class", "_same").alias("_page"))
        pages = rows.select("_host", "_lone", "_page").distinct()
        lines = rows.select("_host", "_lone", "_page", F.explode("_keys").alias("_k")).select("_host", "_lone", "_page", "_k.a", "_k.b").distinct()
    pages = pages.groupBy("_host").agg(F.count(F.lit(1)).alias("_pages"))
    counted = lines.groupBy("_host", "a", "b").agg(F.count(F.lit(1)).alias("_n"))
    # the smallest count that can pass is known before the host's total is joined: it thins the lines that travel
    frequent = counted.filter(F.col("_n") > max_ratio * min_pages)
    kept = frequent.join(pages.filter(F.col("_pages") >= min_pages).withColumnRenamed("_host", "_h"), F.col("_host").eqNullSafe(F.col("_h")))
    return kept.filter(F.col("_n") > F.lit(max_ratio) * F.col("_pages")).groupBy("_host").agg(F.max("_pages").alias("_pages"), F.collect_list(F.struct("a", "b")).alias("_drop"))


def remove_boilerplate(docs: DataFrame, *, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, counts: bool = False, copies: DataFrame | None = None) -> DataFrame:
    """docs with boilerplate lines taken out of `text`; with `counts` also n_lines and n_dropped (long)."""
    drop = common.settle(boilerplate(docs, host=host, text=text, max_ratio=max_ratio, min_pages=min_pages, copies=copies))
    size = drop.agg(F.sum(F.size("_drop"))).first()[0] or 0
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(host).alias("_at"), F.col(text).alias("_text"))
    there = F.col("_at").eqNullSafe(F.col("_host"))
    if size <= BROADCAST_LINES:
        listed = rows.join(F.broadcast(drop), there, "left")
    else:
        hot = F.broadcast(drop.filter(F.col("_pages") * HEAVY > docs.count()))
        listed = rows.join(hot, there).unionByName(rows.join(hot, there, "left_anti").join(drop, there, "left"))
    listed = listed.select("_row", "_drop", F.split("_text", "\n").alias("_lines"))
    left = F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(F.filter("_lines", lambda x: (F.trim(x) == "") | ~F.array_contains("_drop", _key(x))))
    out = listed.select("_row", "_lines", left.alias("_left"))
    more = {"n_lines": F.coalesce(F.size("_lines"), F.lit(0)).cast("long"), "n_dropped": F.coalesce(F.size("_lines") - F.size("_left"), F.lit(0)).cast("long")} if counts else {}
    cols = [F.array_join("_left", "\n").alias(text) if c == text else F.col(f"_row.`{c}`") for c in docs.columns if c not in more]
    return out.select(*cols, *(c.alias(n) for n, c in more.items()))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document (null text: empty)."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    out = remove_boilerplate(docs, counts=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = f"""
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS source, source IS NULL AS nohost,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
pages AS (SELECT coalesce(source, '') AS source, source IS NULL AS nohost, count(*) AS pages FROM documents GROUP BY 1, 2),
freq AS (SELECT source, nohost, trim(line, ' ') AS line, count(DISTINCT doc_id) AS n FROM lines WHERE trim(line, ' ') <> '' GROUP BY 1, 2, 3),
drops AS (SELECT f.source, f.nohost, f.line FROM freq f JOIN pages p ON f.source = p.source AND f.nohost = p.nohost
          WHERE p.pages >= {MIN_PAGES} AND f.n > {MAX_RATIO}::DOUBLE * p.pages),
marked AS (SELECT l.doc_id, l.pos, l.line, d.line IS NOT NULL AS gone FROM lines l LEFT JOIN drops d
           ON l.source = d.source AND l.nohost = d.nohost AND trim(l.line, ' ') = d.line)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
