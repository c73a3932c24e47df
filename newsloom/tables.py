"""Tables as DataFrames, and the item view the news operators run on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Class of an item by the number in its source's name, modulo 4.
CLASSES = ("official_model_company", "news_media", "project_tool", "community_social")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share. A local session without one gets a folder of its own;
    a cluster has to name one, since a machine's own folder is lost with the machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Shuffle files of an execution go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame) -> DataFrame:
    """Cuts lineage by a checkpoint in the session's shared folder. The shuffles that made the table go at once: nothing reads
    them again, and on a driver with memory to spare those of every step would stay on disk beside one another."""
    shared_folder(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # the setting holds for frames made under it
    finally:
        conf.set(CLEANUP, before) if before is not None else conf.unset(CLEANUP)


#: A key is hot if it has more than so many rows and more than a `HEAVY`-th of all: there can be `HEAVY` of them at most.
HOT_ROWS, HEAVY = 100_000, 1000


def with_hot(rows: DataFrame, side: DataFrame, key: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """rows joined with side's one row a key (inner or left). Hot keys' rows of side are broadcast, so that a key's rows
    don't meet in one task; one grouping of rows by key finds them, combined before its shuffle. rows: best a settled table; total: how
    many there are, where that is known."""
    total = rows.count() if total is None else total
    if total <= HOT_ROWS:
        return rows.join(side, key, how)
    hot = settle(rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max(HOT_ROWS, total // HEAVY)).select(key))
    if hot.isEmpty():
        return rows.join(side, key, how)
    few = F.broadcast(side.join(F.broadcast(hot), key))
    rest = rows.join(F.broadcast(hot), key, "left_anti")
    return rows.join(F.broadcast(hot), key, "left_semi").join(few, key, how).unionByName(rest.join(side, key, how))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as news items: page urls, event times and labels join by id, all one to one at most."""
    t = lambda n: table(spark, sf_dir, n)
    d, p, e, la = t("documents"), t("pages"), t("events"), t("labels")
    rows = d.join(p.select(F.col("page_id").alias("doc_id"), "url"), "doc_id", "left").join(e.select(F.col("event_id").alias("doc_id"), "ts", "value"), "doc_id", "left").join(la, "doc_id", "left")
    kind = F.get(F.array(*map(F.lit, CLASSES)), (F.substring("source", 4, 9).cast("int") % 4))
    return rows.select(
        F.col("doc_id").alias("item_id"), F.col("source").alias("source_id"), F.col("url").alias("source_url"), F.get(F.split("text", "\n"), F.lit(0)).alias("title"), F.col("text").alias("content_text"),
        F.col("ts").alias("published_at"), "value", F.coalesce("quality", F.lit(0)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"), kind.alias("content_class"),
    )


ITEMS_SQL = """items AS (SELECT d.doc_id AS item_id, d.source AS source_id, p.url AS source_url, split_part(d.text, chr(10), 1) AS title, d.text AS content_text,
  e.ts AS published_at, e.value, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) AS toxic,
  CASE CAST(substr(d.source, 4) AS INTEGER) % 4 WHEN 0 THEN 'official_model_company' WHEN 1 THEN 'news_media' WHEN 2 THEN 'project_tool' ELSE 'community_social' END AS content_class
  FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id LEFT JOIN events e ON e.event_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
