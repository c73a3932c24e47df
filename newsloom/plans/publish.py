"""Publication: ordered JSON lines, Markdown, manifest, replaced editions, swapped folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def export_jsonl(events: DataFrame, path: str, limit: int = 30) -> None:
    """The first `limit` events by display order, one JSON object a line; an edition is small by definition."""
    events.orderBy("display_order").limit(limit).coalesce(1).write.mode("overwrite").json(path)


def markdown(records: DataFrame, group: str, title: str, order: list[str], line) -> DataFrame:
    """(group, markdown): a heading with the count, then a line a record in order. A group is one edition's few rows."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))), lambda x: x["_line"]), "\n")
    head = F.concat(F.lit(f"# {title} "), F.col(group).cast("string"), F.lit(" ("), F.count(F.lit(1)).cast("string"), F.lit(")\n"))
    return records.groupBy(group).agg(F.concat(head, body).alias("markdown"))


def manifest(records: DataFrame, payload: str, by: list[str] | None = None, limit: int | None = 30) -> DataFrame:
    """Per edition (`by`) the number of its records, sha-256 and bytes of their lines in display order. An edition is its first
    `limit` records, as the export cuts it, so no row holds more than that; a table without editions is one of them."""
    by = by or []
    key = F.struct("display_order", F.col(payload).alias("p"))
    rows = records.select(*by, key.alias("k"))
    if not by and limit is not None:
        rows = rows.orderBy("k").limit(limit)
    lines = F.array_sort(F.collect_list("k"))
    lines = lines if limit is None else F.slice(lines, 1, limit)
    joined = F.array_join(F.transform("lines", lambda x: x["p"]), "\n")
    out = rows.groupBy(*by).agg(lines.alias("lines"))
    return out.select(*by, F.size("lines").cast("long").alias("records"), F.sha2(joined, 256).alias("sha256"), F.octet_length(joined).cast("long").alias("bytes"))


def manifest_record(runs: DataFrame, funnel: DataFrame, digests: DataFrame) -> DataFrame:
    """The manifest (schema 7) of each run as one row. runs: (run, edition_date, partial, partial_reason, reference_time);
    funnel: a row a run; digests: (run, records, sha256, bytes)."""
    state = F.when(F.coalesce("partial", F.lit(False)), "partial").otherwise("ready")
    counters = [c for c in funnel.columns if c != "run"]
    f = funnel.select("run", F.struct(*counters).alias("funnel"))
    artifacts = F.struct(F.lit("intel_items.jsonl").alias("items_jsonl"), F.lit("intel_digest.md").alias("digest_markdown"), F.lit("github-trending").alias("github_trending_dir"))
    rows = runs.join(f, "run", "left").join(digests, "run", "left")
    return rows.select(
        "run", F.lit(7).alias("schema_version"), "edition_date", F.lit("Asia/Shanghai").alias("edition_timezone"), state.alias("artifact_status"), state.alias("edition_status"), F.coalesce("partial", F.lit(False)).alias("partial"), "partial_reason", "reference_time", F.coalesce("records", F.lit(0)).alias("selected_count"),
        F.col("funnel.stage_d_total").alias("stage_d_count"), F.col("funnel.stage_d_candidate_count").alias("stage_d_candidate_count"), "funnel", artifacts.alias("artifacts"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("jsonl_sha256"), F.coalesce("bytes", F.lit(0)).alias("jsonl_bytes"),
    )


def dense_order(records: DataFrame, edition: str = "edition_date") -> DataFrame:
    """Report entries as stored: display order 1..n within an edition by the order given; rows without an event key raise."""
    missing = F.raise_error(F.lit("published record is missing event_key"))
    place = F.row_number().over(Window.partitionBy(edition).orderBy("display_order", "event_key"))
    filled = lambda c, *rest: F.coalesce(*(F.when(F.trim(x) != "", F.trim(x)) for x in (c, *rest)))
    key = F.coalesce(filled(F.col("event_key")), missing.cast("string"))
    return records.withColumns({"event_key": F.substring(key, 1, 512), "display_order": place, "title": F.coalesce(filled(F.col("title")), F.lit("(untitled)")), "original_title": filled(F.col("original_title"), F.col("title"))})


def replace_edition(entries: DataFrame, path: str) -> None:
    """Writes the editions that `entries` holds over their earlier versions, all others stay."""
    entries.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("edition_date").parquet(path)


def promote(spark: SparkSession, staging: str, final: str) -> None:
    """Swaps a staged folder in, by renames on the paths' own file system; the old one comes back if the swap fails."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    src, dst, old = path(staging), path(final), path(final + ".previous")
    fs = dst.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(old, True)
    had = fs.exists(dst) and fs.rename(dst, old)
    if not fs.rename(src, dst):
        if had:
            fs.rename(old, dst)
        raise OSError(f"{staging} can't become {final}")
    fs.delete(old, True)


def fetch_export(items: DataFrame, path: str) -> None:
    """Fetched items for inspection, before any stage: JSON lines with keys in order, and a line of Markdown each."""
    keys = sorted(items.columns)
    ordered = items.select(*keys)
    ordered.write.mode("overwrite").json(f"{path}/items")
    shown = F.concat(F.lit("- ["), F.coalesce("title", F.lit("(untitled)")), F.lit("]("), F.coalesce("url", F.lit("")), F.lit(") "), F.coalesce("source_id", F.lit("")))
    items.select(shown.alias("value")).write.mode("overwrite").text(f"{path}/digest")


def export_edition(records: DataFrame, digest: DataFrame, manifest_: DataFrame, spark: SparkSession, final: str, limit: int = 30) -> None:
    """An edition's lines, digest lines and manifest beside the public folder, then in its place: all or nothing."""
    staged = f"{final}.staging"
    export_jsonl(records, f"{staged}/intel_items.jsonl", limit)
    digest.filter(F.col("display_order") <= limit).orderBy("display_order", "line_no").select("line").coalesce(1).write.mode("overwrite").text(f"{staged}/intel_digest.md")
    manifest_.coalesce(1).write.mode("overwrite").json(f"{staged}/manifest.json")
    promote(spark, staged, final)
