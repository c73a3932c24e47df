"""Tables laid out for look-ups by key: a read of a key opens the files of its bucket, and of those the row groups that may hold it.

Rows are dealt to `buckets` folders by a hash of the key and sorted by it within a file. The bucket of a key that is asked
for is known before the plan is made, so folders are pruned by name; the sort gives Parquet's statistics narrow ranges. Joins with
many keys prune at run time. Null keys have a bucket like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def write(df: DataFrame, path: str, key: str, *, order: list[str] | None = None, buckets: int = BUCKETS, files: int = 1) -> None:
    """Lays the table out, in place of what was there. order: of a key's rows. files: how many a bucket is spread over, by a
    hash of whole rows, so that a key with very many rows isn't one task's."""
    part = F.pmod(F.xxhash64(*df.columns), F.lit(files))
    rows = df.withColumn("_bucket", bucket(F.col(key), buckets)).withColumn("_part", part)
    rows = rows.repartition(buckets * files, "_bucket", "_part").sortWithinPartitions("_bucket", key, *(order or []))
    rows.drop("_part").write.mode("overwrite").partitionBy("_bucket").parquet(path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def look_up(spark: SparkSession, path: str, key: str, values: list, *, buckets: int = BUCKETS) -> DataFrame:
    """The rows of a few keys; others' buckets aren't opened."""
    # a table's columns, but for its bucket
    rows = _read(spark, path)
    kind = rows.schema[key].dataType
    asked = spark.createDataFrame([(v,) for v in values], f"`{key}` {kind.simpleString()}").select(bucket(F.col(key), buckets).alias("b")).distinct()
    at = sorted(r["b"] for r in asked.collect())
    given = [v for v in values if v is not None]
    hit = F.col(key).isin(given) if len(given) == len(values) else F.col(key).isin(given) | F.col(key).isNull()
    return rows.filter(F.col("_bucket").isin(at) & hit).drop("_bucket")


def look_up_all(rows: DataFrame, keys: DataFrame, key: str, *, buckets: int = BUCKETS) -> DataFrame:
    """The rows, as `_read` gives them, of a table of keys: an equality on bucket and key, so that buckets without keys are pruned when it runs."""
    asked = keys.select(key).distinct().withColumn("_bucket", bucket(F.col(key), buckets))
    return rows.join(asked, ["_bucket", key], "left_semi").drop("_bucket")


def children(spark: SparkSession, path: str, key: str, value, order: list[str], *, buckets: int = BUCKETS) -> DataFrame:
    """A key's rows in order."""
    return look_up(spark, path, key, [value], buckets=buckets).orderBy(*order)
