"""Draft, audit and public folders of an edition, on the tables' own file system."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .publish import promote


def draft_path(root: str, edition: str) -> str:
    return f"{root}/draft/edition_date={edition}"


def audit_path(root: str, edition: str) -> str:
    return f"{root}/audit/edition_date={edition}"


def daily_path(root: str, edition: str) -> str:
    return f"{root}/daily/{edition}"


def staging_path(path: str) -> str:
    """Beside the folder it will become, so that a rename suffices."""
    return f"{path}.staging"


def restaged(path: str, staged: str, final: str) -> str:
    """A path below a staging folder as it will be below the final one; others stay."""
    return final + path[len(staged) :] if path == staged or path.startswith(staged + "/") else path


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """The folder and what was left beside it by a run that broke off."""
    for x in (path, staging_path(path), f"{path}.previous"):
        fs, p = _fs(spark, x)
        fs.delete(p, True)


def create(spark: SparkSession, root: str, edition: str, editions: DataFrame, entries: DataFrame) -> str:
    """A new draft of an edition that holds all earlier published editions' entries and nothing else; an audit of the date stays."""
    path = draft_path(root, edition)
    remove(spark, path)
    earlier = editions.filter((F.col("edition_date") < F.lit(edition).cast("date")) & F.col("published_at").isNotNull()).withColumn("status", F.lit("published"))
    earlier.write.parquet(f"{staging_path(path)}/editions")
    entries.join(earlier.select("edition_id"), "edition_id", "left_semi").write.parquet(f"{staging_path(path)}/entries")
    promote(spark, staging_path(path), path)
    return path


def to_audit(spark: SparkSession, root: str, edition: str) -> str:
    """A copy of the draft takes the audit's place; the earlier audit comes back if that fails; the draft goes afterwards."""
    source, target = draft_path(root, edition), audit_path(root, edition)
    if not exists(spark, source):
        raise FileNotFoundError(source)
    fs, src = _fs(spark, source)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    staged = staging_path(target)
    remove(spark, staged)
    _, dst = _fs(spark, staged)
    fs.mkdirs(dst.getParent())
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, src, fs, dst, False, conf)
    promote(spark, staged, target)
    remove(spark, source)
    return target


def resolve(spark: SparkSession, root: str, edition: str) -> tuple[str, str]:
    """(kind, path) of an edition that is being worked on: its draft, else its audit."""
    for kind, path in (("draft", draft_path(root, edition)), ("audit", audit_path(root, edition))):
        if exists(spark, path):
            return kind, path
    raise FileNotFoundError(f"no draft or audit of {edition}")


def frozen(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables as they are now, written once and read from there: later reads of a run see the same rows."""
    for name, table in tables.items():
        table.write.mode("errorifexists").parquet(f"{path}/{name}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in tables}
