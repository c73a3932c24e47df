"""A build's frozen scope: which files, which items, and what time it goes by.

Freezing copies no table. It writes a manifest once: the files of each table with their sizes, the schema, the keys of
the members, and the reference time. Reads resolve through it, so files that are appended later, and rows in them, aren't there
for the build; a file that has changed or gone is an error, never other rows. The manifest's rename is the commit: until
then the build isn't frozen, and of two that freeze at once one wins. Freezing again returns what is frozen, unless
another membership is asked for, which is refused.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .drafts import _fs, exists


class ScopeFrozen(RuntimeError):
    """Membership of a frozen build can't change."""


@dataclass
class Scope:
    spark: SparkSession
    path: str
    manifest: dict

    @property
    def reference_time(self) -> datetime:
        return datetime.fromisoformat(self.manifest["reference_time"])

    def table(self, name: str) -> DataFrame:
        """The table as it was."""
        t = self.manifest["tables"][name]
        for path, size in t["files"]:
            fs, p = _fs(self.spark, path)
            if not fs.exists(p) or fs.getFileStatus(p).getLen() != size:
                raise FileNotFoundError(f"{path} isn't what it was when {self.path} was frozen")
        schema = StructType.fromJson(t["schema"])
        reader = self.spark.read.schema(schema)
        if not t["files"]:
            return self.spark.createDataFrame([], schema)
        return (reader.option("basePath", t["base"]) if t["base"] else reader).parquet(*(f for f, _ in t["files"]))

    def members(self) -> DataFrame:
        """(item_id, source_id)"""
        return self.spark.read.parquet(f"{self.path}/members-{self.manifest['members']}")


def scope_path(root: str, build: str) -> str:
    return f"{root}/scope/build={build}"


def frozen(spark: SparkSession, root: str, build: str) -> Scope | None:
    """The build's scope, if it is frozen."""
    path = scope_path(root, build)
    if not exists(spark, f"{path}/manifest.json"):
        return None
    return Scope(spark, path, json.loads("\n".join(r.value for r in spark.read.text(f"{path}/manifest.json", wholetext=True).collect())))


def _digest(members: DataFrame) -> str:
    """What tells one membership from another, whatever its order: count and sums of hashes."""
    h = F.xxhash64("item_id", "source_id")
    r = members.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.shiftrightunsigned(h, 32)), F.lit(0)).alias("a"), F.coalesce(F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.lit(0)).alias("b")).first()
    return f"{r['n']:x}-{r['a']:x}-{r['b']:x}"


def freeze(spark: SparkSession, root: str, build: str, tables: dict[str, str], members: DataFrame, reference_time: datetime) -> Scope:
    """Freezes a build. tables: names and paths of Parquet tables; members: (item_id, source_id), an item once."""
    path, keys = scope_path(root, build), members.select("item_id", "source_id").distinct()
    digest, was = _digest(keys), frozen(spark, root, build)
    if was is None:
        keys.write.mode("overwrite").parquet(f"{path}/members-{digest}")
        described = {}
        for name, at in tables.items():
            df = spark.read.parquet(at)
            files = [(f, _fs(spark, f)[0].getFileStatus(_fs(spark, f)[1]).getLen()) for f in sorted(df.inputFiles())]
            fs, p = _fs(spark, at)
            described[name] = {"base": at if fs.getFileStatus(p).isDirectory() else None, "schema": df.schema.jsonValue(), "files": files}
        manifest = {"tables": described, "members": digest, "reference_time": reference_time.isoformat()}
        staged = f"{path}/manifest-{digest}.staging"
        fs, p = _fs(spark, staged)
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        _, final = _fs(spark, f"{path}/manifest.json")
        if fs.exists(final) or not fs.rename(p, final):  # another froze it meanwhile
            fs.delete(p, False)
        was = frozen(spark, root, build)
    if was.manifest["members"] != digest:
        raise ScopeFrozen(f"build {build} is frozen with other members")
    return was


def admitted(new: DataFrame, items: DataFrame, members: DataFrame, build: str, *, is_frozen: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows that are attached, refused: item_id, reason) of what is to join a run: new (item_id, status, …). An item must be
    there and of this build; a frozen scope takes no new ones, only new states of its members."""
    known = items.select("item_id", F.col("build").alias("_build"), F.lit(True).alias("_item"))
    inside = members.select("item_id", F.lit(True).alias("_member")).distinct()
    rows = new.join(known, "item_id", "left").join(inside, "item_id", "left")
    late = F.col("_member").isNull() & F.lit(is_frozen)
    reason = F.when(F.col("_item").isNull(), "item_missing").when(~F.col("_build").eqNullSafe(F.lit(build)), "other_build").when(late, "scope_frozen")
    rows = rows.withColumn("reason", reason)
    return rows.filter("reason is null").select(*new.columns), rows.filter("reason is not null").select("item_id", "reason")


def current(results: DataFrame, members: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results to go on with, left out: item_id, reason): those that succeeded, of members, on the item as it is now. results:
    (item_id, status, input_fingerprint, …), where a null fingerprint says nothing; items: (item_id, fingerprint)."""
    inside = members.select("item_id", F.lit(True).alias("_member")).distinct()
    now = items.select("item_id", F.col("fingerprint").alias("_now"), F.lit(True).alias("_item"))
    rows = results.join(inside, "item_id", "left").join(now, "item_id", "left")
    asked = F.col("input_fingerprint")
    reason = F.when(~F.col("status").eqNullSafe("succeeded"), "not_succeeded").when(F.col("_member").isNull() | F.col("_item").isNull(), "out_of_scope").when((asked != "") & ~asked.eqNullSafe(F.col("_now")), "stale")
    rows = rows.withColumn("reason", reason)
    return rows.filter("reason is null").select(*results.columns), rows.filter("reason is not null").select("item_id", "reason")


def to_run(subjects: DataFrame, results: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """Subjects (subject, input, config, …) that have no success with the same input and configuration, or are forced. A
    fingerprint that isn't asked for (null) takes any. One join on the subject, whose successes are few."""
    done = results.filter("status = 'succeeded'").select(F.col("subject").alias("_s"), F.col("input").alias("_i"), F.col("config").alias("_c")).distinct()
    same = (F.col("subject") == F.col("_s")) & (F.col("input").isNull() | F.col("input").eqNullSafe(F.col("_i"))) & (F.col("config").isNull() | F.col("config").eqNullSafe(F.col("_c")))
    left = subjects.join(done, same, "left_anti")
    if forced is None:
        return left
    again = subjects.join(forced.select("subject").distinct(), "subject", "left_semi").select(*subjects.columns)
    return left.join(forced.select("subject").distinct(), "subject", "left_anti").select(*subjects.columns).unionByName(again)
