"""Bundles: a fault after each step leaves the old one or the new one. Keyed tables: look-ups read one bucket."""

import os

import pytest
from pyspark.sql import functions as F

from newsloom.plans import bundle, keyed


class _Fault(Exception):
    pass


def _texts(v):
    return {"digest.md": f"# {v}\n" * 50, "sub/manifest.json": f'{{"v": {v}}}'}


def _table(spark, v):
    return spark.range(20).select(F.col("id"), F.lit(v).alias("v")).repartition(3)


@pytest.mark.parametrize("fault", ["digest.md", "sub/manifest.json", "items.jsonl", "staged", "committed", "pruned"])
def test_a_fault_leaves_one_or_the_other(spark, tmp_path, fault):
    root = f"{tmp_path}/b"
    for v in (1, 2, 3):
        bundle.write(spark, root, _texts(v), {"items.jsonl": _table(spark, v)})

    def step(name):
        if name == fault:
            raise _Fault(name)

    with pytest.raises(_Fault):
        bundle.write(spark, root, _texts(4), {"items.jsonl": _table(spark, 4)}, step)
    for again in range(2):  # before and after recovery
        now = bundle.current(spark, root)
        v = 4 if fault in ("committed", "pruned") else 3
        assert now.version == v and bundle.damaged(spark, now) == []
        assert open(f"{now.path}/digest.md").read() == _texts(v)["digest.md"] and {r.v for r in spark.read.json(f"{now.path}/items.jsonl").collect()} == {v}
        left = bundle.recover(spark, root)
        assert bool(left) == (v == 3 and again == 0)
    assert [n for n in sorted(os.listdir(root)) if not n.startswith(".")] == sorted(f"{k}-{x:08d}{e}" for x in (v - 1, v) for k, e in (("bundle", ""), ("manifest", ".json")))
    after = bundle.write(spark, root, _texts(5), {"items.jsonl": _table(spark, 5)})
    assert after.version == v + 1 and bundle.damaged(spark, after) == []


def test_damage_is_seen(spark, tmp_path):
    root = f"{tmp_path}/b"
    assert bundle.current(spark, root) is None and bundle.recover(spark, root) == []
    made = bundle.write(spark, root, _texts(1), {"items.jsonl": _table(spark, 1), "none.jsonl": _table(spark, 1).filter("false")})
    assert bundle.current(spark, root) == made and bundle.damaged(spark, made) == []
    with open(f"{made.path}/digest.md", "a") as f:
        f.write("x")
    part = next(n for n in os.listdir(f"{made.path}/items.jsonl") if n.startswith("part-"))
    os.remove(f"{made.path}/items.jsonl/{part}")
    os.remove(f"{made.path}/sub/manifest.json")
    for d, _, names in os.walk(made.path):
        for n in names:
            if n.endswith(".crc"):
                os.remove(os.path.join(d, n))
    assert bundle.damaged(spark, made) == ["digest.md", "items.jsonl", "sub/manifest.json"]


def test_look_ups_read_one_bucket(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.range(5000).select(F.when(F.col("id") % 500 != 0, F.concat(F.lit("k"), F.col("id") % 700)).alias("k"), "id", (F.col("id") % 7).alias("place"))
    keyed.write(rows, path, "k", order=["place"], buckets=16)
    whole = len(spark.read.parquet(path).inputFiles())
    for value in ("k5", "k699", "nothing", None):
        got = keyed.look_up(spark, path, "k", [value], buckets=16)
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in rows.filter(F.col("k").eqNullSafe(F.lit(value))).collect())
        scan = got._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in scan and "_bucket" in scan.split("PartitionFilters: [")[1].split("]")[0]
        read = {r.f for r in got.select(F.input_file_name().alias("f")).distinct().collect()}
        assert len(read) <= 1 < whole == 16
    several = keyed.look_up(spark, path, "k", ["k5", "k6", None], buckets=16)
    assert several.count() == rows.filter("k IN ('k5', 'k6') OR k IS NULL").count()
    assert [(r.place, r.id) for r in keyed.children(spark, path, "k", "k5", ["place", "id"], buckets=16).collect()] == sorted((i % 7, i) for i in range(5000) if i % 700 == 5 and i % 500)
    keys = spark.createDataFrame([("k5",), ("k5",), ("zz",)], "k string")
    assert keyed.look_up_all(spark.read.parquet(path), keys, "k", buckets=16).count() == rows.filter("k = 'k5'").count()


def test_a_hot_key_is_spread(spark, tmp_path):
    rows = spark.range(4000).select(F.lit("hot").alias("k"), "id")
    keyed.write(rows, f"{tmp_path}/t", "k", buckets=4, files=3)
    sizes = [r.n for r in spark.read.parquet(f"{tmp_path}/t").groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 4000 and len(sizes) > 1 and keyed.look_up(spark, f"{tmp_path}/t", "k", ["hot"], buckets=4).count() == 4000
