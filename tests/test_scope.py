"""Frozen scopes: appended input changes nothing, nothing is copied, late members are refused, stale results left out."""

import datetime
import os

import pytest

from newsloom.plans import scope

AT = datetime.datetime(2024, 1, 2, tzinfo=datetime.timezone.utc)


@pytest.fixture
def build(spark, tmp_path):
    table = f"{tmp_path}/items"
    spark.range(100).selectExpr("id AS item_id", "concat('s', id % 3) AS source_id", "id % 2 AS day").write.partitionBy("day").parquet(table)
    members = spark.read.parquet(table).filter("item_id < 60").select("item_id", "source_id")
    return str(tmp_path), table, members


def test_appended_input_changes_nothing(spark, build):
    root, table, members = build
    kept = scope.freeze(spark, root, "b1", {"items": table}, members, AT)
    before = sorted(map(tuple, kept.table("items").collect()))
    spark.range(100, 150).selectExpr("id AS item_id", "'new' AS source_id", "id % 2 AS day").write.mode("append").partitionBy("day").parquet(table)
    again = scope.frozen(spark, root, "b1")
    assert spark.read.parquet(table).count() == 150 and sorted(map(tuple, again.table("items").collect())) == before and len(before) == 100
    assert again.members().count() == 60 and again.reference_time == AT and again.table("items").columns == spark.read.parquet(table).columns
    files = [f for d, _, fs in os.walk(f"{root}/scope") for f in fs if f.endswith(".parquet")]
    assert sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(f"{root}/scope") for f in fs if f.endswith(".parquet")) < 20_000 and files  # keys only


def test_membership_is_frozen(spark, build):
    root, table, members = build
    assert scope.frozen(spark, root, "b1") is None
    scope.freeze(spark, root, "b1", {"items": table}, members, AT)
    same = scope.freeze(spark, root, "b1", {"items": table}, members.repartition(7).union(members), AT + datetime.timedelta(days=1))
    assert same.reference_time == AT
    with pytest.raises(scope.ScopeFrozen):
        scope.freeze(spark, root, "b1", {"items": table}, members.filter("item_id < 59"), AT)
    scope.freeze(spark, root, "b2", {"items": table}, members.filter("item_id < 59"), AT)
    assert scope.frozen(spark, root, "b1").members().count() == 60


def test_a_changed_file_is_an_error(spark, build):
    root, table, members = build
    kept = scope.freeze(spark, root, "b", {"items": table}, members, AT)
    one = kept.manifest["tables"]["items"]["files"][0][0].removeprefix("file:").replace("//", "/")
    os.rename(one, one + ".gone")
    with pytest.raises(FileNotFoundError):
        kept.table("items")
    with open(one, "wb") as f:
        f.write(b"x")
    with pytest.raises(FileNotFoundError):
        kept.table("items")


def test_a_half_written_manifest_freezes_nothing(spark, build):
    root, table, members = build
    os.makedirs(f"{root}/scope/build=b")
    with open(f"{root}/scope/build=b/manifest-x.staging", "w") as f:
        f.write('{"tab')
    assert scope.frozen(spark, root, "b") is None
    assert scope.freeze(spark, root, "b", {"items": table}, members, AT).members().count() == 60


def test_late_members_and_stale_results(spark, build):
    _, _, members = build
    items = spark.range(80).selectExpr("id AS item_id", "CASE WHEN id = 7 THEN 'other' WHEN id = 8 THEN NULL ELSE 'b' END AS build", "concat('f', id) AS fingerprint")
    new = spark.createDataFrame([(1, "x"), (7, "x"), (8, "x"), (61, "x"), (500, "x"), (None, "x")], "item_id bigint, status string")
    fine, refused = scope.admitted(new, items, members, "b")
    assert [tuple(r) for r in fine.collect()] == [(1, "x")]
    assert {r.item_id: r.reason for r in refused.collect()} == {7: "other_build", 8: "other_build", 61: "scope_frozen", 500: "item_missing", None: "item_missing"}
    assert scope.admitted(new, items, members, "b", is_frozen=False)[0].count() == 2
    results = spark.createDataFrame([(1, "succeeded", "f1"), (2, "succeeded", "old"), (3, "failed", "f3"), (4, "succeeded", None), (5, "succeeded", ""), (61, "succeeded", "f61"), (6, None, "f6")], "item_id bigint, status string, input_fingerprint string")
    fine, out = scope.current(results, members, items)
    assert sorted(r.item_id for r in fine.collect()) == [1, 4, 5]
    assert {r.item_id: r.reason for r in out.collect()} == {2: "stale", 3: "not_succeeded", 61: "out_of_scope", 6: "not_succeeded"}


def test_what_is_to_run(spark):
    subjects = spark.createDataFrame([("a", "i", "c"), ("b", "i2", "c"), ("c", None, "c"), ("d", "i", None), ("e", "i", "c"), ("f", "i", "c2")], "subject string, input string, config string")
    results = spark.createDataFrame([("a", "succeeded", "i", "c"), ("b", "succeeded", "i", "c"), ("c", "succeeded", "zz", "c"), ("d", "succeeded", "i", "q"), ("e", "failed", "i", "c"), ("f", "succeeded", "i", "c")], "subject string, status string, input string, config string")
    run = lambda forced=None: sorted(r.subject for r in scope.to_run(subjects, results, forced).collect())
    assert run() == ["b", "e", "f"]
    assert run(spark.createDataFrame([("a",), ("b",), ("zz",)], "subject string")) == ["a", "b", "e", "f"]
    assert scope.to_run(subjects.filter("false"), results).isEmpty()
