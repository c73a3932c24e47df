"""Sources, sinks and streams on small landed payloads."""

import json
import os

from pyspark.sql import functions as F

from newsloom.functions import text, urls
from newsloom.operators import ranking
from newsloom.plans import publish
from newsloom.sources import feeds
from newsloom.streaming import gate

RSS = "<rss><channel><item><title>A</title><link>http://x/a</link><guid>1</guid><pubDate>Mon</pubDate></item><item><title>B</title><link>http://x/b</link></item></channel></rss>"
ATOM = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><id>t:1</id><title>C</title><link rel='alternate' href='http://x/c'/><updated>now</updated><summary>s</summary></entry></feed>"


def test_feeds(spark):
    landed = spark.createDataFrame([("r", RSS, 1), ("a", ATOM, 5), ("bad", "<x", 5), ("none", None, 5)], "source_id string, body string, item_limit int")
    rows = {(r.source_id, r.position, r.title, r.url) for r in feeds.feed_items(landed).collect()}
    assert rows == {("r", 1, "A", "http://x/a"), ("a", 1, "C", "http://x/c")}


def test_repositories_and_releases(spark):
    body = json.dumps({"items": [{"full_name": "O/R", "html_url": "u", "stargazers_count": 3, "topics": ["t"]}, {"full_name": "a/b"}]})
    rows = feeds.repositories(spark.createDataFrame([("g", body), ("bad", "{")], "source_id string, body string")).collect()
    assert [(r.position, r.external_id, r.stars) for r in rows] == [(1, "github_repo:o/r", 3), (2, "github_repo:a/b", None)]
    rel = feeds.releases(spark.createDataFrame([("g", json.dumps([{"id": 7, "tag_name": "v1"}]))], "source_id string, body string")).collect()
    assert [(r.external_id, r.title) for r in rel] == [("github_release:7", "v1")]


def test_registry(spark):
    rows = spark.createDataFrame([("b", True, 1, "http://b"), ("a", True, 1, "http://a"), ("c", False, 0, "http://c"), ("d", True, 0, "${HUB}/d")], "id string, enabled boolean, priority int, url string")
    on, skipped = feeds.registry(rows)
    assert [r.id for r in on.collect()] == ["a", "b"] and [r.id for r in skipped.collect()] == ["d"]


def test_edition_replaced_and_promoted(spark, tmp_path):
    p = str(tmp_path / "editions")
    make = lambda rows: spark.createDataFrame(rows, "edition_date string, display_order int, title string")
    publish.replace_edition(make([("d1", 1, "x"), ("d2", 1, "y")]), p)
    publish.replace_edition(make([("d2", 1, "z")]), p)
    assert {(r.edition_date, r.title) for r in spark.read.parquet(p).collect()} == {("d1", "x"), ("d2", "z")}
    publish.export_jsonl(make([("d", 2, "b"), ("d", 1, "a")]), str(tmp_path / "stage"))
    publish.promote(spark, str(tmp_path / "stage"), str(tmp_path / "final"))
    assert [r.title for r in feeds.json_lines(spark, str(tmp_path / "final"), "title string").collect()] == ["a", "b"]
    assert not os.path.exists(tmp_path / "stage")


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:01"), (2, "2024-01-01 00:00:02")], "id int, ts string").select("id", F.to_timestamp("ts").alias("ts")).write.parquet(src)
    stream = gate.deduplicated(spark.readStream.schema("id int, ts timestamp").parquet(src), ["id"], "ts").withColumn("day", F.to_date("ts"))
    gate.write_batches(stream, str(tmp_path / "out"), str(tmp_path / "check"), "day").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_functions(spark):
    row = spark.createDataFrame([("HTTP://WWW.Ex.com:80/a/?b=2&utm_x=1&a=1#f", "<p>x <b>y</b></p><script>z</script>")], "u string, h string").select(urls.envelope_url(F.col("u")).alias("e"), urls.event_url(F.col("u")).alias("i"), text.without_tags(F.col("h")).alias("t")).first()
    assert (row.e, row.i, row.t) == ("http://www.ex.com/a?b=2&a=1", "http://www.ex.com/a?a=1&b=2", "x y")


def test_rank_over_whole_table(spark):
    rows = ranking.ranked(spark.range(1000).withColumn("k", F.col("id") % 7), [F.asc("k"), F.asc("id")], "rank").collect()
    want = sorted(range(1000), key=lambda i: (i % 7, i))
    assert [r.id for r in sorted(rows, key=lambda r: r["rank"])] == want
