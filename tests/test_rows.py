"""Rows by key in a defined order, listings, feed entries, requests, failure classes."""

import datetime
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from newsloom.operators import events, listing, policy, state
from newsloom.plans import requests
from newsloom.sources import entries




@pytest.mark.parametrize("parts", [1, 7])
def test_several_changes_of_a_key_go_by_their_order(spark, parts):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (None, "n", 0)], "item_id int, status string, at int")
    new = spark.createDataFrame([(2, s, t) for t, s in enumerate("zyxw")] + [(3, "q", 5), (3, "p", 5), (3, "r", 1)], "item_id int, status string, at int").repartition(parts)
    got = {r.item_id: r.status for r in state.last_rows(old, new, ["item_id"], ["at"]).collect()}
    assert got == {1: "a", None: "n", 2: "w", 3: "q"}  # of a tie the greater as text
    assert {r.item_id: r.status for r in state.with_status(old, new, "item_id", ["at"]).collect()} == {1: "a", None: "n", 2: "w"}
    items = spark.createDataFrame([(1, "s", "g", "c", "u", "t")], "item_id int, source_id string, source_group string, canonical_url string, source_url string, title string")
    fields = "event_id int, item_id int, source_id string, source_group string, source_url string, source_title string, identity_key string, match_type string, is_primary boolean"
    row = lambda e, i: (e, i, None, None, None, None, None, None, None)
    moves = spark.createDataFrame([(*row(e, 1), t) for t, e in enumerate([9, 4, 7])], fields + ", at int").repartition(parts)
    assert [r.event_id for r in state.event_members(spark.createDataFrame([row(1, 1)], fields), moves, items, ["at"]).collect()] == [7]


def test_null_keys_are_keys(spark):
    old = spark.createDataFrame([(None, "a", "candidate"), (1, "b", "candidate")], "k int, a string, status string")
    new = spark.createDataFrame([(None, "a"), (2, "c")], "k int, a string")
    got = {r.k: (r.a, r.status) for r in state.upsert(old, new, ["k"], ["a"], [], ["a"]).collect()}
    assert got == {None: ("a", "candidate"), 1: ("b", "candidate"), 2: ("c", "new")}
    side = lambda rows: spark.createDataFrame(rows, "k int, sources array<string>, score int, first_seen int, last_seen int")
    got = state.merged_events(side([(None, ["a"], 1, 5, 5)]), side([(None, ["b"], 2, 3, 9)]), "k").collect()
    assert [tuple(r) for r in got] == [(None, ["a", "b"], 2, 3, 9)]


def test_finished_fetches(spark):
    fields = "source_id string, attempt_id int, status string, items_fetched long, http_status int, error_code string, error_message string, finished_at timestamp"
    t = datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("s", 1, "failed", 0, 500, "x", "x", t), ("s", 2, "running", 0, None, None, None, None), ("s", 3, "running", 0, None, None, None, None), ("u", 4, "running", 0, None, None, None, None)], fields)
    done = spark.createDataFrame([(2, "skipped", 0, None, None), (3, "failed", 0, 503, "e503: down")], "attempt_id int, status string, items_fetched long, http_status int, error string")
    ended, sources = state.finished_fetches(spark.createDataFrame([("s",), ("u",)], "id string"), rows, done, F.lit("2024-01-02").cast("timestamp"))
    assert {r.attempt_id: (r.status, r.error_code) for r in ended.collect()} == {1: ("failed", "x"), 2: ("skipped", None), 3: ("failed", "e503"), 4: ("running", None)}
    assert {r.id: (r.health_status, r.consecutive_failures) for r in sources.collect()} == {"s": ("failed", 2), "u": ("unknown", 0)}


def test_materialised_unites_over_members(spark):
    item = lambda i, ext, src: (i, ext, None, f"https://e.org/{i}", f"t{i}", None, datetime.datetime(2024, 1, i), "news_media", src, "g" if i % 2 else " ", 10 * i)
    items = spark.createDataFrame([item(1, "a", "s1"), item(2, "b", "s2"), item(3, "b", "s1"), item(4, "zz", "s3")], "item_id int, external_id string, canonical_url string, source_url string, title string, published_at timestamp, captured_at timestamp, content_class string, source_id string, source_group string, b1_priority int")
    drafts = spark.createDataFrame([(1, " ", "T"), (2, "k", "U"), (3, "k", "V")], "draft_id int, draft_key string, title string")
    members = spark.createDataFrame([(1, 2), (1, 1), (2, 4)], "draft_id int, item_id int")
    reviews = spark.createDataFrame([(1, ["x", None, "y"], [("n", "company")]), (2, ["y", "z", " "], [("n", "company"), ("m", "person")]), (3, ["w"], None)], "item_id int, keywords array<string>, entities array<struct<name:string,type:string>>")
    got = {r.draft_id: r for r in events.materialised(drafts, members, items, items.filter("item_id = 3"), reviews).collect()}
    one = got[1]
    assert (one.item_ids, one.keywords, [tuple(e) for e in one.entities], one.source_ids, one.source_groups) == ([1, 2, 3], ["x", "y", "z", "w"], [("n", "company"), ("m", "person")], ["s1", "s2"], ["g"])
    assert one.event_key == "external:b" and one.primary_item_id == 3 and one.display_score == 30 and one.identity_keys[0] == "external:a"
    assert got[2].event_key == "k" and got[2].keywords == [] and got[2].entities == [] and 3 not in got
    bare = events.materialised(drafts, members, items, items.filter("false")).filter("draft_id = 1").first()
    assert bare.item_ids == [1, 2] and bare.keywords == []


def test_listings(spark):
    ev = spark.createDataFrame([(1,), (2,), (3,)], "event_id int")
    mem = spark.createDataFrame([(1, 7, 2), (1, 8, 1), (2, 99, 1), (1, 7, 3)], "event_id int, item_id int, at int")
    items = spark.createDataFrame([(7, "a"), (8, "b")], "item_id int, title string")
    proof = spark.createDataFrame([(1, 5, "u"), (1, 4, "v"), (3, 1, "w")], "event_id int, n int, url string")
    got = {r.event_id: ([(m["at"], m.title) for m in r.members], r.n_members, [(e.n, e.url) for e in r.evidence]) for r in listing.nested_members(ev, mem, items, order=["at"], fields=["title"], evidence=proof, evidence_order=["n"]).collect()}
    assert got == {1: ([(1, "b"), (2, "a"), (3, "a")], 3, [(4, "v"), (5, "u")]), 2: ([], 0, []), 3: ([], 0, [(1, "w")])}
    assert {r.event_id: r.n for r in listing.counted(ev, mem, "event_id").collect()} == {1: 3, 2: 1, 3: 0}
    ids = spark.createDataFrame([(1, 8), (2, 5), (3, 7), (4, 8)], "position int, item_id int")
    found, missing = listing.in_list_order(items, "item_id", ids)
    assert sorted((r.place, r.item_id) for r in found.collect()) == [(1, 8), (3, 7)] and [(r.item_id, r.place) for r in missing.collect()] == [(5, 2)]
    page, total = listing.member_feed(mem, item="item_id", score="at", first=["at", "event_id"], limit=2, offset=1)
    assert [(r.item_id, r["at"]) for r in page.collect()] == [(8, 1), (99, 1)] and total.first().total == 3
    numbered = listing.next_numbers(spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "event_id int, v string"), proof.withColumnRenamed("n", "seq"), "event_id", "seq", [F.asc("v")])
    assert sorted((r.event_id, r.v, r.seq) for r in numbered.collect()) == [(1, "x", 6), (1, "y", 7), (2, "z", 1)]
    assert [r["values"] for r in listing.united(mem, "event_id", "item_id", ["at"]).filter("event_id = 1").collect()] == [[8, 7]]
    assert tuple(listing.fetch_totals(spark.createDataFrame([], "status string, items_fetched int, items_inserted int, items_skipped int")).first()) == (0, 0, 0, 0, 0, 0)


RSS = """<rss xmlns:content="http://c" xmlns:dc="http://d"><channel><title>feed</title>
<item><title> One &amp; two </title><link>https://e.org/1</link><guid>g1</guid><description>&lt;p&gt;sum&lt;/p&gt;</description><content:encoded>&lt;p&gt;Full  text , here&lt;/p&gt;&lt;div&gt;x&lt;/div&gt;</content:encoded><dc:creator>Ann</dc:creator><pubDate>Mon, 15 Jan 2024 10:30:00 +0100</pubDate><category>a</category><category>b</category></item>
<item><title/><description>line  one
 two


three</description><pubDate>nonsense</pubDate><updated>Jan 5, 2024</updated></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>a1</id><title>T</title><link rel="self" href="https://s"/><link href="https://e.org/a"/><author><name></name><email>m@e.org</email></author><summary>s</summary><content type="html">&lt;b&gt;c&lt;/b&gt;</content><published>2024-01-15T10:30:00Z</published></entry></feed>"""


def test_feed_entries(spark):
    landed = spark.createDataFrame([("rss", RSS, 9), ("atom", ATOM, 9), ("short", RSS, 1), ("none", RSS, 0), ("bad", "<rss", 9), ("null", None, 9)], "source_id string, body string, item_limit int")
    got = {(r.source_id, r.position): r for r in entries.parsed(landed, F.lit("2024-05-31").cast("timestamp")).collect()}
    assert set(got) == {("rss", 1), ("rss", 2), ("atom", 1), ("short", 1)}
    one, two, atom = got["rss", 1], got["rss", 2], got["atom", 1]
    assert (one.external_id, one.title, one.link, one.author, one.raw_summary, one.content_depth, one.published_at) == ("g1", "One & two", "https://e.org/1", "Ann", "<p>sum</p>", "full", datetime.datetime(2024, 1, 15, 9, 30))
    assert json.loads(one.raw_payload)["category"] == ["a", "b"] and one.content_hash == hashlib.sha256("\n".join(["one & two", "https://e.org/1", one.raw_summary, one.raw_content]).encode()).hexdigest()
    assert (two.external_id, two.title, two.link, two.author, two.raw_content, two.content_depth, two.published_at) == (None, "(untitled)", None, None, None, "summary", datetime.datetime(2024, 1, 5))
    assert (atom.external_id, atom.link, atom.author, atom.raw_content, atom.published_at) == ("a1", "https://e.org/a", "m@e.org", "<b>c</b>", datetime.datetime(2024, 1, 15, 10, 30))


def test_entries_by_their_source(spark):
    raw = "source_id string, position int, external_id string, title string, link string, author string, published_at timestamp, raw_summary string, raw_content string, raw_payload string, content_hash string"
    made = lambda s, i, summary, content: (s, i, "x", "t", "l", None, None, summary, content, "{}", "h")
    rows = [made("feed", 1, "s", "<p>a</p><p>b</p>"), made("feed", 2, "s", None), made("feed", 3, None, None), made("google_blog_ai", 1, "s", "c"), made("openai_news", 1, None, "c"), made("rss", 1, "line  one &amp;\r\n\n\n\ntwo ", "c"), made("rss", 2, None, "c"), made("linux_do_hot", 1, "<b>s</b>", None)]
    sources = spark.createDataFrame([("rss", "rsshub"), ("feed", "feed")], "id string, transport string")
    got = {(r.source_id, r.position): (r.content, r.content_depth) for r in entries.domain_items(spark.createDataFrame(rows, raw), sources).collect()}
    assert got == {("feed", 1): ("a\n\nb", "full"), ("feed", 2): (None, "summary"), ("feed", 3): (None, "missing"), ("google_blog_ai", 1): (None, "summary"), ("openai_news", 1): (None, "missing"), ("rss", 1): ("line one &\n\ntwo", "full"), ("rss", 2): (None, "missing"), ("linux_do_hot", 1): ("s", "full")}


@pytest.mark.parametrize(("given", "want"), [
    ((429, None, None, None, False), (True, "provider_retryable", "429")), ((500, "c", "schema", None, False), (True, "provider_retryable", "500")), ((None, "x", "Service Unavailable", None, False), (True, "provider_retryable", "x")),
    ((408, "c", "timed out", None, False), (True, "provider_retryable", "c")), ((None, None, None, "TimeoutError", False), (True, "provider_retryable", "timeout")), ((400, "c", "Schema mismatch", None, False), (False, "schema", "400")),
    ((401, "c", None, None, False), (False, "provider_auth", "401")), ((404, None, "bad AUTH", None, False), (False, "provider_auth", "404")), ((404, "c", "gone", None, False), (False, "provider_blocked", "404")), ((None, None, "x", "ValueError", False), (False, "schema", "ValueError")),
    ((None, None, "missing required", None, False), (False, "schema", "schema_error")), ((None, "odd", None, None, False), (False, "provider_blocked", "odd")), ((None, None, None, None, None), (False, "provider_blocked", "provider_error")), ((429, "c", None, None, True), (False, "provider_retry_exhausted", "c")),
])
def test_failure_classes(spark, given, want):
    df = spark.createDataFrame([given], "status int, code string, message string, kind string, gone boolean")
    again, category, code = policy.failure_class(*map(F.col, df.columns))
    assert tuple(df.select(again, category, code).first()) == want


def test_requests(spark):
    rows = spark.createDataFrame([(1, 2, 10, "b", None), (1, 1, 11, 'a"é', "x"), (2, 1, 12, "c", None)], "run_id int, display_order int, event_id int, title string, topic string")
    made = requests.selection_requests(rows, ["event_id", "title", "topic"], max_selected=3)
    got = {r.run_id: r for r in made.collect()}
    assert json.loads(got[1].body) == {"max_selected": 3, "candidate_events": [{"event_id": 11, "title": 'a"é', "topic": "x"}, {"event_id": 10, "title": "b"}]}
    assert got[1].n_events == 2 and got[1].body_bytes == len(got[1].body.encode()) and got[1].body_sha256 == hashlib.sha256(got[1].body.encode()).hexdigest()
    again = requests.repair_requests(made, spark.createDataFrame([(1, "{", "bad"), (2, "{}", " ")], "run_id int, answer string, error string")).collect()
    assert [r.run_id for r in again] == [1] and json.loads(again[0].body.split("\n")[1]) == {"validation_error": "bad", "previous_answer": "{"}
