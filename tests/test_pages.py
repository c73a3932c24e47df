"""Page parsing and project operators on small literals."""

import datetime
import json

from pyspark.sql import functions as F

from newsloom.operators import projects
from newsloom.sources import pages

ROW = '<article class="Box-row"><h2><a href="/{0}">x</a></h2><p>A <b>tool</b></p><span itemprop="programmingLanguage">Go</span><a href="/{0}/stargazers">1.5k</a><a href="/{0}/forks">12</a> 1,234 stars this week</article>'


def test_trending(spark):
    html = ROW.format("Own/Repo") + ROW.format("sponsors/x") + ROW.format("a/b")
    rows = pages.trending(spark.createDataFrame([("t", "weekly", html), ("u", "daily", None)], "source_id string, period string, body string")).orderBy("rank").collect()
    assert [(r["rank"], r.external_id, r.stars, r.forks, r.stars_since, r.summary, r.language) for r in rows] == [(1, "github_repo:own/repo", 1500, 12, 1234, "A tool", "Go"), (3, "github_repo:a/b", 1500, 12, 1234, "A tool", "Go")]


def test_article_and_figures(spark):
    df = spark.createDataFrame([("<main>short</main><article><p>a longer</p><p>body</p></article>", "12 upvotes, comments: 1,004")], "h string, t string")
    r = df.select(pages.article_text(F.col("h")).alias("a"), pages.article_text(F.lit("<p>x</p>")).alias("none"), pages.engagement(F.col("t"), "upvote").alias("u"), pages.engagement(F.col("t"), "comment").alias("c"), pages.content_depth(F.lit(" "), F.col("t")).alias("d"), pages.pushed_query(F.lit("ai"), F.lit(datetime.date(2024, 1, 2))).alias("q")).first()
    assert (r.a, r.none, r.u, r.c, r.d, r.q) == ("a longer\nbody", None, 12, 1004, "summary", "ai pushed:>2024-01-02")


def test_report(spark):
    rows = [("a", "weekly", 2, 5, 10, None), ("b", "weekly", 1, 5, 10, None), ("a", "daily", 1, 1, 1, None), ("c", "daily", 2, 9, 1, None), ("d", None, None, None, 7, "x"), ("e", None, None, None, 9, None)]
    df = spark.createDataFrame(rows, "external_id string, period string, rank int, stars_since int, stars int, pushed_at string")
    assert {(r.section, r.place, r.external_id) for r in projects.report(df).collect()} == {("weekly", 1, "b"), ("weekly", 2, "a"), ("daily", 2, "c"), ("search", 1, "e"), ("search", 2, "d")}


def test_merges(spark):
    r = spark.range(1).select(
        projects.ordered_union(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("a"), F.lit("c"))).alias("u"),
        projects.best_period(F.create_map(F.lit("daily"), F.struct(F.lit(5).alias("stars_since")), F.lit("weekly"), F.struct(F.lit(5).alias("stars_since")))).alias("p"),
        projects.risk_flags(F.lit(True), F.lit(False), F.lit(None), F.lit("x"), F.array(F.lit("archived"), F.lit("y"))).alias("f"),
    ).first()
    assert (r.u, r.p, r.f) == (["b", "a", "c"], "weekly", ["archived", "missing_license", "y"])


def test_article_body_is_whole_by_source(spark):
    long = "word " * 5000 + "end"
    inner = f"<div><p>{long}</p></div><div>last</div>"
    want = long + "\nlast"
    pages_of = {
        "google_deepmind_blog": f'<div class="rich-text">no</div><main><div class="a rich-text b">{inner}</div>x</main>',
        "huggingface_blog": f"<!-- <div class='blog-content'>no</div> --><div class='blog-content'>{inner}</div><div>x</div>",
        "openrouter_blog": f'<article>x<section class="prose-blog">{inner}</section>x</article>',
        "google_research_blog": f"<main id=m>{inner}</main><p>x</p>",
        "nvidia_ai_blog": f"<article-x>no</article-x><article>{inner}</article><article>x</article>",
        "nvidia_ai_platforms_news": f'<div class="article-body-top">no</div><div class="article-body">{inner}</div><div>x</div>',
        "google_blog_ai": f'<article><div class=rich-text>{inner}</div>x</article>',
        "langchain_blog": f'<div class="blog-post-content">{inner}</div>x',
        "google_developers_blog": f'<div class="rich-content">{inner}</div>x',
        "ithome_ai_news": f'<div id="paragraph">{inner}</div>x',
        "the_decoder_ai_news": f'<div class="entry-content">{inner}</div>x',
        "hacker_news_ai": f"<article>short</article><main>{inner}</main>",
        "techcrunch_ai": json.dumps({"content": {"rendered": inner}}),
    }
    rows = [*pages_of.items(), ("huggingface_blog_2", "<main>x</main>"), ("langchain_blog", "<p>x</p>"), ("techcrunch_ai", "{"), ("langchain_blog", None)]
    got = spark.createDataFrame(rows, "s string, h string").select("s", pages.article_body(F.col("s"), F.col("h")).alias("t")).collect()
    assert {r.s: r.t for r in got[: len(pages_of)]} == dict.fromkeys(pages_of, want)
    assert [r.t for r in got[len(pages_of) :]] == [None] * 4
    ids = spark.createDataFrame([("https://t.co/2024/?p=12",), ("https://t.co/9?a=1&p=34#p=5",), ("https://t.co/77",), ("https://t.co/?p=x&p=1",), (None,)], "u string")
    assert [r[0] for r in ids.select(pages.wordpress_post_id(F.col("u"))).collect()] == [12, 34, None, None, None]
