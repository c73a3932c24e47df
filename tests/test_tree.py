"""Page trees: intervals, selectors, texts; articles, listings and trending lists on them."""

import json
from urllib.parse import urljoin

from pyspark.sql import functions as F

from newsloom.sources import articles, tree


def _tree(spark, *pages):
    return tree.with_tree(spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "id int, body string"), "body")


PAGE = (
    '<main><div class="rich-text first"><p>one &amp; <b>two</b> , <i>three</i> !</p></div></main><div class="rich-text">out</div>'
    '<main id="m2"><section><div class=\'a rich-text\'><h2>Head</h2><p>open<p>inner</p><ul><li>x<li>y</ul><br><img src="i.png"></div></section></main>'
    "<script>var a = '<p class=\"rich-text\">no</p>';</script><!-- <p>no</p> --></nothing><p>last"
)


def _tags(spark, selector, page=PAGE):
    df = _tree(spark, page).select(F.transform(tree.select(F.col("tree"), selector), lambda n: F.concat_ws("@", n["tag"], n["depth"].cast("string"))).alias("s"), F.transform(tree.select(F.col("tree"), selector), lambda n: tree.text(F.col("tree"), n)).alias("t"))
    return df.first()


def test_selectors(spark):
    assert _tags(spark, "main .rich-text").t == ["one & two , three !", "Head open inner x y"]
    assert _tags(spark, ".rich-text").t == ["one & two , three !", "out", "Head open inner x y"]
    assert _tags(spark, "#m2 .a li").t == ["x y", "y"]  # an item without an end holds the next
    assert _tags(spark, "section p, main b").t == ["two", "open inner x y", "inner"]
    assert _tags(spark, '[src="i.png"]').s == ["img@4"] and _tags(spark, 'img[src*=".pn"]').t == [""] and _tags(spark, "[src*='zz']").s == []
    assert _tags(spark, "p").t[-1] == "last" and _tags(spark, "script").t == [""] and _tags(spark, "main main").s == []
    assert _tags(spark, "DIV.rich-text.first p").t == ["one & two , three !"]


def test_nested_and_repeated_scopes(spark):
    page = "<article>a<article class=in>b<p>c</p></article></article><article><p>d</p></article>"
    assert _tags(spark, "article article p", page).t == ["c"] and _tags(spark, "article p", page).t == ["c", "d"] and _tags(spark, "article", page).t == ["a b c", "b c", "d"]
    row = _tree(spark, page).select(F.transform(tree.select(F.col("tree"), "article"), lambda n: F.size(tree.select(F.col("tree"), "p", n))).alias("n")).first()
    assert row.n == [1, 1, 1]


def test_blocks(spark):
    rows = _tree(spark, PAGE, None, "", "plain", "<p> </p>").select("id", tree.block_text(F.col("tree"), tree.first(F.col("tree"), "#m2 .a")).alias("a"), tree.block_text(F.col("tree"), tree.whole(F.col("tree")), ".first, ul").alias("w"), tree.block_text(F.col("tree"), tree.first(F.col("tree"), "main .rich-text")).alias("f")).orderBy("id").collect()
    assert rows[0].a == "Head\n\nopen inner x y\n\ninner\n\nx y\n\ny" and rows[0].w == "Head\n\nopen inner\n\ninner\n\nlast" and rows[0].f == "one & two, three!"
    assert all((r.a, r.w, r.f) == (None, None, None) for r in rows[1:])


def test_broken_pages(spark):
    pages = ["<p", "</", "<div><p>a</div></p>b", "<" * 50, "<a href=x>" * 300 + "t", "<p>&#0;&#xD800;&amp", "<td><br/><p/>x", "\x00<p>\n\n<b\nclass='c'>z</b>"]
    got = _tree(spark, *pages).select("id", F.expr("forall(tree.nodes, n -> n.start <= n.stop)").alias("ok"), tree.block_text(F.col("tree"), tree.whole(F.col("tree"))).alias("t"), tree.text(F.col("tree"), tree.first(F.col("tree"), "b.c")).alias("c")).orderBy("id").collect()
    assert all(r.ok for r in got) and got[2].t == "a" and got[7].c == "z"


def test_bodies_by_source(spark):
    inner = "<div><p>word word</p></div><div>not a block</div><h3>end</h3>"
    want = "word word\n\nend"
    landed = {s: f"<main><article><div id='{q.split('#')[-1]}' class='{q.split('.')[-1]}'>{inner}</div></article></main>" for s, q in articles.SELECTORS.items()}
    landed |= {"hacker_news_ai": f"<article><p>short</p></article><main>{inner}</main><article><p>tiny</p></article>", "techcrunch_ai": json.dumps({"content": {"rendered": f'<div class="ad-unit x"><p>buy</p></div>{inner}<script>x</script>'}})}
    rows = [*landed.items(), ("google_deepmind_blog", '<main>x</main><div class="rich-text"><p>no</p></div><main><p class="rich-text">the <li>second scope</li></p></main>'), ("other", "<main><p>x</p></main>"), ("techcrunch_ai", "{"), ("langchain_blog", None)]
    got = articles.bodies(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, source_id string, body string")).orderBy("i").collect()
    assert [r.article for r in got] == [want] * len(landed) + ["second scope", None, None, None]


def test_listing(spark):
    body = '<a href="/research/a">A <b>title</b></a><a href="../research/b#x">B</a><a href="/about">no</a><a href="https://o.org/research/c">C</a><a href="/research/a">again</a><a href="/research/d">D</a><a href="/research/e">past the limit</a>'
    listings = spark.createDataFrame([("s", "https://l.org/x/y?q=1", body), ("t", "https://l.org/", None)], "source_id string, url string, body string")
    landed = [("https://l.org/research/a", "<article><p>no</p></article><main><p>main a</p></main>"), ("https://l.org/research/b#x", "<article><p>b</p></article>"), ("https://o.org/research/c", "<main>no blocks</main>"), ("https://l.org/research/e", "<main><p>e</p></main>")]
    got = articles.listed_articles(listings, spark.createDataFrame(landed, "url string, body string"), 'a[href*="/research/"]', 5).orderBy("position").collect()
    assert [(r.position, r.title, r.url, r.content) for r in got] == [(1, "A title", "https://l.org/research/a", "main a"), (2, "B", "https://l.org/research/b#x", "b"), (4, "again", "https://l.org/research/a", "main a")]


def test_joined_urls(spark):
    bases = ["https://l.org/x/y?q=1#f", "http://l.org", "https://l.org/a/b/c/"]
    refs = ["", "z", "/z", "//h.org/z", "http://o.org/z", "?p=2", "#g", "../z", "../../../z", "./z", "a/./b/../c", "..", "z/", "mailto:x@y.z", "z?u=/../v", "."]
    df = spark.createDataFrame([(b, r) for b in bases for r in refs], "b string, r string")
    for row in df.select("b", "r", articles.joined_url(F.col("b"), F.col("r")).alias("u")).collect():
        want = urljoin(row.b, row.r)
        assert row.u in (want, want.rstrip("/")) and (row.u == want or row.r == ""), (row.b, row.r, row.u, want)


def test_trending(spark):
    one = '<article class="Box-row x"><h2 class="h3"><a href="/{0}"><span>Own /</span> Repo</a></h2><p>A <b>tool</b></p><span itemprop="programmingLanguage">Go</span><a href="/{0}/stargazers"><svg></svg> 1.5k</a><a href="/{0}/forks.abc">12</a><span class="d float-sm-right">{1}</span></article>'
    html = one.format("Own/Repo", "1,234 stars this week") + one.format("sponsors/x", "") + one.format("a/b?x=1", "7 stars today") + "<article><h2><a href='/no/row'>x</a></h2></article>" + one.format("a/b/c", "")
    got = articles.trending(spark.createDataFrame([("t", "weekly", html), ("u", None, html), ("v", "daily", None)], "source_id string, period string, body string")).orderBy("source_id", "rank").collect()
    assert [(r.source_id, r["rank"], r.full_name, r.external_id, r.stars, r.forks, r.stars_since, r.summary, r.language) for r in got] == [
        ("t", 1, "Own/Repo", "github_repo:own/repo", 1500, 12, 1234, "A tool", "Go"), ("t", 3, "a/b", "github_repo:a/b", 1500, 12, 0, "A tool", "Go"),
        ("u", 1, "Own/Repo", "github_repo:own/repo", 1500, 12, 0, "A tool", "Go"), ("u", 3, "a/b", "github_repo:a/b", 1500, 12, 7, "A tool", "Go"),
    ]
