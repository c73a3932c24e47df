"""Article bodies, listings joined to their articles, and trending lists, from landed pages as trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, text
from . import tree
from .pages import NOT_OWNERS

# Where a source's article stands, and what is taken out of posts.
SELECTORS = {
    "google_deepmind_blog": "main .rich-text",
    "huggingface_blog": ".blog-content",
    "openrouter_blog": "article .prose-blog",
    "google_research_blog": "main",
    "nvidia_ai_blog": "article",
    "nvidia_ai_platforms_news": ".article-body",
    "google_blog_ai": "article .rich-text",
    "langchain_blog": ".blog-post-content",
    "google_developers_blog": ".rich-content",
    "ithome_ai_news": "#paragraph",
    "the_decoder_ai_news": ".entry-content",
}
LARGEST, POSTS, PROMOTIONS = "hacker_news_ai", "techcrunch_ai", ".ad-unit, .jw-player-inline-promo"


def bodies(landed: DataFrame, body: str = "body") -> DataFrame:
    """landed (source_id, body, …) with `article`: the article's blocks of text by its source's rule. A source of pages has a
    selector, of which the first match counts; one has the longer of its articles and mains; posts come as JSON. Null for
    other sources, and where nothing is found."""
    page = F.when(F.col("source_id") == POSTS, F.get_json_object(body, "$.content.rendered")).otherwise(F.col(body))
    rows = tree.with_tree(landed.withColumn("_page", page), "_page", "_tree")
    t = F.col("_tree")
    sized = F.transform(F.concat(tree.select(t, "article"), tree.select(t, "main")), lambda n: F.struct(F.length(tree.text(t, n)).alias("size"), n.alias("node")))
    largest = F.aggregate(sized, F.lit(None).cast(f"struct<size:int,node:{tree.NODE}>"), lambda best, x: F.when(best.isNull() | (x["size"] > best["size"]), x).otherwise(best))["node"]
    out = F.when(F.col("source_id") == POSTS, tree.block_text(t, tree.whole(t), PROMOTIONS)).when(F.col("source_id") == LARGEST, tree.block_text(t, largest))
    for source, selector in SELECTORS.items():
        out = out.when(F.col("source_id") == source, tree.block_text(t, tree.first(t, selector)))
    return rows.withColumn("article", out).drop("_page", "_tree")


def joined_url(base: Column, href: Column) -> Column:
    """A reference as its page's address completes it: whole ones as they are, then by scheme, host, path or query; dots in paths resolved."""
    origin, scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, "^(.*/)", 1))
    to, rest = F.regexp_extract(href, "^([^?#]*)", 1), F.regexp_extract(href, "^[^?#]*(.*)$", 1)
    full = F.when(to.startswith("/"), to).otherwise(F.concat(folder, to))
    parts = F.slice(F.split(full, "/"), 2, 1 << 20)
    none = F.array().cast("array<string>")
    kept = F.aggregate(parts, none, lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.array_append(acc, x)))
    slash = F.when(full.rlike(r"/\.{1,2}$"), "/").otherwise("")
    solved = F.concat(origin, F.lit("/"), F.array_join(kept, "/"), F.when(F.size(kept) > 0, slash).otherwise(F.lit("")), rest)
    return F.when(href == "", base).when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href)).when(to == "", F.concat(F.when(rest.startswith("#"), F.regexp_extract(base, "^([^#]*)", 1)).otherwise(F.regexp_extract(base, "^([^?#]*)", 1)), rest)).otherwise(solved)


def listed_articles(listings: DataFrame, articles: DataFrame, links: str, limit: int = 20) -> DataFrame:
    """(source_id, listing_url, position, external_id, title, url, content) of the first `limit` links of each listing that
    match, with their articles' text (the first main, else the first article); a link whose article hasn't landed or has
    no text gives no row, one that stands there twice two. listings: (source_id, url, body); articles: (url, body), one row a url."""
    rows = tree.with_tree(listings.select("source_id", F.col("url").alias("listing_url"), "body"), "body")
    t = F.col("tree")
    found = F.slice(tree.select(t, links), 1, limit)
    told = F.transform(found, lambda n: F.struct(F.coalesce(tree.attribute(n, "href"), F.lit("")).alias("href"), tree.text(t, n).alias("title")))
    each = rows.select("source_id", "listing_url", F.posexplode(told).alias("at", "link")).select("source_id", "listing_url", (F.col("at") + 1).alias("position"), joined_url(F.col("listing_url"), F.col("link.href")).alias("url"), F.col("link.title").alias("title"))
    read = tree.with_tree(articles.select("url", "body").join(each.select("url").distinct(), "url", "left_semi"), "body")
    content = tree.block_text(t, F.coalesce(tree.first(t, "main"), tree.first(t, "article")))
    texts = read.select("url", content.alias("content")).filter("content is not null")
    return each.join(texts, "url").select("source_id", "listing_url", "position", F.col("url").alias("external_id"), "title", "url", "content")


_SINCE = {"daily": "today", "weekly": r"this\s+week", "monthly": r"this\s+month"}


def trending(landed: DataFrame, limit: int = 100) -> DataFrame:
    """(source_id, period, rank, full_name, url, summary, language, stars, forks, stars_since, external_id) of listed
    repositories, ranked as they stand among the page's first `limit` rows. landed: (source_id, period, body)."""
    rows = tree.with_tree(landed.select("source_id", F.coalesce("period", F.lit("daily")).alias("period"), "body"), "body")
    t = F.col("tree")
    rows = rows.select("source_id", "period", "tree", F.posexplode(F.slice(tree.select(t, "article.Box-row"), 1, limit)).alias("at", "row"))
    r, shown = F.col("row"), lambda n: text.trimmed_or_null(tree.text(t, n))
    parts = F.filter(F.split(F.regexp_extract(tree.attribute(tree.first(t, "h2 a, h3 a", r), "href"), r"^(?:https?://[^/?#]*)?([^?#]*)", 1), "/"), lambda p: p != "")
    figure = lambda what: F.coalesce(numbers.suffixed(tree.text(t, tree.first(t, f'a[href*="/{what}"]', r))), F.lit(0.0)).cast("long")
    told = tree.text(t, r)
    stars = lambda words: F.regexp_extract(told, rf"(?i)([0-9][0-9,]*(?:\.[0-9]+)?[km]?)\s+stars?\s+{words}", 1)
    said = F.when(F.col("period") == "weekly", stars(_SINCE["weekly"])).when(F.col("period") == "monthly", stars(_SINCE["monthly"])).otherwise(stars(_SINCE["daily"]))
    beside = F.get(F.filter(F.transform(tree.select(t, ".float-sm-right", r), lambda n: numbers.suffixed(tree.text(t, n))), lambda v: v.isNotNull()), F.lit(0))
    since = F.coalesce(F.when(said != "", numbers.suffixed(said)).otherwise(beside), F.lit(0.0)).cast("long")
    out = rows.select("source_id", "period", (F.col("at") + 1).alias("rank"), parts.alias("parts"), shown(tree.first(t, "p", r)).alias("summary"), shown(tree.first(t, "[itemprop='programmingLanguage']", r)).alias("language"), figure("stargazers").alias("stars"), figure("forks").alias("forks"), since.alias("stars_since"))
    ours = (F.size("parts") == 2) & ~F.exists("parts", lambda p: p.isin(*NOT_OWNERS))
    name = F.array_join("parts", "/")
    return out.filter(ours).select("source_id", "period", "rank", name.alias("full_name"), F.concat(F.lit("https://github.com/"), name).alias("url"), "summary", "language", "stars", "forks", "stars_since", F.concat(F.lit("github_repo:"), F.lower(name)).alias("external_id"))
