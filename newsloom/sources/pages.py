"""Landed HTML pages to rows: trending listings, article bodies, engagement figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, text, unicode

#: Paths of two parts under these names aren't repositories.
NOT_OWNERS = ("trending", "sponsors", "collections")
#: Sources whose body is one element: (scope's tag or None, attribute, value), or (tag, None, None) for the tag itself.
ARTICLE_RULES = {
    "google_deepmind_blog": ("main", "class", "rich-text"),
    "huggingface_blog": (None, "class", "blog-content"),
    "openrouter_blog": ("article", "class", "prose-blog"),
    "google_research_blog": ("main", None, None),
    "nvidia_ai_blog": ("article", None, None),
    "nvidia_ai_platforms_news": (None, "class", "article-body"),
    "google_blog_ai": ("article", "class", "rich-text"),
    "langchain_blog": (None, "class", "blog-post-content"),
    "google_developers_blog": (None, "class", "rich-content"),
    "ithome_ai_news": (None, "id", "paragraph"),
    "the_decoder_ai_news": (None, "class", "entry-content"),
}


def _inner(html: Column, pattern: str) -> Column:
    """Readable text of the first match's group; null where it is empty."""
    return text.trimmed_or_null(text.collapsed(text.without_tags(F.regexp_extract(html, pattern, 1))))


def trending(landed: DataFrame) -> DataFrame:
    """(source_id, rank, full_name, …) from (source_id, period, body): a row for each listed repository, ranked as listed."""
    parts = F.regexp_extract_all("body", F.lit(r'(?is)<article[^>]*class="[^"]*Box-row[^"]*"[^>]*>(.*?)</article>'), F.lit(1))
    rows = landed.select("source_id", "period", F.posexplode(parts).alias("i", "row"))
    name = F.regexp_extract("row", r'(?is)<h[23][^>]*>.*?<a[^>]*href="/([^/"?#]+/[^/"?#]+)/?["?#]', 1)
    since = F.regexp_extract("row", r"(?i)([0-9][0-9,.]*[km]?)\s+stars?\s+(?:today|this week|this month)", 1)
    figure = lambda what: F.coalesce(numbers.suffixed(_inner(F.col("row"), rf'(?is)<a[^>]*href="[^"]*/{what}"[^>]*>(.*?)</a>')), F.lit(0.0)).cast("long")
    rows = rows.select("source_id", "period", (F.col("i") + 1).alias("rank"), name.alias("full_name"), _inner(F.col("row"), "(?is)<p[^>]*>(.*?)</p>").alias("summary"), _inner(F.col("row"), r"(?is)itemprop=[\"']programmingLanguage[\"'][^>]*>(.*?)<").alias("language"), figure("stargazers").alias("stars"), figure("forks").alias("forks"), F.coalesce(numbers.suffixed(since), F.lit(0.0)).cast("long").alias("stars_since"))
    ours = (F.col("full_name") != "") & ~F.split("full_name", "/")[0].isin(*NOT_OWNERS) & ~F.split("full_name", "/")[1].isin(*NOT_OWNERS)
    return rows.filter(ours).withColumn("external_id", F.concat(F.lit("github_repo:"), F.lower("full_name")))


def article_text(html: Column) -> Column:
    """The longest of the page's article and main elements as text, whole; null where there is none."""
    found = F.concat(F.regexp_extract_all(html, F.lit("(?is)<article[^>]*>(.*?)</article>"), F.lit(1)), F.regexp_extract_all(html, F.lit("(?is)<main[^>]*>(.*?)</main>"), F.lit(1)))
    bodies = F.transform(found, lambda x: text.without_tags(x))
    return unicode.unescaped(text.trimmed_or_null(F.try_element_at(F.array_sort(bodies, lambda a, b: F.length(b) - F.length(a)), F.lit(1))))


def _opening(attribute: str, value: str) -> str:
    """A pattern of start tags that have the value among the attribute's words."""
    return rf"""(?i)<[a-z][a-z0-9-]*\b[^>]*?\s{attribute}\s*=\s*(?:"(?:[^">]*\s)?{value}(?:\s[^">]*)?"|'(?:[^'>]*\s)?{value}(?:\s[^'>]*)?'|{value}(?=[\s>]))"""


def _element(html: Column, opening: str) -> Column:
    """The inside of the first element whose start tag matches, elements of its own tag within it included; null where there is none."""
    start = F.regexp_instr(html, F.lit(opening))
    rest = F.substring(html, start, F.length(html))
    tag = F.regexp_extract(rest, "^<([a-zA-Z][a-zA-Z0-9-]*)", 1)
    pieces = F.split(rest, F.concat(F.lit("(?i)(?=</?"), tag, F.lit(r"(?![\w-]))")))

    def step(at, piece):
        depth = at["depth"] + F.when(piece.startswith("</"), -1).otherwise(1)
        return F.struct((at["i"] + 1).alias("i"), depth.alias("depth"), F.when((at["end"] == 0) & (depth == 0), at["i"]).otherwise(at["end"]).alias("end"))

    end = F.aggregate(pieces, F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(0).alias("end")), step)["end"]
    inside = F.array_join(F.slice(pieces, 1, F.when(end > 0, end).otherwise(F.size(pieces))), "")
    return F.when(start > 0, F.regexp_replace(inside, "^<[^>]*>", ""))


def _bare(html: Column) -> Column:
    """Without comments, scripts and styles, whose text can look like tags."""
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|noscript)\b.*?</\1\s*>", " ")


def article_body(source_id: Column, body: Column) -> Column:
    """The article's whole text from a landed page, or from the posts API's JSON (techcrunch_ai), by its source's rule; null for other sources."""
    html = _bare(body)
    rendered = _bare(F.get_json_object(body, "$.content.rendered"))
    out = F.when(source_id == "hacker_news_ai", article_text(html)).when(source_id == "techcrunch_ai", text.trimmed_or_null(text.without_tags(rendered)))
    for source, (scope, attribute, value) in ARTICLE_RULES.items():
        found = html if scope is None else _element(html, rf"(?i)<{scope}(?![\w-])")
        if attribute is not None:
            found = _element(found, _opening(attribute, value))
        out = out.when(source_id == source, text.trimmed_or_null(text.without_tags(found)))
    return unicode.unescaped(out)


def wordpress_post_id(url: Column) -> Column:
    """The first p of the URL's query where it is digits; else null."""
    return F.regexp_extract(F.regexp_extract(url, r"^[^?#]*\?(?:(?!p=[^&#])[^&#]*&)*+p=([^&#]+)", 1), "^[0-9]+$", 0).try_cast("long")


def engagement(body: Column, what: str) -> Column:
    """The figure in "123 upvotes" or "comments: 4"; null where there is none."""
    number = r"([0-9][0-9,.]*[kKmM]?)"
    before, after = F.regexp_extract(body, rf"(?i){number}\s+{what}s?\b", 1), F.regexp_extract(body, rf"(?i)\b{what}s?\s*:\s*{number}", 1)
    return numbers.suffixed(F.coalesce(F.when(before != "", before), F.when(after != "", after))).cast("long")


def content_depth(body: Column, summary: Column) -> Column:
    return F.when(text.trimmed_or_null(body).isNotNull(), "full").when(text.trimmed_or_null(summary).isNotNull(), "summary").otherwise("missing")


def pushed_query(query: Column, since: Column) -> Column:
    """A repository search with pushed:>date, unless it names one."""
    return F.when(F.contains(query, F.lit("pushed:")), query).otherwise(F.concat(F.trim(query), F.lit(" pushed:>"), F.date_format(since, "yyyy-MM-dd")))
