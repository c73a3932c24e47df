"""Landed raw payloads to item rows: RSS and Atom, repository search and releases, listings, JSON lines."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY = "position int, external_id string, title string, url string, summary string, published string"
REPO = "struct<full_name:string,html_url:string,description:string,stargazers_count:bigint,forks_count:bigint,open_issues_count:bigint,language:string,pushed_at:string,topics:array<string>,archived:boolean>"
RELEASE = "struct<id:bigint,name:string,tag_name:string,html_url:string,body:string,published_at:string>"


def parse_feed(xml: str | None) -> list[tuple]:
    """Entries of an RSS or Atom document in their order; what is no XML has none."""
    import xml.etree.ElementTree as E

    try:
        root = E.fromstring(xml or "")
    except E.ParseError:
        return []
    name = lambda e: e.tag.rsplit("}", 1)[-1]
    out = []
    for e in root.iter():
        if name(e) not in ("item", "entry"):
            continue
        own: dict[str, str] = {}
        for c in e:
            link = c.get("href") if name(c) == "link" and c.get("rel", "alternate") == "alternate" else None
            own.setdefault(name(c), (link or "".join(c.itertext())).strip())
        first = lambda *k: next((own[x] for x in k if own.get(x)), None)
        out.append((len(out) + 1, first("guid", "id"), first("title"), first("link"), first("summary", "description", "content"), first("pubDate", "published", "updated", "date")))
    return out


def feed_items(landed: DataFrame, limit: str = "item_limit") -> DataFrame:
    """(source_id, entry…) from (source_id, body, item_limit); the first entries of each source in feed order."""
    kind = landed.schema["source_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = [(s, *x) for s, body, n in zip(pdf["source_id"], pdf["body"], pdf[limit], strict=True) for x in parse_feed(body)[: int(n)]]
            yield pd.DataFrame(rows, columns=["source_id", *(c.split()[0] for c in ENTRY.split(", "))])

    return landed.select("source_id", "body", limit).mapInPandas(run, f"source_id {kind}, {ENTRY}")


def repositories(landed: DataFrame) -> DataFrame:
    """Repository search payloads (source_id, body) to item rows."""
    found = landed.select("source_id", F.posexplode(F.from_json("body", f"struct<items:array<{REPO}>>")["items"]).alias("i", "r"))
    return found.select("source_id", (F.col("i") + 1).alias("position"), F.concat(F.lit("github_repo:"), F.lower("r.full_name")).alias("external_id"), F.col("r.full_name").alias("title"), F.col("r.html_url").alias("url"), F.col("r.description").alias("summary"), F.col("r.stargazers_count").alias("stars"), F.col("r.forks_count").alias("forks"), "r.language", F.col("r.pushed_at").alias("published"), "r.topics", "r.archived")


def releases(landed: DataFrame) -> DataFrame:
    found = landed.select("source_id", F.explode(F.from_json("body", f"array<{RELEASE}>")).alias("r"))
    return found.select("source_id", F.concat(F.lit("github_release:"), F.col("r.id")).alias("external_id"), F.coalesce("r.name", "r.tag_name").alias("title"), F.col("r.html_url").alias("url"), F.col("r.body").alias("summary"), F.col("r.published_at").alias("published"))


def links(html: Column, part: str) -> Column:
    """Targets of a page's links that hold `part`, distinct, in order."""
    return F.array_distinct(F.filter(F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1)), lambda x: F.contains(x, F.lit(part))))


def error_class(status: Column) -> Column:
    return F.when(status < 400, None).when(status == 429, "rate_limited").when(status.isin(401, 403), "auth_or_access_denied").when(status.isin(404, 410, 422), "permanent_http_error").when(status.isin(408, 425, 500, 502, 503, 504), "transient_http_error").otherwise("http_error")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Exported records; malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def registry(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(enabled sources by priority and id, skipped ones with a reason). Repeated ids are an error."""
    if not rows.groupBy("id").count().filter("count > 1").isEmpty():
        raise ValueError("source ids repeat")
    on = rows.filter("enabled")
    unresolved = F.col("url").rlike(r"\$\{[^}]*\}")
    return on.filter(~unresolved).orderBy("priority", "id"), on.filter(unresolved).select("id", F.lit("unresolved_environment").alias("reason"))


def first_per_source(items: DataFrame, limit: int, order: str = "position") -> DataFrame:
    return items.withColumn("_r", F.row_number().over(Window.partitionBy("source_id").orderBy(order))).filter(F.col("_r") <= limit).drop("_r")


# ---- routing, validators, adapters -------------------------------------------------------------

COLLECTORS = ("feed", "rsshub", "github")


def routed(sources: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(sources by transport, what no transport takes): nothing is guessed."""
    out = {t: sources.filter(F.col("transport") == t) for t in COLLECTORS}
    return out, sources.filter(~F.coalesce(F.col("transport").isin(*COLLECTORS), F.lit(False)))


def conditional_headers(sources: DataFrame) -> DataFrame:
    """(id, headers): the validators of a source's last answer as request headers."""
    pairs = F.array(F.struct(F.lit("If-None-Match").alias("k"), F.col("etag").alias("v")), F.struct(F.lit("If-Modified-Since").alias("k"), F.col("last_modified").alias("v")))
    return sources.select("id", F.map_from_entries(F.filter(pairs, lambda p: F.coalesce(p["v"] != "", F.lit(False)))).alias("headers"))


def landed_status(http_status: Column, body: Column, n_items: Column) -> Column:
    """What a landed answer is: unchanged, failed, degraded (read, but empty) or a success."""
    return F.when(http_status == 304, "not_modified").when(F.coalesce(http_status, F.lit(0)).between(200, 299) & body.isNotNull(), F.when(F.coalesce(n_items, F.lit(0)) > 0, "success").otherwise("degraded")).otherwise("failed")


def interpolated(url: Column, values: dict[str, str]) -> Column:
    """A url's ${NAME} places filled; a base that ends in a slash loses it; null where a name has no value."""
    out = url
    for name, value in values.items():
        out = F.replace(out, F.lit("${" + name + "}"), F.lit(value.rstrip("/") if name.endswith("_BASE_URL") else value))
    return F.when(~F.contains(out, F.lit("${")), out)


def registry_errors(sources: DataFrame) -> DataFrame:
    """(id, error): ids that stand twice, rows without a group."""
    twice = sources.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", F.lit("duplicate_id").alias("error"))
    return twice.unionByName(sources.filter(F.coalesce(F.trim("source_group"), F.lit("")) == "").select("id", F.lit("missing_group").alias("error")))


_FOUND = r"(?i)https?://(?:www\.)?github\.com/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+)"


def project_link(*texts: Column) -> Column:
    """The first repository link in the texts, in order."""
    found = []
    for t in texts:
        owner, repo = F.regexp_extract(t, _FOUND, 1), F.regexp_replace(F.regexp_extract(t, _FOUND, 2), r"\.git$", "")
        found.append(F.when(owner != "", F.regexp_replace(F.concat(F.lit("https://github.com/"), owner, F.lit("/"), repo), "[.,)]+$", "")))
    return F.coalesce(*found)


# Names of a launch's counters in its payload.
VOTES = ("votes", "voteCount", "vote_count", "points", "upvotes", "ph_vote_count", "ph_votes")
COMMENTS = ("comments", "commentCount", "comment_count", "comments_count", "ph_comments_count", "ph_comment_count")


def launches(items: DataFrame, metadata: DataFrame) -> DataFrame:
    """Product launches of an Atom feed: votes and comments out of the payload, else the text; a repository that they link to
    becomes their identity, and its metadata (owner, repo, metadata map) is laid over the metrics. One outer join.
    items: (item_id, external_id, title, url, summary, content, payload: map of texts, metrics: map of texts)."""
    from ..operators import projects
    from .pages import engagement

    p, m = F.col("payload"), F.coalesce("metrics", F.create_map().cast("map<string,string>"))
    said = F.concat_ws(" ", "title", "summary", "content")
    pick = lambda names: F.coalesce(*(F.try_element_at(m, F.lit(n)) for n in names[:1]), *(F.try_element_at(p, F.lit(n)) for n in names))
    votes, comments = F.coalesce(pick(VOTES), engagement(said, "upvote").cast("string")), F.coalesce(pick(COMMENTS), engagement(said, "comment").cast("string"))
    link = project_link(F.col("url"), F.col("content"), F.col("summary"), F.try_element_at(p, F.lit("website")), F.coalesce(F.try_element_at(p, F.lit("productLinks")), F.try_element_at(p, F.lit("product_links"))))
    owner, repo = F.lower(F.regexp_extract(link, "github.com/([^/]+)/([^/]+)", 1)), F.lower(F.regexp_extract(link, "github.com/([^/]+)/([^/]+)", 2))
    key = F.when(link.isNotNull() & ~owner.isin("orgs", "users"), F.concat(owner, F.lit("/"), repo))
    status = F.when(votes.isNull() & comments.isNull(), "unavailable_in_feed").otherwise("available")
    own = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in (("votes", votes), ("comments", comments), ("producthunt_metrics_status", status), ("github_url", link), ("canonical_project_key", key)))), lambda x: x["v"].isNotNull()))
    rows = items.withColumns({"_key": key, "_own": F.map_concat(F.map_filter(m, lambda k, _: ~F.map_contains_key(own, k)), own)})
    known = metadata.select(F.lower(F.concat("owner", F.lit("/"), "repo")).alias("_key"), F.col("metadata").alias("_meta")).dropDuplicates(["_key"])
    rows = rows.join(known, "_key", "left")
    return rows.withColumns({"external_id": F.coalesce(F.concat(F.lit("github_repo:"), F.col("_key")), F.col("external_id")), "metrics": F.when(F.col("_meta").isNotNull(), projects.overlaid(F.col("_own"), F.col("_meta"))).otherwise(F.col("_own"))}).select(*items.columns)


def readme(content: Column, encoding: Column, cap: int = 16_000) -> Column:
    """A README's text out of a contents answer: base64 decoded, cut; null where it is none."""
    text_ = F.when(F.lower(encoding) == "base64", F.try_to_binary(F.regexp_replace(content, r"\s+", ""), F.lit("base64")).cast("string")).otherwise(content)
    return F.when(F.trim(text_) != "", F.substring(text_, 1, cap))


def answer_text(body: Column) -> Column:
    """The text of a provider's answer in either of two shapes: output_text parts, or the first choice's message."""
    whole = F.get_json_object(body, "$.output_text")
    parts = F.from_json(F.get_json_object(body, "$.output"), "array<struct<type:string,content:array<struct<type:string,text:string>>>>")
    texts = F.filter(F.flatten(F.transform(parts, lambda o: F.coalesce(o["content"], F.array().cast("array<struct<type:string,text:string>>")))), lambda c: (c["type"] == "output_text") & c["text"].isNotNull())
    joined = F.array_join(F.transform(texts, lambda c: c["text"]), "")
    return F.coalesce(*(F.when(F.trim(c) != "", c) for c in (whole, joined, F.get_json_object(body, "$.choices[0].message.content"))))


# Names under which a loose record may hold a field, first wins.
RECORD_ALIASES = {
    "canonical_url": ("canonical_url", "url", "link"), "summary": ("summary", "raw_summary"), "content": ("content", "raw_content", "content_text"), "external_id": ("external_id", "guid"),
}


def loose_record(record: Column) -> dict[str, Column]:
    """Fields of a map of texts by their aliases; blanks count as absent."""
    got = lambda k: F.try_element_at(record, F.lit(k))
    return {f: F.coalesce(*(F.when(F.trim(got(a)) != "", got(a)) for a in names)) for f, names in RECORD_ALIASES.items()}


def newest_lines(spark, folder: str, schema: str) -> DataFrame:
    """Records of the newest of the exports below a folder, as its file system lists them; malformed lines dropped."""
    from ..plans.drafts import _fs

    fs, path = _fs(spark, folder)
    listed, newest = fs.listFiles(path, True), None
    while listed.hasNext():
        f = listed.next()
        if f.getPath().getName().endswith(".jsonl"):
            at = (f.getModificationTime(), f.getPath().toString())
            newest = at if newest is None or (-at[0], at[1]) < (-newest[0], newest[1]) else newest
    return json_lines(spark, newest[1], schema) if newest else spark.createDataFrame([], schema)
