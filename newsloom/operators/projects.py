"""Project records: merged metrics, best period, ranked reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged_counter(old: Column, new: Column) -> Column:
    """Counters never fall."""
    return F.greatest(old, new)


def ordered_union(*arrays: Column) -> Column:
    """Distinct elements of all arrays in first-seen order."""
    return F.array_distinct(F.concat(*(F.coalesce(a, F.array().cast("array<string>")) for a in arrays)))


def best_period(periods: Column) -> Column:
    """Of map<period, struct<stars_since, …>> the period with most stars, ties to the later name."""
    entries = F.transform(F.map_entries(periods), lambda e: F.struct(F.coalesce(e["value"]["stars_since"], F.lit(0)).alias("s"), e["key"].alias("k")))
    return F.array_max(entries)["k"]


def period_rows(records: DataFrame, period: str, k: int = 20) -> DataFrame:
    """A period's first k: rank, then most stars since, then fewest stars. records: (external_id, period, rank, stars_since, stars)."""
    rows = records.filter(F.col("period") == period).orderBy(F.coalesce("rank", F.lit(10**9)), F.desc("stars_since"), "stars", "external_id").limit(k)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.coalesce("rank", F.lit(10**9)), F.desc("stars_since"), "stars", "external_id")))


def report(records: DataFrame, k: int = 20) -> DataFrame:
    """(section, place, external_id): weekly, daily and search-only rows, each record in the first section that has it.

    The windows run over k rows a section, what a page shows.
    """
    weekly, daily = period_rows(records, "weekly", k), period_rows(records, "daily", k)
    found = records.filter("period is null").orderBy(F.desc("stars"), F.desc_nulls_last("pushed_at"), "external_id").limit(k)
    found = found.withColumn("place", F.row_number().over(Window.orderBy(F.desc("stars"), F.desc_nulls_last("pushed_at"), "external_id")))
    every = None
    for n, (name, rows) in enumerate((("weekly", weekly), ("daily", daily), ("search", found))):
        part = rows.select(F.lit(n).alias("n"), F.lit(name).alias("section"), "place", "external_id")
        every = part if every is None else every.unionByName(part)
    return every.groupBy("external_id").agg(F.min(F.struct("n", "place", "section")).alias("r")).select("r.section", "r.place", "external_id")


def risk_flags(archived: Column, fork: Column, licence: Column, readme: Column, given: Column) -> Column:
    own = F.array_compact(F.array(F.when(archived, "archived"), F.when(fork, "fork"), F.when(licence.isNull(), "missing_license"), F.when(readme.isNull(), "missing_readme")))
    return ordered_union(own, given)


# ---- reading project records -------------------------------------------------------------------
# records: content_class, source_id, source_transport, external_id, id, url, title, summary, content_text, status, published_at, metrics
# and raw_payload (maps of texts), ai (struct of status, keep, summary_cn, risk_flags).

def is_project_record() -> Column:
    """Whether a record is about a repository, by any of six signs."""
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    kind = F.try_element_at("raw_payload", F.lit("github_item_type"))
    key = F.try_element_at("metrics", F.lit("canonical_project_key"))
    signs = (low("source_transport") == "github") | low("source_id").startswith("github_") | low("external_id").startswith("github_repo:") | F.contains(low("url"), F.lit("github.com/"))
    return signs | F.coalesce(kind.isin("repository", "release"), F.lit(False)) | F.coalesce(key != "", F.lit(False))


def is_reported() -> Column:
    """Whether a record goes into the report: a repository of the project class, no release."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    kind = F.coalesce(F.try_element_at("raw_payload", F.lit("github_item_type")), F.lit(""))
    signs = (kind == "repository") | (low("source_transport") == "github") | low("source_id").startswith("github_") | low("external_id").startswith("github_repo:") | F.contains(low("url"), F.lit("github.com/"))
    return (F.col("content_class") == "project_tool") & (kind != "release") & ~low("external_id").startswith("github_release:") & signs


def count_of(value: Column) -> Column:
    """A counter's text as a whole number: commas, k and m understood, never negative, 0 where it is none."""
    from ..functions import numbers

    return F.greatest(F.lit(0).cast("long"), F.coalesce(numbers.suffixed(value).cast("long"), F.lit(0).cast("long")))


def project_rows(records: DataFrame) -> DataFrame:
    """Accepted records (analysed and kept) as projects: metrics over payload where they aren't null."""
    from ..functions import structured, text, urls

    kept = records.filter((F.col("content_class") == "project_tool") & is_project_record() & (F.col("ai.status") == "success") & F.coalesce(F.col("ai.keep"), F.lit(False)))
    merged = structured.merged(F.coalesce("raw_payload", F.create_map().cast("map<string,string>")), F.map_filter(F.coalesce("metrics", F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull()))
    rows = kept.withColumn("m", merged)
    got = lambda *keys: F.coalesce(*(text.trimmed_or_null(F.try_element_at("m", F.lit(k))) for k in keys))
    title = F.trim(F.regexp_replace("title", "^GitHub repo:", ""))
    true = lambda c: F.coalesce(F.lower(F.trim(c)).isin("1", "true", "yes", "y"), F.lit(False))
    licence = F.coalesce(text.trimmed_or_null(F.get_json_object(got("license"), "$.spdx_id")), text.trimmed_or_null(F.get_json_object(got("license"), "$.name")), F.when(~F.coalesce(got("license").startswith("{"), F.lit(False)), got("license")), got("license_name"))
    archived, fork = true(got("archived")), true(got("fork", "is_fork"))
    bare = true(got("readme_checked")) & (F.lower(got("has_readme", "readme_present")) == "false")
    flags = F.array_compact(F.array(F.when(archived, "archived_repository"), F.when(fork, "fork_repository"), F.when(licence.isNull(), "missing_license"), F.when(bare, "missing_readme")))
    listed = lambda c: structured.decoded_strings(got(c))
    return rows.select(
        F.col("id").cast("long").alias("item_id"), F.coalesce(got("full_name"), text.trimmed_or_null(F.try_element_at("metrics", F.lit("canonical_project_key"))), urls.repo_full_name(F.col("url")), F.when(F.contains(title, F.lit("/")), title), F.lit("unknown/repository")).alias("repo_full_name"),
        F.coalesce(text.trimmed_or_null(F.col("url")), got("html_url")).alias("url"), "source_id", "status", F.coalesce(text.trimmed_or_null(F.col("ai.summary_cn")), text.trimmed_or_null(F.col("summary")), text.trimmed_or_null(F.col("content_text"))).alias("summary"),
        count_of(got("stars", "stargazers_count")).alias("stars"), count_of(got("forks", "forks_count")).alias("forks"), count_of(got("watchers", "watchers_count")).alias("watchers"), count_of(got("open_issues", "open_issues_count")).alias("open_issues"),
        got("language").alias("language"), licence.alias("license_name"), listed("topics").alias("topics"), listed("search_topics").alias("search_topics"), archived.alias("archived"), fork.alias("fork"), got("pushed_at", "updated_at").try_cast("timestamp").alias("pushed_at"),
        release_names(got("latest_releases", "latest_release", "tag_name")).alias("releases"), ordered_union(flags, F.col("ai.risk_flags")).alias("risk_flags"), trending(F.col("m")).alias("trending"),
    )


_PERIOD = "map<string,struct<rank:string,stars_since:string,stars:string,forks:string>>"


def trending(metrics: Column) -> Column:
    """Periods with rank and stars since: the map under trending, and the single period's own fields where it isn't in there."""
    got = lambda k: F.try_element_at(metrics, F.lit(k))
    given = F.coalesce(F.from_json(got("trending"), _PERIOD), F.create_map().cast(_PERIOD))
    period = F.trim(got("trending_period"))
    own = F.struct(got("trending_rank").alias("rank"), got("stars_since").alias("stars_since"), got("stars").alias("stars"), got("forks").alias("forks"))
    alone = (period != "") & ~F.coalesce(F.map_contains_key(given, F.coalesce(period, F.lit(""))), F.lit(False))
    return F.when(F.coalesce(alone, F.lit(False)), F.map_concat(given, F.create_map(period, own))).otherwise(given)


def since(trending_: Column, period: str) -> Column:
    return count_of(F.try_element_at(trending_, F.lit(period))["stars_since"])


def release_names(value: Column, n: int = 3) -> Column:
    """Names of a list of releases, of one release, or a bare name: three at most."""
    many = F.from_json(value, "array<struct<name:string,tag_name:string>>")
    bare = F.from_json(value, "array<string>")
    one = F.from_json(value, "struct<name:string,tag_name:string>")
    name = lambda x: F.coalesce(F.when(F.trim(x["name"]) != "", F.trim(x["name"])), F.when(F.trim(x["tag_name"]) != "", F.trim(x["tag_name"])))
    none = F.array().cast("array<string>")
    first = lambda a, f: F.array_compact(F.transform(F.slice(a, 1, n), f))
    is_list, is_object = F.ltrim(value).startswith("["), F.ltrim(value).startswith("{")
    return F.when(value.isNull(), none).when(is_list & F.ltrim(value).rlike(r"^\[\s*\{"), first(many, name)).when(is_list, first(bare, lambda x: F.when(F.trim(x) != "", F.trim(x)))).when(is_object, F.array_compact(F.array(name(one)))).otherwise(F.array(value))


def filtered(rows: DataFrame, *, query: str | None = None, language: str | None = None, min_stars: int | None = None, min_forks: int | None = None, archived: bool = True) -> DataFrame:
    """Projects whose name, summary, language, licence or topics hold the query, and that pass the other filters given."""
    if query:
        hay = F.lower(F.concat_ws(" ", "repo_full_name", "summary", "language", "license_name", "topics", "search_topics"))
        rows = rows.filter(F.contains(hay, F.lit(query.casefold())))
    if language:
        rows = rows.filter(F.lower("language") == language.casefold())
    if min_stars is not None:
        rows = rows.filter(F.col("stars") >= min_stars)
    if min_forks is not None:
        rows = rows.filter(F.col("forks") >= min_forks)
    return rows if archived else rows.filter(~F.col("archived"))


def ordered(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """By stars of the week, of the day, stars, forks, last push, then the smaller id."""
    out = rows.orderBy(since(F.col("trending"), "weekly").desc(), since(F.col("trending"), "daily").desc(), F.desc("stars"), F.desc("forks"), F.desc_nulls_last("pushed_at"), F.coalesce("item_id", F.lit(0).cast("long")).asc())
    return out if limit is None else out.limit(limit)


def stats(rows: DataFrame) -> DataFrame:
    risky = F.size("risk_flags") > 0
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("archived")).alias("active"), F.count_if(F.col("archived")).alias("archived"), F.count_if(risky).alias("risky"), F.coalesce(F.max("stars"), F.lit(0).cast("long")).alias("max_stars"))


def languages(rows: DataFrame) -> DataFrame:
    return rows.filter("language <> ''").select("language").distinct().orderBy(F.lower("language"), "language")


# ---- metrics and enrichment ---------------------------------------------------------------------

#: Fields of a repository's metadata that are kept, and caps of the free ones.
ALLOWED = ("full_name", "html_url", "description", "topics", "stargazers_count", "forks_count", "watchers_count", "open_issues_count", "language", "pushed_at", "updated_at", "created_at", "archived", "fork", "license", "default_branch", "readme_url")
README, DESCRIPTION, TOPICS, TOPIC = 16_000, 4000, 100, 128
# A metric's name in the metadata.
OVERLAY = {"stars": "stargazers_count", "forks": "forks_count", "pushed_at": "pushed_at", "language": "language", "archived": "archived", "fork": "fork", "license": "license"}


def bounded_metadata(metadata: Column) -> Column:
    """The allowed keys of a metadata map, the description cut, topics (a JSON list) at most 100 of 128 characters."""
    kept = F.map_filter(metadata, lambda k, v: k.isin(*ALLOWED))
    topics = F.to_json(F.slice(F.transform(F.filter(F.from_json(F.try_element_at(metadata, F.lit("topics")), "array<string>"), lambda t: F.trim(t) != ""), lambda t: F.substring(t, 1, TOPIC)), 1, TOPICS))
    return F.transform_values(kept, lambda k, v: F.when(k == "description", F.when(F.trim(v) != "", F.substring(F.trim(v), 1, DESCRIPTION))).when((k == "topics") & topics.isNotNull(), topics).otherwise(v))


def overlaid(metrics: Column, metadata: Column) -> Column:
    """Metrics with the metadata's values over them where they aren't null; a licence is its id or name."""
    licence = F.try_element_at(metadata, F.lit("license"))
    named = F.coalesce(F.get_json_object(licence, "$.spdx_id"), F.get_json_object(licence, "$.name"), F.when(~licence.startswith("{"), licence))
    values = [F.struct(F.lit(t).alias("k"), (named if t == "license" else F.try_element_at(metadata, F.lit(k))).alias("v")) for t, k in OVERLAY.items()]
    given = F.filter(F.array(*values, F.struct(F.lit("github_metadata_fetched").alias("k"), F.lit("true").alias("v"))), lambda x: x["v"].isNotNull())
    new = F.map_from_entries(given)
    return F.map_concat(F.map_filter(metrics, lambda k, _: ~F.map_contains_key(new, k)), new)


def merged_metrics(old: Column, new: Column) -> Column:
    """Maps of texts: counters never fall, other values of the new side win unless null, topics are united (JSON lists)."""
    number = lambda m, k: F.try_element_at(m, F.lit(k)).try_cast("double")
    values = F.map_filter(new, lambda k, v: v.isNotNull())
    out = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(values, k)), values)
    falls = F.array_compact(F.array(*(F.when(number(old, k) > F.coalesce(number(new, k), F.lit(float("-inf"))), k) for k in ("stars", "forks", "watchers", "open_issues"))))
    topics = lambda m: F.coalesce(F.from_json(F.try_element_at(m, F.lit("topics")), "array<string>"), F.array().cast("array<string>"))
    both = F.to_json(F.array_union(topics(old), topics(new)))
    return F.transform_values(out, lambda k, v: F.when(F.array_contains(falls, k), F.try_element_at(old, k)).when(k == "topics", both).otherwise(v))


def enriched(items: DataFrame, found: DataFrame) -> DataFrame:
    """Items with their repository's metadata and README: found: (item_id, metadata map, readme_text, readme_checked, errors).
    A README becomes the content (16,000 characters); a description the summary; where one was looked for and none is
    there, the content, which held metrics only, goes. Items that weren't looked up stay."""
    e = found.select("item_id", bounded_metadata(F.col("metadata")).alias("_meta"), F.substring(F.trim("readme_text"), 1, README).alias("_readme"), "readme_checked", "errors", F.lit(True).alias("_found"))
    rows = items.join(e, "item_id", "left")
    none = F.create_map().cast("map<string,string>")
    status = F.when(F.size("errors") > 0, "partial").otherwise("success")
    more = F.map_concat(F.create_map(F.lit("github_enrichment_status"), status, F.lit("readme_checked"), F.coalesce("readme_checked", F.lit(False)).cast("string")), F.when(F.col("_readme") != "", F.create_map(F.lit("readme_chars"), F.length("_readme").cast("string"))).otherwise(none))
    old = F.coalesce("metrics", none)
    new = F.map_concat(F.map_filter(overlaid(none, F.coalesce("_meta", none)), lambda k, _: ~F.map_contains_key(more, k)), more)
    description = F.try_element_at("_meta", F.lit("description"))
    had = F.map_contains_key(old, "readme_chars")
    content = F.when(F.col("_readme") != "", F.col("_readme")).when(~had & (F.coalesce("readme_checked", F.lit(False)) | (F.size("errors") > 0)), None).otherwise(F.col("content_text"))
    got = F.coalesce("_found", F.lit(False))
    return rows.withColumns({"metrics": F.when(got, merged_metrics(old, new)).otherwise(F.col("metrics")), "content_text": F.when(got, content).otherwise(F.col("content_text")), "summary": F.when(got & (description != ""), description).otherwise(F.col("summary"))}).select(*items.columns)


# ---- the report's Markdown ----------------------------------------------------------------------

# What the report reads.
REPORT = {"link": "- 链接：", "stars": "- 累计 Star：", "weekly": "- 本周新增 Star（GitHub Trending）：", "daily": "- 今日新增 Star（GitHub Trending）：", "forks": "- Fork：", "push": "- 最近 Push：", "sources": "- 来源：", "topics": "- 命中 Topic：", "about": "- 项目介绍：", "none": "暂无介绍"}


def search_line(rows: DataFrame) -> DataFrame:
    """(item_id, line): a search-only project as a table row."""
    from ..functions import numbers

    dash = lambda c: F.coalesce(F.when(c != "", c), F.lit("-"))
    name = F.concat(F.lit("| ["), F.col("repo_full_name"), F.lit("]("), F.coalesce("url", F.lit("")), F.lit(")"))
    return rows.select("item_id", F.concat_ws(" | ", name, numbers.thousands(F.col("stars")), dash(F.date_format("pushed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")), dash(F.array_join(F.array_union("topics", "search_topics"), ", ")), F.concat(dash(F.col("language")), F.lit(" |"))).alias("line"))


def detail_lines(rows: DataFrame) -> DataFrame:
    """(item_id, line_no, line): a project's block, a row a line."""
    from ..functions import numbers

    r = REPORT
    dash = lambda c: F.coalesce(F.when(c != "", c), F.lit("-"))
    period = lambda p: F.when(F.map_contains_key("trending", p), numbers.thousands(since(F.col("trending"), p))).otherwise("-")
    topics = F.array_join(F.array_union("topics", "search_topics"), ", ")
    lines = F.array_compact(F.array(
        F.concat(F.lit("### "), F.col("place").cast("string"), F.lit(". "), F.col("repo_full_name")), F.concat(F.lit(r["link"]), dash(F.col("url"))), F.concat(F.lit(r["stars"]), numbers.thousands(F.col("stars"))), F.concat(F.lit(r["weekly"]), period("weekly")), F.concat(F.lit(r["daily"]), period("daily")),
        F.concat(F.lit(r["forks"]), numbers.thousands(F.col("forks"))), F.concat(F.lit(r["push"]), dash(F.date_format("pushed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))), F.concat(F.lit(r["sources"]), dash(F.col("source_id"))), F.when(topics != "", F.concat(F.lit(r["topics"]), topics)), F.concat(F.lit(r["about"]), F.coalesce(F.when(F.col("summary") != "", F.col("summary")), F.lit(r["none"]))), F.lit(""),
    ))
    return rows.select("item_id", F.posexplode(lines).alias("line_no", "line"))
