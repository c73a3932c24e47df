"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .unicode import casefold, nfkc, unescaped

_BLOCKS = "br|p|div|li|tr|h[1-6]|article|section|blockquote|pre"
_GONE = "script|style|noscript|template|svg"


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def trimmed_or_null(text: Column) -> Column:
    out = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(out != "", out)


def _title(folded: Column) -> Column:
    words = F.regexp_replace(folded, r"[^\p{L}\p{N}_]+", " ")
    return F.trim(F.regexp_replace(words, r"(?<=[一-鿿])\s+(?=[一-鿿])", ""))


def event_title(title: Column) -> Column:
    """Title identity: compatibility forms unified, case folded, letters and digits of any script kept, all else one space,
    none between CJK characters."""
    return _title(casefold(nfkc(F.coalesce(title, F.lit("")))))


def stored_title(title: Column) -> Column:
    """The same as stored with an event: compatibility forms stay as they are."""
    return _title(casefold(F.coalesce(title, F.lit(""))))


def plain(value: Column, newlines: bool = True) -> Column:
    """Readable plain text: compatibility forms unified, entities decoded, zero-width and control characters out, runs of
    spaces as one, one empty line between paragraphs at most. Null gives an empty text; text with tags goes through `without_tags`."""
    text = F.regexp_replace(nfkc(F.coalesce(value, F.lit(""))), "\r\n?", "\n")
    text = F.when(text.rlike(r"<\s*/?[A-Za-z][^>]*>"), _tags_out(text)).otherwise(text)
    return _tidied(text, newlines)


def _tidied(text: Column, newlines: bool = True) -> Column:
    text = F.regexp_replace(unescaped(text), "[\u200b\ufeff]|[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "")
    if not newlines:
        return F.trim(F.regexp_replace(F.translate(text, "\n", " "), r"[ \t\f\x0b\xa0]+", " "))
    lines = F.array_join(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\f\x0b\xa0]+", " "))), "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def external_id(value: Column) -> Column:
    """All white space of any script removed, case folded; empty is null."""
    out = casefold(F.regexp_replace(value, r"(?U)\s+", ""))
    return F.when(out != "", out)


def family_key(value: Column, cap: int = 120) -> Column:
    """Slug of [a-z0-9_], `cap` long at most; other where nothing is left."""
    out = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), "[^a-z0-9_]+", "_"), "^_+|_+$", "")
    return F.when(out == "", "other").otherwise(F.substring(out, 1, cap))


def reason_code(value: Column) -> Column:
    return F.translate(F.lower(F.trim(F.coalesce(value, F.lit("")))), "- ", "__")


def split_list(value: Column, limit: int = 50) -> Column:
    """Parts between line ends, commas, semicolons (ASCII and full width) and bars: trimmed, distinct, in order."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), r"[\r\n,，;；|]+"), lambda x: F.trim(x))
    return F.slice(F.array_distinct(F.filter(parts, lambda x: x != "")), 1, limit)


def _tags_out(html: Column) -> Column:
    text = F.regexp_replace(html, rf"(?is)<\s*({_GONE})\b.*?</\s*\1\s*>", " ")
    text = F.regexp_replace(text, rf"(?i)<\s*/?\s*({_BLOCKS})\b[^>]*>", "\n")
    return F.regexp_replace(text, "<[^>]*>", " ")


def without_tags(html: Column) -> Column:
    """Text of HTML: scripts and styles out, block tags as line ends, other tags as spaces, lines trimmed, blank ones out.
    Entities stay: this form works within higher-order functions."""
    lines = F.filter(F.transform(F.split(_tags_out(html), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\f]+", " "))), lambda x: x != "")
    return F.array_join(lines, "\n")


def html_text(html: Column) -> Column:
    """Readable text of HTML: tags out as above, entities decoded, then as `plain` text."""
    return _tidied(_tags_out(F.coalesce(html, F.lit(""))))


def markdown_label(value: Column, cap: int = 100) -> Column:
    """Brackets escaped; longer labels cut with an ellipsis."""
    out = F.regexp_replace(F.coalesce(value, F.lit("")), r"([\[\]])", r"\\$1")
    return F.when(F.length(out) > cap, F.concat(F.substring(out, 1, cap), F.lit("…"))).otherwise(out)


def matches_all(haystack: Column, tokens: list[str]) -> Column:
    """Every token occurs in the lower-cased text."""
    low = F.lower(haystack)
    out = F.lit(True)
    for t in tokens:
        out = out & F.contains(low, F.lit(t.lower()))
    return out


def truncated(value: Column, cap: int = 500) -> Column:
    """Trimmed and cut; null as empty."""
    return F.substring(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"^\s+|\s+$", ""), 1, cap)


def error_code(message: Column, default: str = "fetch_failed", cap: int = 64) -> Column:
    """What stands before the first colon of an error."""
    head = F.substring(F.trim(F.substring_index(message, ":", 1)), 1, cap)
    return F.when(message.isNull() | (message == ""), None).when(head != "", head).otherwise(default)


def search_text(title: Column, keywords: Column, cap: int = 300) -> Column:
    """A verification query: the title and the first four keywords."""
    return F.substring(F.trim(F.concat_ws(" ", title, F.slice(keywords, 1, 4))), 1, cap)


def is_source_token(value: Column) -> Column:
    return F.coalesce(value.rlike(r"\A[a-z0-9][a-z0-9_-]*\z"), F.lit(False))


# Labels shown for stored codes.
LABELS = {
    "content_class": ("未分类", {"official_model_company": "官方发布", "project_tool": "项目 / 工具", "community_social": "社区线索", "news_media": "媒体报道"}),
    "source_group": ("未标注来源", {
        "official_blog": "官方博客", "official_research": "官方研究", "tech_media": "科技媒体", "github_trending": "GitHub 趋势", "github_release": "GitHub Releases", "github_search": "GitHub 搜索", "producthunt": "Product Hunt",
        "hacker_news": "Hacker News", "reddit_fixed": "Reddit", "reddit_search": "Reddit 搜索", "linux_do": "LINUX DO", "x_official": "X 官方账号", "x_social": "X 社区", "x_search": "X 搜索",
    }),
    "transport": ("未知通道", {"feed": "RSS/Atom", "rsshub": "RSSHub", "github": "GitHub"}),
    "status": ("未知状态", {"new": "待处理", "candidate": "候选事件", "screen_failed": "Stage A 失败", "analysis_failed": "Stage B 失败", "screened_out": "Stage A 排除", "analysis_filtered": "Stage B 过滤"}),
}


def label(value: Column, kind: str) -> Column:
    """The label of a code; unknown codes show as they are (groups with spaces for underscores), none shows the kind's default."""
    default, names = LABELS[kind]
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    other = F.translate(value, "_", " ") if kind == "source_group" else value
    return F.when(value.isNull() | (value == ""), default).otherwise(F.coalesce(F.try_element_at(known, value), other))
