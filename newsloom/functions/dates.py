"""Times: cutoffs, ages, back-off."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Shanghai"


def cutoff(edition: Column) -> Column:
    """UTC instant of the previous day's midnight in the editions' zone."""
    return F.to_utc_timestamp(F.date_sub(edition, 1).cast("timestamp"), ZONE)


def age_hours(at: Column, reference: Column) -> Column:
    return (F.unix_micros(reference.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / F.lit(3_600_000_000)


def iso(date: Column) -> Column:
    """Year, month and day of a date; years past 9999 as plain digits, where a cast writes a sign before them."""
    return F.ltrim(date.cast("string"), F.lit("+"))


# What relative and full dates read.
UNKNOWN, AGO_DAYS, AGO_HOURS, AGO_MINUTES, JUST_NOW, UNKNOWN_TIME = "未知", "天前", "小时前", "分钟前", "刚刚", "未知时间"
WEEKDAYS = ("星期一", "星期二", "星期三", "星期四", "星期五", "星期六", "星期日")


def relative(at: Column, reference: Column) -> Column:
    """Whole days ago, else hours, else minutes, else just now; future times count their hours within the day back from it."""
    micros = F.unix_micros(reference.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))
    days, seconds = F.floor(micros / F.lit(86_400_000_000)), F.floor(F.pmod(micros, F.lit(86_400_000_000)) / F.lit(1_000_000))
    hours, minutes = F.floor(seconds / 3600), F.floor(seconds / 60)
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return F.when(at.isNull(), UNKNOWN).when(days > 0, text(days, AGO_DAYS)).when(hours > 0, text(hours, AGO_HOURS)).when(minutes > 0, text(minutes, AGO_MINUTES)).otherwise(JUST_NOW)


def shown(at: Column) -> Column:
    """Date and minute in the editions' zone."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(at.cast("timestamp"), ZONE), "yyyy-MM-dd HH:mm"), F.lit(UNKNOWN_TIME))


def shown_minute(at: Column) -> Column:
    return F.coalesce(F.date_format(F.from_utc_timestamp(at.cast("timestamp"), ZONE), "HH:mm"), F.lit("--:--"))


def full_date(day: Column, year: bool = True) -> Column:
    """Year, month, day and weekday; text that is no date stays as it is, null is empty."""
    d = F.trim(day.cast("string")).try_cast("date")
    head = F.concat(F.year(d).cast("string"), F.lit("年")) if year else F.lit("")
    out = F.concat(head, F.month(d).cast("string"), F.lit("月"), F.day(d).cast("string"), F.lit("日 "), F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday(d) + 1))
    return F.when(day.isNull(), "").otherwise(F.coalesce(out, day.cast("string")))


def is_historical(edition: Column, now: Column) -> Column:
    """Whether an edition is another than today's in the editions' zone."""
    today = F.date_format(F.from_utc_timestamp(now.cast("timestamp"), ZONE), "yyyy-MM-dd")
    return F.coalesce((edition != "") & (F.trim(edition) != today), F.lit(False))


def edition_or_today(value: Column, now: Column) -> Column:
    """A date given as ISO text, else today in the editions' zone; null where the text is no date."""
    given = F.trim(value)
    return F.when(value.isNull() | (given == ""), F.to_date(F.from_utc_timestamp(now.cast("timestamp"), ZONE))).when(given.rlike(r"^\d{4}-\d{2}-\d{2}$"), given.try_cast("date"))


_FORMATS = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z")


def parsed(*texts: Column) -> Column:
    """The first of the texts that is an instant: ISO forms (without zone: UTC) or the mail form with a zone; others are skipped."""
    tries = []
    for t in texts:
        t = F.trim(t)
        iso = t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}.*)?$")
        tries.append(F.when(iso, t.try_cast("timestamp")))
        named = F.regexp_replace(F.regexp_replace(t, r"\b(GMT|UTC|UT|Z)$", "+0000"), r"^[A-Za-z]{3,9},\s*", "")
        tries += [F.when(~iso, F.try_to_timestamp(named, F.lit(f))) for f in _FORMATS]
    return F.coalesce(*tries)


def time_exclusion(reason: Column) -> Column:
    """One of the three reasons of a text that speaks of it, or null."""
    low = F.lower(F.coalesce(reason, F.lit("")))
    has = lambda x: F.contains(low, F.lit(x))
    return F.when(has("future"), "future_timestamp").when(has("missing") & has("publish"), "missing_published_at").when(has("old") | has("expired") | has("window"), "too_old")


def backoff_seconds(failures: Column, base: int = 60, cap: int = 86_400) -> Column:
    """base times 2 to the failures before, `cap` at most; 0 without failures."""
    return F.when(failures <= 0, F.lit(0)).otherwise(F.least(F.lit(float(cap)), base * F.pow(F.lit(2.0), F.least(failures, F.lit(30)) - 1))).cast("long")
