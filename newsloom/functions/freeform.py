"""Dates as people write them, read in columns: a text is cut into time, zone and the rest; the rest into tokens, each a
month, weekday, number or filler; and the numbers are resolved to year, month and day by their sizes and places.

A colon makes a time, so do am and pm, and digits after T. Of numbers alone the month comes first, unless what stands
there can't be one; a number above 31 or of more than two digits is the year; years of two digits are the nearest to now.
What isn't said comes from now's date (the day at most the month's last; a lone weekday is the next one). Offsets
count where a time came before; after a name like GMT their sign means what is to be added to reach it. Names of zones
other than UTC, GMT and Z say nothing: without an offset the time is UTC. Texts with anything else in them are null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, and fillers between the parts.
MONTHS = (("jan", "january"), ("feb", "february"), ("mar", "march"), ("apr", "april"), ("may",), ("jun", "june"), ("jul", "july"), ("aug", "august"), ("sep", "sept", "september"), ("oct", "october"), ("nov", "november"), ("dec", "december"))
WEEKDAYS = (("mon", "monday"), ("tue", "tuesday"), ("wed", "wednesday"), ("thu", "thursday"), ("fri", "friday"), ("sat", "saturday"), ("sun", "sunday"))
FILLERS = (".", ",", ";", "-", "/", "'", "at", "on", "and", "ad", "m", "t", "of", "st", "nd", "rd", "th")

_NAMES = "|".join(n.upper() for names in (*MONTHS, *WEEKDAYS) for n in names)
_COLON = r"(\d{1,2})\s*:\s*(\d{1,2})(?:\s*:\s*(\d{1,2})(?:[.,](\d+))?)?(?:\s*([AaPp])(?:\.?[Mm])?(?:\.|(?![A-Za-z])))?"
_HOUR = r"(\d{1,2})\s*([AaPp])\.?[Mm](?:\.|(?![A-Za-z]))"
_COMPACT = r"(\d{2})(\d{2})(\d{2})?(?:[.,](\d+))?"
_UNITS = r"(\d{1,2})\s*[Hh](?:ours?)?(?:\s*(\d{1,2})\s*[Mm](?:inutes?)?)?(?:\s*(\d{1,2})(?:\.(\d+))?\s*[Ss](?:econds?)?)?(?![A-Za-z])"
_NAME, _OFFSET = rf"(?!(?:{_NAMES})\b)[A-Z]{{1,5}}(?![A-Za-z])|z(?![A-Za-z])", r"[+-](?:\d{4}|\d{1,2}(?::\d{2})?)(?![\d:/]|-\d)"
_ZONE = rf"(?={_NAME}|{_OFFSET})({_NAME})?\s*(?:([+-])(\d{{4}}|\d{{1,2}}(?::\d{{2}})?)(?![\d:/]|-\d))?\s*(?:\([A-Z]{{3,5}}\))?"
#: A zone follows its time, or stands further on after a space.
_NEXT, _LATER = rf"(?s)^(\s*){_ZONE}(.*)$", rf"(?s)^(.*?\s){_ZONE}(.*)$"
#: A number that can't be a day, with a word stuck to it.
_STUCK = rf"(?i)(?<!\d)(?:3[2-9]|[4-9]\d|\d{{3,}})(?=[a-z])(?!(?:{'|'.join(f for f in FILLERS if f.isalpha())})(?![a-z]))"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _number(pattern: str, text: Column, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def _lookup(word: Column, names: tuple[tuple[str, ...], ...]) -> Column:
    """The place, from 1, of the names that hold the word; null where none does."""
    table = F.create_map(*(F.lit(x) for i, group in enumerate(names, 1) for n in group for x in (n, i)))
    return F.try_element_at(table, word)


def _parts(text: Column) -> Column:
    """(kind, head, hour, minute, second, micros, half, tail) of a trimmed text: what stands before and after its time."""
    colon, hour = rf"(?s)^(.*?)(?<![\d:+-]){_COLON}(?![\d:])(.*)$", rf"(?s)^(.*?)(?<![\d:]){_HOUR}(.*)$"
    tee, long = rf"(?s)^(.*\d{{8}}|.*\d{{4}}-\d{{2}}-\d{{2}})[Tt ]{_COMPACT.replace(r"(\d{2})(\d{2})", r"(\d{2})(?:(\d{2})", 1).replace(r"(\d{2})?", r"(\d{2})?)?", 1)}(?![\d:])(.*)$", rf"(?s)^(.*?(?<!\d)\d{{8}}){_COMPACT}(?!\d)(.*)$"
    units = rf"(?s)^(.*?)(?<![\d:]){_UNITS}(.*)$"

    def of(kind: str, pattern: str, at: tuple[int, int, int, int, int], tail: int) -> Column:
        g = lambda i: F.regexp_extract(text, pattern, i) if i else F.lit("")
        fields = [F.lit(kind).alias("kind"), g(1).alias("head"), *(g(i).alias(n) for i, n in zip(at, ("hour", "minute", "second", "fraction", "half"), strict=True)), g(tail).alias("tail")]
        return F.struct(*fields)

    none = F.struct(F.lit("none").alias("kind"), text.alias("head"), *(F.lit("").alias(n) for n in ("hour", "minute", "second", "fraction", "half", "tail")))
    return F.when(text.rlike(colon), of("colon", colon, (2, 3, 4, 5, 6), 7)).when(text.rlike(hour), of("hour", hour, (2, 0, 0, 0, 3), 4)).when(text.rlike(units), of("units", units, (2, 3, 4, 5, 0), 6)).when(text.rlike(tee), of("tee", tee, (2, 3, 4, 5, 0), 6)).when(text.rlike(long), of("long", long, (2, 3, 4, 5, 0), 6)).otherwise(none)


def _tokens(rest: Column) -> Column:
    """(numbers: array of (value, long, month), weekday, bad) of what is neither time nor zone."""
    words = F.regexp_extract_all(F.lower(rest), F.lit(r"([a-z]+|\d+|[^\sa-z\d])"), F.lit(1))
    one = lambda v, long, month=False: F.struct(v.cast("int").alias("v"), F.lit(long).alias("long") if isinstance(long, bool) else long.alias("long"), F.lit(month).alias("month"))
    none = F.array().cast("array<struct<v:int,long:boolean,month:boolean>>")

    def of(w: Column) -> Column:
        digits, n = w.rlike(r"^\d+$"), F.length(w)
        cut = lambda a, k: F.substring(w, a, k).try_cast("int")
        month = _lookup(w, MONTHS)
        return (
            F.when(month.isNotNull(), F.array(one(month, False, True)))
            .when(digits & (n == 8), F.array(one(cut(1, 4), True), one(cut(5, 2), False), one(cut(7, 2), False)))
            .when(digits & (n == 6), F.array(one(cut(1, 2), False), one(cut(3, 2), False), one(cut(5, 2), False)))
            .when(digits & (n <= 4), F.array(one(w.try_cast("int"), n > 2)))
            .otherwise(none)
        )

    known = lambda w: w.isin(*FILLERS) | _lookup(w, MONTHS).isNotNull() | _lookup(w, WEEKDAYS).isNotNull() | w.rlike(r"^(\d{1,4}|\d{6}|\d{8})$")
    days = lambda ws: F.get(F.filter(F.transform(ws, lambda w: _lookup(w, WEEKDAYS)), lambda d: d.isNotNull()), F.lit(0))
    return let(words, lambda ws: F.struct(F.flatten(F.transform(ws, of)).alias("numbers"), days(ws).alias("weekday"), (F.exists(ws, lambda w: ~known(w)) | rest.rlike(_STUCK)).alias("bad")))


def _resolved(x: Column) -> Column:
    """(y, m, d) of up to three numbers; null fields aren't said, a null struct can't be."""
    v = lambda i: F.get(x, F.lit(i))["v"]
    named = F.array_position(F.transform(x, lambda e: e["month"]), True)  # the month's name, from 1; 0 without
    year = F.array_position(F.transform(x, lambda e: e["long"]), True)
    n = F.size(x)
    say = lambda y=None, m=None, d=None: F.struct(*((F.lit(None) if c is None else c).cast("int").alias(k) for k, c in zip("ymd", (y, m, d), strict=True)))
    other = F.when(named == 1, v(1)).otherwise(v(0))
    at = lambda i: F.get(x, i - 1)["v"]
    third = at(6 - named - year)  # the one of three that is neither
    one = F.when(named > 0, say(m=v(0))).when(v(0) > 31, say(y=v(0))).when(year > 0, say(y=v(0))).otherwise(say(d=v(0)))
    with_name = F.when(year > 0, say(y=at(year), m=at(named))).when(other > 31, say(y=other, m=at(named))).otherwise(say(m=at(named), d=other))
    two = F.when(named > 0, with_name).when((v(0) > 31) | (year == 1), say(y=v(0), m=v(1))).when((v(1) > 31) | (year == 2), say(y=v(1), m=v(0))).otherwise(say(m=v(0), d=v(1)))
    three = (
        F.when((named > 0) & (year > 0), say(at(year), at(named), third))
        .when(named == 1, F.when(v(1) > 31, say(v(1), v(0), v(2))).otherwise(say(v(2), v(0), v(1))))
        .when(named == 2, F.when(v(0) > 31, say(v(0), v(1), v(2))).otherwise(say(v(2), v(1), v(0))))
        .when(named == 3, F.when(v(1) > 31, say(v(1), v(2), v(0))).otherwise(say(v(0), v(2), v(1))))
        .when((v(0) > 31) | (year == 1), say(v(0), v(1), v(2)))
        .when(v(0) > 12, say(v(2), v(1), v(0)))
        .otherwise(say(v(2), v(0), v(1)))
    )
    twice = (F.size(F.filter(x, lambda e: e["long"])) > 1) | (F.size(F.filter(x, lambda e: e["month"])) > 1)
    return F.when(twice | (n > 3), None).when(n == 0, say()).when(n == 1, one).when(n == 2, two).when(n == 3, three)


def _instant(p: Column, z: Column, t: Column, now: Column) -> Column:
    """The instant of time parts, zone parts and tokens."""
    timed = p["kind"] != "none"
    hour = p["hour"].try_cast("int")
    half = F.lower(p["half"])
    hour24 = F.when(half == "", hour).when(hour > 12, None).when((half == "p") & (hour < 12), hour + 12).when((half == "a") & (hour == 12), 0).otherwise(hour)
    minute, second = (F.coalesce(p[c].try_cast("int"), F.lit(0)) for c in ("minute", "second"))
    micros = F.coalesce(F.rpad(F.substring(p["fraction"], 1, 6), 6, "0").try_cast("int"), F.lit(0))
    sign, figures = z["sign"], F.replace(z["offset"], F.lit(":"), F.lit(""))
    long = F.length(figures) > 2
    hours = F.when(long, F.substring(F.lpad(figures, 4, "0"), 1, 2).try_cast("int")).otherwise(figures.try_cast("int"))
    minutes = F.when(long, F.substring(F.lpad(figures, 4, "0"), 3, 2).try_cast("int")).otherwise(0)
    toward = F.when(sign == "+", 1).otherwise(-1) * F.when(z["name"] != "", -1).otherwise(1)
    offset = F.when(sign == "", 0).when(hours > 23, None).otherwise(toward * (hours * 3600 + minutes * 60))

    def build(r: Column) -> Column:
        here = F.year(now)
        near = F.when(r["y"] >= 100, r["y"]).otherwise(let(r["y"] + here - here % 100, lambda y: F.when(y >= here + 50, y - 100).when(y < here - 50, y + 100).otherwise(y)))
        # a year that was written with three or four digits is meant as it is
        full = F.exists(t["numbers"], lambda e: e["long"])
        year = F.coalesce(F.when(full, r["y"]).otherwise(near), here)
        month = F.coalesce(r["m"], F.month(now))
        first = F.try_make_timestamp(year, month, F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC"))
        day = F.coalesce(r["d"], F.least(F.dayofmonth(now), F.dayofmonth(F.last_day(first))))
        at = F.try_make_timestamp(year, month, day, F.when(timed, hour24).otherwise(F.lit(0)), minute, F.when(second < 60, second).cast("decimal(16,6)") + (micros / 1_000_000).cast("decimal(16,6)"), F.lit("UTC"))
        ahead = F.when(t["weekday"].isNotNull() & r["d"].isNull(), F.pmod(t["weekday"] - 1 - F.weekday(at), F.lit(7))).otherwise(0)
        said = timed | (F.size(t["numbers"]) > 0) | t["weekday"].isNotNull()
        return F.when(said & (year > 0) & ~t["bad"] & r.isNotNull(), F.timestamp_micros(F.unix_micros(at) + (ahead.cast("long") * 86_400 - offset) * 1_000_000))

    return let(_resolved(t["numbers"]), build)


def parsed(text: Column, now: Column) -> Column:
    """The instant that a text says, in a session of zone UTC; null where it isn't a date. now: what isn't said comes from it."""

    def with_zone(p: Column, z: Column) -> Column:
        return let(_tokens(F.concat_ws(" ", p["head"], z["before"], z["rest"])), lambda t: _instant(p, z, t, now))

    def with_time(p: Column) -> Column:
        tail = p["tail"]

        def of(pattern: str) -> Column:
            return F.struct(*(F.regexp_extract(tail, pattern, i).alias(n) for i, n in enumerate(("before", "name", "sign", "offset", "rest"), 1)))

        none = F.struct(F.lit("").alias("before"), *(F.lit("").alias(n) for n in ("name", "sign", "offset")), tail.alias("rest"))
        zone = F.when(tail.rlike(_NEXT), of(_NEXT)).when(tail.rlike(_LATER), of(_LATER)).otherwise(none)
        return let(zone, lambda z: with_zone(p, z))

    return F.when(F.trim(text) != "", let(_parts(F.trim(text)), with_time))


def first(now: Column, *texts: Column) -> Column:
    """The first of the texts that is an instant."""
    return F.coalesce(*(parsed(t, now) for t in texts))
