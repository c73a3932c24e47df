"""Free-form dates: literal forms, and random ones against the library whose reading is to be matched."""

import datetime
import random
import warnings

import pytest
from pyspark.sql import functions as F

from newsloom.functions import freeform

NOW = datetime.datetime(2024, 5, 31)
UTC = datetime.timezone.utc
FORMS = """2024-01-15
2024-01-15 10:30
2024-01-15T10:30:00Z
2024-01-15T10:30:00.123456+05:30
2024-01-15T10:30:00,5-0800
20240115
20240115T103000
20240115T1030Z
20240115103045
202401151030
240115
Mon, 15 Jan 2024 10:30:00 GMT
Mon, 15 Jan 2024 10:30:00 +0000
Mon, 15 Jan 2024 10:30:00 EST
Mon, 15 Jan 2024 10:30 -0500 (EST)
Monday, January 15, 2024
January 15, 2024
January 15th, 2024 at 3:30 PM
Jan 15 2024 3pm
Jan. 15, 2024 3:30 p.m.
15 January 2024
15-Jan-2024
15-Jan-24 10:30
15/Jan/2024
15/01/2024
01/15/2024
1/2/2024
1/2/24
13/2/24
31/12/99
99-01-02
2024/1/5
2024.01.15
15.01.2024
15.1.24
Sept 5, 2024
September 2024
Jan 2024
2024-01
01-2024
2024
Mon Jan 15 10:30:00 UTC 2024
Mon Jan 15 10:30:00 2024
Mon Jan 15 10:30:00 2024 +0100
10:30
10:30:15 PM
12:00 am
12:30 pm
3 PM
3pm
Friday
Fri 10:30
Jan 15
15 Jan
1/15
15/1
10:30 15 January 2024
10:30 2024-01-15
2024-01-15 10:30 GMT+3
2024-01-15 10:30 UTC-5
2024-01-15 10:30 +3
2024-01-15 10:30 -03:30
2024-01-15 10:30 CET
2024-01-15 10:30 z
2024-01-15 24:00
2024-01-15 10:61
2024-13-01
2024-02-30
30 Feb 2024
29 Feb 2023
13:30 pm
0:30 am
10:30:60
tomorrow
not a date
15 foo 2024
2024-01-15 UTC
2024-01-15+05:00

 
,
1 2 3 4
2024 2023
Jan Feb 2024
2nd of January 2024
the 2nd of January 2024
Jan '24
'24 Jan 5
Apr-2003-25
25-Apr-03
03-Apr-25
99-Jan-01
2003-Sep-25
Sep-25-2003
25-Sep-2003
Sep 25 03
Thu Sep 25 10:36:28 2003
Thu Sep 10:36:28 2003
Thu 10:36:28
Sep 2003
09-25-2003
25-09-2003
10-09-2003
10-09-03
2003.Sep.25
10h36m28.5s
10 pm
10am on Jan 5
5 Jan 2024, 10:30
2024-01-15 at 10:30
Jan 5, 2024, 10:30:00 AM
2024-1-5 1:2
2024-1-5 1:02
1 Jan 1970 00:00:00 UTC
31 Dec 9999
Tue, 5 Nov 1985 23:59:59 -0000
Wed, 07 Aug 2024 08:00:00 +1400
Sat, 01 Jun 2024 00:00:00 +2400
2024-06-01T00:00:00+00:00
2024-06-01T00:00:00.000Z
2024-06-01T00:00:00.1234567Z
MAY 5 2024
may 5
JAN 5 2024 10:30 JST
Feb 29
Feb 31
June 31
2024-06
30
31
32
45
100
0
00
2024-01-15 10:30:00 PM
2024-01-15 22:30:00 PM
Thursday, 5 September
Thurs Sep 5 2024
Tues
1st Jan 2024
22nd Feb 2024 1:05am
3rd March 2024, 1:05 A.M.
2024-01-15T10:30:00 +0530
2024-01-15T10
2024-01-15T10:30:00+0530 (IST)
Mon,15 Jan 2024 10:30:00 GMT
15Jan2024
15 Jan, 2024; 10:30
5/6/7
50/6/7
5/60/7
5/6/70
5-Jun
Jun-5
2024Jan15
10h
10 hours 5 minutes
5 Jan 2024 10h30m
2024-01-15 10
20240115T10
10:30:00 -0500 2024-01-15
10:30 +0100 15 Jan 2024
2024-01-15 10:30+01:00
1:2:3""".split("\n")


def _read(spark, forms):
    rows = spark.createDataFrame([(s,) for s in forms], "s string").coalesce(2)
    got = rows.select("s", freeform.parsed(F.col("s"), F.lit("2024-05-31 00:00:00").cast("timestamp")).alias("t")).collect()
    return {r.s: r.t.replace(tzinfo=UTC) if r.t else None for r in got}


def test_literals(spark):
    at = lambda *a: datetime.datetime(*a, tzinfo=UTC)
    want = {
        "Mon, 15 Jan 2024 10:30:00 +0530": at(2024, 1, 15, 5), "January 15th, 2024 at 3:30 PM": at(2024, 1, 15, 15, 30), "15-Jan-24 10:30": at(2024, 1, 15, 10, 30), "13/2/24": at(2024, 2, 13), "1/2/24": at(2024, 1, 2), "31/12/99": at(1999, 12, 31),
        "20240115T1030Z": at(2024, 1, 15, 10, 30), "240115": at(2015, 1, 24), "2024-01-15 10:30 GMT+3": at(2024, 1, 15, 7, 30) + datetime.timedelta(hours=6), "2024-01-15 10:30 EST": at(2024, 1, 15, 10, 30), "Mon Jan 15 10:30:00 UTC 2024": at(2024, 1, 15, 10, 30),
        "Sept 2024": at(2024, 9, 30), "Feb 29": at(2024, 2, 29), "Friday": at(2024, 5, 31), "Mon": at(2024, 6, 3), "10:30": at(2024, 5, 31, 10, 30), "12 am": at(2024, 5, 31), "74-1-2": at(1974, 1, 2), "73-1-2": at(2073, 1, 2),
        "": None, " ": None, "not a date": None, "2024-02-30": None, "24:00": None, "13:30 pm": None, "1 2 3 4": None, "Tues": None, "15 foo 2024": None, "\u0663 Jan": None, "x" * 5000: None,
    }
    assert _read(spark, want) == want
    row = spark.sql("SELECT 'bad' AS a, '5 Jan 2024' AS b, CAST(NULL AS STRING) AS c").select(freeform.first(F.lit("2024-05-31").cast("timestamp"), F.col("c"), F.col("a"), F.col("b")).alias("t"), freeform.parsed(F.col("c"), F.lit("2024-05-31").cast("timestamp")).alias("n")).first()
    assert row.t == datetime.datetime(2024, 1, 5) and row.n is None


def _random(seed, n=900):
    rng, out = random.Random(seed), []
    for _ in range(n):
        day, month, year = rng.choice(["15", "5", "05", "31", "1st", "22nd"]), rng.choice(["Jan", "january", "SEPT", "Dec.", "5", "11", "02"]), rng.choice(["2024", "24", "99", "1985", "70"])
        sep = rng.choice([" ", "-", "/", ".", ", "])
        if (day[-1] in "td" and sep not in " , ") or (month[-1] == "." and sep != " ") or (sep == "." and not month.isdigit()):
            continue
        date = sep.join(rng.choice([(day, month, year), (month, day, year), (year, month, day)]))
        time = rng.choice(["", "10:30", "9:05:07", "12:00 AM", "11:59 p.m.", "3pm", "T10:30:00", "00:00:00.25", "7:08:09,5"])
        zone = rng.choice(["", "Z", " UTC", " GMT", " +0000", " -0330", "+05:30", " EST", " CEST", " GMT+2", " -7", " +0900 (JST)"]) if time else ""
        later = date + ("" if time.startswith("T") or not time else " ") + time + zone
        out.append(rng.choice(["", "Mon, ", "Friday ", "Sunday, "]) + (later if rng.random() < 0.85 or not time or time[0] == "T" else time + zone + " " + date))
    return out


@pytest.mark.parametrize("forms", [FORMS, _random(1), _random(2)])
def test_reads_as_the_library_does(spark, forms):
    parser = pytest.importorskip("dateutil.parser")
    warnings.simplefilter("ignore")
    want = {}
    for s in forms:
        try:
            t = parser.parse(s, default=NOW)
            want[s] = (t if t.tzinfo else t.replace(tzinfo=UTC)).astimezone(UTC)
        except (ValueError, OverflowError, TypeError):
            want[s] = None
    assert _read(spark, want) == want and sum(t is not None for t in want.values()) > len(want) / 2


def test_no_python_in_the_plan(spark):
    plan = spark.range(1).select(freeform.parsed(F.col("id").cast("string"), F.current_timestamp()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
