"""Sessions of the New York exchange from 1995 on, as rules over a date column: no table of days has to be kept.

Closed are Saturdays and Sundays, holidays by their rules, and single days that no rule tells (`CLOSED`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Days on which the exchange stayed closed out of turn.
CLOSED = ["2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11", "2007-01-02", "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09"]
#: Holidays on a date (month, day, first year, whether a Saturday is kept on the Friday before).
DATED = [(1, 1, 1995, False), (6, 19, 2022, True), (7, 4, 1995, True), (12, 25, 1995, True)]
#: Holidays on a weekday (month, weekday from Monday 0, least day of the month, greatest, first year).
MOVING = [(1, 0, 15, 21, 1998), (2, 0, 15, 21, 1995), (5, 0, 25, 31, 1995), (9, 0, 1, 7, 1995), (11, 3, 22, 28, 1995)]


def easter(year: Column) -> Column:
    """Easter Sunday of a year, by the Gregorian rule: the Sunday after the full moon of the church's calendar."""
    whole = lambda a, b: F.floor(a / b)
    golden, century = year % 19, whole(year, 100)
    skipped = whole(century, 4)
    moon = whole(century - whole(century + 8, 25) + 1, 3)
    epact = (19 * golden + century - skipped - moon + 15) % 30
    to_sunday = (32 + 2 * (century % 4) + 2 * whole(year % 100, 4) - epact - (year % 100) % 4) % 7
    late = whole(golden + 11 * epact + 22 * to_sunday, 451)
    days = epact + to_sunday - 7 * late + 114
    return F.make_date(year, whole(days, 31).cast("int"), (days % 31 + 1).cast("int"))


def is_session(day: Column) -> Column:
    """Whether a date is a session."""
    year, month, of_month, weekday = F.year(day), F.month(day), F.dayofmonth(day), F.weekday(day)
    closed = (weekday > 4) | day.isin([F.lit(d).cast("date") for d in CLOSED]) | (day == F.date_sub(easter(year), 2))
    for m, d, since, friday in DATED:
        on = lambda x, m=m, d=d, since=since: (F.month(x) == m) & (F.dayofmonth(x) == d) & (F.year(x) >= since)
        closed = closed | on(day) | ((weekday == 0) & on(F.date_sub(day, 1)))
        closed = closed | ((weekday == 4) & on(F.date_add(day, 1))) if friday else closed
    for m, w, lo, hi, since in MOVING:
        closed = closed | ((month == m) & (weekday == w) & of_month.between(lo, hi) & (year >= since))
    return ~closed


def is_weekday(day: Column) -> Column:
    return F.weekday(day) < 5


def sessions(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(date, idx) of the sessions from start to end."""
    days = F.filter(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date")), is_session)
    return spark.range(1).select(F.posexplode(days).alias("idx", "date")).select("date", F.col("idx").cast("long").alias("idx"))
