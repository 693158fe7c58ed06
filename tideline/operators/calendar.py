"""Exchange calendars by rule."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

# Days on which the New York exchange stayed shut beside its holidays.
CLOSURES = ("2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11", "2007-01-02", "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09")
EXCHANGES = ("NYSE", "NASDAQ", "XNYS")


def nth_weekday(year: int, month: int, weekday: int, n: int) -> dt.date:
    """The n-th such weekday of a month, from its end if n is negative."""
    if n > 0:
        first = dt.date(year, month, 1)
        return first + dt.timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(1)
    return last - dt.timedelta((last.weekday() - weekday) % 7 + 7 * (-n - 1))


def easter(year: int) -> dt.date:
    """Gregorian Easter Sunday, by the anonymous algorithm."""
    golden, century, rest = year % 19, *divmod(year, 100)
    epact = (19 * golden + century - century // 4 - (century - (century + 8) // 25 + 1) // 3 + 15) % 30
    week = (32 + 2 * (century % 4) + 2 * (rest // 4) - epact - rest % 4) % 7
    month, day = divmod(epact + week - 7 * ((golden + 11 * epact + 22 * week) // 451) + 114, 31)
    return dt.date(year, month, day + 1)


def observed(day: dt.date) -> dt.date:
    """Saturday's holiday on Friday, Sunday's on Monday."""
    return day + dt.timedelta({5: -1, 6: 1}.get(day.weekday(), 0))


def holidays(year: int) -> set[dt.date]:
    new_year = dt.date(year, 1, 1)
    days = {
        nth_weekday(year, 1, 0, 3), nth_weekday(year, 2, 0, 3), easter(year) - dt.timedelta(2), nth_weekday(year, 5, 0, -1),
        observed(dt.date(year, 7, 4)), nth_weekday(year, 9, 0, 1), nth_weekday(year, 11, 3, 4), observed(dt.date(year, 12, 25)),
    }
    if new_year.weekday() != 5:  # a Saturday's New Year isn't made up for
        days.add(observed(new_year))
    if year >= 2022:
        days.add(observed(dt.date(year, 6, 19)))
    return days


def trading_days(spark: SparkSession, exchange: str, start: str | dt.date, end: str | dt.date) -> DataFrame:
    """date and day_idx of every session from start to end; ValueError for an exchange without rules."""
    if exchange not in EXCHANGES:
        raise ValueError(f"unknown exchange {exchange}")
    lo, hi = (dt.date.fromisoformat(str(d)) for d in (start, end))
    shut = {dt.date.fromisoformat(d) for d in CLOSURES} | {d for y in range(lo.year, hi.year + 1) for d in holidays(y)}
    days = [lo + dt.timedelta(k) for k in range((hi - lo).days + 1)]
    rows = [d for d in days if d.weekday() < 5 and d not in shut]
    return spark.createDataFrame(list(zip(rows, range(len(rows)), strict=True)), "date date, day_idx int")
