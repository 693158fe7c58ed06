"""Alignment to a calendar, coverage, missingness and validation of long panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def common_coverage(obs: DataFrame, key: str = "symbol", value: str = "price") -> DataFrame:
    """One row: start (the latest first day of any series) and end (the earliest last day)."""
    each = obs.groupBy(key).agg(F.min(F.when(F.col(value).isNotNull(), F.col("date"))).alias("first"), F.max(F.when(F.col(value).isNotNull(), F.col("date"))).alias("last"))
    return each.agg(F.max("first").alias("start"), F.min("last").alias("end"), F.count(F.when(F.col("first").isNull(), 1)).alias("empty"))


def checked_coverage(obs: DataFrame, key: str = "symbol", value: str = "price"):
    """(start, end); ValueError for a series without values or series that don't overlap."""
    row = common_coverage(obs, key, value).first()
    if row["empty"] or row["start"] is None:
        raise ValueError("a series has no values")
    if row["start"] >= row["end"]:
        raise ValueError("No overlapping coverage")
    return row["start"], row["end"]


def align(obs: DataFrame, calendar: DataFrame, key: str = "symbol", value: str = "price", fill: int = 0) -> DataFrame:
    """date, key, value on every day of calendar for every series; other days drop out; a value is carried on for fill days of the calendar at most."""
    grid = calendar.select("date").join(obs.select(key).distinct(), how="cross")  # a handful of series by days: the panel itself
    full = grid.join(obs.select("date", key, value), ["date", key], "left")
    if fill:
        recent = Window.partitionBy(key).orderBy("date").rowsBetween(-fill, 0)
        full = full.withColumn(value, F.last(value, ignorenulls=True).over(recent))
    return full


def availability(obs: DataFrame, key: str = "symbol", value: str = "price") -> DataFrame:
    """First and last day with a value, values, rows, and values as a share of the longest series' rows."""
    has = F.col(value).isNotNull()
    each = obs.groupBy(key).agg(F.min(F.when(has, F.col("date"))).alias("first_date"), F.max(F.when(has, F.col("date"))).alias("last_date"), F.count(value).alias("valid_days"), F.count(F.lit(1)).alias("total_days"))
    longest = each.agg(F.max("total_days").alias("longest"))
    return each.join(F.broadcast(longest)).select(key, "first_date", "last_date", "valid_days", "total_days", F.round(F.try_divide(F.col("valid_days") * 100.0, F.col("longest")), 1).alias("availability_pct"))


def missingness(panel: DataFrame, key: str = "symbol", value: str = "price") -> DataFrame:
    """For each series: first and last valid day, days, valid days, nulls before the first, gaps between, and coverage between in percent."""
    has = F.col(value).isNotNull()
    whole = Window.partitionBy(key)
    marked = panel.select(key, "date", has.alias("ok"), F.min(F.when(has, F.col("date"))).over(whole).alias("first_valid"), F.max(F.when(has, F.col("date"))).over(whole).alias("last_valid"))
    inside = F.col("date").between(F.col("first_valid"), F.col("last_valid"))
    return marked.groupBy(key, "first_valid", "last_valid").agg(
        F.count(F.lit(1)).alias("total_days"), F.count_if("ok").alias("valid_days"), F.count_if(F.coalesce(F.col("date") < F.col("first_valid"), F.lit(True))).alias("pre_inception"),
        F.count_if(inside & ~F.col("ok")).alias("gaps"), F.coalesce(F.round(F.try_divide(F.count_if("ok") * 100.0, F.count_if(inside)), 2), F.lit(0.0)).alias("coverage_pct"),
    )


def checked_columns(obs: DataFrame, key: str = "symbol", value: str = "price") -> DataFrame:
    """obs itself; ValueError that names columns that are missing, or a date that is neither date nor timestamp."""
    kinds = dict(obs.dtypes)
    missing = [c for c in (key, "date", value) if c not in kinds]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if kinds["date"] not in ("date", "timestamp", "timestamp_ntz"):
        raise ValueError(f"date is {kinds['date']}")
    return obs


def validate(obs: DataFrame, key: str = "symbol", value: str = "price", signed: bool = True) -> DataFrame:
    """Checks of each series: rows, duplicate dates, values under and at zero (errors, if signed) and nulls (a warning). Tables have no order of rows, so falling dates can't occur; null dates are one date."""
    checked_columns(obs, key, value)
    days = obs.groupBy(key, "date").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(value) < 0).alias("neg"), F.count_if(F.col(value) == 0).alias("zero"), F.count_if(F.col(value).isNull()).alias("null"))
    each = days.groupBy(key).agg(F.sum("n").alias("n_rows"), F.count_if(F.col("n") > 1).alias("duplicate_dates"), F.sum("neg").alias("negative"), F.sum("zero").alias("zeros"), F.sum("null").alias("nulls"))
    bad = F.col("duplicate_dates") + (F.col("negative") + F.col("zeros") if signed else 0)
    return each.select("*", F.round(F.try_divide(F.col("nulls") * 100.0, F.col("n_rows")), 2).alias("null_pct"), (bad == 0).alias("is_valid"))


def trim_to_complete(wide: DataFrame, columns: list[str]) -> DataFrame:
    """Rows from the first on which all columns have values; later nulls stay."""
    complete = wide.where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns)).agg(F.min("date").alias("_start"))
    return wide.join(F.broadcast(complete), F.col("date") >= F.col("_start")).drop("_start")
