"""Long price and indicator panels from Parquet tables, and the calendars they align to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Assets in the order that pairs and wide columns follow.
ASSETS = ("AF", "AO", "NF", "NO", "RF", "RO")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def price_observations(spark: SparkSession, sf_dir: str, step: str = "day", base: float = 20_000.0) -> DataFrame:
    """date, symbol, price: base and mean unit price of each return flag and line status, by day or by week (Monday).

    The base brings the day-to-day changes of such means down to those of market prices.
    """
    l = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_shipdate", "l_extendedprice", "l_quantity")
    date = F.to_date(F.date_trunc("week" if step == "week" else "day", "l_shipdate"))
    return l.groupBy(date.alias("date"), F.concat("l_returnflag", "l_linestatus").alias("symbol")).agg((F.lit(base) + F.avg(F.expr("try_divide(l_extendedprice, l_quantity)"))).alias("price"))


def macro_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, series_id, value: mean order value of each priority by day."""
    o = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderpriority", "o_totalprice")
    return o.groupBy(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("series_id")).agg(F.avg("o_totalprice").alias("value"))


def weekdays_between(bounds: DataFrame) -> DataFrame:
    """date of every Monday to Friday from bounds' lo to its hi (one row)."""
    days = bounds.select(F.explode(F.expr("CASE WHEN lo <= hi THEN sequence(lo, hi, interval 1 day) ELSE array() END")).alias("date"))
    return days.where(F.weekday("date") < 5)


def span(observations: DataFrame) -> DataFrame:
    return observations.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
