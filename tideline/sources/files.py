"""Parquet tables, dated cache files and configuration files."""

from __future__ import annotations

import datetime as dt
import logging
import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = logging.getLogger("tideline")
STAMPED = re.compile(r"^(?P<id>.+)_(?P<stamp>\d{8})$")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; FileNotFoundError if it isn't there (local paths)."""
    if "://" not in str(path) and not Path(path).exists():
        raise FileNotFoundError(path)
    return spark.read.parquet(str(path))


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", by: list[str] | None = None) -> str:
    """df as Parquet, one folder for each value of the columns by; replaces what is there."""
    writer = df.write.mode("overwrite").option("compression", compression)
    (writer.partitionBy(*by) if by else writer).parquet(str(path))
    return str(path)


def cache_path(folder: str, identifier: str, day: dt.date | None = None, extension: str = ".parquet") -> Path:
    """<folder>/<identifier>_<YYYYMMDD><extension>, of today by default."""
    return Path(folder) / f"{identifier}_{(day or dt.date.today()):%Y%m%d}{extension}"


def cache_date(path: str | Path) -> dt.date | None:
    """The date in a cache file's name; None if it has none."""
    m = STAMPED.match(Path(path).stem)
    try:
        return dt.datetime.strptime(m["stamp"], "%Y%m%d").date() if m else None
    except ValueError:
        return None


def latest_cache(folder: str, identifier: str, extension: str = ".parquet") -> Path | None:
    """The newest cache of exactly this identifier, by the date in its name."""
    own = [p for p in Path(folder).glob(f"*{extension}") if (m := STAMPED.match(p.stem)) and m["id"] == identifier and cache_date(p)]
    return max(own, key=cache_date, default=None)


def cache_is_valid(path: str | Path, max_age_days: int | None = None, today: dt.date | None = None) -> bool:
    """The file is there, its name has a date, and that is at most max_age_days back (None: any age)."""
    day = cache_date(path)
    if not Path(path).exists() or day is None:
        return False
    return max_age_days is None or ((today or dt.date.today()) - day).days <= max_age_days


def ingest(spark: SparkSession, folder: str, identifiers: list[str], key: str, required: list[str] | None = None, fetch: Callable[[str], DataFrame] | None = None, max_age_days: int | None = None, refresh: bool = False) -> DataFrame:
    """The newest caches of all identifiers as one long table with the column key; ValueError if a required one (all by default) has none, a logged warning for others.

    fetch: called for identifiers without a cache of at most max_age_days (for all, with refresh); what it returns becomes
    today's cache. If it fails, that is an error for a required identifier, and a warning for others.
    """
    for i in identifiers if fetch else []:
        cached = latest_cache(folder, i)
        if refresh or cached is None or not cache_is_valid(cached, max_age_days):
            try:
                write_parquet(fetch(i), str(cache_path(folder, i)))
            except Exception as e:
                if required is None or i in required:
                    raise
                LOG.warning("%s: not fetched (%s)", i, e)
    for i in identifiers:
        if required is not None and i not in required and latest_cache(folder, i) is None:
            LOG.warning("no data for optional %s", i)
    found = {i: p for i in identifiers if (p := latest_cache(folder, i))}
    missing = [i for i in (identifiers if required is None else required) if i not in found]
    if missing:
        raise ValueError(f"no data for {', '.join(missing)}")
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)_\d{8}\.[^/]*(?:/[^/]*)?$", 1)
    return spark.read.parquet(*(str(p) for p in found.values())).withColumn(key, name)


def strategies(spark: SparkSession, folder: str, prefix: str = "weights_") -> DataFrame:
    """All weight tables of a folder as one, with the column strategy from their names; FileNotFoundError if there is none."""
    paths = sorted(str(p) for p in Path(folder).glob(f"{prefix}*.parquet"))
    if not paths:
        raise FileNotFoundError(f"{folder}/{prefix}*.parquet")
    return spark.read.parquet(*paths).withColumn("strategy", F.regexp_extract(F.col("_metadata.file_path"), rf"{prefix}([^/]*)\.parquet", 1))


def landed(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of a landing table between two dates (both inside; None: open); ValueError if none is there."""
    df = spark.read.parquet(path).withColumn("date", F.to_date("date"))
    df = df.where(F.col("date") >= start) if start else df
    df = df.where(F.col("date") <= end) if end else df
    if df.isEmpty():
        raise ValueError(f"no rows in {path} between {start} and {end}")
    return df
