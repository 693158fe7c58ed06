"""Causal features as window expressions: every frame ends at the current row."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR = 252


def ordered(*by: str):
    return Window.partitionBy(*by).orderBy("date")


def trailing(rows: int, *by: str):
    return ordered(*by).rowsBetween(1 - rows, 0)


def so_far(*by: str):
    return ordered(*by).rowsBetween(Window.unboundedPreceding, 0)


def log_return(price: Column, over) -> Column:
    return F.ln(price) - F.lag(F.ln(price)).over(over)


def simple_return(price: Column, over, pad: bool = False) -> Column:
    """price / previous price - 1; with pad the last known prices stand in for nulls."""
    if pad:
        known = F.last(price, ignorenulls=True)
        now, before = known.over(over.rowsBetween(Window.unboundedPreceding, 0)), known.over(over.rowsBetween(Window.unboundedPreceding, -1))
        return F.try_divide(now, before) - 1
    return F.try_divide(price, F.lag(price).over(over)) - 1


def returns(panel: DataFrame, pad: bool = False) -> DataFrame:
    """panel (date, symbol, price) with ret (log) and simple."""
    w = ordered("symbol")
    return panel.withColumns({"ret": log_return(F.col("price"), w), "simple": simple_return(F.col("price"), w, pad)})


def at_least(n: int, counted: Column, over, value: Column) -> Column:
    return F.when(F.count(counted).over(over) >= n, value)


def volatility(ret: Column, over, least: int, annual: int | None = YEAR) -> Column:
    """Sample deviation over the frame, annualised, from least values on."""
    sd = F.stddev_samp(ret).over(over)
    return at_least(least, ret, over, sd * (annual**0.5) if annual else sd)


def drawdown(price: Column, over) -> Column:
    """Fall from the frame's highest price, as a negative share."""
    top = F.max(price).over(over)
    return F.try_divide(price - top, top)


def correlation(x: Column, y: Column, over, least: int) -> Column:
    """Pearson over the frame's complete pairs, null without variance or with under least pairs."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    r = F.try_divide(F.covar_pop(x, y).over(over), F.stddev_pop(x).over(over) * F.stddev_pop(y).over(over))
    return at_least(least, x, over, r)


def pair_correlations(rets: DataFrame, assets: list[str], window: int = 63, least: int = 30, exclude: tuple[str, ...] = ()) -> DataFrame:
    """date, a, b, corr for pairs in the order of assets: each day's returns meet in one map, so no join is needed."""
    kept = [s for s in assets if s not in exclude]
    days = rets.where(F.col("symbol").isin(kept)).groupBy("date").agg(*(F.max(F.when(F.col("symbol") == s, F.col("ret"))).alias(f"_{k}") for k, s in enumerate(kept)))
    pairs = F.array(*(F.struct(F.lit(kept[i]).alias("a"), F.lit(kept[j]).alias("b"), F.col(f"_{i}").alias("x"), F.col(f"_{j}").alias("y")) for i, j in combinations(range(len(kept)), 2)))
    long = days.select("date", F.explode(pairs).alias("p")).select("date", "p.*")
    w = trailing(window, "a", "b")
    return long.select("date", "a", "b", correlation(F.col("x"), F.col("y"), w, least).alias("corr"))


def average_correlation(corr: DataFrame) -> DataFrame:
    return corr.groupBy("date").agg(F.avg("corr").alias("avg_corr"))


def by_window(daily: DataFrame, windows: DataFrame, value: str) -> DataFrame:
    """name, days, mean, max of value in each window (name, start, end; both ends inside) with values, and the mean's ratio to that of all days."""
    inside = daily.where(F.col(value).isNotNull()).join(F.broadcast(windows), F.col("date").between(F.col("start"), F.col("end")))
    each = inside.groupBy("name").agg(F.count(value).alias("days"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    return each.join(F.broadcast(daily.agg(F.avg(value).alias("_all")))).select("name", "days", "mean", "max", F.try_divide("mean", "_all").alias("ratio"))


def selected(wide: DataFrame, columns: list[str]) -> DataFrame:
    """date and the named columns, as doubles, in their order; KeyError that names the missing ones. Upper and lower case are alike."""
    known = {c.lower(): c for c in wide.columns}
    missing = [c for c in columns if c.lower() not in known]
    if missing:
        raise KeyError(f"features not in the matrix: {', '.join(missing)}")
    return wide.select("date", *(F.col(f"`{known[c.lower()]}`").cast("double").alias(c) for c in columns))


def standardised(wide: DataFrame, columns: list[str], least: int = 60, by: tuple[str, ...] = ()) -> DataFrame:
    """by, date and z: the named columns' z-scores so far as an array; days on which one is missing drop out."""
    w = so_far(*by) if by else Window.partitionBy(F.lit(1)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    z = wide.select(*by, "date", *(expanding_zscore(F.col(f"`{c}`"), w, least).alias(c) for c in columns)).na.drop(subset=columns)
    return z.select(*by, "date", F.array(*(F.col(f"`{c}`") for c in columns)).alias("z"))


def expanding_zscore(x: Column, over, least: int = 60) -> Column:
    """(x - mean) / sample deviation of all values so far, from least values on; null without variance."""
    return at_least(least, x, over, F.try_divide(x - F.avg(x).over(over), F.stddev_samp(x).over(over)))


def long_features(panel: DataFrame, short: int = 21, long: int = 63, least: int = 15, peak: int = 252, annual: int = YEAR) -> DataFrame:
    """panel with ret, simple, vol of both windows and dd, all from one sort for each symbol."""
    rets = returns(panel)
    ret = F.col("ret")
    return rets.withColumns({f"vol{short}": volatility(ret, trailing(short, "symbol"), least, annual), f"vol{long}": volatility(ret, trailing(long, "symbol"), least, annual), "dd": drawdown(F.col("price"), trailing(peak, "symbol"))})


def wide(long: DataFrame, assets: list[str], values: dict[str, str]) -> DataFrame:
    """One row for each date with <asset><suffix> columns; values: column -> suffix. An aggregate with the column list given, so no job looks for values."""
    return long.groupBy("date").agg(*(F.max(F.when(F.col("symbol") == s, F.col(c))).alias(f"{s.lower()}{suffix}") for c, suffix in values.items() for s in assets))


def feature_matrix(panel: DataFrame, macro: DataFrame | None, assets: list[str], series: list[str] = (), exclude: tuple[str, ...] = (), short: int = 21, long: int = 63, corr_window: int = 63, peak: int = 252, least: int = 15, least_corr: int = 30, annual: int = YEAR) -> DataFrame:
    """All features, one row for each date: returns, volatilities, drawdowns, pair and average correlations, indicators."""
    feats = long_features(panel, short, long, least, peak, annual)
    out = wide(feats, assets, {"ret": "_ret", f"vol{short}": f"_vol{short}d", f"vol{long}": f"_vol{long}d", "dd": "_dd"})
    corr = pair_correlations(feats, assets, corr_window, least_corr, exclude)
    kept = [s for s in assets if s not in exclude]
    named = [F.max(F.when((F.col("a") == a) & (F.col("b") == b), F.col("corr"))).alias(f"{a.lower()}_{b.lower()}_corr{corr_window}d") for a, b in combinations(kept, 2)]
    out = out.join(corr.groupBy("date").agg(*named, F.avg("corr").alias(f"avg_corr{corr_window}d")), "date", "left")
    if macro is not None:
        out = out.join(macro.groupBy("date").agg(*(F.max(F.when(F.col("series_id") == s, F.col("value"))).alias(n) for s, n in series)), "date", "left")
    return out


def metadata(columns: list[str]) -> list[dict[str, str]]:
    """name, kind and description of feature columns, by their names."""
    kinds = [("_ret", "return", "log return"), ("_simpleret", "return", "simple return"), ("_vol", "volatility", "annualised rolling volatility"), ("avg_corr", "correlation", "mean of the pairs' rolling correlations"), ("_corr", "correlation", "rolling correlation"), ("_dd", "drawdown", "fall from the rolling peak")]
    return [next(({"name": c, "kind": k, "description": d} for mark, k, d in kinds if mark in c), {"name": c, "kind": "macro", "description": "indicator, carried forward"}) for c in columns if c != "date"]
