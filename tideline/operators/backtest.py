"""Rebalancing schedules, weights, backtests, metrics and significance."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import normal_cdf
from ..models.allocators import Allocator, optimality_gap

YEAR = 252


def rebalance_days(days: DataFrame, lookback: int = 252, every: int = 21, on_change: bool = True) -> DataFrame:
    """Days (strategy, date, regime, i) on which weights are set: warm (their row number i, from 1, reaches lookback) and labelled, and first, every so many rows since the last, or at another label than at the last.

    Each depends on the last one, so a fold over a strategy's days finds them; days without a label may lie anywhere.
    """
    rows = days.withColumn("i", F.row_number().over(Window.partitionBy("strategy").orderBy("date"))).where((F.col("i") >= lookback) & F.col("regime").isNotNull())
    kind = "array<struct<i:int,date:date,regime:int>>"
    packed = rows.groupBy("strategy").agg(F.sort_array(F.collect_list(F.struct("i", "date", F.col("regime").cast("int").alias("regime")))).cast(kind).alias("d"))

    def fold(done, day):
        last = F.try_element_at(done, F.lit(-1))
        due = last.isNull() | (day["i"] - last["i"] >= every)
        return F.when(due | (day["regime"] != last["regime"]) if on_change else due, F.concat(done, F.array(day))).otherwise(done)

    return packed.select("strategy", F.inline(F.aggregate("d", F.array().cast(kind), fold))).select("strategy", "date", "regime", "i")


def allocate(returns: DataFrame, assets: list[str], strategies: dict, labels: DataFrame | None = None, lookback: int = 252, every: int = 21, on_change: bool = True) -> DataFrame:
    """strategy, date, asset, w of every day from the first rebalancing on.

    returns: date, symbol, simple; labels: date, regime. strategies: for each name an allocator (blind to labels), a dict from
    label to allocator (labels that it lacks take that of its smallest), or a function from the label (None without labels) to an allocator.
    An allocator has weights(window of returns, weights before or None). Rebalancings are groups of their own, each with its window
    of returns, so all of all strategies run in parallel, unless each depends on the one before: then the strategy is one task. That is so
    for a turnover penalty, for functions, and for own allocators that don't say depends_on_previous = False.
    """
    day = returns.groupBy("date").agg(*(F.max(F.when(F.col("symbol") == s, F.col("simple"))).alias(f"_{k}") for k, s in enumerate(assets))).na.drop()
    day = day.select("date", F.array(*(f"_{k}" for k in range(len(assets)))).alias("r"), F.row_number().over(Window.orderBy("date")).alias("i"))
    names = day.select("date", F.explode(F.array(*map(F.lit, strategies))).alias("strategy"))
    blind = [n for n, a in strategies.items() if hasattr(a, "weights") or labels is None]
    if labels is not None:
        names = names.join(labels.select("date", F.col("regime").alias("label")), "date", "left")
    else:
        names = names.withColumn("label", F.lit(None).cast("int"))
    names = names.withColumn("regime", F.when(F.col("strategy").isin(blind), F.lit(0)).otherwise(F.col("label")))
    labelled = labels is not None

    def solve(name, regime, window, before=None):
        chosen = strategies[name]
        if isinstance(chosen, dict):
            chosen = chosen.get(regime, chosen[min(chosen)])
        elif not hasattr(chosen, "weights"):
            chosen = chosen(regime if labelled else None)
        return chosen.weights(window, before)

    def rows_of(name, date, w):
        return [(name, date, a, float(x)) for a, x in zip(assets, w, strict=True)]

    def solve_one(pdf):
        import pandas as pd

        pdf = pdf.sort_values("j")
        name, at, regime = pdf["strategy"].iloc[0], pdf["date"].iloc[0], int(pdf["regime"].iloc[0])
        return pd.DataFrame(rows_of(name, at, solve(name, regime, np.array(pdf["r"].tolist(), dtype=float))), columns=["strategy", "date", "asset", "w"])

    def solve_all(pdf):
        import pandas as pd

        pdf = pdf.sort_values("i", ignore_index=True)
        name, r, current, rows = pdf["strategy"].iloc[0], np.array(pdf["r"].tolist(), dtype=float), None, []
        for t in pdf.index[pdf["due"].notna()]:
            current = solve(name, int(pdf["due"].iloc[t]), r[t + 1 - lookback : t + 1], current)
            rows += rows_of(name, pdf["date"].iloc[t], current)
        return pd.DataFrame(rows, columns=["strategy", "date", "asset", "w"])

    schema = "strategy string, date date, asset string, w double"
    free_of = lambda a: not getattr(a, "depends_on_previous", True)
    serial = [n for n, a in strategies.items() if not all(map(free_of, a.values() if isinstance(a, dict) else [a]))]
    due = rebalance_days(names, lookback, every, on_change)
    free = due.where(~F.col("strategy").isin(serial)) if serial else due
    windows = free.withColumn("j", F.explode(F.sequence(F.col("i") - lookback + 1, F.col("i")))).join(day.select(F.col("i").alias("j"), "r"), "j")
    set_ = windows.groupBy("strategy", "i").applyInPandas(solve_one, schema)
    if serial:
        whole = names.select("strategy", "date").where(F.col("strategy").isin(serial)).join(day, "date").join(due.select("strategy", "date", F.col("regime").alias("due")), ["strategy", "date"], "left")
        set_ = set_.unionAll(whole.groupBy("strategy").applyInPandas(solve_all, schema))
    return hold(set_, names.select("strategy", "date"), assets)


def optimality(returns: DataFrame, assets: list[str], strategies: dict[str, Allocator], lookback: int = 252, every: int = 21) -> DataFrame:
    """strategy, date, total (sum of weights) and gap (see optimality_gap()) of every rebalancing of static strategies without a turnover penalty."""
    day = returns.groupBy("date").agg(*(F.max(F.when(F.col("symbol") == s, F.col("simple"))).alias(f"_{k}") for k, s in enumerate(assets))).na.drop()
    day = day.select("date", F.array(*(f"_{k}" for k in range(len(assets)))).alias("r"), F.row_number().over(Window.orderBy("date")).alias("i"))
    due = rebalance_days(day.select("date", F.explode(F.array(*map(F.lit, strategies))).alias("strategy"), F.lit(0).alias("regime")), lookback, every)
    held = allocate(returns, assets, strategies, None, lookback, every).groupBy("strategy", "date").agg(F.array(*(F.max(F.when(F.col("asset") == a, F.col("w"))) for a in assets)).alias("w"))
    rows = due.join(held, ["strategy", "date"]).withColumn("j", F.explode(F.sequence(F.col("i") - lookback + 1, F.col("i")))).join(day.select(F.col("i").alias("j"), "r"), "j")

    def measure(pdf):
        import pandas as pd

        pdf = pdf.sort_values("j")
        name, w = pdf["strategy"].iloc[0], np.array(pdf["w"].iloc[0], dtype=float)
        chosen = strategies[name]
        gap = optimality_gap(chosen.name, np.array(pdf["r"].tolist(), dtype=float), w, **dict(chosen.settings))
        return pd.DataFrame({"strategy": [name], "date": [pdf["date"].iloc[0]], "total": [w.sum()], "gap": [gap]})

    return rows.groupBy("strategy", "i").applyInPandas(measure, "strategy string, date date, total double, gap double")


def hold(set_: DataFrame, days: DataFrame, assets: list[str]) -> DataFrame:
    """Weights carried on from each rebalancing to the next."""
    grid = days.withColumn("asset", F.explode(F.array(*map(F.lit, assets))))
    w = Window.partitionBy("strategy", "asset").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(set_, ["strategy", "date", "asset"], "left").withColumn("w", F.last("w", ignorenulls=True).over(w)).where("w IS NOT NULL")


def run_backtest(weights: DataFrame, returns: DataFrame, cost_bps: Column | float = 10.0, extra: tuple[str, ...] = ()) -> DataFrame:
    """strategy, date, gross, cost, net, turnover, equity: a day earns on the weights of the day before.

    weights: strategy, date, asset, w (days with a null weight drop out); returns: date, asset, r. A missing return counts as 0.
    """
    key = ["strategy", *extra]
    per_asset = Window.partitionBy(*key, "asset").orderBy("date")
    whole = weights.withColumn("_ok", F.min(F.col("w").isNotNull()).over(Window.partitionBy(*key, "date"))).where("_ok").drop("_ok")
    dated = whole.join(returns.select("date").distinct(), "date", "left_semi").join(returns, ["date", "asset"], "left")
    held = dated.withColumn("held", F.coalesce(F.lag("w").over(per_asset), F.lit(0.0)))
    moved = held.withColumn("moved", F.abs(F.col("held") - F.coalesce(F.lag("held").over(per_asset), F.lit(0.0))))
    day = moved.groupBy(*key, "date").agg(F.sum(F.coalesce(F.col("held") * F.col("r"), F.lit(0.0))).alias("gross"), F.sum("moved").alias("turnover"))
    cost = (cost_bps if isinstance(cost_bps, Column) else F.lit(float(cost_bps))) / 1e4 * F.col("turnover")
    net = day.withColumn("cost", cost).withColumn("net", F.col("gross") - F.col("cost"))
    so_far = Window.partitionBy(*key).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return net.withColumn("equity", F.product(1 + F.col("net")).over(so_far))


def in_excess(bt: DataFrame, risk_free: DataFrame | None = None) -> DataFrame:
    """bt with excess: net less the risk-free return (date, rf) of the day; a day without one counts as 0, as all do without the series."""
    if risk_free is None:
        return bt.withColumn("excess", F.col("net"))
    return bt.join(risk_free.select("date", "rf"), "date", "left").withColumn("excess", F.col("net") - F.coalesce("rf", F.lit(0.0))).drop("rf")


def metrics(bt: DataFrame, key: tuple[str, ...] = ("strategy",), risk_free: DataFrame | None = None) -> DataFrame:
    """Annual return, volatility, Sharpe (of the return in excess of risk_free), largest drawdown (of an equity that starts after the first day) and annual turnover."""
    bt = in_excess(bt, risk_free)
    peak = F.max("equity").over(Window.partitionBy(*key).orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    n = F.count("net")
    down = bt.withColumn("dd", F.try_divide(peak - F.col("equity"), peak))
    return down.groupBy(*key).agg(
        n.alias("days"), (F.pow(F.product(1 + F.col("net")), F.lit(float(YEAR)) / n) - 1).alias("ann_return"), (F.stddev_samp("net") * YEAR**0.5).alias("ann_vol"),
        (F.try_divide(F.avg("excess"), F.stddev_samp("excess")) * YEAR**0.5).alias("sharpe"), F.max("dd").alias("max_drawdown"), F.try_divide(F.sum("turnover") * YEAR, 2 * n).alias("ann_turnover"),
    ).withColumn("calmar", F.when(F.col("max_drawdown") > 0, F.col("ann_return") / F.col("max_drawdown")))


def stress_returns(bt: DataFrame, windows: DataFrame, key: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """name, key, total return, largest drawdown and days of each window (name, start, end; both ends inside). Equity starts anew in each."""
    inside = bt.join(F.broadcast(windows), F.col("date").between(F.col("start"), F.col("end")))
    w = Window.partitionBy("name", *key).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    eq = inside.withColumn("eq", F.product(1 + F.col("net")).over(w))
    eq = eq.withColumn("dd", F.try_divide(F.max("eq").over(w) - F.col("eq"), F.max("eq").over(w)))
    return eq.groupBy("name", *key).agg((F.product(1 + F.col("net")) - 1).alias("total_return"), F.max("dd").alias("max_drawdown"), F.count(F.lit(1)).alias("days"))


def mean_weights(weights: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Mean weight and days by strategy and asset; with labels (date, regime) only over their days, and also by regime."""
    means = (F.avg("w").alias("mean_w"), F.count(F.lit(1)).alias("days"))
    if labels is None:
        return weights.groupBy("strategy", "asset").agg(*means)
    return weights.join(labels, "date").groupingSets([["strategy", "asset"], ["strategy", "asset", "regime"]], "strategy", "asset", "regime").agg(*means)


def turnover(weights: DataFrame) -> DataFrame:
    """Rebalancings and turnover a year (of calendar days) of each strategy; turnover is half the sum of changes."""
    w = Window.partitionBy("strategy", "asset").orderBy("date")
    day = weights.withColumn("dw", F.abs(F.col("w") - F.lag("w").over(w))).groupBy("strategy", "date").agg((F.sum("dw") / 2).alias("t"))
    years = F.datediff(F.max("date"), F.min("date")) / 365.25
    return day.groupBy("strategy").agg(F.count_if(F.col("t") > 1e-9).alias("rebalances"), F.try_divide(F.sum("t"), years).alias("annual_turnover"))


def common_window(bt: DataFrame) -> DataFrame:
    """Days on which every strategy has a row."""
    n = bt.agg(F.countDistinct("strategy").alias("n"))
    days = bt.groupBy("date").agg(F.countDistinct("strategy").alias("k")).join(F.broadcast(n)).where("k = n").select("date")
    return bt.join(days, "date", "left_semi")


def psr_arguments(bt: DataFrame, benchmark: Column | float = 0.0, risk_free: DataFrame | None = None) -> DataFrame:
    """Daily Sharpe sr, population skew g3 and kurtosis g4 of returns in excess of risk_free, and the argument of the normal in the probabilistic Sharpe ratio."""
    x = F.col("excess")
    m = in_excess(bt, risk_free).groupBy("strategy").agg(F.count(x).alias("n"), F.try_divide(F.avg(x), F.stddev_samp(x)).alias("sr"), F.skewness(x).alias("g3"), (F.kurtosis(x) + 3).alias("g4"))
    star = benchmark if isinstance(benchmark, Column) else F.lit(float(benchmark))
    spread = F.sqrt(1 - F.col("g3") * F.col("sr") + (F.col("g4") - 1) / 4 * F.col("sr") ** 2)
    return m.withColumn("z", F.try_divide((F.col("sr") - star) * F.sqrt(F.col("n") - 1), spread))


def expected_max_sharpe(variance: float, trials: int) -> float:
    if trials < 2 or not variance > 0:
        return 0.0
    inv, gamma = NormalDist().inv_cdf, 0.5772156649015329
    return variance**0.5 * ((1 - gamma) * inv(1 - 1 / trials) + gamma * inv(1 - 1 / (trials * np.e)))


def deflated_sharpe(bt: DataFrame, risk_free: DataFrame | None = None) -> DataFrame:
    """strategy and the probability that its Sharpe ratio (in excess of risk_free) beats the best of as many trials without skill."""
    trials = psr_arguments(bt, 0.0, risk_free).select("strategy", "n", "sr").agg(F.var_samp("sr").alias("v"), F.count("sr").alias("k")).first()
    star = expected_max_sharpe(trials["v"] or 0.0, trials["k"])
    return psr_arguments(bt, star, risk_free).select("strategy", "sr", F.when(F.col("n") >= 3, normal_cdf(F.col("z"))).alias("dsr"))


def pbo_splits(net: DataFrame, n_blocks: int = 16) -> DataFrame:
    """For each half of the blocks as training set: the best strategy there, its rank among the others' results, and the logit.

    net: idx (row number from 0), strategy, net. Sums and squares of each block come first; the splits work on those few rows.
    """
    shape = net.agg((F.max("idx") + 1).alias("t"), F.countDistinct("strategy").alias("n")).first()
    rows = (shape["t"] or 0) // n_blocks
    if n_blocks % 2 or shape["n"] < 2 or rows < 2:
        raise ValueError("needs an even number of blocks, two strategies, and two rows in a block")
    blocks = net.where(F.col("idx") < rows * n_blocks).groupBy("strategy", F.floor(F.col("idx") / rows).cast("int").alias("block")).agg(F.sum("net").alias("s1"), F.sum(F.col("net") * F.col("net")).alias("s2"))
    masks = net.sparkSession.range(1 << n_blocks).where(F.bit_count("id") == n_blocks // 2)
    inside = F.expr("(id >> block) & 1") == 1
    one = lambda c, cond: F.sum(F.when(cond, F.col(c)).otherwise(0.0))
    half = float(rows * n_blocks // 2)
    sharpe = lambda s1, s2: F.col(s1) / half / F.sqrt(F.greatest(F.col(s2) / half - (F.col(s1) / half) ** 2, F.lit(1e-18)))
    sums = F.broadcast(blocks).join(masks).groupBy("id", "strategy").agg(one("s1", inside).alias("a1"), one("s2", inside).alias("a2"), one("s1", ~inside).alias("b1"), one("s2", ~inside).alias("b2"))
    scored = sums.select("id", "strategy", sharpe("a1", "a2").alias("si"), sharpe("b1", "b2").alias("so"))
    by = Window.partitionBy("id")
    ranked = scored.withColumns({"best": F.row_number().over(by.orderBy(F.desc("si"), "strategy")), "rank": F.row_number().over(by.orderBy("so", "strategy"))})
    omega = F.col("rank") / (shape["n"] + 1.0)
    return ranked.where("best = 1").select("id", "strategy", "rank", F.ln(omega / (1 - omega)).alias("logit"))


def pbo(net: DataFrame, n_blocks: int = 16) -> DataFrame:
    return pbo_splits(net, n_blocks).agg(F.count(F.lit(1)).alias("splits"), F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"))
