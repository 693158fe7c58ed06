"""Registered queries over the panels, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..models.allocators import Allocator
from ..models.states import known_jump, known_markov
from ..operators import backtest as bt
from ..operators import features as ft
from ..operators import labels as lb
from ..operators import panel as pn
from ..operators.calendar import trading_days
from ..sources import panels as src
from ..streaming import filters
from . import oracle

ASSETS = list(src.ASSETS)
MACRO = [(s, "m" + s[0]) for s in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]
COSTS = (0.0, 5.0, 10.0, 20.0)


def r6(df: DataFrame) -> DataFrame:
    """Doubles rounded to six places, so that engines that add in another order agree."""
    return df.select(*(((F.round(F.col(f"`{c}`"), 6) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`")) for c, t in df.dtypes))


def prices(spark: SparkSession, d: str) -> DataFrame:
    return src.price_observations(spark, d)


def calendar(spark: SparkSession, d: str) -> DataFrame:
    return src.weekdays_between(src.span(prices(spark, d)))


def panel(spark: SparkSession, d: str) -> DataFrame:
    return pn.align(prices(spark, d), calendar(spark, d))


def macro(spark: SparkSession, d: str) -> DataFrame:
    return pn.align(src.macro_observations(spark, d), calendar(spark, d), "series_id", "value", 5)


def feats(spark: SparkSession, d: str) -> DataFrame:
    return ft.long_features(panel(spark, d))


def corr(spark: SparkSession, d: str) -> DataFrame:
    return ft.pair_correlations(ft.returns(panel(spark, d)), ASSETS, exclude=("RO",))


def market(spark: SparkSession, d: str) -> DataFrame:
    """date and z-scores (so far) of mean volatilities, mean fall and mean correlation of all assets."""
    day = feats(spark, d).groupBy("date").agg(F.avg("vol21").alias("v21"), F.avg("vol63").alias("v63"), (-F.avg("dd")).alias("fall"))
    day = day.join(ft.average_correlation(corr(spark, d)), "date", "left").withColumn("panel_id", F.lit(1))
    w = ft.so_far("panel_id")
    return day.select("date", *(ft.expanding_zscore(F.col(c), w).alias(c) for c in ("v21", "v63", "fall", "avg_corr")))


def rule_labels(spark: SparkSession, d: str) -> DataFrame:
    """method, date, regime by fixed cuts of two z-scores: a label source that SQL can express too."""
    both = market(spark, d).select("date", F.explode(F.array(F.struct(F.lit("fall").alias("method"), F.col("fall").alias("z")), F.struct(F.lit("vol").alias("method"), F.col("v21").alias("z")))).alias("m"))
    return both.select("m.method", "date", F.when(F.col("m.z") < 0, 0).when(F.col("m.z") < 1, 1).when(F.col("m.z").isNotNull(), 2).alias("regime"))


def known_labels(spark: SparkSession, d: str) -> DataFrame:
    return rule_labels(spark, d).where("regime IS NOT NULL")


def stress(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(oracle.STRESS, "name string, start string, end string").select("name", F.to_date("start").alias("start"), F.to_date("end").alias("end"))


def simple_returns_of(spark: SparkSession, d: str) -> DataFrame:
    return ft.returns(panel(spark, d)).select("date", F.col("symbol").alias("asset"), F.expm1("ret").alias("r"))


def weights(spark: SparkSession, d: str) -> DataFrame:
    """Three strategies of plain rules: equal, by inverse volatility, and tilted to later assets."""
    f = feats(spark, d).select("date", F.col("symbol").alias("asset"), F.try_divide(F.lit(1.0), F.col("vol21")).alias("iv"))
    whole = Window.partitionBy("date")
    f = f.withColumns({"n": F.count("iv").over(whole), "total": F.sum("iv").over(whole)}).where(F.col("n") == len(ASSETS))
    tilt = F.element_at(F.create_map(*(x for k, a in enumerate(ASSETS, 1) for x in (F.lit(a), F.lit(k / 21)))), F.col("asset"))
    kinds = F.array(*(F.struct(F.lit(n).alias("strategy"), w.alias("w")) for n, w in (("equal", F.lit(1 / 6)), ("inverse_vol", F.try_divide("iv", "total")), ("tilt", tilt))))
    return f.select("date", "asset", F.explode(kinds).alias("k")).select("k.strategy", "date", "asset", "k.w")


def tested(spark: SparkSession, d: str) -> DataFrame:
    return bt.run_backtest(weights(spark, d), simple_returns_of(spark, d))


def z_matrix(spark: SparkSession, d: str) -> DataFrame:
    return market(spark, d).na.drop().select("date", F.array("v21", "v63", "fall", "avg_corr").alias("z"))


def complete_returns(spark: SparkSession, d: str) -> DataFrame:
    return ft.returns(panel(spark, d)).select("date", "symbol", F.expm1("ret").alias("simple"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Weekly features of the asset panel, wide."""
    weekly = src.price_observations(spark, d, "week")
    return r6(ft.wide(ft.long_features(weekly, 13, 26, 8, 52), ASSETS, {"ret": "_ret", "vol13": "_vol13w", "dd": "_dd"}))


# One function for each query; names are those of QUERIES.
def calendar_days(spark, d):
    return calendar(spark, d)


def exchange_calendar(spark, d):
    return trading_days(spark, "NYSE", "2020-01-01", "2020-12-31")


def price_panel(spark, d):
    return r6(panel(spark, d))


def macro_ffill_limit(spark, d):
    return r6(macro(spark, d))


def log_returns(spark, d):
    return r6(ft.returns(panel(spark, d)).select("date", "symbol", "ret"))


def simple_returns(spark, d):
    return r6(ft.returns(panel(spark, d)).select("date", "symbol", "simple"))


def simple_returns_padded(spark, d):
    return r6(ft.returns(panel(spark, d), pad=True).select("date", "symbol", "simple"))


def rolling_vol_21(spark, d):
    return r6(feats(spark, d).select("date", "symbol", "vol21"))


def rolling_vol_63(spark, d):
    return r6(feats(spark, d).select("date", "symbol", "vol63"))


def drawdown_252(spark, d):
    return r6(feats(spark, d).select("date", "symbol", "dd"))


def pair_corr_63(spark, d):
    return r6(corr(spark, d))


def avg_corr_63(spark, d):
    return r6(ft.average_correlation(corr(spark, d)))


def expanding_zscore(spark, d):
    return r6(market(spark, d))


def usable_rows(spark, d):
    return market(spark, d).agg(F.count(F.lit(1)).alias("days"), F.count_if(F.col("v21").isNotNull() & F.col("v63").isNotNull() & F.col("fall").isNotNull() & F.col("avg_corr").isNotNull()).alias("usable"))


def feature_matrix_trimmed(spark, d):
    wide = ft.feature_matrix(panel(spark, d), macro(spark, d), ASSETS, MACRO, ("RO",))
    return r6(pn.trim_to_complete(wide, [f"{a.lower()}_ret" for a in ASSETS]))


def common_coverage(spark, d):
    return pn.common_coverage(prices(spark, d)).select("start", "end")


def asset_availability(spark, d):
    return pn.availability(prices(spark, d))


def missingness(spark, d):
    return pn.missingness(panel(spark, d))


def price_validation(spark, d):
    return pn.validate(prices(spark, d))


def macro_validation(spark, d):
    return pn.validate(src.macro_observations(spark, d), "series_id", "value", signed=False)


def return_describe(spark, d):
    ret = ft.returns(panel(spark, d))
    return r6(ret.groupBy("symbol").agg(F.count("ret").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("std"), F.min("ret").alias("min"), F.max("ret").alias("max"), (F.avg("ret") * 252).alias("ann_mean"), (F.try_divide(F.avg("ret"), F.stddev_samp("ret")) * 252**0.5).alias("sharpe")))


def corr_summary(spark, d):
    return r6(ft.average_correlation(corr(spark, d)).agg(F.avg("avg_corr").alias("mean"), F.stddev_samp("avg_corr").alias("std"), F.min("avg_corr").alias("min"), F.max("avg_corr").alias("max")))


def corr_histogram(spark, d):
    avg = ft.average_correlation(corr(spark, d)).where("avg_corr IS NOT NULL")
    edges = avg.agg(F.min("avg_corr").alias("lo"), F.max("avg_corr").alias("hi"))
    bucket = F.least(F.floor(F.try_divide(F.col("avg_corr") - F.col("lo"), F.col("hi") - F.col("lo")) * 50), F.lit(49))
    return avg.join(F.broadcast(edges)).groupBy(bucket.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def corr_matrix(spark, d):
    """Pearson of each pair over the last 500 days on which all assets have returns."""
    ret = ft.returns(panel(spark, d))
    days = ret.groupBy("date").agg(*(F.max(F.when(F.col("symbol") == s, F.col("ret"))).alias(s) for s in ASSETS)).na.drop().orderBy(F.desc("date")).limit(500)
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in combinations(ASSETS, 2)))
    return r6(days.select(F.explode(pairs).alias("p")).select("p.*").groupBy("a", "b").agg(F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")).alias("corr")))


def label_runs(spark, d):
    return lb.runs(known_labels(spark, d))


def label_distribution(spark, d):
    return r6(lb.distribution(known_labels(spark, d)))


def label_persistence(spark, d):
    return r6(lb.persistence(known_labels(spark, d)))


def crisis_share(spark, d):
    return r6(lb.crisis_share(known_labels(spark, d), stress(spark)))


def detector_agreement(spark, d):
    return r6(lb.agreement(known_labels(spark, d)))


def crisis_intervals(spark, d):
    return lb.runs(known_labels(spark, d)).where("regime = 2").select("method", "start", "end", "days")


def rebalance_schedule(spark, d):
    return bt.rebalance_days(rule_labels(spark, d).withColumnRenamed("method", "strategy")).select("strategy", "date", "regime")


def rebalance_schedule_gaps(spark, d):
    """The schedule where labels are missing on two days of the week."""
    gaps = rule_labels(spark, d).withColumn("regime", F.when(~F.dayofweek("date").isin(3, 6), F.col("regime"))).withColumnRenamed("method", "strategy")
    return bt.rebalance_days(gaps).select("strategy", "date", "regime")


def corr_by_window(spark, d):
    return r6(ft.by_window(ft.average_correlation(corr(spark, d)), stress(spark), "avg_corr"))


def optimality_gaps(spark, d):
    return r6(bt.optimality(complete_returns(spark, d), ASSETS, {n: Allocator(n) for n in ("equal_weight", "mean_variance", "min_variance", "risk_parity")}))


def weights_rules(spark, d):
    return r6(weights(spark, d))


def weights_held(spark, d):
    set_ = weights(spark, d).where(F.dayofmonth("date") <= 3)
    return r6(bt.hold(set_, weights(spark, d).select("strategy", "date").distinct(), ASSETS))


def mean_weight_by_regime(spark, d):
    vol = known_labels(spark, d).where("method = 'vol'").select("date", "regime")
    return r6(bt.mean_weights(weights(spark, d), vol))


def alloc_turnover(spark, d):
    return r6(bt.turnover(weights(spark, d)))


def backtest_daily(spark, d):
    return r6(tested(spark, d))


def backtest_metrics(spark, d):
    return r6(bt.metrics(tested(spark, d)))


def equity_drawdown(spark, d):
    peak = F.max("equity").over(Window.partitionBy("strategy").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return r6(tested(spark, d).withColumn("peak", peak).select("strategy", "date", "equity", F.try_divide(F.col("peak") - F.col("equity"), F.col("peak")).alias("drawdown")))


def stress_returns(spark, d):
    return r6(bt.stress_returns(tested(spark, d), stress(spark)))


def cost_sweep(spark, d):
    grid = weights(spark, d).withColumn("cost_bps", F.explode(F.array(*map(F.lit, COSTS))))
    out = bt.run_backtest(grid, simple_returns_of(spark, d), F.col("cost_bps"), ("cost_bps",))
    return r6(bt.metrics(out, ("strategy", "cost_bps")).select("strategy", "cost_bps", "ann_return", "sharpe"))


def common_window(spark, d):
    cut = tested(spark, d).where("strategy <> 'tilt' OR date >= DATE '1996-06-01'")
    return r6(bt.metrics(bt.common_window(cut)).select("strategy", "days", "ann_return", "sharpe"))


def pbo_cscv(spark, d):
    net = tested(spark, d).withColumn("idx", F.row_number().over(Window.partitionBy("strategy").orderBy("date")) - 1)
    return r6(bt.pbo(net.select("idx", "strategy", "net")))


def pbo_split_ranks(spark, d):
    """How often each strategy is best in training, by its rank among the others' results."""
    net = tested(spark, d).withColumn("idx", F.row_number().over(Window.partitionBy("strategy").orderBy("date")) - 1)
    return r6(bt.pbo_splits(net.select("idx", "strategy", "net")).groupBy("strategy", "rank").agg(F.count(F.lit(1)).alias("splits"), F.avg("logit").alias("logit")))


def risk_free(spark, d):
    """The last asset stands for cash: its simple returns are the risk-free series."""
    return simple_returns_of(spark, d).where(F.col("asset") == ASSETS[-1]).select("date", F.col("r").alias("rf"))


def backtest_metrics_excess(spark, d):
    return r6(bt.metrics(tested(spark, d), risk_free=risk_free(spark, d)))


def deflated_sharpe_excess(spark, d):
    return r6(bt.deflated_sharpe(tested(spark, d), risk_free(spark, d)))


def psr_argument(spark, d):
    return r6(bt.psr_arguments(tested(spark, d)))


def ledoit_wolf(spark, d):
    """Shrinkage, its target and the shrunk covariance of the full sample, from plain sums."""
    day = complete_returns(spark, d).groupBy("date").agg(*(F.max(F.when(F.col("symbol") == s, F.col("simple"))).alias(s) for s in ASSETS)).na.drop()
    means = day.agg(*(F.avg(s).alias(f"m_{s}") for s in ASSETS))
    x = day.join(F.broadcast(means)).select(*((F.col(s) - F.col(f"m_{s}")).alias(s) for s in ASSETS))
    cells = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col(a) * F.col(b)).alias("xy")) for a in ASSETS for b in ASSETS))
    s = x.select(F.explode(cells).alias("c")).select("c.*").groupBy("a", "b").agg(F.avg("xy").alias("s"), F.avg(F.col("xy") ** 2).alias("q"), F.count("xy").alias("n"))
    p = float(len(ASSETS))
    m = s.agg((F.sum(F.when(F.col("a") == F.col("b"), F.col("s"))) / p).alias("m"))
    parts = s.join(F.broadcast(m)).agg(F.first("m").alias("m"), (F.sum((F.col("s") - F.when(F.col("a") == F.col("b"), F.col("m")).otherwise(0.0)) ** 2) / p).alias("d2"), (F.sum(F.col("q") - F.col("s") ** 2) / p / F.first("n")).alias("b2"))
    rho = parts.select("m", F.coalesce(F.try_divide(F.least("b2", "d2"), F.col("d2")), F.lit(0.0)).alias("rho"))
    cov = ((1 - F.col("rho")) * F.col("s") + F.when(F.col("a") == F.col("b"), F.col("rho") * F.col("m")).otherwise(0.0)) * 252
    return r6(s.join(F.broadcast(rho)).select("a", "b", "rho", cov.alias("cov")))


def cov_to_corr(spark, d):
    cov = ledoit_wolf(spark, d).select("a", "b", "cov")
    var = cov.where("a = b").select(F.col("a").alias("s"), F.col("cov").alias("v"))
    both = cov.join(F.broadcast(var.select(F.col("s").alias("a"), F.col("v").alias("va"))), "a").join(F.broadcast(var.select(F.col("s").alias("b"), F.col("v").alias("vb"))), "b")
    sd: Column = F.sqrt(F.when(F.col("va") > 0, F.col("va")).otherwise(1.0)) * F.sqrt(F.when(F.col("vb") > 0, F.col("vb")).otherwise(1.0))
    corr_ = F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cov") / sd)))
    return both.select("a", "b", (F.round(corr_, 4) + 0.0).alias("corr"))


def events_tumbling(spark, d):
    return r6(filters.hourly(src.table(spark, d, "events")).select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", "mean_value"))


def states_markov(spark, d):
    """States and the worst one's probability as known by each day, under a fixed hidden Markov model."""
    rows = lb.states(z_matrix(spark, d), known_markov(*oracle.MARKOV))
    return r6(rows.select("date", "regime", F.col("proba")[2].alias("p_worst")))


def states_jump(spark, d):
    """States as known by each day under a fixed jump model."""
    return lb.states(z_matrix(spark, d), known_jump(*oracle.JUMP)).select("date", "regime")


def states_jump_path(spark, d):
    """The best path of a fixed jump model through all days: its squared distances and penalties, which no path undercuts."""
    path = lb.states(z_matrix(spark, d), known_jump(*oracle.JUMP), smoothed=True)
    jump = F.coalesce((F.col("regime") != F.lag("regime").over(Window.orderBy("date"))).cast("int"), F.lit(0))
    x = z_matrix(spark, d).join(path, "date").withColumn("jump", jump)
    centre = F.array(*(F.array(*map(F.lit, m)) for m in oracle.JUMP[0]))[F.col("regime")]
    far = F.aggregate(F.zip_with("z", centre, lambda a, b: (a - b) ** 2), F.lit(0.0), lambda a, b: a + b)
    return x.agg(F.round(F.sum(far) + oracle.JUMP[1] * F.sum("jump"), 4).alias("cost"))


def detected(method: str, **settings) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: lb.walk_forward(z_matrix(spark, d), method, severity=[0, 1, 2], **settings)


def allocated(name: str, **settings) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: r6(bt.allocate(complete_returns(spark, d), ASSETS, {name: Allocator(name, tuple(settings.items()))}))


def weights_switching(spark, d):
    by_state = {0: Allocator("mean_variance"), 1: Allocator("risk_parity"), 2: Allocator("min_cvar")}
    return r6(bt.allocate(complete_returns(spark, d), ASSETS, {"regime_vol": by_state}, known_labels(spark, d).where("method = 'vol'")))


def backtest_switching(spark, d):
    return r6(bt.metrics(bt.run_backtest(weights_switching(spark, d), simple_returns_of(spark, d))))


def deflated_sharpe(spark, d):
    return r6(bt.deflated_sharpe(tested(spark, d)))


PLAIN = (
    calendar_days, exchange_calendar, price_panel, macro_ffill_limit, log_returns, simple_returns, simple_returns_padded, rolling_vol_21, rolling_vol_63, drawdown_252, pair_corr_63, avg_corr_63,
    expanding_zscore, usable_rows, feature_matrix_trimmed, common_coverage, asset_availability, missingness, price_validation, macro_validation, return_describe, corr_summary, corr_histogram, corr_matrix,
    label_runs, label_distribution, label_persistence, crisis_share, detector_agreement, crisis_intervals, rebalance_schedule, weights_rules, weights_held, mean_weight_by_regime, alloc_turnover,
    backtest_daily, backtest_metrics, equity_drawdown, stress_returns, cost_sweep, common_window, pbo_cscv, psr_argument, ledoit_wolf, cov_to_corr, events_tumbling,
    states_markov, states_jump, states_jump_path, rebalance_schedule_gaps, corr_by_window, optimality_gaps, pbo_split_ranks, backtest_metrics_excess, deflated_sharpe_excess, weights_switching, backtest_switching, deflated_sharpe,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {"flagship": flagship} | {f.__name__: f for f in PLAIN}
    out |= {"labels_hmm": detected("hmm"), "labels_jump": detected("jump"), "labels_changepoint": detected("changepoint")}
    return out | {f"weights_{n}": allocated(n) for n in ("equal_weight", "mean_variance", "min_variance", "risk_parity", "min_cvar", "hrp")}


def oracle_sql() -> dict[str, str]:
    return oracle.sql()
