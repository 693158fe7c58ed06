"""Command line: the phases over a folder of Parquet tables (prices: date, symbol, price; macro: date, series_id, value)."""

from __future__ import annotations

import argparse
import datetime as dt
import re
from pathlib import Path

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import config, report
from .operators import backtest as bt
from .operators import features as ft
from .operators import labels as lb
from .operators import panel as pn
from .operators.calendar import trading_days
from .session import get_session
from .sources.files import ingest, read_parquet, write_parquet


def checked_series(macro, data: config.Data, log):
    """macro's rows of the configured series; ValueError for a required one without values, a warning for an optional one."""
    there = {r[0] for r in macro.where(F.col("series_id").isin([s.id for s in data.series]) & F.col("value").isNotNull()).select("series_id").distinct().collect()}
    missing = [s for s in data.required_series if s not in there]
    if missing:
        raise ValueError(f"no data for {', '.join(missing)}")
    for s in data.series:
        if s.id not in there:
            log.warning("no data for optional series %s", s.id)
    return macro.where(F.col("series_id").isin(sorted(there)))


def priced(prices, column: str):
    """prices with the configured column as price; a table that has price already stays as it is."""
    names = {c.lower(): c for c in prices.columns}
    return prices.withColumnRenamed(names[column.lower()], "price") if column.lower() in names and "price" not in names else prices


def stress_frame(spark, windows: dict[str, tuple[dt.date, dt.date]]):
    """name, start, end of settings' windows."""
    return spark.createDataFrame([(n, *days) for n, days in windows.items()], "name string, start date, end date")


def symbols(df, wanted: list[str] = ()) -> list[str]:
    """The wanted symbols, or all; KeyError that names wanted ones that aren't there."""
    there = [r[0] for r in df.select("symbol").distinct().orderBy("symbol").collect()]
    missing = [s for s in wanted if s not in there]
    if missing:
        raise KeyError(f"no prices for {', '.join(missing)}")
    return list(wanted) or there


def build(spark, data: config.Data, prices, macro, out: str, log=None) -> None:
    """Validate, align, compute features; writes features, prices, the dictionary and the QA report."""
    prices = priced(prices, data.price_column)
    checks = pn.validate(prices)
    assets = symbols(prices, data.tickers)
    prices = prices.where(F.col("symbol").isin(assets))
    bad = [r["symbol"] for r in checks.where(F.col("symbol").isin(assets) & ~F.col("is_valid")).select("symbol").collect()]
    if bad:
        raise ValueError(f"invalid prices: {', '.join(bad)}")
    start, end = pn.checked_coverage(prices)
    calendar = trading_days(spark, data.exchange, data.start or start, data.end or end)
    unbounded = 1 << 20  # days that a carried price may be old
    panel = pn.align(prices, calendar, fill=unbounded if data.price_forward_fill else 0).persist()
    filled = None
    if macro is not None:
        pn.checked_columns(macro, "series_id", "value")
        macro = checked_series(macro, data, log or report.logger()) if data.series else macro
        filled = pn.align(macro, calendar, "series_id", "value", data.macro_max_staleness_days)
    series = [(s.id, s.id.lower()) for s in data.series]
    if filled is not None and not series:
        series = [(r[0], r[0].lower()) for r in macro.select("series_id").distinct().orderBy("series_id").collect()]
    w, least = data.windows, data.min_periods
    wide = ft.feature_matrix(panel, filled, assets, series, tuple(data.correlation_exclude), w.volatility_short, w.volatility_long, w.correlation, w.drawdown, least.volatility, least.correlation, data.trading_days_per_year)
    wide = pn.trim_to_complete(wide, [f"{a.lower()}_ret" for a in assets]).orderBy("date")
    write_parquet(wide, f"{out}/features.parquet")
    write_parquet(ft.returns(panel).select("date", "symbol", "price", "ret", "simple"), f"{out}/prices.parquet")
    Path(out, "data_dictionary.md").write_text(report.data_dictionary(wide.columns))
    parts = {"Availability": pn.availability(prices), "Missing values": pn.missingness(panel), "Checks": checks}
    average = f"avg_corr{w.correlation}d"
    if average in wide.columns:
        parts["Mean correlation in windows of stress"] = ft.by_window(spark.read.parquet(f"{out}/features.parquet"), stress_frame(spark, config.STRESS), average)
    report.write_report(f"{out}/qa_report.md", "Data quality", parts, {k: [df.columns[0]] for k, df in parts.items()})
    panel.unpersist()


def market_features(wide) -> tuple:
    """(date and four features of the whole market, their names) from a feature matrix: mean short and long volatility, mean fall, mean correlation."""
    vols = [c for c in wide.columns if re.search(r"_vol\d+d$", c)]
    spans = sorted({int(re.search(r"_vol(\d+)d$", c)[1]) for c in vols})
    corr = [c for c in wide.columns if re.match(r"avg_corr\d+d$", c)]
    mean = lambda cols: F.try_divide(sum(F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in cols), sum(F.col(f"`{c}`").isNotNull().cast("int") for c in cols))
    out = {f"vol{n}": mean([c for c in vols if c.endswith(f"_vol{n}d")]) for n in spans}
    out |= {"fall": -mean([c for c in wide.columns if c.endswith("_dd")]), "avg_corr": F.col(corr[0])}
    return wide.select("date", *(v.alias(k) for k, v in out.items())), list(out)


def detect(spark, conf: config.Detection, wide, methods: list[str], out: str) -> None:
    """Labels of each method, by walk-forward refits over features of the matrix wide, and their report."""
    chosen, columns = (ft.selected(wide, conf.features), conf.features) if conf.features else market_features(wide)
    z = ft.standardised(chosen, columns, conf.zscore_min_periods).persist()
    for method in methods:
        write_parquet(lb.walk_forward(z, method, conf.min_train, conf.refit_every, **conf.settings(method)), f"{out}/regimes_{method}.parquet")
    z.unpersist()
    labels = spark.read.parquet(*(f"{out}/regimes_{m}.parquet" for m in methods))
    parts = {"Days by state": lb.distribution(labels, conf.n_states), "Persistence": lb.persistence(labels)}
    if conf.stress_windows:
        parts["Share of the worst state in windows of stress"] = lb.crisis_share(labels, stress_frame(spark, conf.stress_windows), conf.n_states, every=True)
    if len(methods) > 1:
        parts["Agreement"] = lb.agreement(labels)
    report.write_report(f"{out}/detection.md", "Detection", parts, {k: [c for c in ("method", "regime", "window", "a", "b") if c in df.columns] for k, df in parts.items()})


def allocate(spark, conf: config.Allocation, prices, methods: list[str], baselines: list[str], out: str) -> None:
    """Weights of switching strategies (one for each method of labels) and of static ones, and their report."""
    assets = symbols(prices, conf.assets)
    simple = prices.select("date", "symbol", F.expm1("ret").alias("simple"))
    how = conf.lookback, conf.rebalance_every, conf.on_regime_change
    made, labels = [], {m: read_parquet(spark, f"{out}/regimes_{m}.parquet").select("date", "regime") for m in methods}
    for m in methods:
        made.append(bt.allocate(simple, assets, {f"regime_{m}": conf.by_regime()}, labels[m], *how))
    if baselines:
        made.append(bt.allocate(simple, assets, {f"static_{b}": conf.allocator(b) for b in baselines}, None, *how))
    whole = made[0]
    for df in made[1:]:
        whole = whole.unionByName(df)
    write_parquet(whole, f"{out}/weights.parquet", by=["strategy"])
    weights = read_parquet(spark, f"{out}/weights.parquet")
    parts = {"Turnover": bt.turnover(weights), "Mean weights": bt.mean_weights(weights)}
    for m in methods:
        parts[f"Mean weights of regime_{m} by state"] = bt.mean_weights(weights.where(F.col("strategy") == f"regime_{m}"), labels[m]).where("regime IS NOT NULL")
    by = ["strategy", "asset"]
    report.write_report(f"{out}/allocation.md", "Allocation", parts, {"Turnover": by[:1]} | {k: by + (["regime"] if "state" in k else []) for k in parts if k != "Turnover"})


def backtest(spark, conf: config.Backtest, prices, out: str) -> None:
    """Net results of all weights on their own and their common window, windows of stress, significance, and the cost sweep."""
    weights = read_parquet(spark, f"{out}/weights.parquet")
    assets = symbols(prices, conf.assets)
    weights = weights.where(F.col("asset").isin(assets))
    rets = prices.where(F.col("symbol").isin(assets)).select("date", F.col("symbol").alias("asset"), F.expm1("ret").alias("r"))
    cash = rets.where(F.col("asset") == conf.rf_asset).select("date", F.col("r").alias("rf")) if conf.rf_asset in assets else None
    own = bt.run_backtest(weights, rets, conf.cost_bps).persist()
    run = bt.common_window(own).persist()
    write_parquet(run, f"{out}/backtest.parquet")
    idx = run.withColumn("idx", F.row_number().over(Window.partitionBy("strategy").orderBy("date")) - 1).select("idx", "strategy", "net")
    grid = weights.withColumn("cost_bps", F.explode(F.array(*map(F.lit, conf.cost_grid))))
    swept = bt.run_backtest(grid, rets, F.col("cost_bps"), ("cost_bps",))
    sweep = bt.metrics(swept, ("strategy", "cost_bps"), cash).select("strategy", "cost_bps", "sharpe")
    parts = {"Metrics": bt.metrics(run, risk_free=cash), "Metrics of own windows": bt.metrics(own, risk_free=cash), "Deflated Sharpe": bt.deflated_sharpe(run, cash)}
    if conf.stress_windows:
        parts["Windows of stress"] = bt.stress_returns(run, stress_frame(spark, conf.stress_windows))
    parts |= {"Overfitting": bt.pbo(idx, conf.n_blocks), "Costs": sweep}
    order = {k: ["strategy"] for k in ("Metrics", "Metrics of own windows", "Deflated Sharpe")} | {"Windows of stress": ["name", "strategy"], "Costs": ["strategy", "cost_bps"]}
    report.write_report(f"{out}/backtest.md", "Backtest", parts, order)
    run.unpersist()
    own.unpersist()


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tideline", description=__doc__)
    parser.add_argument("phase", choices=["build", "detect", "allocate", "backtest"])
    parser.add_argument("--prices", help="price table (build)")
    parser.add_argument("--cache", help="folder of dated cache files, one for each configured asset and series (build, instead of tables)")
    parser.add_argument("--macro", help="indicator table (build)")
    parser.add_argument("--config", help="YAML file of the phase")
    parser.add_argument("--out", default="out")
    parser.add_argument("--method", default="all", help="hmm, jump, changepoint or all")
    parser.add_argument("--no-baselines", action="store_true")
    parser.add_argument("--cost-bps", type=float)
    parser.add_argument("--verbose", action="store_true")
    a = parser.parse_args(argv)
    kind = {"build": config.Data, "detect": config.Detection, "allocate": config.Allocation, "backtest": config.Backtest}[a.phase]
    conf = kind.from_yaml(a.config) if a.config else kind()
    log, spark = report.logger(level="DEBUG" if a.verbose else getattr(conf, "log_level", "INFO")), get_session()
    methods = ["hmm", "jump", "changepoint"] if a.method == "all" else [a.method]
    with report.step(log, a.phase, spark):
        if a.phase == "build":
            if a.cache:
                prices = ingest(spark, a.cache, conf.tickers, "symbol")
                macro = ingest(spark, a.cache, [s.id for s in conf.series], "series_id", conf.required_series) if conf.series else None
            else:
                prices, macro = read_parquet(spark, a.prices), read_parquet(spark, a.macro) if a.macro else None
            build(spark, conf, prices, macro, a.out, log)
            return
        prices = read_parquet(spark, f"{a.out}/prices.parquet")
        if a.phase == "detect":
            detect(spark, conf, read_parquet(spark, f"{a.out}/features.parquet"), methods, a.out)
        elif a.phase == "allocate":
            allocate(spark, conf, prices, methods, [] if a.no_baselines else conf.baselines, a.out)
        else:
            backtest(spark, conf.model_copy(update={"cost_bps": a.cost_bps}) if a.cost_bps is not None else conf, prices, a.out)


if __name__ == "__main__":
    main()
