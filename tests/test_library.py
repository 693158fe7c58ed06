"""Files, settings, the command line, streams, and the driver's entry points."""

import datetime as dt
from pathlib import Path

import numpy as np
import pytest

from pyspark.sql import functions as F

from tideline import cli, config
from tideline.models import states as st
from tideline.operators import features as ft
from tideline.sources import files
from tideline.streaming import filters


def test_cache_files(spark, tmp_path):
    day = dt.date(2024, 5, 1)
    assert files.cache_path("x", "A", day).name == "A_20240501.parquet" and files.cache_date("A_2024x.parquet") is None and files.cache_date("A_20249999.parquet") is None
    for name in ("A_20240501", "A_20240601", "A_B_20240701"):
        spark.createDataFrame([(day, 1.0)], "date date, close double").write.parquet(f"{tmp_path}/{name}.parquet")
    assert files.latest_cache(tmp_path, "A").name == "A_20240601.parquet"
    assert files.cache_is_valid(tmp_path / "A_20240601.parquet", 10, dt.date(2024, 6, 5)) and not files.cache_is_valid(tmp_path / "A_20240601.parquet", 2, dt.date(2024, 6, 5))
    got = files.ingest(spark, tmp_path, ["A", "A_B"], "symbol").select("symbol").collect()
    assert sorted(r[0] for r in got) == ["A", "A_B"]
    with pytest.raises(ValueError):
        files.ingest(spark, tmp_path, ["A", "Z"], "symbol")
    assert files.ingest(spark, tmp_path, ["A", "Z"], "symbol", required=["A"]).count() == 1
    with pytest.raises(FileNotFoundError):
        files.read_parquet(spark, f"{tmp_path}/none.parquet")
    spark.range(1).write.parquet(f"{tmp_path}/weights_x.parquet")
    assert files.strategies(spark, tmp_path).first()["strategy"] == "x"
    assert files.landed(spark, f"{tmp_path}/A_20240501.parquet", "2024-05-01", "2024-05-01").count() == 1
    with pytest.raises(ValueError):
        files.landed(spark, f"{tmp_path}/A_20240501.parquet", "2025-01-01")


def test_fetch_or_cache(spark, tmp_path, caplog):
    day, asked = dt.date(2024, 5, 1), []

    def fetch(i):
        asked.append(i)
        if i == "Z":
            raise OSError("no answer")
        return spark.createDataFrame([(day, float(len(asked)))], "date date, value double")

    get = lambda **how: {r["id"]: r["value"] for r in files.ingest(spark, str(tmp_path), ["A", "B", "Z"], "id", required=["A"], fetch=fetch, **how).collect()}
    spark.createDataFrame([(day, 0.0)], "date date, value double").write.parquet(f"{tmp_path}/A_20240501.parquet")
    with caplog.at_level("WARNING", "tideline"):
        assert get() == {"A": 0.0, "B": 1.0} and asked == ["B", "Z"] and "no data for optional Z" in caplog.text and "no answer" in caplog.text
    assert get(max_age_days=30) == {"A": 3.0, "B": 1.0} and asked[2:] == ["A", "Z"]
    assert get(refresh=True) == {"A": 5.0, "B": 6.0}
    with pytest.raises(OSError):
        files.ingest(spark, str(tmp_path), ["Z"], "id", fetch=fetch)


def test_build_from_caches(spark, tmp_path):
    rng, day = np.random.default_rng(6), dt.date(2020, 1, 1)
    for s in "AB":
        p = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 120)))
        spark.createDataFrame([(day + dt.timedelta(i), float(v)) for i, v in enumerate(p)], "date date, Close double").write.parquet(f"{tmp_path}/{s}_20240101.parquet")
    spark.createDataFrame([(day + dt.timedelta(i), float(i)) for i in range(120)], "date date, value double").write.parquet(f"{tmp_path}/V_20240101.parquet")
    (tmp_path / "d.yaml").write_text("assets: [{ticker: A}, {ticker: B}]\nseries: [{id: V}, {id: W, optional: true}]\nprice_column: Close\n")
    cli.main(["build", "--cache", str(tmp_path), "--config", f"{tmp_path}/d.yaml", "--out", f"{tmp_path}/out"])
    got = spark.read.parquet(f"{tmp_path}/out/features.parquet")
    assert {"a_ret", "b_ret", "v"} <= set(got.columns) and got.where("v IS NOT NULL").count() > 60
    assert "2020 COVID" in Path(tmp_path, "out", "qa_report.md").read_text()


def test_settings(tmp_path):
    (tmp_path / "d.yaml").write_text("detection:\n  n_states: 4\n  method: jump\n")
    conf = config.Detection.from_yaml(tmp_path / "d.yaml")
    assert conf.n_states == 4 and conf.build().n_states == 4 and isinstance(conf.build(), st.JumpModel)
    (tmp_path / "e.yaml").write_text("")
    with pytest.raises(ValueError):
        config.Data.from_yaml(tmp_path / "e.yaml")
    with pytest.raises(FileNotFoundError):
        config.Data.from_yaml(tmp_path / "f.yaml")
    for bad in ({"macro_max_staleness_days": 31}, {"start": "2020-13-01"}, {"log_level": "LOUD"}, {"windows": {"drawdown": 10}}):
        with pytest.raises(ValueError):
            config.Data(**bad)
    assert config.Allocation().by_regime()[2].name == "min_cvar"


def test_command_line(spark, tmp_path):
    rng, day = np.random.default_rng(1), dt.date(2020, 1, 1)
    rows = []
    for k, s in enumerate("ABC"):
        p = 100 * np.exp(np.cumsum(rng.normal(0.0003, 0.01 * (k + 1), 560)))
        rows += [(day + dt.timedelta(i), s, float(v)) for i, v in enumerate(p)]
    spark.createDataFrame(rows, "date date, symbol string, price double").write.parquet(f"{tmp_path}/p.parquet")
    out = f"{tmp_path}/out"
    Path(out).mkdir()
    (tmp_path / "d.yaml").write_text("min_train: 200\nrefit_every: 80\n")
    (tmp_path / "a.yaml").write_text("lookback: 100\n")
    (tmp_path / "b.yaml").write_text("n_blocks: 6\nrf_asset: A\nstress_windows: {spring: [2021-03-01, 2021-05-31]}\n")
    cli.main(["build", "--prices", f"{tmp_path}/p.parquet", "--out", out])
    cli.main(["detect", "--method", "changepoint", "--out", out, "--config", f"{tmp_path}/d.yaml"])
    cli.main(["allocate", "--method", "changepoint", "--out", out, "--config", f"{tmp_path}/a.yaml"])
    cli.main(["backtest", "--out", out, "--config", f"{tmp_path}/b.yaml"])
    assert "2020 COVID" in Path(out, "detection.md").read_text() and "Mean weights of regime_changepoint by state" in Path(out, "allocation.md").read_text()
    assert "| spring | regime_changepoint |" in Path(out, "backtest.md").read_text() and "Metrics of own windows" in Path(out, "backtest.md").read_text()
    assert "regime_changepoint" in Path(out, "backtest.md").read_text() and "| pbo |" in Path(out, "backtest.md").read_text().replace("splits | pbo", "pbo")
    assert "Gaps" in Path(out, "qa_report.md").read_text() or "gaps" in Path(out, "qa_report.md").read_text()


def test_sections_and_other_names_of_settings(tmp_path):
    (tmp_path / "d.yaml").write_text("""
universe: {name: X, exchange: NYSE, assets: {A: {description: an asset, approx_inception: "2000-01-01"}}}
dates: {start_date: "2004-01-01", end_date: null}
sources: {prices: {price_column: Close}, macro: {series: {V: {description: v}, N: {description: n, optional: true}}}}
calendar: {macro_max_staleness_days: 7, price_forward_fill: true}
features: {windows: {correlation: 42}, trading_days_per_year: 250, correlation_exclude: [A], min_periods: {volatility: 11}}
logging: {level: warning}
""")
    d = config.Data.from_yaml(tmp_path / "d.yaml")
    assert d.tickers == ["A"] and d.required_series == ["V"] and d.start == "2004-01-01" and d.price_forward_fill and d.macro_max_staleness_days == 7 and d.log_level == "WARNING"
    assert d.windows.correlation == 42 and d.min_periods.volatility == 11 and d.trading_days_per_year == 250 and d.correlation_exclude == ["A"] and d.price_column == "Close"
    c = config.Detection(features=["a", "b", "c"], severity_features=["c", "b"], n_restarts=3, random_state=7, standardize_min_periods=30, cp_window=99, cp_pen_scale=1.5, covariance_type="full", n_iter=5)
    assert c.settings("hmm") == {"n_states": 3, "seed": 7, "severity": [2, 1], "restarts": 3, "covariance": "full", "rounds": 5, "tol": 1e-4, "floor": 1e-3}
    assert c.build("changepoint").window == 99 and c.build("jump").tries == 10 and c.zscore_min_periods == 30
    a = config.Allocation(mean_shrinkage=0.1, cvar_beta=0.9, hrp_linkage="average")
    assert dict(a.allocator("hrp").settings) == {"w_max": 1.0, "turnover_penalty": 0.0, "risk_aversion": 10.0, "mean_shrink": 0.1, "beta": 0.9, "linkage": "average"}
    assert config.Backtest(cscv_blocks=4, cost_grid_bps=[1]).n_blocks == 4
    with pytest.raises(ValueError):
        config.Detection(n_sates=3)


def test_settings_reach_the_feature_matrix(spark, tmp_path):
    rng, day = np.random.default_rng(4), dt.date(2020, 1, 1)
    walk = {s: 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 200))) for s in "ABC"}
    prices = spark.createDataFrame([(day + dt.timedelta(i), s, float(v)) for s, p in walk.items() for i, v in enumerate(p) if (s, i) != ("B", 100)], "date date, symbol string, Close double").persist()
    macro = spark.createDataFrame([(day + dt.timedelta(i), "V", float(i)) for i in range(0, 200, 9)], "date date, series_id string, value double")

    def built(**settings):
        cli.build(spark, config.Data(series=[{"id": "V"}], price_column="close", **settings), prices, macro, str(tmp_path))
        return spark.read.parquet(f"{tmp_path}/features.parquet").orderBy("date").toPandas()

    plain = built()
    count = lambda df, c: int(df[c].notna().sum())
    assert "avg_corr42d" in built(windows={"correlation": 42}).columns and "a_vol10d" in built(windows={"volatility_short": 10}).columns
    more = built(min_periods={"volatility": 5, "correlation": 10}, trading_days_per_year=200, macro_max_staleness_days=1)
    assert count(more, "a_vol21d") == count(plain, "a_vol21d") + 10 and count(more, "avg_corr63d") == count(plain, "avg_corr63d") + 20 and count(more, "v") < count(plain, "v")
    assert more["a_vol21d"].iloc[-1] == pytest.approx(plain["a_vol21d"].iloc[-1] * (200 / 252) ** 0.5)
    assert not (built(windows={"drawdown": 63})["a_dd"] == plain["a_dd"]).all()
    assert not any("b_" in c and "corr" in c for c in built(correlation_exclude=["B"]).columns)
    assert count(built(price_forward_fill=True), "b_ret") > count(plain, "b_ret") or count(plain, "b_ret") == count(plain, "a_ret")
    with pytest.raises(ValueError, match="no data for W"):
        cli.build(spark, config.Data(series=[{"id": "W"}], price_column="close"), prices, macro, str(tmp_path))
    built_optional = config.Data(series=[{"id": "V"}, {"id": "W", "optional": True}], price_column="close")
    cli.build(spark, built_optional, prices, macro, str(tmp_path))
    with pytest.raises(KeyError, match="Z"):
        cli.build(spark, config.Data(assets=[{"ticker": "Z"}], price_column="close"), prices, macro, str(tmp_path))
    with pytest.raises(ValueError, match="missing columns: price"):
        cli.build(spark, config.Data(), prices, macro, str(tmp_path))
    with pytest.raises(KeyError, match="no_vol"):
        ft.selected(spark.read.parquet(f"{tmp_path}/features.parquet"), ["A_ret", "no_vol"])


def test_stream_of_events_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events")
    stream = filters.hourly(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events"))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("hourly").start()
    query.processAllAvailable()
    query.stop()
    key = ["hour", "event_type", "n", F.round("mean_value", 9)]
    assert sorted(map(str, spark.table("hourly").select(key).collect())) == sorted(map(str, filters.hourly(events).select(key).collect()))


def test_online_filter_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(m, 0.5, (60, 2)) for m in (0, 3, 6, 0)])
    model = st.HiddenMarkov(restarts=1, rounds=20).fit(x)
    days = [dt.date(2020, 1, 1) + dt.timedelta(k) for k in range(len(x))]
    schema = "panel_id int, date date, z array<double>"
    for k in range(0, 240, 80):
        spark.createDataFrame([(1, d, v.tolist()) for d, v in zip(days[k : k + 80], x[k : k + 80], strict=True)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = filters.online_states(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in"), model)
    query = stream.writeStream.outputMode("append").format("memory").queryName("online").start()
    query.processAllAvailable()
    query.stop()
    got = [r["regime"] for r in spark.table("online").orderBy("date").collect()]
    assert got == model.filtered_states(x).tolist()


def test_entry_points(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for name in ("calendar_days", "price_panel", "common_coverage", "events_tumbling"):
        assert entry.queries()[name](spark, sf).count() > 0


def test_column_helpers(spark):
    from tideline.functions import columns as c

    row = spark.sql("SELECT double('NaN') AS x, 2 AS s, 1.0D AS a, 0.0D AS b, DATE '2020-01-01' AS d").select(
        c.null_nan(F.col("x")).alias("x"), c.state_label(F.col("s")).alias("s"), c.safe_div(F.col("a"), F.col("b")).alias("q"), c.year_fraction(F.col("d"), F.date_add("d", 731)).alias("y")
    ).first()
    assert row["x"] is None and row["s"] == "crisis" and row["q"] is None and row["y"] == pytest.approx(731 / 365.25)
