"""Calendar, alignment, coverage, features: values, gates, and that nothing looks ahead."""

import datetime as dt
import re

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from tideline.operators import features as ft
from tideline.operators import panel as pn
from tideline.operators.calendar import trading_days

ASSETS = ["SPY", "TLT", "LQD", "GLD", "DBC", "BIL"]


@pytest.fixture(scope="module")
def wide():
    rng = np.random.default_rng(42)
    vols = np.array([0.15, 0.12, 0.08, 0.14, 0.18, 0.02]) / np.sqrt(252)
    return pd.DataFrame(100 * np.exp(np.cumsum(rng.normal(0.0003, vols, (400, 6)), axis=0)), index=pd.bdate_range("2020-01-01", periods=400), columns=ASSETS)


def frame(spark, wide):
    long = wide.rename_axis("date").reset_index().melt("date", var_name="symbol", value_name="price")
    rows = [(d.date(), s, None if p != p else float(p)) for d, s, p in long.itertuples(index=False)]
    return spark.createDataFrame(rows, "date date, symbol string, price double")


def pivoted(df, value, index="date", columns="symbol"):
    out = df.select(index, columns, value).toPandas().pivot(index=index, columns=columns, values=value).astype(float)
    out.index = pd.to_datetime(out.index)
    return out


def test_calendar(spark):
    count = lambda a, b: trading_days(spark, "NYSE", a, b).count()
    assert [count(a, "2026-06-26") for a in ("2004-01-02", "2004-11-18", "2006-02-06", "2007-05-30")] == [5656, 5434, 5129, 4800]
    days = {r["date"] for r in trading_days(spark, "NYSE", "2020-01-01", "2020-12-31").collect()}
    shut = ["01-01", "01-20", "02-17", "04-10", "05-25", "07-03", "09-07", "11-26", "12-25"]
    assert not days & {dt.date.fromisoformat(f"2020-{d}") for d in shut} and len(days) == 253
    with pytest.raises(ValueError):
        trading_days(spark, "MOON", "2020-01-01", "2020-02-01")


def test_features_equal_pandas(spark, wide):
    wide = wide.copy()
    wide.iloc[50:55, 0] = np.nan
    wide.iloc[:30, 1] = np.nan
    feats = ft.long_features(frame(spark, wide))
    ret = np.log(wide) - np.log(wide).shift(1)
    for column, want in {
        "ret": ret, "simple": wide / wide.shift(1) - 1, "vol21": ret.rolling(21, min_periods=15).std() * np.sqrt(252), "vol63": ret.rolling(63, min_periods=15).std() * np.sqrt(252),
        "dd": (wide - wide.rolling(252, min_periods=1).max()) / wide.rolling(252, min_periods=1).max(),
    }.items():
        pd.testing.assert_frame_equal(pivoted(feats, column)[ASSETS], want, check_names=False, check_freq=False, atol=1e-10)
    corr = ft.pair_correlations(feats, ASSETS, exclude=("BIL",)).where("a = 'SPY' AND b = 'TLT'").toPandas().sort_values("date")
    np.testing.assert_allclose(corr["corr"].astype(float), ret["SPY"].rolling(63, min_periods=30).corr(ret["TLT"]), atol=1e-9, equal_nan=True)


def test_padded_returns_and_flat_series(spark):
    days = pd.bdate_range("2020-01-01", periods=40)
    flat = pd.DataFrame({"A": 5.0, "B": np.arange(40) + 1.0}, index=days)
    corr = ft.pair_correlations(ft.returns(frame(spark, flat)), ["A", "B"], 20, 10)
    assert corr.where("corr IS NOT NULL").count() == 0
    gap = pd.DataFrame({"A": [1.0, np.nan, 2.0]}, index=days[:3])
    assert [r["simple"] for r in ft.returns(frame(spark, gap)).orderBy("date").collect()] == [None, None, None]
    assert [r["simple"] for r in ft.returns(frame(spark, gap), pad=True).orderBy("date").collect()] == [None, 0.0, 1.0]


@pytest.mark.parametrize("day", [70, 150, 399])
def test_truncation_changes_nothing(spark, wide, day):
    cut = wide.index[day].date()

    def at(prices):
        feats = ft.long_features(frame(spark, prices))
        corr = ft.average_correlation(ft.pair_correlations(feats, ASSETS)).where(F.col("date") == F.lit(cut)).first()
        return sorted(map(str, feats.where(F.col("date") == F.lit(cut)).collect())), corr

    assert at(wide) == at(wide.iloc[: day + 1])


def test_no_frame_looks_ahead(spark, wide):
    long = frame(spark, wide)
    feats = ft.long_features(long)
    w = ft.so_far("symbol")
    for df in (feats, ft.pair_correlations(feats, ASSETS), feats.withColumn("z", ft.expanding_zscore(F.col("ret"), w))):
        plan = df._jdf.queryExecution().analyzed().toString()
        for upper in re.findall(r"specifiedwindowframe\((?:RowFrame|RangeFrame), [^,]+, ([^)]+)\)", plan):
            assert "unbounded" not in upper and (upper.startswith("currentrow") or int(re.sub(r"\D", "", upper) or 0) == 0 or upper.startswith("-")), upper


def test_alignment_and_staleness(spark):
    calendar = spark.createDataFrame([(d.date(),) for d in pd.bdate_range("2020-01-01", periods=20)], "date date")
    rows = [(dt.date(2020, 1, 1), "m", 1.0), (dt.date(2020, 1, 4), "m", 9.0), (dt.date(2020, 1, 20), "m", 2.0)]
    obs = spark.createDataFrame(rows, "date date, symbol string, price double")
    got = [r["price"] for r in pn.align(obs, calendar, fill=5).orderBy("date").collect()]
    assert got == [1.0] * 6 + [None] * 7 + [2.0] * 6 + [None]
    assert [r["price"] for r in pn.align(obs, calendar).orderBy("date").collect()][1] is None


def test_coverage_missingness_and_checks(spark):
    days = pd.bdate_range("2010-01-01", periods=100)
    a = pd.Series(1.0, index=days)
    a.iloc[:20] = np.nan
    a.iloc[50:53] = np.nan
    long = frame(spark, pd.DataFrame({"A": a, "B": 2.0}))
    assert pn.checked_coverage(long) == (days[20].date(), days[-1].date())
    rows = {r["symbol"]: r for r in pn.missingness(long).collect()}
    assert (rows["A"]["pre_inception"], rows["A"]["gaps"], rows["A"]["coverage_pct"]) == (20, 3, 96.25) and (rows["B"]["gaps"], rows["B"]["coverage_pct"]) == (0, 100.0)
    assert {r["symbol"]: r["availability_pct"] for r in pn.availability(long).collect()} == {"A": 77.0, "B": 100.0}
    apart = frame(spark, pd.DataFrame({"A": a.where(a.index < days[50]), "B": pd.Series(1.0, index=days[60:])}))
    with pytest.raises(ValueError, match="No overlapping"):
        pn.checked_coverage(apart)
    with pytest.raises(ValueError, match="no values"):
        pn.checked_coverage(frame(spark, pd.DataFrame({"A": [np.nan, np.nan]}, index=days[:2])))
    bad = long.unionAll(spark.createDataFrame([(days[0].date(), "B", -1.0)], long.schema))
    r = pn.validate(bad).where("symbol = 'B'").first()
    assert (r["duplicate_dates"], r["negative"], r["is_valid"]) == (1, 1, False)


def test_matrix_is_trimmed_to_the_first_complete_row(spark, wide):
    wide = wide.copy()
    wide.iloc[:40, 5] = np.nan
    out = ft.feature_matrix(frame(spark, wide), None, ASSETS, (), ("BIL",))
    out = pn.trim_to_complete(out, [f"{a.lower()}_ret" for a in ASSETS])
    assert out.count() == 400 - 41 and len(out.columns) == 1 + 6 * 4 + 10 + 1
    assert {m["kind"] for m in ft.metadata(out.columns)} == {"return", "volatility", "correlation", "drawdown"}
