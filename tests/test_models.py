"""State models, allocators, schedules, backtests and significance."""

import datetime as dt
import random
import sys

import numpy as np
import pytest

from pyspark import cloudpickle

from tideline.models import allocators as al
from tideline.models import states as st
from tideline.operators import backtest as bt
from tideline.operators import labels as lb


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


def chain(n=500, seed=0):
    rng = np.random.default_rng(seed)
    move = np.array([[0.97, 0.02, 0.01], [0.03, 0.94, 0.03], [0.02, 0.05, 0.93]])
    means, sds = np.array([[-1, -1, -1], [0.5, 0.5, 0.5], [3, 3, 3.0]]), np.array([0.4, 0.6, 0.9])
    s = [0]
    for _ in range(n - 1):
        s.append(rng.choice(3, p=move[s[-1]]))
    return means[s] + rng.normal(size=(n, 3)) * sds[s][:, None], np.array(s)


MODELS = [("hmm", {"restarts": 4}), ("jump", {"tries": 5, "penalty": 5.0}), ("changepoint", {})]


@pytest.mark.parametrize("method,how", MODELS)
def test_states_are_causal_and_ordered(method, how):
    x, truth = chain()
    model = st.make_detector(method, **how).fit(x[:350])
    whole = model.filtered_states(x)
    for t in (120, 260, 400, 499):
        assert (model.filtered_states(x[: t + 1]) == whole[: t + 1]).all()
    assert (np.diff(model.means.sum(1)) > 0).all()
    assert (whole == truth).mean() > 0.7
    assert (st.make_detector(method, **how).fit(x[:350]).filtered_states(x) == whole).all()
    np.testing.assert_allclose(model.filtered_proba(x[:200]).sum(1), 1)
    assert (model.smoothed_states(x) == truth).mean() > 0.7


@pytest.mark.parametrize("kind", ["diag", "spherical", "full", "tied"])
def test_covariances_of_states(kind):
    rng = np.random.default_rng(7)
    half = [rng.multivariate_normal(m, c, 400) for m, c in (([0, 0], [[1, 0.8], [0.8, 1]]), ([4, 4], [[1, -0.6], [-0.6, 2]]))]
    x = np.concatenate(half)
    model = st.HiddenMarkov(2, restarts=2, covariance=kind).fit(x)
    assert (model.filtered_states(x) == np.repeat([0, 1], 400)).mean() > 0.97
    if kind == "full":
        np.testing.assert_allclose(model.var, [np.cov(h.T, bias=True) for h in half], atol=0.15)
        diag = st.HiddenMarkov(2, restarts=2)
        flat = np.array([np.diag(v) for v in model.var])
        want = diag.density(x, model.means, flat)
        np.testing.assert_allclose(model.density(x, model.means, np.array([np.diag(v) for v in flat])), want)
    if kind == "tied":
        np.testing.assert_allclose(model.var[0], model.var[1])
    if kind == "spherical":
        np.testing.assert_allclose(model.var[:, 0], model.var[:, 1])
    with pytest.raises(ValueError):
        st.HiddenMarkov(covariance="round")


def test_linkages_of_the_tree():
    dist = np.abs(np.subtract.outer(p := np.array([0, 1, 2.1, 5.2, 3.4]), p))
    assert al.leaf_order(dist) == [3, 4, 2, 0, 1] and al.leaf_order(dist, "complete") == [0, 1, 3, 2, 4] and al.leaf_order(dist, "average") == [3, 0, 1, 2, 4]
    for linkage in ("single", "complete", "average"):
        w = al.Allocator("hrp", (("linkage", linkage),)).weights(returns(250))
        assert w.sum() == pytest.approx(1)


def test_unfitted_and_unknown():
    with pytest.raises(RuntimeError):
        st.HiddenMarkov().filtered_proba(np.zeros((3, 2)))
    with pytest.raises(ValueError):
        st.make_detector("tarot")
    with pytest.raises(ValueError):
        al.Allocator("lottery")
    assert [st.state_name(k) for k in range(3)] == ["calm", "volatile", "crisis"] and st.state_name(1, 4) == "state1"


def test_breakpoints_equal_exhaustive_search():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(m, 0.5, (25, 2)) for m in (0, 3, -2)])
    error = lambda a, b: ((x[a:b] - x[a:b].mean(0)) ** 2).sum()
    best = {0: (-8.0, [])}
    for e in [k for k in range(10, 75, 5)] + [75]:
        best[e] = min((best[a][0] + error(a, e) + 8.0, best[a][1] + [e]) for a in best if e - a >= 10)
    assert st.breakpoints(x, 8.0) == best[75][1] == [25, 50, 75]


def test_walk_forward(spark):
    x, _ = chain(400)
    days = [dt.date(2010, 1, 1) + dt.timedelta(k) for k in range(400)]
    z = spark.createDataFrame([(d, v.tolist()) for d, v in zip(days, x, strict=True)], "date date, z array<double>")
    rows = lb.walk_forward(z, "jump", 250, 60, tries=2, penalty=5.0).orderBy("date").collect()
    assert [r["date"] for r in rows] == days[250:]
    model = st.make_detector("jump", tries=2, penalty=5.0).fit(x[:310])
    assert [r["regime"] for r in rows[60:120]] == model.filtered_states(x[:370])[310:].tolist()
    with pytest.raises(ValueError):
        lb.walk_forward(z, "jump", 400)
    with pytest.raises(ValueError):
        lb.walk_forward(z.withColumn("z", z.z.cast("array<double>")).limit(399).unionAll(spark.createDataFrame([(days[0], None)], z.schema)), "jump")


class Highest(st.Detector):
    """A detector of a user's own: 1 over the mean of the days it was fitted on."""

    def fit(self, x):
        self.means = x.mean(0)
        return self

    def filtered_states(self, x):
        return (x[:, 0] > self.means[0]).astype(int)


def test_walk_forward_by_panel_with_own_detector(spark):
    x, _ = chain(300)
    days = [dt.date(2010, 1, 1) + dt.timedelta(k) for k in range(300)]
    z = spark.createDataFrame([(p, d, (v * p).tolist()) for p in (1, -2) for d, v in zip(days[: 300 if p == 1 else 260], x, strict=False)], "panel int, date date, z array<double>")
    rows = lb.walk_forward(z, Highest, 200, 40, by=("panel",)).collect()
    got = {(r["panel"], r["date"]): r["regime"] for r in rows}
    assert {r["method"] for r in rows} == {"Highest"} and len(rows) == 160
    for p, n in ((1, 300), (-2, 260)):
        for start in range(200, n, 40):
            for t in range(start, min(start + 40, n)):
                assert got[p, days[t]] == int(x[t, 0] * p > (x[:start, 0] * p).mean())


def returns(n=800, k=5, seed=0, sd=0.01):
    return np.random.default_rng(seed).normal(0.0003, sd, (n, k))


@pytest.mark.parametrize("name", list(al.ALLOCATORS))
def test_weights_are_long_only_and_sum_to_one(name):
    w = al.Allocator(name).weights(returns(250))
    assert (w >= 0).all() and w.sum() == pytest.approx(1)


def test_allocators_do_what_they_are_for():
    r = returns(3000, 4, 1) @ np.linalg.cholesky(np.array([[1, 0.5, 0.2, 0], [0.5, 1, 0.3, 0], [0.2, 0.3, 2, 0.1], [0, 0, 0.1, 0.5]]) + 0.0).T
    w, cov = al.risk_parity(r), al.shrunk_covariance(r)
    assert np.ptp(w * (cov @ w)) < 1e-5
    two = np.column_stack([np.random.default_rng(3).normal(0, 0.004, 4000), np.random.default_rng(4).normal(0, 0.02, 4000)])
    assert al.min_variance(two)[0] > 0.85
    crash = returns(1500, 2, 4)
    crash[::37, 1] -= 0.08
    assert al.min_tail_loss(crash)[0] > 0.7
    assert al.mean_variance(r, w_max=0.3).max() <= 0.3 + 1e-9
    prev = np.full(4, 0.25)
    move = lambda tau: np.abs(al.mean_variance(r[:200], prev, turnover_penalty=tau) - prev).sum()
    assert move(50.0) < move(0.0)
    assert al.mean_variance(r, w_max=0.2).sum() == pytest.approx(1)


@pytest.mark.parametrize("name", ["equal_weight", "mean_variance", "min_variance", "risk_parity"])
def test_optimality_gaps(name):
    r = returns(300, 5, 8, 0.02)
    w = al.Allocator(name).weights(r)
    assert 0 <= al.optimality_gap(name, r, w) + 1e-9 < 2e-7
    other = al.finish(w + np.array([0.1, 0, 0, 0, 0.02]))
    assert al.optimality_gap(name, r, other) > 1e-4
    if name.endswith("variance"):
        assert al.optimality_gap(name, r, al.Allocator(name, (("w_max", 0.3),)).weights(r), w_max=0.3) < 1e-6
        # The gap bounds what any other weights gain.
        mu, cov = al.shrunk_mean(r, 0.5) * (name == "mean_variance"), al.shrunk_covariance(r)
        value = lambda v: mu @ v - 5 * v @ cov @ v
        assert value(w) - value(other) <= al.optimality_gap(name, r, other) + 1e-12
    with pytest.raises(ValueError):
        al.optimality_gap("hrp", r, w)


def test_tail_loss_optimum_against_a_grid():
    r = returns(252, 2, 7)
    r[::20, 1] -= 0.03
    best = min(al.tail_loss(r, np.array([a, 1 - a]), 0.95) for a in np.linspace(0, 1, 2001))
    assert al.tail_loss(r, al.min_tail_loss(r), 0.95) <= best + 1e-7


def test_mean_variance_meets_the_optimality_conditions():
    r = returns(300, 5, 8, 0.02)
    w, cov, mu = al.mean_variance(r), al.shrunk_covariance(r), al.shrunk_mean(r, 0.5)
    slope = mu - 10 * cov @ w
    inside = w > 1e-7
    assert np.ptp(slope[inside]) < 1e-5 and (slope[~inside] <= slope[inside].max() + 1e-5).all()


def rule(labels, lookback, every, on_change=True):
    """Rebalancing rows by the rule, row by row."""
    out, last, label = [], None, None
    for t, r in enumerate(labels):
        if t + 1 >= lookback and r is not None and (last is None or t - last >= every or on_change and r != label):
            out.append(t)
            last, label = t, r
    return out


@pytest.mark.parametrize("on_change", [True, False])
def test_schedule_equals_the_rule_with_gaps_anywhere(spark, on_change):
    rng = random.Random(1)
    rows, want = [], set()
    for s in range(12):
        labels, now = [None] * rng.randrange(0, 40), 0
        while len(labels) < 200:
            labels += [now] * rng.randrange(1, 60) + [None] * rng.choice([0, 0, 1, 7, 30])
            now = rng.choice([0, 1, 2])
        days = [dt.date(2020, 1, 1) + dt.timedelta(k) for k in range(len(labels))]
        rows += [(f"s{s}", d, v) for d, v in zip(days, labels, strict=True)]
        want |= {(f"s{s}", days[t]) for t in rule(labels, 50, 21, on_change)}
    rows += [("none", dt.date(2020, 1, 1), None)]
    frame = spark.createDataFrame(rows, "strategy string, date date, regime int")
    assert {(r["strategy"], r["date"]) for r in bt.rebalance_days(frame, 50, 21, on_change).collect()} == want


class Momentum:
    """An allocator of a user's own: all in the asset that rose most, half of it if it is held already."""

    def weights(self, window, before=None):
        w = np.eye(window.shape[1])[window.sum(0).argmax()]
        return w if before is None else (w + before) / 2


def test_own_allocators_and_choices(spark):
    r = returns(200, 2, 9)
    days = [dt.date(2020, 1, 1) + dt.timedelta(k) for k in range(200)]
    long = spark.createDataFrame([(d, a, float(v)) for d, row in zip(days, r, strict=True) for a, v in zip("AB", row, strict=True)], "date date, symbol string, simple double")
    labels = spark.createDataFrame([(d, None if k % 17 == 3 else k // 90) for k, d in enumerate(days)], "date date, regime int")
    pick = lambda label: Momentum() if label == 1 else al.Allocator("equal_weight")
    how = {"own": Momentum(), "choice": pick, "dict": {0: al.Allocator("equal_weight"), 1: Momentum()}}
    got = {(x["strategy"], x["date"], x["asset"]): x["w"] for x in bt.allocate(long, ["A", "B"], how, labels, 60, 21).collect()}
    for name, seen, choose in (("own", [0] * 200, lambda k: Momentum()), ("choice", [None if k % 17 == 3 else k // 90 for k in range(200)], pick), ("dict", [None if k % 17 == 3 else k // 90 for k in range(200)], pick)):
        now, at = None, set(rule(seen, 60, 21))
        for t in range(59, 200):
            if t in at:
                now = choose(seen[t]).weights(r[t - 59 : t + 1], now)
            if now is not None:
                assert [got[name, days[t], a] for a in "AB"] == pytest.approx(now), (name, t)
    blind = bt.allocate(long, ["A", "B"], {"c": lambda label: al.Allocator("equal_weight" if label is None else "hrp")}, None, 60, 21)
    assert {x["w"] for x in blind.collect()} == {0.5} and blind.count() == 282


def test_allocation_switches_and_is_causal(spark):
    r = returns(300, 2, 5)
    r[:, 1] *= 4
    days = [dt.date(2020, 1, 1) + dt.timedelta(k) for k in range(300)]
    long = lambda n: spark.createDataFrame([(d, a, float(v)) for d, row in zip(days[:n], r[:n], strict=True) for a, v in zip("AB", row, strict=True)], "date date, symbol string, simple double")
    labels = spark.createDataFrame([(d, 0 if k < 150 else 2) for k, d in enumerate(days)], "date date, regime int")
    how = {"sw": {0: al.Allocator("equal_weight"), 2: al.Allocator("min_variance")}}
    got = {(x["date"], x["asset"]): x["w"] for x in bt.allocate(long(300), ["A", "B"], how, labels, 60, 21).collect()}
    assert min(d for d, _ in got) == days[59] and got[days[149], "A"] == 0.5 and got[days[150], "A"] > 0.8
    part = {(x["date"], x["asset"]): x["w"] for x in bt.allocate(long(200), ["A", "B"], how, labels, 60, 21).collect()}
    assert all(got[k] == pytest.approx(v) for k, v in part.items())


def frames(spark, w, r):
    days = [dt.date(2020, 1, 1) + dt.timedelta(k) for k in range(len(w))]
    a = spark.createDataFrame([("s", d, n, None if x != x else float(x)) for d, row in zip(days, w, strict=True) for n, x in zip("AB", row, strict=True)], "strategy string, date date, asset string, w double")
    return a, spark.createDataFrame([(d, n, float(x)) for d, row in zip(days, r, strict=True) for n, x in zip("AB", row, strict=True)], "date date, asset string, r double")


def test_backtest_timing_cost_and_drawdown(spark):
    w = [[1, 0], [0, 1], [0, 1], [1, 0], [1, 0]]
    r = [[0.5, 0.5], [0.1, 0.9], [0.9, 0.2], [0.9, -0.2], [0.3, 0.9]]
    rows = bt.run_backtest(*frames(spark, w, r), 10).orderBy("date").collect()
    assert [x["gross"] for x in rows] == pytest.approx([0, 0.1, 0.2, -0.2, 0.3]) and [x["turnover"] for x in rows] == pytest.approx([0, 1, 2, 0, 2])
    assert rows[2]["net"] == pytest.approx(0.2 - 0.002) and rows[-1]["equity"] == pytest.approx(np.prod([1 + x["net"] for x in rows]))
    m = bt.metrics(bt.run_backtest(*frames(spark, w, r), 0)).first()
    assert m["max_drawdown"] == pytest.approx(0.2) and m["days"] == 5
    flat = bt.metrics(bt.run_backtest(*frames(spark, [[1, 0]] * 4, [[0, 0]] * 4), 0)).first()
    assert flat["sharpe"] is None
    assert bt.run_backtest(*frames(spark, [[float("nan"), 1], *w], [[0, 0], *r]), 0).count() == 5


def nets(spark, x):
    return spark.createDataFrame([(k, f"s{j}", float(v)) for k, row in enumerate(x) for j, v in enumerate(row)], "idx int, strategy string, net double")


def test_overfitting(spark):
    x = np.random.default_rng(3).normal(0, 0.01, (1200, 8))
    assert bt.pbo(nets(spark, x), 10).first()["pbo"] > 0.3
    x[:, 0] += 0.003
    assert bt.pbo(nets(spark, x), 10).first()["pbo"] < 0.2
    with pytest.raises(ValueError):
        bt.pbo(nets(spark, x), 7)
    assert bt.expected_max_sharpe(0.1, 100) > bt.expected_max_sharpe(0.1, 10) > 0 == bt.expected_max_sharpe(0.1, 1)


def test_deflated_sharpe_is_a_probability(spark):
    x = np.random.default_rng(5).normal(0.0005, 0.01, (500, 4))
    frame = nets(spark, x)
    rows = bt.deflated_sharpe(frame.select("strategy", "net")).collect()
    assert len(rows) == 4 and all(0 <= r["dsr"] <= 1 for r in rows)
    plain = {r["strategy"]: r["z"] for r in bt.psr_arguments(frame).collect()}
    against = {r["strategy"]: r["z"] for r in bt.psr_arguments(frame, 0.1).collect()}
    assert all(against[s] < plain[s] for s in plain)
