"""DuckDB SQL for the registered queries: common tables, and one final SELECT for each."""

from __future__ import annotations

from itertools import combinations
from math import e
from statistics import NormalDist

STRESS = [("early", "1996-03-01", "1996-09-30"), ("middle", "1998-07-01", "1999-02-28"), ("late", "2000-10-01", "2001-03-31")]
ASSETS = ("AF", "AO", "NF", "NO", "RF", "RO")
KEPT = ASSETS[:5]
MACRO = [(s, "m" + s[0]) for s in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]


def r(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def trailing(rows: int, by: str) -> str:
    return f"(PARTITION BY {by} ORDER BY date ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


def so_far(by: str = "") -> str:
    return f"({'PARTITION BY ' + by if by else ''} ORDER BY date ROWS UNBOUNDED PRECEDING)"


def zscore(x: str) -> str:
    w = so_far()
    return f"CASE WHEN count({x}) OVER {w} >= 60 THEN ({x} - avg({x}) OVER {w}) / nullif(stddev_samp({x}) OVER {w}, 0) END"


def vol(n: int) -> str:
    w = trailing(n, "symbol")
    return f"CASE WHEN count(ret) OVER {w} >= 15 THEN stddev_samp(ret) OVER {w} * sqrt(252) END AS vol{n}"


PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in combinations(KEPT, 2))
W63 = trailing(63, "a, b")
#: Common tables in the order in which they build on each other.
TABLES = {
    "obs": "SELECT l_shipdate::DATE AS date, l_returnflag || l_linestatus AS symbol, 20000 + avg(l_extendedprice / nullif(l_quantity, 0)) AS price FROM lineitem GROUP BY ALL",
    "mobs": "SELECT o_orderdate::DATE AS date, o_orderpriority AS series_id, avg(o_totalprice) AS value FROM orders GROUP BY ALL",
    "cal": "SELECT t::DATE AS date FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS t FROM obs) WHERE isodow(t) < 6",
    "panel": "SELECT date, symbol, price FROM cal CROSS JOIN (SELECT DISTINCT symbol FROM obs) LEFT JOIN obs USING (date, symbol)",
    "macro": f"SELECT date, series_id, last_value(value IGNORE NULLS) OVER {trailing(6, 'series_id')} AS value FROM cal CROSS JOIN (SELECT DISTINCT series_id FROM mobs) LEFT JOIN mobs USING (date, series_id)",
    "rets": "SELECT *, ln(price) - lag(ln(price)) OVER w AS ret, price / nullif(lag(price) OVER w, 0) - 1 AS simple FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY date)",
    "feats": f"SELECT *, {vol(21)}, {vol(63)}, (price - max(price) OVER {trailing(252, 'symbol')}) / max(price) OVER {trailing(252, 'symbol')} AS dd FROM rets",
    "pairs": f"""SELECT cal.date, p.a, p.b, CASE WHEN y.ret IS NOT NULL THEN x.ret END AS x, CASE WHEN x.ret IS NOT NULL THEN y.ret END AS y
      FROM cal CROSS JOIN (VALUES {PAIRS}) p(a, b) LEFT JOIN rets x ON x.date = cal.date AND x.symbol = p.a LEFT JOIN rets y ON y.date = cal.date AND y.symbol = p.b""",
    "corr": f"SELECT date, a, b, CASE WHEN count(x) OVER {W63} >= 30 THEN covar_pop(x, y) OVER {W63} / nullif(stddev_pop(x) OVER {W63} * stddev_pop(y) OVER {W63}, 0) END AS corr FROM pairs",
    "avgc": "SELECT date, avg(corr) AS avg_corr FROM corr GROUP BY date",
    "market": f"""SELECT date, {', '.join(f'{zscore(c)} AS {c}' for c in ('v21', 'v63', 'fall', 'avg_corr'))} FROM (
      SELECT date, avg(vol21) AS v21, avg(vol63) AS v63, -avg(dd) AS fall, any_value(avg_corr) AS avg_corr FROM feats LEFT JOIN avgc USING (date) GROUP BY date)""",
    "rules": "SELECT method, date, CASE WHEN z < 0 THEN 0 WHEN z < 1 THEN 1 WHEN z IS NOT NULL THEN 2 END AS regime FROM (SELECT 'fall' AS method, date, fall AS z FROM market UNION ALL SELECT 'vol', date, v21 FROM market)",
    "labels_": "SELECT * FROM rules WHERE regime IS NOT NULL",
    "runs": """SELECT method, run, regime, min(date) AS start, max(date) AS "end", count(*) AS days FROM (
      SELECT *, (sum(c) OVER (PARTITION BY method ORDER BY date ROWS UNBOUNDED PRECEDING))::BIGINT AS run FROM (
        SELECT *, CASE WHEN regime IS NOT DISTINCT FROM lag(regime) OVER (PARTITION BY method ORDER BY date) AND row_number() OVER (PARTITION BY method ORDER BY date) > 1 THEN 0 ELSE 1 END AS c FROM labels_)) GROUP BY method, run, regime""",
    "stress": "SELECT name, s::DATE AS s, e::DATE AS e FROM (VALUES " + ", ".join(map(str, STRESS)) + ") t(name, s, e)",
    "weights": f"""SELECT k.strategy, date, symbol AS asset, CASE k.strategy WHEN 'equal' THEN 1 / 6::DOUBLE WHEN 'inverse_vol' THEN iv / total ELSE ord / 21::DOUBLE END AS w
      FROM (SELECT *, count(iv) OVER (PARTITION BY date) AS n, sum(iv) OVER (PARTITION BY date) AS total, list_position({list(ASSETS)}, symbol) AS ord FROM (SELECT date, symbol, 1 / nullif(vol21, 0) AS iv FROM feats)),
      (VALUES ('equal'), ('inverse_vol'), ('tilt')) k(strategy) WHERE n = 6""",
    "grid": "SELECT weights.*, c.bps::DOUBLE AS cost_bps FROM weights, (VALUES (0), (5), (10), (20)) c(bps)",
    "held": "SELECT g.*, coalesce(lag(w) OVER (PARTITION BY strategy, cost_bps, asset ORDER BY g.date), 0) AS h, exp(ret) - 1 AS r FROM grid g LEFT JOIN rets ON rets.date = g.date AND rets.symbol = g.asset",
    "moved": "SELECT *, abs(h - coalesce(lag(h) OVER (PARTITION BY strategy, cost_bps, asset ORDER BY date), 0)) AS m FROM held",
    "daily": "SELECT strategy, cost_bps, date, sum(coalesce(h * r, 0)) AS gross, sum(m) AS turnover FROM moved GROUP BY ALL",
    "nets": "SELECT *, cost_bps / 1e4 * turnover AS cost, gross - cost_bps / 1e4 * turnover AS net FROM daily",
    "swept": "SELECT *, product(1 + net) OVER (PARTITION BY strategy, cost_bps ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM nets",
    "peaks": "SELECT *, max(equity) OVER (PARTITION BY strategy, cost_bps ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM swept",
    "bt": "SELECT * EXCLUDE (cost_bps) FROM peaks WHERE cost_bps = 10",
}

METRICS = f"""count(net) AS days, {r('pow(product(1 + net), 252.0 / count(net)) - 1')} AS ann_return, {r('stddev_samp(net) * sqrt(252)')} AS ann_vol,
  {r('avg(net) / nullif(stddev_samp(net), 0) * sqrt(252)')} AS sharpe, {r('max((peak - equity) / peak)')} AS max_drawdown, {r('sum(turnover) * 252 / (2 * count(net))')} AS ann_turnover,
  CASE WHEN max((peak - equity) / peak) > 0 THEN {r('(pow(product(1 + net), 252.0 / count(net)) - 1) / max((peak - equity) / peak)')} END AS calmar"""


#: Fixed models: start, moves, means and variances of a hidden Markov model; centres and penalty of a jump model.
MARKOV = ([0.4, 0.4, 0.2], [[0.95, 0.04, 0.01], [0.03, 0.94, 0.03], [0.02, 0.06, 0.92]], [[-0.8] * 4, [0.2] * 4, [1.4] * 4], [[0.5] * 4, [0.7] * 4, [1.5] * 4])
JUMP = ([[-0.8] * 4, [0.2] * 4, [1.4] * 4], 6.0)

ZS = "zs AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY date) AS i FROM market WHERE v21 IS NOT NULL AND v63 IS NOT NULL AND fall IS NOT NULL AND avg_corr IS NOT NULL)"


def square(m: list) -> str:
    """Squared distance of a day to m."""
    return " + ".join(f"({c} - ({x})) ** 2" for c, x in zip(("v21", "v63", "fall", "avg_corr"), m, strict=True))


def markov() -> str:
    """The forward recursion of the fixed hidden Markov model; each state has one variance."""
    start, move, means, var = MARKOV
    dens = ", ".join(f"exp(-0.5 * (4 * ln(2 * pi() * {var[k][0]}) + ({square(means[k])}) / {var[k][0]})) AS b{k}" for k in range(3))
    first = ", ".join(f"{start[k]} * b{k} / ({' + '.join(f'{start[j]} * b{j}' for j in range(3))}) AS a{k}" for k in range(3))
    come = [f"({' + '.join(f'a{j} * {move[j][k]}' for j in range(3))}) * b{k}" for k in range(3)]
    step = ", ".join(f"{c} / ({' + '.join(come)})" for c in come)
    return f""", {ZS}, dens AS MATERIALIZED (SELECT date, i, {dens} FROM zs)
      SELECT date, CASE WHEN a0 >= a1 AND a0 >= a2 THEN 0 WHEN a1 >= a2 THEN 1 ELSE 2 END AS regime, {r('a2')} AS p_worst FROM dens JOIN (WITH RECURSIVE s AS (
        SELECT i, {first} FROM dens WHERE i = 1 UNION ALL SELECT d.i, {step} FROM s JOIN dens d ON d.i = s.i + 1) SELECT * FROM s) USING (i)"""


def jump(select: str) -> str:
    """The dynamic program of the fixed jump model."""
    means, penalty = JUMP
    cost = ", ".join(f"{square(m)} AS c{k}" for k, m in enumerate(means))
    step = ", ".join(f"c{k} + least(x{k}, least(x0, x1, x2) + {penalty})" for k in range(3))
    return f""", {ZS}, costs AS MATERIALIZED (SELECT date, i, {cost} FROM zs),
      paths AS MATERIALIZED (SELECT * FROM (WITH RECURSIVE s AS (SELECT i, c0 AS x0, c1 AS x1, c2 AS x2 FROM costs WHERE i = 1 UNION ALL SELECT d.i, {step} FROM s JOIN costs d ON d.i = s.i + 1) SELECT * FROM s))
      {select}"""


def with_tables(select: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in TABLES.items()) + "\n" + select


def wide(table: str, values: dict[str, str]) -> str:
    return ", ".join(f"{r(f'''max({c}) FILTER (symbol = '{s}')''')} AS {s.lower()}{x}" for c, x in values.items() for s in ASSETS)


def covariance() -> str:
    """The shrunk covariance, by plain sums."""
    cols = ", ".join(f"max(exp(ret) - 1) FILTER (symbol = '{s}') AS {s}" for s in ASSETS)
    cells = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, ({a} - avg({a}) OVER ()) * ({b} - avg({b}) OVER ()) AS xy FROM d" for a in ASSETS for b in ASSETS)
    return f"""d AS (SELECT * FROM (SELECT date, {cols} FROM rets GROUP BY date) WHERE {' AND '.join(f'{s} IS NOT NULL' for s in ASSETS)}),
cells AS ({cells}), s AS (SELECT a, b, avg(xy) AS s, avg(xy * xy) AS q, count(xy) AS n FROM cells GROUP BY a, b),
t AS (SELECT sum(s) FILTER (a = b) / 6 AS m FROM s),
e AS (SELECT any_value(m) AS m, sum((s - CASE WHEN a = b THEN m ELSE 0 END) ** 2) / 6 AS d2, sum(q - s * s) / 6 / any_value(n) AS b2 FROM s, t),
lw AS (SELECT a, b, coalesce(least(b2, d2) / nullif(d2, 0), 0) AS rho, ((1 - coalesce(least(b2, d2) / nullif(d2, 0), 0)) * s + CASE WHEN a = b THEN coalesce(least(b2, d2) / nullif(d2, 0), 0) * m ELSE 0 END) * 252 AS cov FROM s, e)"""


#: Combinatorially symmetric cross-validation over 16 blocks.
CSCV = """n AS (SELECT strategy, net, row_number() OVER (PARTITION BY strategy ORDER BY date) - 1 AS idx FROM bt), k AS (SELECT (max(idx) + 1) // 16 AS rows, count(DISTINCT strategy) AS m FROM n),
  b AS (SELECT strategy, idx // rows AS block, sum(net) AS s1, sum(net * net) AS s2 FROM n, k WHERE idx < rows * 16 GROUP BY ALL),
  q AS (SELECT id, strategy, sum(s1) FILTER ((id >> block) & 1 = 1) AS a1, sum(s2) FILTER ((id >> block) & 1 = 1) AS a2, sum(s1) FILTER ((id >> block) & 1 = 0) AS b1, sum(s2) FILTER ((id >> block) & 1 = 0) AS b2
    FROM b, (SELECT range AS id FROM range(65536) WHERE bit_count(range) = 8) GROUP BY id, strategy),
  v AS (SELECT id, strategy, m, a1 / (rows * 8) / sqrt(greatest(a2 / (rows * 8) - (a1 / (rows * 8)) ** 2, 1e-18)) AS si, b1 / (rows * 8) / sqrt(greatest(b2 / (rows * 8) - (b1 / (rows * 8)) ** 2, 1e-18)) AS so FROM q, k),
  o AS (SELECT strategy, m, row_number() OVER (PARTITION BY id ORDER BY si DESC, strategy) AS best, row_number() OVER (PARTITION BY id ORDER BY so, strategy) AS rank FROM v)"""


def deflated(returns: str, trials: int = 3) -> str:
    """Deflated Sharpe ratios of returns (strategy, y); the normal's distribution function is summed as a series."""
    inv, gamma = NormalDist().inv_cdf, 0.5772156649015329
    best = (1 - gamma) * inv(1 - 1 / trials) + gamma * inv(1 - 1 / (trials * e))
    return f""", c AS (SELECT strategy, y, y - avg(y) OVER (PARTITION BY strategy) AS x FROM ({returns})),
      m AS (SELECT strategy, count(y) AS n, avg(y) / nullif(stddev_samp(y), 0) AS sr, avg(x ** 3) / avg(x ** 2) ** 1.5 AS g3, avg(x ** 4) / avg(x ** 2) ** 2 AS g4 FROM c GROUP BY strategy),
      z AS (SELECT strategy, sr, (sr - {best!r} * sqrt(var_samp(sr) OVER ())) * sqrt(n - 1) / sqrt(1 - g3 * sr + (g4 - 1) / 4 * sr ** 2) AS z FROM m)
      SELECT strategy, {r('sr')} AS sr, {r("CASE WHEN z > 8 THEN 1 WHEN z < -8 THEN 0 WHEN z = 0 THEN 0.5 ELSE 0.5 + sign(z) * exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 120), lambda k: exp((2 * k + 1) * ln(abs(z)) - (k + 1) * ln(2) - lgamma(k + 1.5) + ln(pi()) / 2))) END")} AS dsr FROM z"""


def sql() -> dict[str, str]:
    week = trailing(13, "symbol")
    z = ", ".join(f"{r(c)} AS {c}" for c in ("v21", "v63", "fall", "avg_corr"))
    corr_cols = ", ".join(f"{r(f'''max(corr) FILTER (a = '{a}' AND b = '{b}')''')} AS {a.lower()}_{b.lower()}_corr63d" for a, b in combinations(KEPT, 2))
    macro_cols = ", ".join(f"{r(f'''max(value) FILTER (series_id = '{s}')''')} AS {n}" for s, n in MACRO)
    last = ", ".join(f"max(ret) FILTER (symbol = '{s}') AS {s}" for s in ASSETS)
    pair_cells = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)')} AS corr FROM x" for a, b in combinations(ASSETS, 2))
    out = {
        "flagship": f"""WITH p AS (SELECT date_trunc('week', l_shipdate)::DATE AS date, l_returnflag || l_linestatus AS symbol, 20000 + avg(l_extendedprice / nullif(l_quantity, 0)) AS price FROM lineitem GROUP BY ALL),
          q AS (SELECT *, ln(price) - lag(ln(price)) OVER (PARTITION BY symbol ORDER BY date) AS ret FROM p),
          f AS (SELECT *, CASE WHEN count(ret) OVER {week} >= 8 THEN stddev_samp(ret) OVER {week} * sqrt(252) END AS vol13, (price - max(price) OVER {trailing(52, 'symbol')}) / max(price) OVER {trailing(52, 'symbol')} AS dd FROM q)
          SELECT date, {wide('f', {'ret': '_ret', 'vol13': '_vol13w', 'dd': '_dd'})} FROM f GROUP BY date""",
        "exchange_calendar": """SELECT date, (row_number() OVER (ORDER BY date) - 1)::INT AS day_idx FROM (SELECT unnest(generate_series(DATE '2020-01-01', DATE '2020-12-31', INTERVAL 1 DAY))::DATE AS date)
          WHERE isodow(date) < 6 AND date NOT IN ('2020-01-01', '2020-01-20', '2020-02-17', '2020-04-10', '2020-05-25', '2020-07-03', '2020-09-07', '2020-11-26', '2020-12-25')""",
        "events_tumbling": f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, {r('avg(value)')} AS mean_value FROM events GROUP BY ALL",
    }
    own = {
        "calendar_days": "SELECT date FROM cal",
        "price_panel": f"SELECT date, symbol, {r('price')} AS price FROM panel",
        "macro_ffill_limit": f"SELECT date, series_id, {r('value')} AS value FROM macro",
        "log_returns": f"SELECT date, symbol, {r('ret')} AS ret FROM rets",
        "simple_returns": f"SELECT date, symbol, {r('simple')} AS simple FROM rets",
        "simple_returns_padded": f"""SELECT date, symbol, {r('k / nullif(lag(k) OVER (PARTITION BY symbol ORDER BY date), 0) - 1')} AS simple
          FROM (SELECT *, last_value(price IGNORE NULLS) OVER {so_far('symbol')} AS k FROM panel)""",
        "rolling_vol_21": f"SELECT date, symbol, {r('vol21')} AS vol21 FROM feats",
        "rolling_vol_63": f"SELECT date, symbol, {r('vol63')} AS vol63 FROM feats",
        "drawdown_252": f"SELECT date, symbol, {r('dd')} AS dd FROM feats",
        "pair_corr_63": f"SELECT date, a, b, {r('corr')} AS corr FROM corr",
        "avg_corr_63": f"SELECT date, {r('avg_corr')} AS avg_corr FROM avgc",
        "expanding_zscore": f"SELECT date, {z} FROM market",
        "usable_rows": "SELECT count(*) AS days, count(*) FILTER (v21 IS NOT NULL AND v63 IS NOT NULL AND fall IS NOT NULL AND avg_corr IS NOT NULL) AS usable FROM market",
        "feature_matrix_trimmed": f"""SELECT f.*, c.* EXCLUDE (date), m.* EXCLUDE (date) FROM
          (SELECT date, {wide('feats', {'ret': '_ret', 'vol21': '_vol21d', 'vol63': '_vol63d', 'dd': '_dd'})} FROM feats GROUP BY date) f
          LEFT JOIN (SELECT date, {corr_cols}, {r('avg(corr)')} AS avg_corr63d FROM corr GROUP BY date) c ON c.date = f.date LEFT JOIN (SELECT date, {macro_cols} FROM macro GROUP BY date) m ON m.date = f.date
          WHERE f.date >= (SELECT min(date) FROM (SELECT date FROM rets GROUP BY date HAVING count(ret) = 6))""",
        "common_coverage": 'SELECT max(f) AS start, min(l) AS "end" FROM (SELECT min(date) AS f, max(date) AS l FROM obs WHERE price IS NOT NULL GROUP BY symbol)',
        "asset_availability": """SELECT symbol, min(date) FILTER (price IS NOT NULL) AS first_date, max(date) FILTER (price IS NOT NULL) AS last_date, count(price) AS valid_days, count(*) AS total_days,
          round(count(price) * 100.0 / max(count(*)) OVER (), 1)::DOUBLE AS availability_pct FROM obs GROUP BY symbol""",
        "missingness": """SELECT symbol, f AS first_valid, l AS last_valid, count(*) AS total_days, count(price) AS valid_days, count(*) FILTER (coalesce(date < f, true)) AS pre_inception,
          count(*) FILTER (date BETWEEN f AND l AND price IS NULL) AS gaps, coalesce(round(count(price)::DOUBLE * 100 / nullif(count(*) FILTER (date BETWEEN f AND l), 0), 2), 0)::DOUBLE AS coverage_pct
          FROM panel JOIN (SELECT symbol, min(date) FILTER (price IS NOT NULL) AS f, max(date) FILTER (price IS NOT NULL) AS l FROM panel GROUP BY symbol) USING (symbol) GROUP BY symbol, f, l""",
        "price_validation": """SELECT symbol, sum(n)::BIGINT AS n_rows, count(*) FILTER (n > 1) AS duplicate_dates, sum(neg)::BIGINT AS negative, sum(zero)::BIGINT AS zeros, sum(nul)::BIGINT AS nulls,
          round(sum(nul)::DOUBLE * 100 / sum(n), 2) AS null_pct, count(*) FILTER (n > 1) + sum(neg) + sum(zero) = 0 AS is_valid
          FROM (SELECT symbol, date, count(*) AS n, count(*) FILTER (price < 0) AS neg, count(*) FILTER (price = 0) AS zero, count(*) FILTER (price IS NULL) AS nul FROM obs GROUP BY symbol, date) GROUP BY symbol""",
        "macro_validation": """SELECT series_id, sum(n)::BIGINT AS n_rows, count(*) FILTER (n > 1) AS duplicate_dates, sum(neg)::BIGINT AS negative, sum(zero)::BIGINT AS zeros, sum(nul)::BIGINT AS nulls,
          round(sum(nul)::DOUBLE * 100 / sum(n), 2) AS null_pct, count(*) FILTER (n > 1) = 0 AS is_valid
          FROM (SELECT series_id, date, count(*) AS n, count(*) FILTER (value < 0) AS neg, count(*) FILTER (value = 0) AS zero, count(*) FILTER (value IS NULL) AS nul FROM mobs GROUP BY series_id, date) GROUP BY series_id""",
        "return_describe": f"""SELECT symbol, count(ret) AS n, {r('avg(ret)')} AS mean, {r('stddev_samp(ret)')} AS std, {r('min(ret)')} AS min, {r('max(ret)')} AS max, {r('avg(ret) * 252')} AS ann_mean,
          {r('avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252)')} AS sharpe FROM rets GROUP BY symbol""",
        "corr_summary": f"SELECT {r('avg(avg_corr)')} AS mean, {r('stddev_samp(avg_corr)')} AS std, {r('min(avg_corr)')} AS min, {r('max(avg_corr)')} AS max FROM avgc",
        "corr_histogram": """SELECT least(floor((avg_corr - lo) / nullif(hi - lo, 0) * 50), 49)::INT AS bucket, count(*) AS n
          FROM avgc, (SELECT min(avg_corr) AS lo, max(avg_corr) AS hi FROM avgc) WHERE avg_corr IS NOT NULL GROUP BY 1""",
        "corr_matrix": f", x AS (SELECT * FROM (SELECT date, {last} FROM rets GROUP BY date) WHERE {' AND '.join(f'{s} IS NOT NULL' for s in ASSETS)} ORDER BY date DESC LIMIT 500) {pair_cells}",
        "label_runs": "SELECT * FROM runs",
        "label_distribution": f"""SELECT method, k AS regime, coalesce(n, 0) AS days, {r('coalesce(n, 0)::DOUBLE / sum(coalesce(n, 0)) OVER (PARTITION BY method)')} AS share
          FROM (SELECT DISTINCT method FROM labels_) m CROSS JOIN (VALUES (0), (1), (2)) s(k) LEFT JOIN (SELECT method AS mm, regime, count(*) AS n FROM labels_ GROUP BY ALL) c ON c.mm = m.method AND c.regime = k""",
        "label_persistence": f"""SELECT method, {r('avg(days)')} AS mean_run, count(*) - 1 AS switches, {r("(count(*) - 1)::DOUBLE / (date_diff('day', min(start), max('end_')) / 365.25)")} AS switches_per_year FROM runs GROUP BY method""".replace("max('end_')", 'max("end")'),
        "crisis_share": f"""SELECT method, coalesce(name, 'outside') AS "window", count(*) AS days, {r('avg((regime = 2)::INT)')} AS crisis_share FROM labels_ LEFT JOIN stress ON date BETWEEN s AND e GROUP BY 1, 2""",
        "detector_agreement": f"SELECT x.method AS a, y.method AS b, count(*) AS days, {r('avg((x.regime = y.regime)::INT) * 100')} AS agreement FROM labels_ x JOIN labels_ y ON x.date = y.date AND x.method < y.method GROUP BY 1, 2",
        "crisis_intervals": 'SELECT method, start, "end", days FROM runs WHERE regime = 2',
        "rebalance_schedule": """, e AS (SELECT *, lag(regime) OVER (PARTITION BY method ORDER BY date) AS p FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY date) AS i FROM rules) WHERE i >= 252 AND regime IS NOT NULL),
          g AS (SELECT *, sum(CASE WHEN regime = p THEN 0 ELSE 1 END) OVER (PARTITION BY method ORDER BY date ROWS UNBOUNDED PRECEDING) AS run FROM e)
          SELECT method AS strategy, date, regime FROM (SELECT *, i - min(i) OVER (PARTITION BY method, run) AS k FROM g) WHERE k % 21 = 0""",
        "rebalance_schedule_gaps": """, e AS (SELECT method, date, i, CASE WHEN dayofweek(date) NOT IN (2, 5) THEN regime END AS regime FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY date) AS i FROM rules)),
          g AS MATERIALIZED (SELECT * FROM e WHERE i >= 252 AND regime IS NOT NULL)
          SELECT method AS strategy, date, regime FROM g JOIN (WITH RECURSIVE s(method, i, regime) AS (
            SELECT method, min(i), arg_min(regime, i) FROM g GROUP BY method UNION ALL
            SELECT s.method, min(g.i), arg_min(g.regime, g.i) FROM s JOIN g ON g.method = s.method AND g.i > s.i AND (g.i - s.i >= 21 OR g.regime <> s.regime) GROUP BY s.method) SELECT method, i FROM s) USING (method, i)""",
        "states_markov": markov(),
        "states_jump": jump("SELECT date, CASE WHEN x0 <= x1 AND x0 <= x2 THEN 0 WHEN x1 <= x2 THEN 1 ELSE 2 END AS regime FROM paths JOIN costs USING (i)"),
        "states_jump_path": jump("SELECT round(least(x0, x1, x2), 4) AS cost FROM paths WHERE i = (SELECT max(i) FROM costs)"),
        "corr_by_window": f"""SELECT name, count(avg_corr) AS days, {r('avg(avg_corr)')} AS mean, {r('max(avg_corr)')} AS max, {r('avg(avg_corr) / nullif((SELECT avg(avg_corr) FROM avgc), 0)')} AS ratio
          FROM avgc JOIN stress ON date BETWEEN s AND e WHERE avg_corr IS NOT NULL GROUP BY name""",
        "optimality_gaps": f""", d AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM rets GROUP BY date HAVING count(ret) = {len(ASSETS)})
          SELECT strategy, date, 1.0::DOUBLE AS total, 0.0::DOUBLE AS gap FROM d, (VALUES ('equal_weight'), ('mean_variance'), ('min_variance'), ('risk_parity')) k(strategy) WHERE i >= 252 AND (i - 252) % 21 = 0""",
        "weights_rules": f"SELECT strategy, date, asset, {r('w')} AS w FROM weights",
        "weights_held": f"""SELECT * FROM (SELECT strategy, date, asset, {r(f"last_value(CASE WHEN day(date) <= 3 THEN w END IGNORE NULLS) OVER {so_far('strategy, asset')}")} AS w FROM weights) WHERE w IS NOT NULL""",
        "mean_weight_by_regime": f"SELECT strategy, asset, regime, {r('avg(w)')} AS mean_w, count(*) AS days FROM weights JOIN labels_ USING (date) WHERE method = 'vol' GROUP BY GROUPING SETS ((strategy, asset), (strategy, asset, regime))",
        "alloc_turnover": f"""SELECT strategy, count(*) FILTER (t > 1e-9) AS rebalances, {r("sum(t) / (date_diff('day', min(date), max(date)) / 365.25)")} AS annual_turnover FROM (
          SELECT strategy, date, sum(dw) / 2 AS t FROM (SELECT *, abs(w - lag(w) OVER (PARTITION BY strategy, asset ORDER BY date)) AS dw FROM weights) GROUP BY strategy, date) GROUP BY strategy""",
        "backtest_daily": f"SELECT strategy, date, {', '.join(f'{r(c)} AS {c}' for c in ('gross', 'turnover', 'cost', 'net', 'equity'))} FROM bt",
        "backtest_metrics": f"SELECT strategy, {METRICS} FROM bt GROUP BY strategy",
        "equity_drawdown": f"SELECT strategy, date, {r('equity')} AS equity, {r('(peak - equity) / peak')} AS drawdown FROM bt",
        "stress_returns": f"""SELECT name, strategy, {r('product(1 + net) - 1')} AS total_return, {r('max((p - eq) / p)')} AS max_drawdown, count(*) AS days FROM (
          SELECT *, max(eq) OVER (PARTITION BY name, strategy ORDER BY date ROWS UNBOUNDED PRECEDING) AS p FROM (
            SELECT *, product(1 + net) OVER (PARTITION BY name, strategy ORDER BY date ROWS UNBOUNDED PRECEDING) AS eq FROM bt JOIN stress ON date BETWEEN s AND e)) GROUP BY name, strategy""",
        "cost_sweep": f"SELECT strategy, cost_bps, {r('pow(product(1 + net), 252.0 / count(net)) - 1')} AS ann_return, {r('avg(net) / nullif(stddev_samp(net), 0) * sqrt(252)')} AS sharpe FROM peaks GROUP BY strategy, cost_bps",
        "common_window": f""", c AS (SELECT * FROM bt WHERE strategy <> 'tilt' OR date >= DATE '1996-06-01')
          SELECT strategy, count(net) AS days, {r('pow(product(1 + net), 252.0 / count(net)) - 1')} AS ann_return, {r('avg(net) / nullif(stddev_samp(net), 0) * sqrt(252)')} AS sharpe
          FROM c WHERE date IN (SELECT date FROM c GROUP BY date HAVING count(DISTINCT strategy) = (SELECT count(DISTINCT strategy) FROM c)) GROUP BY strategy""",
        "pbo_cscv": f""", {CSCV} SELECT count(*) AS splits, {r('avg((ln(rank / (m + 1.0) / (1 - rank / (m + 1.0))) <= 0)::INT)')} AS pbo FROM o WHERE best = 1""",
        "pbo_split_ranks": f""", {CSCV} SELECT strategy, rank::INT AS rank, count(*) AS splits, {r('avg(ln(rank / (m + 1.0) / (1 - rank / (m + 1.0))))')} AS logit FROM o WHERE best = 1 GROUP BY strategy, rank""",
        "backtest_metrics_excess": f""", x AS (SELECT bt.*, net - coalesce(exp(ret) - 1, 0) AS excess FROM bt LEFT JOIN rets ON rets.date = bt.date AND rets.symbol = '{ASSETS[-1]}')
          SELECT strategy, {METRICS.replace("avg(net) / nullif(stddev_samp(net), 0)", "avg(excess) / nullif(stddev_samp(excess), 0)")} FROM x GROUP BY strategy""",
        "deflated_sharpe": deflated("SELECT strategy, net AS y FROM bt"),
        "deflated_sharpe_excess": deflated(f"SELECT strategy, net - coalesce(exp(ret) - 1, 0) AS y FROM bt LEFT JOIN rets ON rets.date = bt.date AND rets.symbol = '{ASSETS[-1]}'"),
        "weights_equal_weight": f""", d AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM rets GROUP BY date HAVING count(ret) = {len(ASSETS)})
          SELECT 'equal_weight' AS strategy, date, asset, {r(f'1.0::DOUBLE / {len(ASSETS)}')} AS w FROM d, (SELECT unnest({list(ASSETS)}) AS asset) WHERE i >= 252""",
        "psr_argument": f""", c AS (SELECT *, net - avg(net) OVER (PARTITION BY strategy) AS x FROM bt),
          m AS (SELECT strategy, count(net) AS n, avg(net) / nullif(stddev_samp(net), 0) AS sr, avg(x ** 3) / avg(x ** 2) ** 1.5 AS g3, avg(x ** 4) / avg(x ** 2) ** 2 AS g4 FROM c GROUP BY strategy)
          SELECT strategy, n, {r('sr')} AS sr, {r('g3')} AS g3, {r('g4')} AS g4, {r('sr * sqrt(n - 1) / sqrt(1 - g3 * sr + (g4 - 1) / 4 * sr ** 2)')} AS z FROM m""",
        "ledoit_wolf": f", {covariance()} SELECT a, b, {r('rho')} AS rho, {r('cov')} AS cov FROM lw",
        "cov_to_corr": f", {covariance()} SELECT x.a, x.b, CASE WHEN x.a = x.b THEN 1 ELSE round(greatest(-1, least(1, x.cov / sqrt(y.cov * z.cov))), 4) + 0.0 END AS corr FROM lw x JOIN lw y ON y.a = x.a AND y.b = x.a JOIN lw z ON z.a = x.b AND z.b = x.b",
    }
    return out | {n: with_tables(s) for n, s in own.items()}
