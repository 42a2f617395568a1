import math

import numpy as np
import pytest
from test_market import frame

from barloom.operators import backtest as B
from barloom.operators import forecast as M


@pytest.fixture(scope="module")
def rising(spark):
    return frame(spark, [float(x) for x in 100 + np.cumsum(0.3 + 0.05 * np.sin(np.arange(260)))])


def test_no_look_ahead_and_the_same_forecast_as_the_batch_operator(spark, rising):
    rows = B.walk_forward(rising, minimum=80).orderBy("cutoff").collect()
    assert rows and all(r.train_end < r.target_ts for r in rows)
    r = rows[-1]
    train = rising.where(rising.ts <= r.train_end)
    want = M.forecast_prices(train, 5).first()
    np.testing.assert_allclose((r.forecast_return, r.volatility, r.hurst), (want.expected_return, want.volatility, want.hurst), rtol=1e-9)


def test_costs_never_help_and_a_rising_series_pays(spark, rising):
    rows = B.walk_forward(rising, minimum=80).cache()
    free, dear = (B.backtest_metrics(B.simulate_trades(rows, cost_bps=x, edge=0.0)).first() for x in (0, 200))
    assert free.total_return > 0 and free.win_rate > 0.5 and free.profit_factor > 1
    assert dear.total_return <= free.total_return and dear.costs > free.costs == 0
    few = B.backtest_metrics(B.simulate_trades(rows.limit(6), edge=0.0)).first()
    assert few.verdict not in ("STRONG_EDGE", "PROFITABLE") and "insufficient sample of trades" in few.reasons


def test_equity_is_the_loop(spark, rising):
    t = B.simulate_trades(B.walk_forward(rising, minimum=80), edge=0.0).orderBy("cutoff").collect()
    equity = peak = 1e6
    run = longest = worst = 0
    for r in t:
        equity += equity * 0.05 * r.trade_return
        assert abs(equity - r.equity) < 1e-3
        peak, run = (equity, 0) if equity >= peak else (peak, run + 1)
        longest, worst = max(longest, run), max(worst, (peak - equity) / peak)
    d = B.equity_drawdown(spark.createDataFrame(t)).first()
    assert d.duration == longest and abs(d.max_drawdown - worst) < 1e-9


def test_bootstrap_is_finite_and_repeats(spark, rising):
    t = B.simulate_trades(B.walk_forward(rising, minimum=80), edge=0.0)
    a, b = (B.bootstrap_returns(t, 100).first() for _ in range(2))
    np.testing.assert_allclose(a[1:], b[1:], rtol=1e-12)
    assert math.isfinite(a.p50) and a.worst <= a.p5 <= a.p50 <= a.p95 <= a.best and 0 <= a.p_positive <= 1


@pytest.mark.parametrize("horizon", [1, 5, 70])
def test_forecasts_of_all_windows_at_once_are_those_of_each_window(horizon):
    g = np.random.default_rng(1)
    for n, still in ((40, 0), (62, 0), (113, 20), (533, 80), (2000, 300)):
        r = 0.01 * g.normal(size=n)
        r[n // 3 : n // 3 + still] = 0
        close = 100 * np.exp(np.cumsum(r))
        ends = np.arange(45, n, 5)
        got, want = B.prefix_forecasts(close, ends, horizon), [B.prefix_forecast(close[:e], horizon) for e in ends]
        for k, v in got.items():
            assert len(v) == len(ends)
            np.testing.assert_allclose(v.astype(float), [float(f[k]) for f in want], rtol=1e-8, atol=1e-12)


def test_a_forecast_of_ones_own_is_asked_for_each_window(spark, rising):
    own = lambda close, horizon: B.prefix_forecast(close, horizon)
    a, b = (B.walk_forward(rising, f, minimum=80).orderBy("cutoff").toPandas() for f in (own, B.prefix_forecast))
    assert len(a) == len(b) > 10 and (a[["cutoff", "train_end", "target_ts"]] == b[["cutoff", "train_end", "target_ts"]]).all().all()
    np.testing.assert_allclose(a["forecast_return"], b["forecast_return"], rtol=1e-8)


def test_bootstrap_draws_are_hashes_into_the_trades_in_order(spark):
    trades = [("A", 7 * i % 60, "BUY" if i % 4 else "NO_TRADE", 0.01 * math.sin(i) if i % 4 else 0.0) for i in range(40)] + [("few", i, "BUY", 0.1) for i in range(9)]
    t = spark.createDataFrame(trades, "symbol string, cutoff long, signal string, trade_return double")
    got = B.bootstrap_returns(t.repartition(3), 40)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan  # draws are not rows
    mine = [x[3] for x in sorted(trades) if x[0] == "A" and x[2] == "BUY"]
    draws = spark.range(1).selectExpr("explode(sequence(1, 40)) as sim").selectExpr("sim", f"explode(sequence(1, {len(mine)})) as draw").selectExpr("sim", f"pmod(xxhash64(1, 'A', sim, draw), {len(mine)}L) as i").collect()
    r = sorted(math.expm1(sum(math.log1p(0.05 * mine[d.i]) for d in draws if d.sim == k)) for k in range(1, 41))
    (row,) = got.collect()
    np.testing.assert_allclose([row.p5, row.p25, row.p50, row.p75, row.p95, row.worst, row.best, row.p_positive], [r[2], r[10], r[20], r[30], r[38], r[0], r[-1], sum(x > 0 for x in r) / 40], atol=1e-12)
