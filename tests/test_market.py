import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import scalar as S
from barloom.operators import cleaning as C
from barloom.operators import features as X
from barloom.operators import forecast as M
from barloom.operators import risk as K
from barloom.operators import signals as G
from barloom.operators import stats as T

DAY = dt.datetime(2023, 11, 14)


def frame(spark, closes, volumes=None, symbol="A"):
    volumes = volumes or [100_000.0] * len(closes)
    rows = [(symbol, DAY + dt.timedelta(days=i), c, c * 1.01, c * 0.99, float(c), float(v)) for i, (c, v) in enumerate(zip(closes, volumes, strict=True))]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")


def test_reconcile_takes_the_baseline_beyond_the_tolerance(spark):
    p, b = frame(spark, [100.0, 50.0]), frame(spark, [102.0])
    got = {r.ts: r for r in C.reconcile_streams(p, b).collect()}
    first, second = got[DAY], got[DAY + dt.timedelta(days=1)]
    assert (first.close, first.anomaly, first.fallback_source) == (102.0, True, "baseline")
    assert (second.close, second.anomaly, second.divergence_score) == (50.0, False, None)


def test_one_bad_print_is_rejected(spark):
    b = frame(spark, [100.0 + i for i in range(20)] + [200.0], [1000.0] * 21)
    got = C.flag_bad_prints(b).orderBy("ts").collect()
    assert sum(r.rejected for r in got) == 1 and got[-1].rejected
    assert [r.close for r in got if not r.rejected][-1] == 119.0


def test_confirmed_by_volume_a_jump_stays(spark):
    b = frame(spark, [100.0 + i for i in range(20)] + [200.0], [1000.0] * 20 + [5000.0])
    assert C.flag_bad_prints(b).where("rejected").count() == 0


def test_split_is_detected_and_adjusted(spark):
    closes = [500.0 + i for i in range(40)] + [102.0 + i / 2 for i in range(20)]
    b = frame(spark, closes)
    a = C.detect_corporate_actions(b)
    (action,) = a.collect()
    assert action.factor > 4 and action.kind == "SPLIT"
    out = [r.close for r in C.apply_corporate_actions(b, a).orderBy("ts").collect()]
    assert max(abs(y / x - 1) for x, y in zip(out, out[1:], strict=False)) < 0.05


def test_action_touches_earlier_bars_only(spark):
    b = frame(spark, [100.0, 110.0], [10.0, 20.0])
    a = spark.createDataFrame([("A", DAY + dt.timedelta(days=1), 2.0)], "symbol string, ts timestamp, factor double")
    assert [(r.close, r.volume) for r in C.apply_corporate_actions(b, a).orderBy("ts").collect()] == [(50.0, 20.0), (110.0, 20.0)]


def test_features_do_not_look_ahead(spark):
    closes = [100 + 5 * math.sin(0.3 * i) + 0.1 * i for i in range(130)]
    keys = ["ret_mean_std_w", "ema_w", "macd", "adx_14", "rsi_14", "obv", "aroon_25"]
    a = X.compute_features(frame(spark, closes), keys).where("idx < 120").orderBy("idx").toPandas()
    b = X.compute_features(frame(spark, closes[:120]), keys).orderBy("idx").toPandas()
    np.testing.assert_allclose(a.drop(columns=["symbol", "ts"]).to_numpy(float), b.drop(columns=["symbol", "ts"]).to_numpy(float), rtol=1e-12, equal_nan=True)


def test_feature_matrix_has_no_nulls_and_needs_110_bars(spark):
    b = frame(spark, [100 + math.sin(i) for i in range(112)]).unionByName(frame(spark, [1.0] * 50, symbol="B"))
    m = X.feature_matrix(b)
    assert m.count() == 111
    assert not m.toPandas().isna().any().any()


@pytest.mark.parametrize("estimate", [T.hurst_rs, T.hurst_dfa])
def test_hurst_is_a_share(spark, estimate):
    p, prices = 100.0, []
    for i in range(300):
        p += 0.3 + 0.05 * math.sin(i)
        prices.append(p)
    (r,) = estimate(frame(spark, prices)).collect()
    assert 0 <= r.hurst <= 1 and 0 <= r.confidence <= 1 and r.points >= 3


def test_kalman_follows_the_price(spark):
    got = T.kalman_track(frame(spark, [100.0, 101.0, 102.0, 101.0], [1.0] * 4)).orderBy("ts").collect()
    assert len(got) == 4 and got[-1].filtered > 100


def test_half_life_is_infinite_without_persistence(spark):
    (r,) = T.half_life(frame(spark, [100.0, 110.0] * 20)).collect()
    assert r.beta < 0 and r.half_life == float("inf")


def test_forecast_has_an_interval_around_it(spark):
    for r in M.forecast_multi_horizon(frame(spark, [100 + 0.4 * i + math.sin(i) for i in range(60)])).collect():
        assert r.lower < r.expected_price < r.upper and 0.1 <= r.confidence <= 0.95


def test_scaled_prices_have_the_same_risk(spark):
    closes = [100 + 5 * math.sin(1.3 * i) + 0.2 * i for i in range(80)]
    a, b = (K.risk_profile(frame(spark, [c * f for c in closes])).select("var99", "sharpe", "kelly").first() for f in (1, 7))
    np.testing.assert_allclose(a, b, rtol=1e-9)


def signal_row(spark, **change):
    row = {"symbol": "A", "expected_return": 0.01, "volatility": 0.01, "p_trend": 0.7, "p_reversion": 0.0, "hurst": 0.7, "stationary": True, "authorized": True, "is_extreme": False, "confidence": 0.6, "catalyst": "NEUTRAL", "direction": "UP", "liquid": True, "last_price": 100.0, "horizon": 5} | change
    return spark.createDataFrame([row])


@pytest.mark.parametrize(("change", "short", "want"), [({}, False, "BUY"), ({"expected_return": -0.01, "direction": "DOWN", "p_reversion": 0.5}, True, "SELL"), ({"expected_return": 0.001}, False, "NO_TRADE"), ({"is_extreme": True}, False, "NO_TRADE"), ({"liquid": False}, False, "NO_TRADE")])
def test_signals(spark, change, short, want):
    (r,) = G.generate_signal(signal_row(spark, **change), allow_short=short).collect()
    assert r.signal == want
    assert (r.stop is None) == (want == "NO_TRADE")
    if want == "BUY":
        assert r.stop < r.entry < r.target


def test_trading_days_skip_weekends(spark):
    rows = [(DAY + dt.timedelta(days=i, hours=5), n) for i in range(7) for n in range(0, 12)]
    got = spark.createDataFrame(rows, "ts timestamp, n int").select("ts", "n", S.add_trading_days(F.col("ts"), F.col("n")).alias("to")).collect()
    for r in got:
        day, left = r.ts, r.n
        while left:
            day += dt.timedelta(days=1)
            left -= day.weekday() < 5
        assert r.to == day


def test_normal_cdf(spark):
    (r,) = spark.range(1).select(S.normal_cdf(F.lit(1.96)).alias("a"), S.normal_cdf(F.lit(-1.0)).alias("b"), S.chi2_sf_even(F.lit(18.307), 10).alias("c")).collect()
    assert abs(r.a - 0.975) < 1e-4 and abs(r.b - 0.158655) < 1e-5 and abs(r.c - 0.05) < 1e-4


def test_empty_bars_give_no_rows(spark):
    e = frame(spark, [1.0]).limit(0)
    assert X.compute_features(e, ["macd"]).count() == 0 and K.risk_profile(e).count() == 0 and T.hurst_rs(e).count() == 0 and C.flag_bad_prints(e).count() == 0


def test_covariance_and_portfolio_over_the_whole_universe(spark):
    import __spark_entry__ as entry
    from barloom.plans import q_market, testbed

    sf = "/root/testdata/sf0.001"
    b = testbed.bars(spark, sf).cache()
    r = q_market.monthly_returns(b).toPandas().pivot(index="ts", columns="symbol", values="ret")
    every = sorted(x.symbol for x in b.select("symbol").distinct().collect())
    assert len(every) > 0 and sorted(r.columns) == every
    got = entry.queries()["covariance_pairs_universe"](spark, sf).toPandas()
    both = r.notna().astype(int).T @ r.notna().astype(int)
    assert len(got) == sum(both.loc[x, y] > 0 for x in every for y in every if x <= y)
    want, few = r.cov(min_periods=2), C.covariance_pairs(q_market.monthly_returns(b), block_symbols=3).toPandas()
    for pairs in (got, few):
        assert (pairs["a"] <= pairs["b"]).all() and not pairs.duplicated(["a", "b"]).any() and len(pairs) == len(got)
        for x in pairs.itertuples():
            assert x.n == both.loc[x.a, x.b] and (abs(x.cov - want.loc[x.a, x.b]) < 2e-9 if x.n > 1 else x.cov != x.cov)
    risk = entry.queries()["portfolio_risk_universe"](spark, sf).toPandas().set_index("symbol")
    value = b.toPandas().assign(v=lambda d: d["close"] * d["volume"]).groupby("symbol")["v"].sum()
    w, full = (value / value.sum())[every], r.fillna(0.0)[every]
    sigma = full.cov()
    vol = float(np.sqrt(w @ sigma @ w))
    assert sorted(risk.index) == every
    np.testing.assert_allclose(risk.loc[every, "marginal"], sigma @ w / vol, atol=2e-8)
    np.testing.assert_allclose(risk["portfolio_vol"], vol, atol=2e-8)
    np.testing.assert_allclose(risk["diversification"], (w * np.sqrt(np.diag(sigma))).sum() / vol, atol=2e-8)
    np.testing.assert_allclose(risk["portfolio_var"], abs(np.sort(full @ w)[int(0.01 * len(full))]), atol=2e-8)


def test_covariance_covers_symbols_beyond_the_tenth(spark):
    days = [DAY + dt.timedelta(days=i) for i in range(6)]
    r = np.random.default_rng(4)
    rows = [(f"S{i:02}", d, float(r.normal())) for i in range(25) for k, d in enumerate(days) if (i + k) % 7]
    f = spark.createDataFrame(rows, "symbol string, ts timestamp, ret double")
    got = {(x.a, x.b): (x.n, x.cov) for x in C.covariance_pairs(f, block_symbols=6).collect()}
    at = {}
    for s, d, v in rows:
        at.setdefault(s, {})[d] = v
    names = sorted(at)
    assert len(got) == 25 * 26 // 2
    for i, a in enumerate(names):
        for b in names[i:]:
            common = sorted(at[a].keys() & at[b].keys())
            want = np.cov([at[a][d] for d in common], [at[b][d] for d in common])[0, 1]
            assert got[a, b][0] == len(common) and abs(got[a, b][1] - want) < 1e-12


def test_covariance_reads_returns_once_and_leaves_out_null_symbols(spark):
    days = [DAY + dt.timedelta(days=i) for i in range(6)]
    rows = [(s, d, float(np.sin(i * k))) for i, s in enumerate(["S1", None, "S2", "S3"], 1) for k, d in enumerate(days)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    f = spark.createDataFrame(rows, "symbol string, ts timestamp, ret double").mapInArrow(counted, "symbol string, ts timestamp, ret double")
    got = C.covariance_pairs(f).orderBy("a", "b").collect()
    assert read.value == len(rows)
    assert [(x.a, x.b, x.n) for x in got] == [(a, b, 6) for a, b in [("S1", "S1"), ("S1", "S2"), ("S1", "S3"), ("S2", "S2"), ("S2", "S3"), ("S3", "S3")]]


def test_covariance_tiles_and_slices_of_time_add_up(monkeypatch):
    import pyarrow as pa

    r, cells = np.random.default_rng(5), {}
    for i in range(23):
        for t in np.flatnonzero(r.random(40) < 0.3):
            cells.setdefault(f"S{i:02}", {})[int(t)] = float(r.normal())
    monkeypatch.setattr(C, "TILE", (5, 7))
    monkeypatch.setattr(C, "SLICE", 6)
    monkeypatch.setattr(C, "ROW", 2)
    for half in (23, 11):  # one block with itself, then two blocks
        block = lambda i: int(i >= half)  # noqa: B023, E731
        rows = [{"x": 0, "y": block(22), "block": block(i), "symbol": s, "t": list(c), "ret": list(c.values())} for i, (s, c) in enumerate(sorted(cells.items()))]
        got = {}
        for b in C.covariance_tiles(iter([pa.RecordBatch.from_pylist(rows[:9]), pa.RecordBatch.from_pylist(rows[9:])])):
            for x in b.to_pylist():
                assert len(x["left"]) <= 2 and len(x["n"]) == len(x["cov"]) == len(x["left"]) * x["width"]
                for k, (n, cov) in enumerate(zip(x["n"], x["cov"], strict=True)):
                    pair = tuple(sorted((x["left"][k // x["width"]], x["right"][k % x["width"]])))
                    assert n == 0 or pair not in got
                    if n:
                        got[pair] = n, cov
        want = {}
        for i, a in enumerate(sorted(cells)):
            for j, b in enumerate(sorted(cells)):
                common = sorted(cells[a].keys() & cells[b].keys())
                if common and (i <= j if half == 23 else block(i) < block(j)):
                    want[a, b] = len(common), np.cov([cells[a][t] for t in common], [cells[b][t] for t in common])[0, 1] if len(common) > 1 else None
        assert got.keys() == want.keys()
        for k, (n, cov) in want.items():
            assert got[k][0] == n and (n == 1 or abs(got[k][1] - cov) < 1e-12)


def test_rounded_off_is_rounding_half_away_from_zero(spark):
    from barloom.plans.testbed import rounded_off

    values = [0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, -0.2, 1e300, float("inf"), None, 0.1 + 0.2]
    got = [x.v for x in rounded_off(spark.createDataFrame([(v,) for v in values], "v double"), digits=0, v=F.col("v")).collect()]
    assert got == [1.0, -1.0, 2.0, 3.0, -3.0, 0.0, 0.0, 1e300, float("inf"), None, 0.0] and math.copysign(1, got[6]) == 1


def test_verified_matrix_adjusts_splits_and_drops_bad_prints(spark):
    closes = [100.0 + i % 3 for i in range(60)]
    truth = list(closes)
    closes = [c * 4 if i < 30 else c for i, c in enumerate(closes)]
    closes[45] *= 3
    b = frame(spark, closes).unionByName(frame(spark, [50.0 + i % 2 for i in range(20)] + [float("nan")], symbol="B"))
    got = C.prepare_verified_matrix(b, b.limit(0)).orderBy("symbol", "ts").collect()
    a = [r for r in got if r.symbol == "A"]
    assert [r.ts for r in a] == [DAY + dt.timedelta(days=i) for i in range(60) if i != 45] and all(r.usable for r in a)
    factor = closes[29] / closes[30]
    assert [r.close for r in a] == pytest.approx([closes[i] / (factor if i < 30 else 1) for i in range(60) if i != 45])
    assert max(abs(r.close - truth[0]) for r in a) < 5
    assert [r.usable for r in got if r.symbol == "B"] == [False] * 21


def test_every_matrix_column_is_returned(spark):
    import __spark_entry__ as entry

    got = entry.queries()["feature_matrix_rows"](spark, "/root/testdata/sf0.001")
    assert set(got.columns) == {"symbol", "ts_ms"} | {n for k in X.families().values() for n in k}
