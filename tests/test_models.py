"""Models, their validation, folds and corrected market operators against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_market import frame

from barloom.operators import backtest as B
from barloom.operators import cleaning as C
from barloom.operators import forecast as M
from barloom.operators import ml as L
from barloom.operators import models as P
from barloom.operators import running_ml as R_
from barloom.operators import tracking as R
from barloom.operators import validation as V

r = np.random.default_rng(3)
CLOSE = 100 * np.exp(np.cumsum(0.01 * r.normal(size=260) + 0.004 * np.sin(np.arange(260) / 3)))
RET = np.diff(np.log(CLOSE))


@pytest.fixture(scope="module")
def bars(spark):
    return frame(spark, [float(x) for x in CLOSE]).cache()


def adf(y, lag, trend):
    rows = []
    for t in range(lag + 1, len(y)):
        rows.append([y[t - 1], *([1.0] if trend != "nc" else []), *([float(t - lag)] if trend == "ct" else []), *(y[t - 1] - y[t - 1 - k] for k in range(1, lag + 1))])
    x, z = np.array(rows), y[lag + 1 :]
    b = np.linalg.lstsq(x, z, rcond=None)[0]
    rss = ((z - x @ b) ** 2).sum()
    se = math.sqrt(rss / (len(z) - len(b))) / math.sqrt(((x[:, 0] - x[:, 0].mean()) ** 2).sum())
    return b[0] / se, len(z) * math.log(rss / len(z)) + 2 * len(b)


@pytest.mark.parametrize("trend", ["nc", "c", "ct"])
def test_unit_root_test_equals_plain_regressions(bars, trend):
    got = P.adf_test(bars, trend=trend).first()
    stats = [adf(RET, lag, trend) for lag in range(int(len(RET) ** (1 / 3)) + 1)]
    best = min(range(len(stats)), key=lambda k: stats[k][1])
    assert got.lags == best and abs(got.statistic - stats[best][0]) < 1e-6
    assert got.stationary == (got.statistic < P.critical_values(len(RET) - best - 1, trend)[1])


def test_autoregression_equals_least_squares(bars):
    got = P.fit_ar(bars).first()
    fits = []
    for p in range(1, 6):
        x = np.column_stack([np.ones(len(RET) - p), *(RET[p - k : len(RET) - k] for k in range(1, p + 1))])
        b = np.linalg.lstsq(x, RET[p:], rcond=None)[0]
        fits.append((len(RET) * math.log(((RET[p:] - x @ b) ** 2).sum() / len(RET)) + 2 * (p + 1), b))
    aic, b = min(fits, key=lambda f: f[0])
    assert got.ar_order == len(b) - 1 and abs(got.aic - aic) < 1e-5
    np.testing.assert_allclose([got.intercept, *got.coefficients], b, rtol=1e-6, atol=1e-9)
    path = list(RET)
    for _ in range(5):
        path.append(b[0] + sum(b[k] * path[-k] for k in range(1, len(b))))
    ahead = {x.horizon: x.ar_forecast for x in P.forecast_ar(P.fit_ar(bars), (1, 5)).collect()}
    np.testing.assert_allclose([ahead[1], ahead[5]], [path[-5], path[-1]], rtol=1e-6)
    plain, with_ar = M.forecast_prices(bars, 5).first(), M.forecast_prices(bars, 5, use_ar=True).first()
    assert abs(with_ar.per_bar - plain.per_bar - 0.4 * plain.p_random * ahead[5]) < 1e-9


def test_quotes_anchor_the_forecast(spark, bars):
    last = bars.agg(F.max("ts")).first()[0]
    quote = bars.select("symbol").distinct().select("symbol", F.lit(250.0).alias("anchor_price"), F.lit(last).alias("anchor_ts"))
    as_of = F.lit(last) + F.expr("interval 3 days")
    plain, live = M.forecast_prices(bars, 5).first(), M.forecast_prices(bars, 5, anchors=quote, as_of=as_of).first()
    assert live.last_price == 250 and live.staleness_days == 3 and abs(live.expected_return - plain.expected_return) < 1e-12 and live.expected_ts > plain.expected_ts
    none = M.forecast_prices(bars, 5, anchors=quote.withColumn("anchor_price", F.lit(None).cast("double"))).first()
    assert none.last_price == plain.last_price and not none.anchored


def test_linear_model_and_components(spark):
    x = r.normal(size=(300, 4)) @ np.diag([5, 2, 1, 0.1])
    y = 1 + x @ np.array([0.5, -1, 2, 0]) + 0.1 * r.normal(size=300)
    df = spark.createDataFrame([("a", i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))] + [("b", 0, [1.0] * 4, 1.0)], "symbol string, i int, f array<double>, y double").repartition(5)
    fit = {m.symbol: m for m in P.linear_model(df, F.col("f"), F.col("y")).collect()}
    want = np.linalg.lstsq(np.column_stack([np.ones(300), x]), y, rcond=None)[0]
    np.testing.assert_allclose([fit["a"].intercept, *fit["a"].coefficients], want, rtol=1e-6, atol=1e-8)
    assert fit["b"].n == 1 and fit["b"].coefficients == [0.0] * 4
    pca = P.pca_features(df.where("symbol = 'a'"), F.col("f"), share=0.999)
    got = pca.orderBy("component").collect()
    load = np.array([g.loadings for g in got])
    np.testing.assert_allclose(load @ load.T, np.eye(len(load)), atol=1e-9)
    value = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    np.testing.assert_allclose([g.explained for g in got], (value / value.sum())[: len(got)], rtol=1e-6)
    rows = P.pca_transform(df.where("symbol = 'a'"), F.col("f"), pca).orderBy("i").collect()
    np.testing.assert_allclose([w.components for w in rows], (x - x.mean(0)) @ load.T, atol=1e-6)


def test_models_see_no_later_bar_and_blocks_don_t_matter(spark, bars):
    names = ["rsi_14", "hl_spread"]
    rows = lambda b, **o: {x.cutoff: x for x in L.walk_forward_ml(L.ml_frame(b, names, lookback=5), minimum=60, features=4, **o).collect()}
    a, b = rows(bars, block=4), rows(bars, block=64)
    assert a == b and len(a) > 20
    later = bars.withColumn("n", F.row_number().over(C.by_time())).withColumn("close", F.when(F.col("n") > 150, F.col("close") * 3).otherwise(F.col("close"))).drop("n")
    changed = rows(later)
    same = [k for k in a if k < 145]
    assert same and all(changed[k].predicted_return == a[k].predicted_return and changed[k].volatility == a[k].volatility for k in same)
    m = L.ml_metrics(L.walk_forward_ml(L.ml_frame(bars, names, lookback=5), minimum=60, features=4)).first()
    assert m.observations == len(a) and 0 <= m.direction_accuracy <= 1
    e = L.embargo_validation(L.ml_frame(bars, names, lookback=5), minimum=60, features=4).collect()
    assert e and all(abs(x.actual_return - (CLOSE[x.cutoff + 10] / CLOSE[x.cutoff - 1] - 1)) < 1e-9 for x in e)


@pytest.mark.parametrize("how", [{"selection": "f_regression"}, {"components": 3}, {"components": 3, "gap": 4, "purge": 0}, {"selection": "f_regression", "purge": 12}])
@pytest.mark.parametrize("horizon", [1, 7])
def test_models_from_running_sums_equal_those_fitted_anew(spark, bars, how, horizon):
    names = ["rsi_14", "hl_spread", "volume_z_20"]  # the last is mostly 0: no spread
    flat = bars.withColumn("volume", F.when(F.rand(1) < 0.2, 5.0).otherwise(100.0))
    frame = L.ml_frame(flat, names, lookback=6, horizon=horizon).cache()
    frame = frame.withColumn("purge", F.lit(how.get("purge", 5))).withColumn("gap", F.lit(how.get("gap", 0)))
    got = {x.cutoff: x for x in R_.predictions(frame, 6, 40, 5, 3, 4, how.get("components"), 0.95).collect()}
    want = {x.cutoff: x for x in L.refitted(frame, 6, 40, 5, 16, features=4, selection="f_regression", components=how.get("components")).collect()}
    assert set(got) == set(want) and len(got) > 20
    for k, w in want.items():
        g = got[k]
        assert (g.train_end, g.train_rows, g.actual_return, g.start_price, g.actual_price) == (w.train_end, w.train_rows, w.actual_return, w.start_price, w.actual_price)
        assert abs(g.predicted_return - w.predicted_return) < 1e-7, k


def test_every_horizon_and_validation_in_one_pass_equals_its_own(spark, bars):
    names = ["rsi_14", "hl_spread"]
    every, walk = L.comprehensive_validation(bars, names, (1, 5), lookback=4, minimum=40, components=3)
    got = {(x.horizon, x.validation): (x.observations, x.direction_accuracy, x.rmse) for x in every.collect()}
    for h in (1, 5):
        frame = L.ml_frame(bars, names, lookback=4, horizon=h)
        wf, em = (L.ml_metrics(d).first() for d in (L.walk_forward_ml(frame, minimum=40, components=3), L.embargo_validation(frame, 6, minimum=40, components=3)))
        folds, summary = L.purged_kfold_ml(bars, names, 5, 2, 10, h, 40, 4, components=3)
        s, f = summary.first(), folds.collect()
        assert s.folds == len(f) and abs(s.mean_rmse - np.mean([x.test_rmse for x in f])) < 1e-12 and s.positive == sum(x.test_direction_accuracy > 0.5 for x in f)
        want = {"walk_forward": (wf.observations, wf.direction_accuracy, wf.rmse), "embargo": (em.observations, em.direction_accuracy, em.rmse), "purged_kfold": (s.observations, s.mean_direction_accuracy, s.mean_rmse)}
        for k, v in want.items():
            np.testing.assert_allclose(got[h, k], v, rtol=1e-9)
    assert len(got) == 6 and walk.first().horizons == 2


def test_quartiles_of_every_lag(spark):
    v = np.round(r.normal(size=400), 1)
    p = R_.Plan(9, 3, 30, 5, 5, 0, 4)
    near = {}
    for part, q, low, around in R_.neighbours(v, p, len(v)):
        near.setdefault(part, {})[q] = (low, around)
    for part in near:
        for t in range(max(p.start(part), 12), min(p.start(part + 1), len(v))):
            cut = R_.quartiles([near[part][q] for q in range(3)], t - 9, v[max(0, p.start(part) - 9) : t - 9], v[:9], v[t - 9 : t])
            for lag in range(9):
                s = np.sort(v[lag : t - 9 + lag])
                assert [cut[q, lag] for q in range(3)] == [s[int(len(s) * x)] for x in (0.25, 0.5, 0.75)]


def test_folds_train_before_they_test(spark, bars):
    numbered = bars.withColumn("i", F.row_number().over(C.by_time()) - 1)
    got = {(x.fold, x.role): (x.low, x.high, x.n) for x in B.folds(numbered, 5, 2, 10, 50).groupBy("fold", "role").agg(F.min("i").alias("low"), F.max("i").alias("high"), F.count("*").alias("n")).collect()}
    assert got == {(k, role): v for k in (2, 3) for role, v in (("train", (0, 52 * k - 11, 52 * k - 10)), ("test", (52 * k, min(259, 52 * (k + 2) - 1), min(260, 52 * (k + 2)) - 52 * k)))}
    folds, summary = B.purged_cv_backtest(bars, edge=0.0)
    f, s = folds.collect(), summary.first()
    assert len(f) == s.folds and abs(np.mean([x.test_sharpe for x in f]) - s.mean_sharpe) < 1e-9 and all(abs(x.train_sharpe - x.test_sharpe - x.overfit) < 1e-12 for x in f)
    labels = B.regimes(bars, 63, 21).orderBy("idx").collect()
    assert [x.idx for x in labels] == list(range(63, 260, 21)) and abs(labels[0].hurst - B.prefix_hurst(np.diff(np.log(CLOSE[:63])))) < 1e-9
    assert all(x.observations >= 3 for x in B.regime_backtest(bars, edge=0.0).collect())


def test_ratings_let_the_later_rule_decide(spark):
    rows = [("a", 0.7, 0.6, 0.5), ("b", 0.56, 0.4, 0.7), ("c", 0.52, 0.2, 0.9), ("d", 0.7, 0.05, 0.5)]
    df = spark.createDataFrame([(*x, 0.1) for x in rows], "symbol string, direction_accuracy double, corr double, theil_u double, mape double")
    assert {x.symbol: x.rating for x in V.performance_report(df).collect()} == {"a": "EXCELLENT", "b": "GOOD", "c": "POOR", "d": "FAILING"}
    v = V.backtest_validation(spark.createDataFrame([("a|b", i, float(i), float(i) + 1, i - 1.0, i + 2.0) for i in range(60)], "symbol string, cutoff int, predicted double, actual double, lower double, upper double"))
    assert {(x.symbol, x.window): x.n for x in v[0].collect()} == {("a|b", 0): 60, ("a|b", 20): 20, ("a|b", 50): 50} and v[1].first().coverage == 1


def test_first_places_of_overlapping_symbols_and_the_class_of_the_excerpt(spark):
    docs = spark.createDataFrame([(1, "(ogdc), gains"), (2, "XOGDC and OGDC"), (3, "OGDC " + "x " * 2000 + "LOSS"), (4, "nothing"), (5, "News of ABC-X and (OGDC), A.B  LOSS"), (6, None), (7, "")], "doc_id long, text string")
    symbols = ["OGDC", "ABC-X", "A.B", "X", "GDC", "OG", "ABC", "", None]
    for at_once in (200_000, 3):
        got = sorted((x.doc_id, x.symbol, x.at, x.direction, x.excerpt) for x in C.catalyst_events(docs, spark.createDataFrame([(s,) for s in symbols], "symbol string"), ["GAIN"], ["LOSS"], at_once).collect())
        want = []
        for d, text in [(r.doc_id, r.text) for r in docs.collect()]:
            clean = " ".join((text or "").upper().split())
            for s in filter(None, symbols):
                if (at := clean.find(s)) >= 0:
                    e = clean[max(at - 250, 0) : at + 1500]
                    want.append((d, s, at + 1, "POSITIVE" if "GAIN" in e else "NEGATIVE" if "LOSS" in e else "NEUTRAL", e))
        assert got == sorted(want) and len(want) > 12


def test_predictions_stay_pending_until_they_expire(spark):
    p = spark.sql("select 'a' as symbol, timestamp '2024-01-10' as expiry, 'PENDING' as status, 100.0D as anchor_price, 0.1D as expected_return, 90.0D as lower, 120.0D as upper")
    p = p.unionByName(p.withColumn("expiry", F.expr("timestamp '2030-01-01'"))).unionByName(p.withColumn("expiry", F.expr("timestamp '2024-03-01'")))
    b = spark.sql("select 'a' as symbol, timestamp '2024-01-11' as ts, 110.0D as close union all select 'a', timestamp '2024-04-01', 200.0D")
    got = sorted((str(x.expiry.date()), x.status) for x in R.resolve_outcomes(p, b, F.lit("2024-03-15").cast("timestamp")).collect())
    assert got == [("2024-01-10", "RESOLVED"), ("2024-03-01", "EXPIRED_NO_DATA"), ("2030-01-01", "PENDING")]


def test_long_rows_of_the_dataset_are_not_shuffled(spark, bars):
    d = L.ml_dataset(bars, ["ret", "hl_spread"], lookback=20, kind=("return", "direction"))
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    rows = d.orderBy("ts").collect()
    assert len(rows) == len(CLOSE) - 21 - 5  # the first bar has no return; 20 rows before, five returns after
    first = rows[0]
    np.testing.assert_allclose(first.features[::2], RET[:20], rtol=1e-9)
    assert abs(first["return"] - RET[21:26].sum()) < 1e-9 and first.direction == float(RET[21:26].sum() > 0)
    assert d.count() == L.ml_dataset(bars, ["ret", "hl_spread"], lookback=20).where("y is not null").count()


def test_counts_kept_over_growing_rows_give_the_mutual_information_of_each():
    g = np.random.default_rng(5)
    x = np.cumsum(g.normal(size=(200, 6)), 0)  # ranges move
    x[:, 4], x[:, 5] = 2.0, np.round(x[:, 5])
    y = g.normal(size=200)
    grids = L.Grids(x, y)
    for n in (30, 35, 35, 90, 95, 200):
        np.testing.assert_allclose(grids.scores(n), L.mutual_info(x[:n], y[:n]), atol=1e-10)


def test_models_by_kept_counts_are_those_of_whole_pipelines(spark, bars):
    f = L.ml_frame(bars, ["ret", "rsi_14"], lookback=20)
    rows = f.orderBy("idx").toPandas()
    got = L.walk_forward_ml(f, block=3).orderBy("cutoff").toPandas()
    series, y = np.stack(rows["x"].to_numpy()), rows["y"].to_numpy(float)
    x = np.lib.stride_tricks.sliding_window_view(series, 20, axis=0).transpose(0, 2, 1).reshape(len(series) - 19, -1)
    assert len(got) > 20
    for r in got.itertuples():
        t = r.cutoff - 5
        assert abs(L.Pipeline(x[: t - 20], y[20:t]).predict(x[r.cutoff - 20][None])[0] - r.predicted_return) < 1e-9
