"""Queries of models, their validation and back-tests by fold and regime, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import backtest as B
from ..operators import cleaning as C
from ..operators import forecast as M
from ..operators import ml as L
from ..operators import models as P
from ..operators import signals as G
from ..operators import validation as V
from .q_data import LONG
from .q_data import NAMES as FIVE
from .q_market import c, quotes, QUOTES
from .least_squares_sql import ADF_LAGS, AR
from .q_model import ADF, PRED, SIG, forecast_ctes, predicted, signals
from .testbed import BARS, RET, bars, rounded, sql_rounded, table

NAMES = [*FIVE]


def adf_test(spark, sf):
    return rounded(P.adf_test(bars(spark, sf)), "symbol", F.col("lags").cast("long").alias("lags"), "stationary", **c("statistic", "p_value"))


def adf_test_without_lags(spark, sf):
    """The same with no lagged differences, which SQL can say."""
    d = P.adf_test(bars(spark, sf), max_lag=0)
    return rounded(d, "symbol", "stationary", **c("statistic", "p_value"))


def fit_ar(spark, sf):
    return rounded(P.fit_ar(bars(spark, sf)), "symbol", F.col("ar_order").cast("long").alias("ar_order"), **c("intercept", "aic")).withColumn("n_coefficients", F.col("ar_order"))


def forecast_with_ar(spark, sf):
    return rounded(M.forecast_multi_horizon(bars(spark, sf), use_ar=True), "symbol", F.col("horizon").cast("long").alias("horizon"), "direction", **c("ar_forecast", "per_bar", "expected_return"), digits=9)


def forecast_anchored(spark, sf):
    b = bars(spark, sf)
    q = b.groupBy("symbol").agg((F.max_by("close", "ts") * F.when(F.col("symbol").cast("long") % 2 == 0, 1.01)).alias("anchor_price"), F.max("ts").alias("anchor_ts"))
    d = M.forecast_multi_horizon(b, anchors=q, as_of=F.lit("2002-01-02").cast("timestamp"))
    return rounded(d, "symbol", F.col("horizon").cast("long").alias("horizon"), "anchored", "staleness_days", F.unix_millis("expected_ts").alias("expected_ms"), **c("last_price", "expected_price", "expected_return", "lower", "upper"))


def two(spark, sf):
    """Rows with two features and the target."""
    from ..operators import features as X

    f = X.compute_features(bars(spark, sf), ["rsi_14", "hl_spread"]).where("idx >= 20")
    return f.join(L.targets(bars(spark, sf)).select("symbol", "ts", "y"), ["symbol", "ts"])


def linear_model(spark, sf):
    m = P.linear_model(two(spark, sf), F.array("rsi_14", "hl_spread"), F.col("y"))
    return rounded(m, "symbol", "n", intercept=F.col("intercept"), b_rsi=F.col("coefficients")[0], b_spread=F.col("coefficients")[1])


def matrix(spark, sf):
    from ..operators import features as X

    f = X.compute_features(bars(spark, sf), ["ret_mean_std_w", "rsi_14", "hl_spread", "z_scores_20", "ema_w"]).where("idx >= 20")
    return f.select("symbol", "ts", F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in FIVE]).alias("features"))


def pca_features(spark, sf):
    d = P.pca_features(matrix(spark, sf), F.col("features"))
    return rounded(d, "symbol", F.col("component").cast("long").alias("component"), F.array_join(F.transform("loadings", lambda x: F.format_number(x, 4)), " ").alias("loadings"), **c("explained"))


def pca_transform(spark, sf):
    m = matrix(spark, sf)
    d = P.pca_transform(m, F.col("features"), P.pca_features(m, F.col("features")))
    return rounded(d, "symbol", F.unix_millis("ts").alias("ts_ms"), first=F.col("components")[0])


def purged_cv_backtest(spark, sf):
    return rounded(B.purged_cv_backtest(bars(spark, sf), edge=0.02)[0], "symbol", F.col("fold").cast("long").alias("fold"), "train_verdict", "test_verdict", **c("train_sharpe", "test_sharpe", "overfit"))


def purged_cv_summary(spark, sf):
    return rounded(B.purged_cv_backtest(bars(spark, sf), edge=0.02)[1], "symbol", "folds", "positive", **c("mean_sharpe", "sd_sharpe", "consistency"))


def regime_backtest(spark, sf):
    return rounded(B.regime_backtest(bars(spark, sf), edge=0.02), "symbol", "regime", "observations", "trades", "verdict", **c("sharpe", "max_drawdown", "win_rate"))


def walk_forward_ml(spark, sf):
    d = L.judged(L.walk_forward_ml(L.ml_frame(bars(spark, sf), NAMES)))
    return rounded(d, "symbol", "cutoff", "train_rows", "direction", "direction_correct", "within", **c("predicted_return", "actual_return", "expected_price", "actual_price"))


def walk_forward_ml_metrics(spark, sf):
    return ml_rounded(L.ml_metrics(L.walk_forward_ml(L.ml_frame(bars(spark, sf), NAMES))))


def embargo_validation(spark, sf):
    return ml_rounded(L.ml_metrics(L.embargo_validation(L.ml_frame(bars(spark, sf), NAMES))))


def ml_rounded(d):
    return rounded(d, "symbol", "observations", "verdict", **c("direction_accuracy", "coverage", "mae", "rmse", "precision", "recall", "f1"))


def walk_forward_pca(spark, sf):
    """Models of principal components of the 300 columns of each cutoff's training rows."""
    d = L.judged(L.walk_forward_ml(L.ml_frame(bars(spark, sf), NAMES), components=10))
    return rounded(d, "symbol", "cutoff", "train_rows", "direction", "direction_correct", "within", **c("predicted_return", "actual_return", "expected_price", "actual_price"))


def walk_forward_direction(spark, sf):
    """Whether the next five returns add up to a gain, by F scores."""
    return ml_rounded(L.ml_metrics(L.walk_forward_ml(L.ml_frame(bars(spark, sf), NAMES, kind="direction"), selection="f_regression")))


def kfold(spark, sf):
    return L.purged_kfold_ml(bars(spark, sf), NAMES)


def purged_kfold_ml(spark, sf):
    return rounded(kfold(spark, sf)[0], "symbol", F.col("fold").cast("long").alias("fold"), "train_verdict", "test_verdict", **c("train_rmse", "test_rmse", "direction_accuracy_gap", "rmse_gap", "coverage_gap"))


def purged_kfold_summary(spark, sf):
    return rounded(kfold(spark, sf)[1], "symbol", "folds", "positive", **c("mean_direction_accuracy", "sd_direction_accuracy", "mean_rmse", "sd_rmse", "mean_coverage", "sd_coverage", "consistency"))


def comprehensive_validation(spark, sf):
    """Each horizon's walk-forward, embargo and k-fold metrics, of models of principal components."""
    d = L.comprehensive_validation(bars(spark, sf), NAMES)[0]
    return rounded(d, "symbol", F.col("horizon").cast("long").alias("horizon"), "validation", "observations", **c("direction_accuracy", "rmse", "coverage"))


def model_drift(spark, sf):
    return rounded(V.model_drift(predicted(spark, sf)), "symbol", "drift", F.array_join("alerts", "; ").alias("alerts"), **c("psi", "ks", "p_value", "mae_ratio", "direction_ratio"))


def performance_report(spark, sf):
    d = V.performance_report(V.validate_model(predicted(spark, sf)))
    return d.select("symbol", "rating", "reading_direction", "reading_corr", "reading_theil_u", F.array_join("recommendations", "; ").alias("recommendations"))


def walked(spark, sf):
    """Walk-forward predictions with their intervals in simple returns."""
    r = B.walk_forward(bars(spark, sf), purge=0, minimum=100)
    half = 1.96 * F.col("volatility") * 5**0.5
    at = lambda sign: (1 + F.col("forecast_return")) * F.exp(sign * half) - 1
    return r.select("symbol", "cutoff", F.col("forecast_return").alias("predicted"), F.log1p("actual_return").alias("actual"), at(-1).alias("lower"), at(1).alias("upper"))


def backtest_validation(spark, sf):
    d = V.backtest_validation(walked(spark, sf))[0]
    return rounded(d, "symbol", F.col("window").cast("long").alias("window"), "n", **c("mae", "rmse", "direction_accuracy", "corr", "theil_u"))


def backtest_intervals(spark, sf):
    return rounded(V.backtest_validation(walked(spark, sf))[1], "symbol", **c("coverage", "width", "conditional"))


def rank_predictions(spark, sf):
    return rounded(G.rank_predictions(signals(spark, sf).withColumn("edge_score", F.round("edge_score", 9))), "symbol", "signal", F.col("rank").cast("long").alias("rank"), **c("score"), digits=9)


def missing_symbols(spark, sf):
    wanted = table(spark, sf, "customer").select(F.concat(F.lit(" "), F.col("c_custkey").cast("string")).alias("symbol"))
    return C.missing_symbols(wanted, quotes(spark, sf))


def prefix_join(spark, sf):
    """Means of the expanding training windows of every 50th bar."""
    b = bars(spark, sf)
    k = b.withColumn("cutoff", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1).where("cutoff >= 50 and cutoff % 50 = 0").select("symbol", "cutoff", (F.col("cutoff") - 5).alias("train_end"))
    d = C.prefix_join(k, b).groupBy("symbol", F.col("cutoff").cast("long").alias("cutoff")).agg(F.count("*").alias("rows"), F.avg("close").alias("mean_close"), F.max("ts").alias("train_ts"))
    return rounded(d, "symbol", "cutoff", "rows", F.unix_millis("train_ts").alias("train_ms"), **c("mean_close"))


QUERIES = {f.__name__: f for f in (
    adf_test, adf_test_without_lags, fit_ar, forecast_with_ar, forecast_anchored, linear_model, pca_features, pca_transform, purged_cv_backtest, purged_cv_summary, regime_backtest, walk_forward_ml, walk_forward_ml_metrics,
    walk_forward_pca, walk_forward_direction, embargo_validation, purged_kfold_ml, purged_kfold_summary, comprehensive_validation, model_drift, performance_report, backtest_validation, backtest_intervals, rank_predictions, missing_symbols, prefix_join,
)}

N0 = RET + """,
n0 as (select symbol, ret, idx - 1 as k, count(*) over (partition by symbol) as n from r where ret is not null)"""
VM = """y as (select symbol, avg(abs(e)) as mae, sqrt(avg(e * e)) as rmse, avg(case when actual <> 0 then abs(e / actual) else 0 end) as mape, avg((sign(predicted) = sign(actual))::int) as acc, corr(predicted, actual) as cr,
    sqrt(avg(e * e)) / (sqrt(avg(predicted ** 2)) + sqrt(avg(actual ** 2))) as tu from u group by 1 having count(*) >= 10)"""
P_VALUE = "case when statistic < cv1 then 0.001 when statistic < cv5 then 0.025 when statistic < cv10 then 0.075 else 0.5 end"
ORACLES = {
    "adf_test": f"with recursive {N0}, {ADF_LAGS} select symbol, lags, {P_VALUE} < 0.05 as stationary, {sql_rounded({'statistic': 'statistic', 'p_value': P_VALUE})} from adf",
    "fit_ar": f"with recursive {N0}, {AR} select symbol, ar_order, ar_order as n_coefficients, {sql_rounded({'intercept': 'intercept', 'aic': 'aic'})} from fit",
    "adf_test_without_lags": f"with {N0}, {ADF} select symbol, statistic < cv5 as stationary, {sql_rounded({'statistic': 'statistic', 'p_value': 'case when statistic < cv1 then 0.001 when statistic < cv5 then 0.025 when statistic < cv10 then 0.075 else 0.5 end'})} from adf",
    "forecast_anchored": f"""with {BARS}, {forecast_ctes()}, g0 as (select *, case when symbol::bigint % 2 = 0 then last_price * 1.01 else last_price end as p, symbol::bigint % 2 = 0 as anchored from f3)
        select symbol, horizon, anchored, greatest(0, floor((epoch_us(timestamp '2002-01-02') - epoch_us(last_ts)) / 86400000000 + 0.5))::bigint as staleness_days,
        epoch_us(timestamp '2002-01-02' + to_days((select list_filter(range(1, 60), lambda d: isodow(timestamp '2002-01-02' + to_days(d::int)) <= 5)[horizon])::int)) // 1000 as expected_ms,
        {sql_rounded({'last_price': 'p', 'expected_price': 'p * exp(per_bar * horizon)', 'expected_return': 'expected_return', 'lower': 'p * exp(per_bar * horizon - 1.96 * fvol)', 'upper': 'p * exp(per_bar * horizon + 1.96 * fvol)'})} from g0""",
    "linear_model": f"""with {LONG}, t as (select symbol, f_rsi_14 as a, f_hl_spread as b, y from y0 where y is not null and idx >= 20),
        s as (select symbol, count(*) as n, avg(a) as ma, avg(b) as mb, avg(y) as my, var_pop(a) as aa, var_pop(b) as bb, covar_pop(a, b) as ab, covar_pop(a, y) as ay, covar_pop(b, y) as cy from t group by 1),
        w as (select *, (ay * bb - ab * cy) / (aa * bb - ab * ab) as b1, (cy * aa - ab * ay) / (aa * bb - ab * ab) as b2 from s) select symbol, n, {sql_rounded({'intercept': 'my - b1 * ma - b2 * mb', 'b_rsi': 'b1', 'b_spread': 'b2'})} from w""",
    "model_drift": f"""with {PRED}, t as (select *, row_number() over (partition by symbol, part order by seq desc) as back, count(*) over (partition by symbol, part) as rows_ from u), dw as (select symbol, part, predicted as x, actual from t where back <= 50 and rows_ >= 50),
        m as (select symbol, avg(abs(x - actual)) filter (part = 'ref') as rm, avg(abs(x - actual)) filter (part = 'cur') as cm, avg((sign(x) = sign(actual))::int) filter (part = 'ref') as rr, avg((sign(x) = sign(actual))::int) filter (part = 'cur') as cr from dw group by 1),
        y as (select symbol, part, least(9, floor((x - min(x) over (partition by symbol)) / (max(x) over (partition by symbol) - min(x) over (partition by symbol)) * 10)) as bin from dw), tt as (select symbol, count(*) filter (part = 'ref') as rn, count(*) filter (part = 'cur') as cn from y group by 1),
        w as (select symbol, bin, greatest(count(*) filter (part = 'ref') / max(rn), 1e-4) as p, greatest(count(*) filter (part = 'cur') / max(cn), 1e-4) as q from y join tt using (symbol) group by 1, 2), ps as (select symbol, sum((q - p) * ln(q / p)) as psi from w group by 1),
        g as (select symbol, abs(sum((part = 'ref')::int) over (partition by symbol order by x) / sum((part = 'ref')::int) over (partition by symbol) - sum((part = 'cur')::int) over (partition by symbol order by x) / sum((part = 'cur')::int) over (partition by symbol)) as gap from dw),
        k as (select symbol, max(gap) as ks from g group by 1), z as (select m.*, psi, ks, least(1, 2 * exp(-2 * (ks * sqrt(rn * cn / (rn + cn))) ** 2)) as pv, case when rm > 0 then cm / rm else 1 end as mr from m join ps using (symbol) join k using (symbol) join tt using (symbol) where rm is not null and cm is not null)
        select symbol, psi > 0.2 or pv < 0.05 or mr > 1.5 as drift, array_to_string(list_filter([case when psi > 0.2 then 'PSI exceeds threshold' end, case when pv < 0.05 then 'KS test p-value below threshold' end, case when mr > 1.5 then 'MAE ratio exceeds threshold' end], lambda x: x is not null), '; ') as alerts,
        {sql_rounded({'psi': 'psi', 'ks': 'ks', 'p_value': 'pv', 'mae_ratio': 'mr', 'direction_ratio': 'cr / greatest(0.001, rr)'})} from z""",
    "performance_report": f"""with {PRED}, {VM} select symbol, case when acc < 0.5 or cr < 0.1 or tu > 1.2 then 'FAILING' when acc > 0.6 and cr > 0.5 and tu < 0.6 then 'EXCELLENT' when acc > 0.55 and cr > 0.3 and tu < 0.8 then 'GOOD' else 'POOR' end as rating,
        case when acc > 0.55 then 'Better than random' else 'No better than random' end as reading_direction, case when cr > 0.3 then 'Meaningful linear relationship' else 'Weak linear relationship' end as reading_corr, case when tu < 1 then 'Better than naive forecast' else 'Worse than naive forecast' end as reading_theil_u,
        array_to_string(list_filter([case when acc < 0.55 then 'Consider regime-specific models' end, case when cr < 0.3 then 'Add more predictive features' end, case when tu > 1 then 'Reduce forecast variance, increase shrinkage' end, case when mape > 0.05 then 'High percentage errors - check for outliers' end], lambda x: x is not null), '; ') as recommendations from y""",
    "rank_predictions": f"with recursive {SIG} select symbol, signal, rank() over (order by round(edge_score, 9) desc) as rank, {sql_rounded({'score': 'edge_score'}, 9)} from g",
    "missing_symbols": f"with {QUOTES} select c_custkey::varchar as symbol from customer where c_custkey::varchar not in (select symbol from q)",
    "prefix_join": f"""with {BARS}, i as (select *, row_number() over (partition by symbol order by ts) - 1 as idx from bars), k as (select symbol, idx as cutoff from i where idx >= 50 and idx % 50 = 0)
        select k.symbol, k.cutoff, count(*) as rows, epoch_us(max(ts)) // 1000 as train_ms, {sql_rounded({'mean_close': 'avg(close)'})} from k join i on k.symbol = i.symbol and i.idx < k.cutoff - 5 group by 1, 2""",
}
