"""Queries of forecasts, signals, validation, tracking and ranking, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import backtest as B
from ..operators import forecast as M
from ..operators import models as L
from ..operators import risk as K
from ..operators import signals as G
from ..operators import tracking as R
from ..operators import validation as V
from .least_squares_sql import ADF_LAGS
from .q_market import BASE, EWMV, GARCH, NUM, RSQ, RP, c, quotes
from .testbed import BARS, bars, rounded, sql_rounded, table

FORECAST = ("last_price", "volatility", "per_bar", "expected_price", "expected_return", "lower", "upper", "p_positive", "p_gain", "p_loss", "confidence")


def forecast_factors(spark, sf):
    return rounded(M.factors(bars(spark, sf)), "symbol", **c("volatility", "ewma_vol", "drift", "momentum5", "momentum20", "z", "reversion", "trend"))


def regime_probabilities(spark, sf):
    return rounded(M.forecast_regime(bars(spark, sf)), "symbol", **c("hurst", "p_trend", "p_reversion", "p_random"))


def historical_extreme(spark, sf):
    return rounded(M.historical_extreme(bars(spark, sf)), "symbol", F.col("horizon").cast("long").alias("horizon"), **c("extreme"))


def forecast_multi_horizon(spark, sf):
    return rounded(M.forecast_multi_horizon(bars(spark, sf)), "symbol", F.col("horizon").cast("long").alias("horizon"), "direction", "is_extreme", "actionable", **c(*FORECAST))


def forecast_prices(spark, sf):
    return rounded(M.forecast_prices(bars(spark, sf), 5), "symbol", "direction", "is_extreme", "actionable", **c(*FORECAST))


def liquidity_gate(spark, sf):
    return G.liquidity_gate(bars(spark, sf), 280_000)


def spread_bps(spark, sf):
    q = quotes(spark, sf).select("event_id", F.col("close").alias("bid"), F.when(F.col("event_id") % 4 != 0, F.col("close") + F.col("volume") / 1000).alias("ask"))
    return rounded(G.spread_bps(q), "event_id", **c("spread_bps"))


def signals(spark, sf):
    b = bars(spark, sf)
    f = M.forecast_prices(b, 5).join(K.risk_profile(b).select("symbol", "authorized"), "symbol").join(G.liquidity_gate(b), "symbol").join(L.adf_test(b).select("symbol", "stationary"), "symbol", "left")
    return G.generate_signal(f.withColumn("stationary", F.coalesce("stationary", F.lit(False))).withColumn("catalyst", F.lit(None).cast("string")), threshold=0.02, min_conviction=0.3, min_quality=0.02)


def generate_signal(spark, sf):
    return rounded(signals(spark, sf), "symbol", "signal", "wish", F.array_join("reasons", "; ").alias("reasons"), **c("conviction", "quality", "edge_score", "size", "entry", "stop", "target"), digits=5)


def signal_to_order(spark, sf):
    return rounded(G.signal_to_order(signals(spark, sf)), "symbol", "side", "quantity", **c("limit_price", "stop", "target"), digits=4)


def rank_universe(spark, sf):
    """By edge times the accuracy of the symbol's back-test."""
    tested = B.backtest_metrics(B.simulate_trades(B.walk_forward(bars(spark, sf)), edge=0.02)).select("symbol", "accuracy")
    ranked = G.rank_universe(signals(spark, sf).select("symbol", "signal", "edge_score"), tested)
    return rounded(ranked, "symbol", "signal", F.col("rank").cast("long").alias("rank"), **c("score"), digits=9)


def strongest_buy(spark, sf):
    return rank_universe(spark, sf).where("signal = 'BUY'").orderBy(F.desc("score"), "symbol").limit(1)


def best_blocked(spark, sf):
    return rank_universe(spark, sf).where("signal <> 'BUY' and score > 0").orderBy(F.desc("score"), "symbol").limit(1)


def predicted(spark, sf):
    """The mean of the last 5 returns as a prediction of the next one."""
    from ..operators.features import by_time, log_returns

    r = log_returns(bars(spark, sf))
    r = r.withColumn("predicted", F.avg("ret").over(by_time().rowsBetween(-5, -1))).withColumn("sd", F.stddev_samp("ret").over(by_time().rowsBetween(-20, -1))).where("idx >= 21")
    return r.select("symbol", F.col("idx").alias("seq"), "predicted", F.col("ret").alias("actual"), (F.col("predicted") - 1.96 * F.col("sd")).alias("lower"), (F.col("predicted") + 1.96 * F.col("sd")).alias("upper"), (F.col("ret") - F.col("predicted")).alias("x"), F.when(F.col("idx") < 300, "ref").otherwise("cur").alias("part"))


PRED = NUM.split(",\nn0")[0] + """,
v as (select symbol, idx as seq, avg(ret) over (partition by symbol order by ts rows between 5 preceding and 1 preceding) as predicted, ret as actual, stddev_samp(ret) over (partition by symbol order by ts rows between 20 preceding and 1 preceding) as sd from r qualify idx >= 21),
u as (select *, predicted - actual as e, predicted - 1.96 * sd as lower, predicted + 1.96 * sd as upper, actual - predicted as res, case when seq < 300 then 'ref' else 'cur' end as part from v)"""
VALID = ("mae", "mse", "mape", "direction_accuracy", "corr", "bias", "over_rate", "under_rate", "rmse", "theil_u", "precision", "recall", "f1", "r2")


def validate_model(spark, sf):
    return rounded(V.validate_model(predicted(spark, sf)), "symbol", "n", **c(*VALID))


def ljung_box(spark, sf):
    return rounded(V.ljung_box(predicted(spark, sf)), "symbol", **c("stat", "p_value"))


def jarque_bera(spark, sf):
    return rounded(V.jarque_bera(predicted(spark, sf)), "symbol", **c("stat", "p_value"))


def psi(spark, sf):
    return rounded(V.psi(predicted(spark, sf)), "symbol", **c("psi"))


def ks_two_sample(spark, sf):
    return rounded(V.ks_two_sample(predicted(spark, sf)), "symbol", **c("d", "stat", "p_value"))


def interval_coverage(spark, sf):
    return rounded(V.interval_coverage(predicted(spark, sf)), "symbol", **c("coverage", "width", "width_sd", "conditional", "gap"))


def stored(spark, sf):
    """Predictions made 20 bars before the end of each symbol."""
    early = bars(spark, sf).withColumn("later", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where("later > 20").drop("later")
    return R.store_predictions(M.forecast_multi_horizon(early))


AS_OF = "2001-08-05"


def store_predictions(spark, sf):
    return rounded(R.store_predictions(M.forecast_multi_horizon(bars(spark, sf))), "symbol", F.col("horizon").cast("long").alias("horizon"), F.unix_millis("expiry").alias("expiry_ms"), "status", **c("anchor_price"), digits=4)


def outcomes(spark, sf):
    return R.resolve_outcomes(stored(spark, sf), bars(spark, sf), F.lit(AS_OF).cast("timestamp"))


def resolve_outcomes(spark, sf):
    return rounded(outcomes(spark, sf), "symbol", F.col("horizon").cast("long").alias("horizon"), "status", F.unix_millis("actual_ts").alias("actual_ms"), *[F.coalesce(x, F.lit(False)).alias(x) for x in ("direction_correct", "in_interval")], **c("actual_price", "actual_return", "absolute_error"))


def prediction_stats(spark, sf):
    return stats(R.statistics(outcomes(spark, sf), "((symbol), (symbol, horizon))"))


def global_prediction_stats(spark, sf):
    return stats(R.statistics(outcomes(spark, sf), "((), (symbol), (horizon))"))


def stats(d):
    return rounded(d, "symbol", F.col("horizon").cast("long").alias("horizon"), "level", "total", "resolved", "expired", **c("direction_accuracy", "coverage", "mae", "rmse"))


def store_stats(spark, sf):
    return outcomes(spark, sf).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "RESOLVED").alias("resolved"), F.count_if(F.col("status") == "EXPIRED_NO_DATA").alias("expired"), F.countDistinct("symbol").alias("symbols"))


def scalar_functions(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    x = F.col("value") / 50 - 1
    return rounded(e, "event_id", F.unix_millis(S.add_trading_days(F.col("ts"), F.col("event_id") % 13)).alias("trading_ms"), S.staleness_days(F.lit("2024-02-15 00:00:00").cast("timestamp"), F.col("ts")).alias("stale"), S.pct_format(F.round(F.col("value") / 128, 0), 2).alias("pct"), cdf=S.normal_cdf(x), sf=S.chi2_sf_even(F.abs(x) * 5, 10))


QUERIES = {f.__name__: f for f in (
    forecast_factors, regime_probabilities, historical_extreme, forecast_multi_horizon, forecast_prices, liquidity_gate, spread_bps, generate_signal, signal_to_order, rank_universe, strongest_buy, best_blocked,
    validate_model, ljung_box, jarque_bera, psi, ks_two_sample, interval_coverage, store_predictions, resolve_outcomes, prediction_stats, global_prediction_stats, store_stats, scalar_functions,
)}


def forecast_ctes(source: str = "bars", tag: str = "") -> str:
    """The forecast of every horizon from a view of bars."""
    return f"""
fb as (select *, row_number() over (partition by symbol order by ts desc) - 1 as back, row_number() over (partition by symbol order by ts) - 1 as idx, ln(close / lag(close) over (partition by symbol order by ts)) as ret from {source}),
fp as (select symbol, count(*) as nb, max(case when back = 0 then close end) as last_price, max(ts) as last_ts, ln(max(case when back = 0 then close end) / max(case when back = 5 then close end)) / 5 as momentum5, ln(max(case when back = 0 then close end) / max(case when back = 20 then close end)) / 20 as momentum20, avg(case when back < 20 then close end) as mean20 from fb group by 1),
fn as (select symbol, ret, idx - 1 as k, count(*) over (partition by symbol) as n, avg(ret) over (partition by symbol) as m, var_samp(ret) over (partition by symbol) as s2 from fb where ret is not null),
fg as (select symbol, sqrt({GARCH}) as volatility from fn group by 1),
fv as (select symbol, sqrt(sum(case when k60 >= 1 then 0.06 * 0.94 ** back * (ret - m60) ** 2 end)) as ewma_vol from (select symbol, ret, back, count(ret) over (partition by symbol) - 1 - back as k60, avg(ret) over (partition by symbol) as m60 from fb where back < 60) group by 1),
fd as (select symbol, sum(case when back = 19 then 1 else 0.1 end * 0.9 ** back * ret) as drift from fb where back < 20 group by 1),
ff as (select fp.*, volatility, ewma_vol, drift, greatest(-3, least(3, (last_price - mean20) / (ewma_vol * sqrt(20)))) as z, -greatest(-3, least(3, (last_price - mean20) / (ewma_vol * sqrt(20)))) * ewma_vol * 0.3 as reversion, drift * 0.5 + momentum5 * 0.3 + momentum20 * 0.2 as trend
       from fp join fg using (symbol) join fv using (symbol) join fd using (symbol) where nb >= 50),
hs as (select symbol, n, unnest([8, 16, 32, 64, 128, 256, 512, 1024]) as scale from (select distinct symbol, n from fn)),
he as (select fn.*, scale, k // scale as seg from fn join hs using (symbol) where scale <= fn.n // 4 and fn.n // scale >= 2 and k // scale < fn.n // scale),
hc as (select *, sum(ret - m) over (partition by symbol, scale, seg order by k) as cum from he),
hg as (select symbol, scale, seg, greatest(max(cum), 0) - least(min(cum), 0) as rg, stddev_samp(ret) as sd from hc group by symbol, scale, seg),
hp as (select symbol, log2(scale) as x, log2(avg(rg / sd)) as y from hg where sd > 0 group by symbol, scale),
hh as (select symbol, case when count(*) >= 2 then least(1, greatest(0, regr_slope(y, x))) else 0.5 end as hurst from hp group by symbol),
hr as (select symbol, hurst, case when hurst > 0.55 then (hurst - 0.5) * 2 when hurst < 0.45 then 0 else abs(hurst - 0.5) * 2 end as p_trend, case when hurst > 0.55 then 0 when hurst < 0.45 then (0.5 - hurst) * 2 else abs(hurst - 0.5) * 2 end as p_reversion,
       case when hurst between 0.45 and 0.55 then 1 - abs(hurst - 0.5) * 4 when hurst > 0.55 then greatest(0, 1 - (hurst - 0.5) * 2) else greatest(0, 1 - (0.5 - hurst) * 2) end as p_random from hh),
fx as (select symbol, h as horizon, coalesce(max(abs(ln(b.close / a.close))), 0) as extreme from (select unnest([1, 3, 5, 10, 20])::bigint as h), fb a left join fb b using (symbol) where b.idx = a.idx + h group by 1, 2),
f0 as (select *, (p_trend * trend + p_reversion * reversion) * 0.4 as per_bar, volatility * sqrt(horizon) as fvol from ff join hr using (symbol) join fx using (symbol)),
f1 as (select *, last_price * exp(per_bar * horizon) as expected_price, exp(per_bar * horizon) - 1 as expected_return, last_price * exp(per_bar * horizon - 1.96 * fvol) as lower, last_price * exp(per_bar * horizon + 1.96 * fvol) as upper from f0),
f2 as (select *, abs(expected_return) > greatest(0.25, extreme * 3) as is_extreme, case when per_bar > volatility * 0.3 then 'UP' when per_bar < -volatility * 0.3 then 'DOWN' else 'UNCERTAIN' end as direction,
       {cdf('expected_return / fvol')} as p_positive, 1 - {cdf('(0.02 - expected_return) / fvol')} as p_gain, {cdf('(-0.03 - expected_return) / fvol')} as p_loss,
       greatest(0.1, least(0.95, 0.5 + least(0.3, abs(expected_return) / fvol * 0.15) + greatest(p_trend, p_reversion, p_random) * 0.15 + case when hurst > 0.55 or hurst < 0.45 then 0.1 else 0 end
         + case when abs(expected_return) / extreme < 0.5 then 0.1 when abs(expected_return) / extreme > 2 then -0.15 else 0 end)) as confidence from f1),
f3 as (select *, not is_extreme and confidence > 0.3 as actionable from f2)"""


def cdf(e: str) -> str:
    t = f"(1 / (1 + 0.3275911 * abs(({e}) / sqrt(2))))"
    return f"(0.5 * (1 + sign({e}) * (1 - (((((1.061405429 * {t} - 1.453152027) * {t}) + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-1 * (({e}) / sqrt(2)) ** 2))))"


FC = BARS + "," + forecast_ctes()
#: The unit-root test without lags: the regression of a return on the one before.
ADF = """
ax as (select symbol, k, ret as y, lag(ret) over (partition by symbol order by k) as x from n0),
ay as (select symbol, count(*) as m, regr_slope(y, x) as b, regr_intercept(y, x) as a, var_pop(x) * count(*) as sxx from ax where x is not null group by symbol),
az as (select symbol, ay.m, b, sxx, sum((ax.y - a - b * x) ** 2) as rss from ax join ay using (symbol) where x is not null group by symbol, ay.m, b, sxx),
adf as (select symbol, b / (sqrt(rss / (m - 2)) / sqrt(sxx)) as statistic, -2.86 + 0.3 / sqrt(m) as cv5, -3.43 + 0.5 / sqrt(m) as cv1, -2.57 + 0.2 / sqrt(m) as cv10 from az)"""
SIG = RP + "," + forecast_ctes() + "," + ADF_LAGS + """,
ad as (select symbol, statistic < cv5 as stationary from adf),
lq as (select symbol, volume as median_volume, volume >= 100000 as liquid from (select symbol, volume, row_number() over (partition by symbol order by volume) - 1 as nth, count(*) over (partition by symbol) as n from bars) where nth = n // 2),
g0 as (select f3.*, sharpe > 0.15 and sortino > 0.15 and calmar > 0.15 and allocation > 0.005 as authorized, liquid, case when hurst > 0.58 then 'STRONG_TREND' when hurst > 0.52 then 'WEAK_TREND' when hurst < 0.42 then 'STRONG_MEAN_REVERSION' when hurst < 0.48 then 'WEAK_MEAN_REVERSION' else 'RANDOM_WALK' end as regime,
       expected_return / f3.volatility as edge_score, stationary from f3 join a using (symbol) join lq using (symbol) join ad using (symbol) where horizon = 5),
g1 as (select *, least(1, abs(edge_score) / 0.5) * 0.2 + case when (p_trend > 0.4 and regime like '%TREND') or (p_reversion > 0.4 and regime like '%REVERSION') then 1 else 0.4 end * 0.18 + case when stationary then 0.8 else 0.4 end * 0.15 + authorized::int * 0.12 + (not is_extreme)::int * 0.1 + 0.5 * 0.1 + confidence * 0.05 as conviction,
       least(1, abs(edge_score) / 0.5 + case when direction = 'UNCERTAIN' then 0 when regime = 'STRONG_TREND' then 0.15 when regime = 'STRONG_MEAN_REVERSION' then 0.08 when regime = 'WEAK_TREND' then 0.05 when regime = 'WEAK_MEAN_REVERSION' then 0.03 else 0 end) as quality from g0),
g2 as (select *, case when is_extreme then 'NO_TRADE' when edge_score >= 0.02 and (hurst > 0.45 or p_trend > 0.4 or (p_trend > 0.3 and hurst > 0.4)) then 'BUY' when abs(edge_score) < 0.02 and edge_score >= 0.01 and (p_trend > 0.6 or p_reversion > 0.6) then 'BUY' else 'NO_TRADE' end as wish from g1),
g3 as (select *, case when authorized and liquid and conviction >= 0.3 and quality >= 0.02 and not is_extreme then wish else 'NO_TRADE' end as signal,
       array_to_string(list_filter([case when wish = 'NO_TRADE' then 'forecast edge below threshold or regime misaligned' end, case when is_extreme then 'projected move outside conservative historical range' end, case when not authorized then 'VaR/CVaR or Kelly risk gate failed' end,
         case when not liquid then 'median volume below minimum' end, case when conviction < 0.3 then 'conviction below minimum' end, case when quality < 0.02 then 'signal quality below minimum' end], lambda x: x is not null), '; ') as reasons,
       case when direction = 'DOWN' then 0 else least(0.1, least(0.15 / (volatility * sqrt(252)), abs(edge_score) * 0.25 * conviction, 0.02 / (volatility * sqrt(252)))) end as size from g2),
g as (select *, case when signal = 'BUY' then last_price end as entry, case when signal = 'BUY' then last_price - 1.5 * volatility * sqrt(5) * last_price end as stop, case when signal = 'BUY' then last_price + 2.5 * volatility * sqrt(5) * last_price end as target from g3)"""
RANK = SIG + ", {tested}, rk as (select g.symbol, signal, edge_score * coalesce(km.accuracy, 0.5) as score, rank() over (order by round(edge_score * coalesce(km.accuracy, 0.5), 9) desc) as rank from g left join km on g.symbol = km.symbol)"
TRACK = BASE + ", early as (select symbol, ts, open, high, low, close, volume from bars qualify row_number() over (partition by symbol order by ts desc) > 20)," + forecast_ctes("early") + """,
st as (select symbol, horizon, last_ts, last_price as anchor_price, expected_return, lower, upper, (select list_filter(range(1, 40), lambda d: isodow(last_ts + to_days(d::int)) <= 5)[horizon]) as days from f3),
sp as (select *, last_ts + to_days(days::int) as expiry from st),
oc as (select sp.*, b.ts as actual_ts, b.close as actual_price from sp asof left join (select * from bars where ts <= timestamp '2001-08-05') b on sp.symbol = b.symbol and sp.expiry <= b.ts),
o as (select *, actual_price / anchor_price - 1 as actual_return, case when actual_price is not null then 'RESOLVED' when expiry <= timestamp '2001-08-05' then 'EXPIRED_NO_DATA' else 'PENDING' end as status, sign(expected_return) = sign(actual_price / anchor_price - 1) as direction_correct,
      actual_price between lower and upper as in_interval, abs(actual_price / anchor_price - 1 - expected_return) as absolute_error from oc)"""
STORE = TRACK.replace("> 20)", "> 0)").split("\noc as")[0].rstrip(",")
STATS = "count(*) as total, count(*) filter (status = 'RESOLVED') as resolved, count(*) filter (status = 'EXPIRED_NO_DATA') as expired, " + sql_rounded({"direction_accuracy": "avg(direction_correct::int)", "coverage": "avg(in_interval::int)", "mae": "avg(absolute_error)", "rmse": "sqrt(avg(absolute_error ** 2))"})
LB = ", ".join(f"sum(d * lag{k}) as p{k}" for k in range(1, 11))

ORACLES = {
    "forecast_factors": f"with {FC} select symbol, {sql_rounded({x: x for x in ('volatility', 'ewma_vol', 'drift', 'momentum5', 'momentum20', 'z', 'reversion', 'trend')})} from ff",
    "regime_probabilities": f"with {FC} select symbol, {sql_rounded({x: x for x in ('hurst', 'p_trend', 'p_reversion', 'p_random')})} from hr",
    "historical_extreme": f"with {FC} select symbol, horizon, {sql_rounded({'extreme': 'extreme'})} from fx",
    "forecast_multi_horizon": f"with {FC} select symbol, horizon, direction, is_extreme, actionable, {sql_rounded({x: x for x in FORECAST})} from f3",
    "forecast_prices": f"with {FC} select symbol, direction, is_extreme, actionable, {sql_rounded({x: x for x in FORECAST})} from f3 where horizon = 5",
    "liquidity_gate": f"with {BARS} select symbol, volume as median_volume, volume >= 280000 as liquid from (select symbol, volume, row_number() over (partition by symbol order by volume) - 1 as nth, count(*) over (partition by symbol) as n from bars) where nth = n // 2",
    "spread_bps": f"select event_id, {sql_rounded({'spread_bps': chr(39).join(['case when event_id % 4 <> 0 then (json_extract_string(props, ', '$.k', ')::double / 1000) / value * 10000 end'])})} from events where value > 0",
    "generate_signal": f"with recursive {SIG} select symbol, signal, wish, reasons, {sql_rounded({x: x for x in ('conviction', 'quality', 'edge_score', 'size', 'entry', 'stop', 'target')}, 5)} from g",
    "signal_to_order": f"with recursive {SIG} select symbol, signal as side, floor(1e6 * size / entry)::bigint as quantity, {sql_rounded({'limit_price': 'entry', 'stop': 'stop', 'target': 'target'}, 4)} from g where signal <> 'NO_TRADE'",
    "validate_model": f"""with {PRED}, y as (select symbol, count(*) as n, avg(abs(e)) as mae, avg(e * e) as mse, avg(case when actual <> 0 then abs(e / actual) else 0 end) as mape, avg((sign(predicted) = sign(actual))::int) as direction_accuracy,
        count(*) filter (predicted > 0 and actual > 0) as tp, count(*) filter (predicted > 0 and actual <= 0) as fp, count(*) filter (predicted <= 0 and actual > 0) as fn, corr(predicted, actual) as corr, avg(e) as bias, avg((e > 0)::int) as over_rate, avg((e < 0)::int) as under_rate, corr(predicted, actual) ** 2 as r2, sqrt(avg(e * e)) / (sqrt(avg(predicted ** 2)) + sqrt(avg(actual ** 2))) as theil_u from u group by 1),
        w as (select *, sqrt(mse) as rmse, tp / (tp + fp) as precision, tp / (tp + fn) as recall, 2 * tp / (2 * tp + fp + fn) as f1 from y where n >= 10) select symbol, n, {sql_rounded({x: x for x in VALID})} from w""",
    "ljung_box": f"""with {PRED}, l0 as (select symbol, seq, res - avg(res) over (partition by symbol) as d, count(*) over (partition by symbol) as n from u), l1 as (select *, {', '.join(f'lag(d, {k}) over (partition by symbol order by seq) as lag{k}' for k in range(1, 11))} from l0),
        l2 as (select symbol, max(n) as n, sum(d * d) as dd, {LB} from l1 group by 1), l3 as (select symbol, n * (n + 2) * ({' + '.join(f'(p{k} / dd) ** 2 / (n - {k})' for k in range(1, 11))}) as stat from l2)
        select symbol, {sql_rounded({'stat': 'stat', 'p_value': 'exp(-stat / 2) * (1 + stat / 2 + (stat / 2) ** 2 / 2 + (stat / 2) ** 3 / 6 + (stat / 2) ** 4 / 24)'})} from l3""",
    "jarque_bera": f"""with {PRED}, y as (select symbol, count(*) as n, avg(res) as m, stddev_samp(res) as s from u group by 1), w as (select symbol, max(n) as n, avg(((res - m) / s) ** 3) as sk, avg(((res - m) / s) ** 4) - 3 as ku from u join y using (symbol) group by 1)
        select symbol, {sql_rounded({'stat': 'n / 6 * (sk ** 2 + ku ** 2 / 4)', 'p_value': 'exp(-(n / 6 * (sk ** 2 + ku ** 2 / 4)) / 2)'})} from w""",
    "psi": f"""with {PRED}, y as (select symbol, part, least(9, floor((res - min(res) over (partition by symbol)) / (max(res) over (partition by symbol) - min(res) over (partition by symbol)) * 10)) as bin from u), t as (select symbol, count(*) filter (part = 'ref') as rn, count(*) filter (part = 'cur') as cn from y group by 1),
        w as (select symbol, bin, greatest(count(*) filter (part = 'ref') / max(rn), 1e-4) as p, greatest(count(*) filter (part = 'cur') / max(cn), 1e-4) as q from y join t using (symbol) group by 1, 2) select symbol, {sql_rounded({'psi': 'sum((q - p) * ln(q / p))'})} from w group by 1""",
    "ks_two_sample": f"""with {PRED}, y as (select symbol, abs(sum((part = 'ref')::int) over (partition by symbol order by res) / sum((part = 'ref')::int) over (partition by symbol) - sum((part = 'cur')::int) over (partition by symbol order by res) / sum((part = 'cur')::int) over (partition by symbol)) as gap, part from u),
        w as (select symbol, max(gap) as d, count(*) filter (part = 'ref') as n, count(*) filter (part = 'cur') as m from y group by 1), z as (select symbol, d, d * sqrt(n * m / (n + m)) as stat from w) select symbol, {sql_rounded({'d': 'd', 'stat': 'stat', 'p_value': 'least(1, 2 * exp(-2 * stat ** 2))'})} from z""",
    "interval_coverage": f"""with {PRED}, y as (select symbol, seq, (actual between lower and upper)::int as hit, upper - lower as width from u), w as (select *, lag(hit) over (partition by symbol order by seq) as b from y)
        select symbol, {sql_rounded({'coverage': 'avg(hit)', 'width': 'avg(width)', 'width_sd': 'stddev_samp(width)', 'conditional': 'avg((hit = b)::int)', 'gap': 'avg(hit) - 0.95'})} from w group by 1""",
    "store_predictions": f"with {STORE} select symbol, horizon, epoch_us(expiry) // 1000 as expiry_ms, 'PENDING' as status, {sql_rounded({'anchor_price': 'anchor_price'}, 4)} from sp",
    "resolve_outcomes": f"with {TRACK} select symbol, horizon, status, epoch_us(actual_ts) // 1000 as actual_ms, coalesce(direction_correct, false) as direction_correct, coalesce(in_interval, false) as in_interval, {sql_rounded({x: x for x in ('actual_price', 'actual_return', 'absolute_error')})} from o",
    "prediction_stats": f"with {TRACK} select symbol, horizon, grouping(symbol, horizon) as level, {STATS} from o group by grouping sets ((symbol), (symbol, horizon))",
    "global_prediction_stats": f"with {TRACK} select symbol, horizon, grouping(symbol, horizon) as level, {STATS} from o group by grouping sets ((), (symbol), (horizon))",
    "store_stats": f"with {TRACK} select count(*) as total, count(*) filter (status = 'RESOLVED') as resolved, count(*) filter (status = 'EXPIRED_NO_DATA') as expired, count(distinct symbol) as symbols from o",
    "scalar_functions": f"""with e as (select event_id, ts, value, value / 50 - 1 as x, abs(value / 50 - 1) * 2.5 as y, event_id % 13 as nd from events) select event_id,
        epoch_us(ts + to_days(case when nd = 0 then 0 else list_filter(range(1, 30), lambda d: isodow(ts + to_days(d::int)) <= 5)[nd] end::int)) // 1000 as trading_ms, greatest(0, floor((epoch_us(timestamp '2024-02-15') - epoch_us(ts)) / 86400000000 + 0.5))::bigint as stale,
        format('{{:.2f}}%', round(value / 128, 0) * 100) as pct, {sql_rounded({'cdf': cdf('x'), 'sf': 'exp(-y) * (1 + y + y ** 2 / 2 + y ** 3 / 6 + y ** 4 / 24)'})} from e""",
}
