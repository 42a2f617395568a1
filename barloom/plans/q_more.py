"""Parts of larger operators as queries of their own, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import forecast as M
from ..operators import stats as T
from ..operators import tracking as R
from . import q_model as Q
from .q_market import NUM, REGIME, RSQ, c
from .testbed import MS, bars, ms, rounded, sql_rounded


def part(source, keys, names, digits=6):
    def run(spark, sf):
        return rounded(source(spark, sf), *keys, digits=digits, **c(*names))

    return run


def multi(spark, sf):
    return M.forecast_multi_horizon(bars(spark, sf)).withColumn("horizon", F.col("horizon").cast("long"))


def hurst_regime(spark, sf):
    return T.hurst_rs(bars(spark, sf)).select("symbol", "regime")


def pending_predictions(spark, sf):
    p = Q.stored(spark, sf)
    return p.where("status = 'PENDING'").select("symbol", F.col("horizon").cast("long").alias("horizon"), F.unix_millis("expiry").alias("expiry_ms")).orderBy("expiry_ms", "symbol", "horizon")


def list_predictions(spark, sf):
    return R.list_predictions(Q.stored(spark, sf), "PENDING", 3).select("symbol", F.col("horizon").cast("long").alias("horizon"), "status")


def manual_resolve(spark, sf):
    p = Q.stored(spark, sf)
    prices = p.where("horizon in (1, 5)").select("symbol", F.when(F.col("horizon") == 1, F.col("id")).otherwise("unknown").alias("id"), (F.col("anchor_price") * 1.01).alias("price"))
    done, rejected = R.manual_resolve(p, prices)
    return done.groupBy("symbol").agg(F.count("*").alias("resolved"), F.round(F.max("actual_return"), 6).alias("actual_return")).join(rejected.groupBy("symbol").agg(F.count("*").alias("rejected")), "symbol")


def garch_vol(spark, sf):
    return rounded(X.garch_vol(bars(spark, sf)), "symbol", ms(), digits=8, **c("garch_vol"))


def rolling_hurst_100(spark, sf):
    return rounded(X.rolling_hurst(bars(spark, sf)), "symbol", ms(), **c("rolling_hurst"))


def kalman_smooth(spark, sf):
    return rounded(T.kalman_track(bars(spark, sf)), "symbol", ms(), **c("smoothed"))


QUERIES = {f.__name__: f for f in (hurst_regime, pending_predictions, list_predictions, manual_resolve, garch_vol, rolling_hurst_100, kalman_smooth)} | {
    "return_probabilities": part(multi, ("symbol", "horizon"), ("p_positive", "p_gain", "p_loss")),
    "forecast_confidence": part(multi, ("symbol", "horizon"), ("confidence",)),
    "conviction_score": part(Q.signals, ("symbol",), ("conviction",)),
    "signal_quality": part(Q.signals, ("symbol",), ("quality",)),
    "entry_exit": part(Q.signals, ("symbol",), ("entry", "stop", "target"), 5),
}
ORACLES = {
    "hurst_regime": f"with {RSQ} select symbol, {REGIME} from rs",
    "pending_predictions": f"with {Q.TRACK} select symbol, horizon, epoch_us(expiry) // 1000 as expiry_ms from sp",
    "list_predictions": f"with {Q.TRACK} select symbol, horizon, 'PENDING' as status from sp where horizon in (1, 3, 5)",
    "manual_resolve": f"with {Q.TRACK} select symbol, 1::bigint as resolved, round(0.01::double, 6) as actual_return, 1::bigint as rejected from sp where horizon = 1",
    "garch_vol": f"""with {NUM}, h as (select a.symbol, a.ts, sqrt(greatest(1e-10, 0.85 ** (a.k + 1) * max(a.s2) + sum(0.85 ** (a.k - b.k) * (b.s2 * (1 - 0.1 - 0.85) + 0.1 * (b.ret - b.m) ** 2)))) as v from n0 a join n0 b on a.symbol = b.symbol and b.k <= a.k group by a.symbol, a.ts, a.k)
        select r.symbol, {MS.replace('(ts)', '(r.ts)')}, {sql_rounded({'garch_vol': 'h.v'}, 8)} from r left join h on r.symbol = h.symbol and r.ts = h.ts""",
    "return_probabilities": f"with {Q.FC} select symbol, horizon, {sql_rounded({x: x for x in ('p_positive', 'p_gain', 'p_loss')})} from f3",
    "forecast_confidence": f"with {Q.FC} select symbol, horizon, {sql_rounded({'confidence': 'confidence'})} from f3",
    "conviction_score": f"with recursive {Q.SIG} select symbol, {sql_rounded({'conviction': 'conviction'})} from g",
    "signal_quality": f"with recursive {Q.SIG} select symbol, {sql_rounded({'quality': 'quality'})} from g",
    "entry_exit": f"with recursive {Q.SIG} select symbol, {sql_rounded({x: x for x in ('entry', 'stop', 'target')}, 5)} from g",
}
