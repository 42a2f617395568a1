"""Forecasts per symbol from all of its bars: regime, factors, price, interval, probabilities and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import add_trading_days, normal_cdf, staleness_days
from . import stats
from .models import fit_ar, forecast_ar
from .risk import ewma_mean_sum, ewma_variance_sum, garch_sum

HORIZONS = (1, 3, 5, 10, 20)


def forecast_regime(bars: DataFrame) -> DataFrame:
    """(symbol, hurst, and the probabilities of trend, mean reversion and random walk) with the forecast's own Hurst rules."""
    points = stats.rescaled_range(bars, segments=2, values=1, least_sd=0.0)
    h = stats.regression(points, bars.select("symbol").distinct(), 2).select("symbol", "hurst")
    x = F.col("hurst")
    trend = F.when(x > 0.55, (x - 0.5) * 2).when(x < 0.45, 0.0).otherwise(F.abs(x - 0.5) * 2)
    back = F.when(x > 0.55, 0.0).when(x < 0.45, (0.5 - x) * 2).otherwise(F.abs(x - 0.5) * 2)
    h = h.withColumn("p_trend", trend).withColumn("p_reversion", back)
    return h.withColumn("p_random", F.greatest(F.lit(0.0), 1 - F.when((x <= 0.55) & (x >= 0.45), F.abs(x - 0.5) * 4).otherwise(F.col("p_trend") + F.col("p_reversion"))))


def factors(bars: DataFrame, minimum: int = 50, horizons: tuple = ()) -> DataFrame:
    """Per symbol with ``minimum`` bars: last price, conditional and recent volatility, drift, momentum and reversion.

    One ordered pass over the bars and one aggregate; with ``horizons`` also extreme_<h>, see ``historical_extreme``.
    """
    c, all_, w = F.col, Window.partitionBy("symbol"), Window.partitionBy("symbol").orderBy("ts")
    lag = lambda h: F.log(c("close") / F.lag("close", h).over(w))
    b = bars.select("symbol", "ts", "close", (F.row_number().over(w) - 1).alias("idx"), lag(1).alias("ret"), *[F.abs(lag(h)).alias(f"move_{h}") for h in horizons])
    # k counts the returns, which begin at the second bar; back counts bars from the last one
    b = b.withColumn("bars", F.count("*").over(all_)).withColumn("back", c("bars") - 1 - c("idx")).withColumn("k", c("idx") - 1).withColumn("n", c("bars") - 1)
    recent = F.when(c("back") < 60, c("ret"))
    b = b.withColumn("m", F.avg("ret").over(all_)).withColumn("s2", F.coalesce(F.var_samp("ret").over(all_), F.lit(0.0))).withColumn("m60", F.avg(recent).over(all_))
    at = lambda k: F.max(F.when(c("back") == k, c("close")))
    of = lambda n: {"n": F.least(c("n"), F.lit(n)), "k": F.least(c("n"), F.lit(n)) - 1 - c("back")}
    f = b.groupBy("symbol").agg(
        F.max("bars").alias("bars"), at(0).alias("last_price"), F.max("ts").alias("last_ts"), at(5).alias("c5"), at(20).alias("c20"), F.avg(F.when(c("back") < 20, c("close"))).alias("mean20"),
        F.sqrt(garch_sum()).alias("volatility"), F.sqrt(ewma_variance_sum(value=F.when(c("back") < 60, c("ret") - c("m60")), **of(60))).alias("ewma_vol"),
        ewma_mean_sum(0.9, value=F.when(c("back") < 20, c("ret")), **of(20)).alias("drift"), *[F.coalesce(F.max(f"move_{h}"), F.lit(0.0)).alias(f"extreme_{h}") for h in horizons],
    ).where(c("bars") >= minimum)
    f = f.withColumn("momentum5", F.coalesce(F.log(F.col("last_price") / F.col("c5")) / 5, F.lit(0.0))).withColumn("momentum20", F.coalesce(F.log(F.col("last_price") / F.col("c20")) / 20, F.lit(0.0)))
    safe = F.when(F.col("ewma_vol") > 0, F.col("ewma_vol")).otherwise(1e-6)
    f = f.withColumn("z", F.greatest(F.lit(-3.0), F.least(F.lit(3.0), (F.col("last_price") - F.col("mean20")) / (safe * 20**0.5))))
    return f.withColumn("reversion", -F.col("z") * safe * 0.3).withColumn("trend", F.col("drift") * 0.5 + F.col("momentum5") * 0.3 + F.col("momentum20") * 0.2)


def historical_extreme(bars: DataFrame, horizons: tuple = HORIZONS) -> DataFrame:
    """(symbol, horizon, extreme): the largest absolute log return over ``horizon`` bars, 0 without any."""
    w = Window.partitionBy("symbol").orderBy("ts")
    moves = bars.select("symbol", *[F.abs(F.log(F.col("close") / F.lag("close", h).over(w))).alias(f"h{h}") for h in horizons])
    return moves.select("symbol", F.inline(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"h{h}").alias("move")) for h in horizons]))).groupBy("symbol", "horizon").agg(F.coalesce(F.max("move"), F.lit(0.0)).alias("extreme"))


def return_probabilities(mu: Column, sigma: Column, gain: float = 0.02, loss: float = 0.03) -> dict[str, Column]:
    ok = sigma > 0
    return {
        "p_positive": F.when(ok, normal_cdf(mu / sigma)).otherwise(0.5),
        "p_gain": F.when(ok, 1 - normal_cdf((gain - mu) / sigma)).otherwise(0.0),
        "p_loss": F.when(ok, normal_cdf((-loss - mu) / sigma)).otherwise(0.0),
    }


def confidence(mu: Column, sigma: Column, extreme: Column, p_max: Column, hurst: Column) -> Column:
    c = 0.5 + F.when(sigma > 0, F.least(F.lit(0.3), F.abs(mu) / sigma * 0.15)).otherwise(0.0) + p_max * 0.15 + F.when((hurst > 0.55) | (hurst < 0.45), 0.1).otherwise(0.0)
    ratio = F.abs(mu) / extreme
    c = c + F.when(extreme > 0, F.when(ratio < 0.5, 0.1).when(ratio > 2, -0.15).otherwise(0.0)).otherwise(0.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(0.95), c))


def forecast_multi_horizon(
    bars: DataFrame, horizons: tuple = HORIZONS, gain: float = 0.02, loss: float = 0.03, shrink: float = 0.4, minimum: int = 50, use_ar: bool = False, anchors: DataFrame | None = None, as_of: Column | None = None
) -> DataFrame:
    """One row per symbol and horizon.

    A random walk adds no drift unless ``use_ar`` gives it the autoregressive forecast. ``anchors`` (symbol,
    anchor_price, anchor_ts) are live quotes: prices above 0 take the last close's place. ``as_of`` is the time of the
    forecast, that of the last bar if not given: staleness is the days since the last bar, expected_ts the trading day
    ``horizon`` after the latest of bar, quote and ``as_of``.
    """
    f = factors(bars, minimum, horizons).join(forecast_regime(bars), "symbol")
    ahead = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"extreme_{h}").alias("extreme")) for h in horizons])
    f = f.select("*", F.inline(ahead)).drop(*[f"extreme_{h}" for h in horizons])
    c = F.col
    if anchors is None:
        f = f.withColumns({"anchored": F.lit(False), "anchor_ts": c("last_ts")})
    else:
        f = f.join(anchors.select("symbol", "anchor_price", "anchor_ts"), "symbol", "left").withColumn("anchored", F.coalesce(c("anchor_price") > 0, F.lit(False)))
        f = f.withColumn("last_price", F.when(c("anchored"), c("anchor_price")).otherwise(c("last_price")))
    now = c("last_ts") if as_of is None else as_of
    f = f.withColumn("staleness_days", staleness_days(now, c("last_ts"))).withColumn("expected_ts", add_trading_days(F.greatest(c("last_ts"), c("anchor_ts"), now), c("horizon")))
    walk = F.lit(0.0)
    if use_ar:
        f, walk = f.join(forecast_ar(fit_ar(bars), horizons), ["symbol", "horizon"]), c("p_random") * c("ar_forecast")
    per_bar = (c("p_trend") * c("trend") + c("p_reversion") * c("reversion") + walk) * shrink
    f = f.withColumn("per_bar", per_bar).withColumn("expected_price", c("last_price") * F.exp(c("per_bar") * c("horizon"))).withColumn("expected_return", c("expected_price") / c("last_price") - 1)
    f = f.withColumn("forecast_vol", c("volatility") * F.sqrt("horizon"))
    f = f.withColumn("lower", c("last_price") * F.exp(c("per_bar") * c("horizon") - 1.96 * c("forecast_vol"))).withColumn("upper", c("last_price") * F.exp(c("per_bar") * c("horizon") + 1.96 * c("forecast_vol")))
    f = f.withColumn("is_extreme", F.abs("expected_return") > F.greatest(F.lit(0.25), c("extreme") * 3))
    f = f.withColumn("direction", F.when(c("per_bar") > c("volatility") * 0.3, "UP").when(c("per_bar") < -c("volatility") * 0.3, "DOWN").otherwise("UNCERTAIN"))
    f = f.withColumns(return_probabilities(c("expected_return"), c("forecast_vol"), gain, loss))
    f = f.withColumn("confidence", confidence(c("expected_return"), c("forecast_vol"), c("extreme"), F.greatest("p_trend", "p_reversion", "p_random"), c("hurst")))
    return f.withColumn("actionable", ~c("is_extreme") & (c("confidence") > 0.3))


def forecast_prices(bars: DataFrame, horizon: int = 5, **options) -> DataFrame:
    return forecast_multi_horizon(bars, (horizon,), **options)
