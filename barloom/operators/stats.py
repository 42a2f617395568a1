"""Statistics of each symbol's series of log returns."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import normal_cdf
from .risk import numbered
from .series import BUCKET_DAYS, kept, speculative


def rescaled_range(bars: DataFrame, minimum_scale: int = 8, segments: int = 3, values: int = 2, least_sd: float = 1e-10) -> DataFrame:
    """(symbol, scale, log2 of it, log2 of the mean rescaled range): the points that the R/S regression goes through."""
    r = numbered(bars).where("n >= 31")
    top = F.floor(F.col("n") / 4)
    scales = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: (minimum_scale * F.pow(F.lit(2), i)).cast("long"))
    r = r.withColumn("scale", F.explode(F.filter(scales, lambda s: (s <= top) & (F.floor(F.col("n") / s) >= segments)))).withColumn("seg", F.floor(F.col("k") / F.col("scale"))).where(F.col("seg") < F.floor(F.col("n") / F.col("scale")))
    part = Window.partitionBy("symbol", "scale", "seg")
    r = r.withColumn("cum", F.sum(F.col("ret") - F.col("m")).over(part.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
    seg = r.groupBy("symbol", "scale", "seg").agg((F.greatest(F.max("cum"), F.lit(0.0)) - F.least(F.min("cum"), F.lit(0.0))).alias("range"), F.stddev_samp("ret").alias("sd"))
    rs = seg.where(F.col("sd") > least_sd).groupBy("symbol", "scale").agg(F.avg(F.col("range") / F.col("sd")).alias("rs"), F.count("*").alias("used")).where(F.col("used") >= values)
    return rs.select("symbol", "scale", F.log2("scale").alias("x"), F.log2("rs").alias("y"))


def hurst_regime(h: Column) -> Column:
    return F.when(h > 0.58, "STRONG_TREND").when(h > 0.52, "WEAK_TREND").when(h < 0.42, "STRONG_MEAN_REVERSION").when(h < 0.48, "WEAK_MEAN_REVERSION").otherwise("RANDOM_WALK")


def regression(points: DataFrame, symbols: DataFrame, need: int) -> DataFrame:
    fit = points.groupBy("symbol").agg(F.count("*").alias("points"), F.regr_slope("y", "x").alias("slope"), F.regr_r2("y", "x").alias("r2"))
    out = symbols.join(fit, "symbol", "left")
    enough = F.coalesce(F.col("points"), F.lit(0)) >= need
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    out = out.withColumn("hurst", F.when(enough, clip(F.col("slope"))).otherwise(0.5)).withColumn("confidence", F.when(enough, clip(F.coalesce("r2", F.lit(0.0)))).otherwise(0.0))
    return out.select("symbol", F.coalesce("points", F.lit(0)).alias("points"), "hurst", "confidence", F.when(enough, hurst_regime(F.col("hurst"))).otherwise("INSUFFICIENT_DATA").alias("regime"))


def hurst_rs(bars: DataFrame) -> DataFrame:
    """Hurst exponent by rescaled range, one row per symbol with 32 bars at least."""
    symbols = bars.groupBy("symbol").agg(F.count("*").alias("bars")).where("bars >= 32").select("symbol")
    return regression(rescaled_range(bars), symbols, 3)


def hurst_dfa(bars: DataFrame) -> DataFrame:
    """Hurst exponent by detrended fluctuation; by rescaled range where fewer than three scales can be used."""
    r = numbered(bars).where("n >= 31")
    r = r.withColumn("c", F.sum("ret").over(Window.partitionBy("symbol").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
    top = F.floor(F.col("n") / 4)
    scales = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: (8 * F.pow(F.lit(2), i)).cast("long"))
    r = r.withColumn("scale", F.explode(F.filter(scales, lambda s: (s <= top) & (F.floor(F.col("n") / s) >= 3)))).withColumn("seg", F.floor(F.col("k") / F.col("scale"))).where(F.col("seg") < F.floor(F.col("n") / F.col("scale")))
    # a shift of the whole profile by its mean changes no residual
    seg = r.groupBy("symbol", "scale", "seg").agg(((F.regr_syy("c", "k") - F.pow(F.regr_sxy("c", "k"), 2) / F.regr_sxx("c", "k")) / F.first("scale")).alias("f2"))
    points = seg.groupBy("symbol", "scale").agg(F.avg("f2").alias("f2"), F.count("*").alias("used")).where("used >= 2").select("symbol", "scale", F.log2("scale").alias("x"), (0.5 * F.log2("f2")).alias("y"))
    symbols = bars.groupBy("symbol").agg(F.count("*").alias("bars")).where("bars >= 32").select("symbol")
    dfa = regression(points, symbols, 3).withColumn("method", F.lit("DFA"))
    rs = hurst_rs(bars).select("symbol", *[F.col(c).alias(f"rs_{c}") for c in ("points", "hurst", "confidence", "regime")])
    out = dfa.join(rs, "symbol")
    use = F.col("points") >= 3
    return out.select("symbol", *[F.when(use, F.col(c)).otherwise(F.col(f"rs_{c}")).alias(c) for c in ("points", "hurst", "confidence", "regime")], F.when(use, "DFA").otherwise("RS").alias("method"))


def variance_ratio(bars: DataFrame, lags: tuple = (2, 4, 8, 16)) -> DataFrame:
    """Variance of sums over ``lag`` returns against that of single ones, with its normal test; an exact last chunk is left out."""
    r = numbered(bars).withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).withColumn("chunk", F.floor(F.col("k") / F.col("lag")))
    sums = r.where((F.col("chunk") + 1) * F.col("lag") < F.col("n")).groupBy("symbol", "lag", "chunk").agg(F.sum("ret").alias("total"), F.first("n").alias("n"), F.first("s2").alias("s2"))
    v = sums.groupBy("symbol", "lag").agg(F.coalesce(F.var_samp("total"), F.lit(0.0)).alias("v"), F.first("n").alias("n"), F.first("s2").alias("s2"))
    lag, n = F.col("lag"), F.col("n")
    v = v.withColumn("vr", F.when(F.col("s2") > 0, F.col("v") / (lag * F.col("s2"))).otherwise(1.0)).withColumn("stat", (F.col("vr") - 1) / F.sqrt(2 * (2 * lag - 1) * (lag - 1) / (3 * lag * n)))
    return v.withColumn("p_value", 2 * (1 - normal_cdf(F.abs("stat")))).select("symbol", "lag", "vr", "stat", "p_value")


def half_life(bars: DataFrame) -> DataFrame:
    """Half-life of the regression of a return on the one before; infinite unless its slope is positive."""
    r = numbered(bars).withColumn("before", F.lag("ret").over(Window.partitionBy("symbol").orderBy("k")))
    f = r.where("before is not null").groupBy("symbol").agg(F.regr_slope("ret", "before").alias("beta"), F.regr_intercept("ret", "before").alias("alpha"))
    return f.select("symbol", "alpha", "beta", F.when(F.col("beta") > 0, math.log(2) / F.col("beta")).otherwise(float("inf")).alias("half_life"), (F.col("alpha") / (1 - F.col("beta"))).alias("long_run_mean"))


def kalman_step(state, close: float, volume: float, r: float = 1e-2, low: float = 1e-8, high: float = 1e-3):
    """(state, innovation) after one more bar; the noise adapts to recent innovations.

    ``state``: (bars so far, estimate, covariance, noise, covariance ahead of the last bar, last 10 innovations), or None at first.
    """
    n, estimate, p, q, before, recent = state or (0, close, 1.0, 1e-5, 0.0, [])
    ahead = p + q * max(1.0, volume or 1.0)
    gain = ahead / (ahead + r)
    innovation = close - estimate
    p = (1 - gain) * ahead
    if n > 10 and before > 0:
        mean = sum(recent) / len(recent)  # ten numbers: an array costs more than the loop
        q = max(low, min(high, q * (sum((x - mean) ** 2 for x in recent) / (len(recent) - 1)) / (before / 10)))
    return (n + 1, estimate + gain * innovation, p, q, ahead, [*recent, innovation][-10:]), innovation


def kalman_chunk_step(state, close, volume):
    """``kalman_step`` with its state as a list of numbers; the count of bars matters up to 11 only."""
    now = (int(state[0]), *state[1:5], state[5:]) if state else None
    (n, estimate, p, q, ahead, recent), innovation = kalman_step(now, close, volume)
    return [float(min(n, 11)), estimate, p, q, ahead, *recent], (estimate, innovation, p, q)


def smoothed_back(filtered, cov, noise, after: float | None) -> tuple[list[float], float, float]:
    """(smoothed values of a chunk, a, b): each is g times the next one plus 1 - g times the filtered one, g = cov / (cov + noise).

    ``after``: the first smoothed value of the chunk after; None at the end of the series, where the last filtered one
    stands as it is. The chunk's first value is a * after + b.
    """
    out, a, b = [], 1.0, 0.0
    value = after
    for i in range(len(filtered) - 1, -1, -1):
        g = cov[i] / (cov[i] + noise[i])
        value = filtered[i] if value is None else filtered[i] + g * (value - filtered[i])
        a, b = g * a, g * b + (1 - g) * filtered[i]
        out.append(value)
    return out[::-1], a, b


def kalman_track(bars: DataFrame, bucket_days: float = BUCKET_DAYS) -> DataFrame:
    """(symbol, ts, close, filtered, innovation, covariance, noise, smoothed).

    The filter adapts to its own innovations, so chunks of a series run speculatively (see ``series``). Smoothing is an
    affine recursion from the end: each chunk is smoothed as if it were the last and is one map, maps are composed over a
    row for each chunk, and a chunk with another after it is smoothed again from that one's first smoothed value.
    """

    def finish(filtered, innovation, covariance, noise):
        out, a, b = smoothed_back(filtered, covariance, noise, None)
        return [out], [a, b, filtered[-1]]

    names = ["close", "filtered", "innovation", "covariance", "noise", "smoothed"]
    rows = speculative(bars, kalman_chunk_step, "filtered double, innovation double, covariance double, noise double", 64, bucket_days, finish, "smoothed double")
    s = Window.partitionBy("symbol").orderBy(F.desc("bucket"))
    m = F.col("more")
    each = rows.where("more is not null").select("symbol", "bucket", m[0].alias("a"), m[1].alias("b"), m[2].alias("last")).withColumn("n", F.row_number().over(s))
    # the last chunk's first value comes from its own last filtered one
    each = kept(each.withColumn("b", F.when(F.col("n") == 1, F.col("a") * F.col("last") + F.col("b")).otherwise(F.col("b"))))
    longest, r = each.agg(F.max("n")).first()[0] or 1, 1
    if longest == 1:
        return rows.select("symbol", "ts", *names)
    while r < longest:
        a0, b0 = F.lag("a", r).over(s), F.lag("b", r).over(s)
        each = each.select("symbol", "bucket", (F.col("a") * F.coalesce(a0, F.lit(1.0))).alias("a"), (F.col("a") * F.coalesce(b0, F.lit(0.0)) + F.col("b")).alias("b"))
        r *= 2
    after = kept(each.select("symbol", "bucket", F.lag("b").over(s).alias("after")).where("after is not null"))

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        out = smoothed_back(pdf["filtered"].tolist(), pdf["covariance"].tolist(), pdf["noise"].tolist(), float(pdf["after"].iloc[0]))[0]
        return pdf[["symbol", "ts", *names[:-1]]].assign(smoothed=out)

    inner = rows.select("symbol", "bucket", "ts", *names).join(after, ["symbol", "bucket"]).groupBy("symbol", "bucket").applyInPandas(smooth, "symbol string, ts timestamp, " + ", ".join(f"{n} double" for n in names))
    last = rows.join(after.select("symbol", "bucket"), ["symbol", "bucket"], "left_anti").select("symbol", "ts", *names)
    return last.unionByName(inner)
