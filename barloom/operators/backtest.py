"""Walk-forward back-tests: forecasts from expanding training windows, simulated trades, and their metrics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def weights(keep: float, n: int) -> np.ndarray:
    return keep ** np.arange(n - 1, -1, -1.0)


def prefix_hurst(r: np.ndarray) -> float:
    """Rescaled-range exponent of one training window, by the forecast's rules."""
    n, points = len(r), []
    if n < 31:
        return 0.5
    d, scale = r - r.mean(), 8
    while scale <= n // 4:
        k = n // scale
        seg = d[: k * scale].reshape(k, scale)
        cum = np.cumsum(seg, 1)
        sd = r[: k * scale].reshape(k, scale).std(1, ddof=1)  # of the returns themselves: exactly 0 where prices stand still
        ok = sd > 0
        if k >= 2 and ok.any():
            spread = np.maximum(cum.max(1), 0) - np.minimum(cum.min(1), 0)
            points.append((math.log2(scale), math.log2((spread[ok] / sd[ok]).mean())))
        scale *= 2
    if len(points) < 2:
        return 0.5
    x, y = np.array(points).T
    return float(min(1.0, max(0.0, ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum())))


def prefix_forecast(close: np.ndarray, horizon: int) -> dict:
    """The forecast of ``forecast.forecast_prices`` from one array of closes."""
    r = np.diff(np.log(close))
    n, last = len(r), close[-1]
    s2 = r.var(ddof=1)
    h = max(1e-10, 0.85**n * s2 + (weights(0.85, n) * (s2 * (1 - 0.1 - 0.85) + 0.1 * (r - r.mean()) ** 2)).sum()) if n >= 10 else s2
    vol = math.sqrt(h)
    t = r[-60:]
    recent = math.sqrt((0.06 * weights(0.94, len(t))[1:] * (t[1:] - t.mean()) ** 2).sum())
    d = r[-20:]
    w = weights(0.9, len(d)) * 0.1
    w[0] *= 10
    drift = float((w * d).sum())
    m5, m20 = (math.log(last / close[-1 - k]) / k if n >= k else 0.0 for k in (5, 20))
    safe = recent if recent > 0 else 1e-6
    z = max(-3.0, min(3.0, (last - close[-20:].mean()) / (safe * math.sqrt(20))))
    hurst = prefix_hurst(r)
    trend = (hurst - 0.5) * 2 if hurst > 0.55 else 0.0 if hurst < 0.45 else abs(hurst - 0.5) * 2
    back = 0.0 if hurst > 0.55 else (0.5 - hurst) * 2 if hurst < 0.45 else abs(hurst - 0.5) * 2
    per_bar = 0.4 * (trend * (drift * 0.5 + m5 * 0.3 + m20 * 0.2) + back * -z * safe * 0.3)
    ret = math.exp(per_bar * horizon) - 1
    moves = np.abs(np.log(close[horizon:] / close[:-horizon])) if len(close) > horizon else np.zeros(1)
    return {"forecast_return": ret, "volatility": vol, "hurst": hurst, "is_extreme": bool(abs(ret) > max(0.25, 3 * moves.max(initial=0.0))), "edge_score": ret / vol if vol > 0 else 0.0}


#: Closes of a window from which on windows are taken together, and numbers of one step over several windows.
TOGETHER, STEP_CELLS = 61, 1 << 20


def prefix_hursts(r: np.ndarray, n: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """``prefix_hurst`` of the first ``n`` (ascending) returns each, whose means are ``mean``: a scale's segments are cut and added up once for all windows."""
    out, scales = np.full(len(n), 0.5), 2.0 ** np.arange(3, 64)
    cut = {}
    for at in range(0, len(n), size := int(max(1, min(32, STEP_CELLS // max(1, n.max(initial=1)))))):
        m, mu = n[at : at + size], mean[at : at + size]
        x, y = [], []
        for s in scales[scales <= m[-1] // 4].astype(int).tolist():
            if s not in cut:
                seg = r[: len(r) // s * s].reshape(-1, s)
                cut[s] = np.ascontiguousarray(np.cumsum(seg, 1).T), seg.std(1, ddof=1)
            k = m // s
            cum, sd = cut[s][0][:, : k[-1], None], cut[s][1][: k[-1], None]
            gone = cum - np.arange(1.0, s + 1)[:, None, None] * mu
            spread = np.maximum(gone.max(0), 0) - np.minimum(gone.min(0), 0)
            ok = (sd > 0) & (np.arange(k[-1])[:, None] < k) & (s <= m // 4)
            found = ok.sum(0)
            ratio = np.divide(spread, sd, out=np.zeros_like(spread), where=ok).sum(0) / np.maximum(found, 1)
            x.append(np.where(found > 0, math.log2(s), np.nan))
            y.append(np.log2(ratio, out=np.full(len(m), np.nan), where=found > 0))
        if not x:
            continue
        x, y = np.array(x), np.array(y)
        has = ~np.isnan(x)
        points = np.maximum(has.sum(0), 1)
        dx = np.where(has, x - np.where(has, x, 0).sum(0) / points, 0)
        dy = np.where(has, y - np.where(has, y, 0).sum(0) / points, 0)
        slope = (dx * dy).sum(0) / np.where(has.sum(0) > 1, (dx**2).sum(0), 1)
        out[at : at + size] = np.where((has.sum(0) > 1) & (m >= 31), np.clip(slope, 0, 1), 0.5)
    return out


def prefix_forecasts(close: np.ndarray, ends: np.ndarray, horizon: int) -> dict:
    """``prefix_forecast`` of the first ``ends`` (ascending) closes each, as arrays: sums over a prefix are running sums, so no window is read anew."""
    names = ("forecast_return", "volatility", "hurst", "is_extreme", "edge_score")
    ends = np.asarray(ends, np.int64)
    few = [prefix_forecast(close[:e], horizon) for e in ends[ends < TOGETHER].tolist()]
    ends = ends[ends >= TOGETHER]
    got = {k: np.array([f[k] for f in few], bool if k == "is_extreme" else float) for k in names}
    if not len(ends):
        return got
    r, n = np.diff(np.log(close)), ends - 1
    shift = r[: TOGETHER - 1].mean()  # sums of squares keep their digits about a mean
    d, back = r - shift, n - 1
    m = np.cumsum(d)[back] / n
    s2 = np.maximum(0, (np.cumsum(d * d)[back] - n * m * m) / (n - 1))
    kernel = 0.85 ** np.arange(min(len(d), 260.0))  # older weights are below the rounding of a double
    faded = lambda v: np.convolve(v, kernel)[back]
    all_ = (1 - 0.85**n) / (1 - 0.85)
    h = np.maximum(1e-10, 0.85**n * s2 + s2 * (1 - 0.1 - 0.85) * all_ + 0.1 * (faded(d * d) - 2 * m * faded(d) + m * m * all_))
    vol, last = np.sqrt(h), close[ends - 1]
    of = lambda v, length, at: np.lib.stride_tricks.sliding_window_view(v, length)[at - length]
    t = of(r, 60, n)
    recent = np.sqrt((0.06 * weights(0.94, 60)[1:] * (t[:, 1:] - t.mean(1, keepdims=True)) ** 2).sum(1))
    w = weights(0.9, 20) * 0.1
    w[0] *= 10
    drift = (of(r, 20, n) * w).sum(1)
    m5, m20 = (np.log(last / close[ends - 1 - k]) / k for k in (5, 20))
    safe = np.where(recent > 0, recent, 1e-6)
    z = np.clip((last - of(close, 20, ends).mean(1)) / (safe * math.sqrt(20)), -3.0, 3.0)
    hurst = prefix_hursts(r, n, m + shift)
    near = np.abs(hurst - 0.5) * 2
    trend = np.where(hurst > 0.55, (hurst - 0.5) * 2, np.where(hurst < 0.45, 0.0, near))
    turn = np.where(hurst > 0.55, 0.0, np.where(hurst < 0.45, (0.5 - hurst) * 2, near))
    ret = np.exp(0.4 * (trend * (drift * 0.5 + m5 * 0.3 + m20 * 0.2) + turn * -z * safe * 0.3) * horizon) - 1
    most = np.maximum.accumulate(np.append(0.0, np.abs(np.log(close[horizon:] / close[:-horizon]))))[np.maximum(0, ends - horizon)]
    made = {"forecast_return": ret, "volatility": vol, "hurst": hurst, "is_extreme": np.abs(ret) > np.maximum(0.25, 3 * most), "edge_score": np.divide(ret, vol, out=np.zeros_like(ret), where=vol > 0)}
    return {k: np.concatenate([got[k], made[k]]) for k in names}


def walk_forward(bars: DataFrame, forecast=prefix_forecast, horizon: int = 5, minimum: int = 50, step: int = 5, purge: int = 5) -> DataFrame:
    """One row per symbol and cutoff: trained on the bars before cutoff - purge, tested on the close ``horizon`` bars after the cutoff.

    ``forecast`` takes the training closes and the horizon and returns a dict with forecast_return, volatility, hurst,
    is_extreme and edge_score; it never sees a later bar. A symbol is one group, so its closes are sent once. Columns
    ``horizon`` and ``purge`` of ``bars``, if there, are a symbol's own.
    """
    given = {"horizon": horizon, "purge": purge}
    named = [c for c in given if c in bars.columns]
    schema = "symbol string, cutoff long, train_end timestamp, target_ts timestamp, actual_price double, actual_return double, forecast_return double, volatility double, hurst double, is_extreme boolean, edge_score double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        horizon, purge = (int(pdf[c].iloc[0]) if c in pdf else v for c, v in given.items())
        pdf = pdf.sort_values("ts", kind="stable")
        close, ts = pdf["close"].to_numpy(), pdf["ts"].to_numpy()
        cutoffs = np.arange(max(minimum, minimum + -(-purge // step) * step), len(close) - horizon, step)
        ends, at = cutoffs - purge, cutoffs + horizon
        if not len(cutoffs):
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        if forecast is prefix_forecast:
            made = prefix_forecasts(close, ends, horizon)
        else:
            made = pd.DataFrame([forecast(close[:e], horizon) for e in ends.tolist()])
        made = {c: made[c] for c in ("forecast_return", "volatility", "hurst", "is_extreme", "edge_score")}
        return pd.DataFrame({"symbol": pdf["symbol"].iloc[0], "cutoff": cutoffs, "train_end": ts[ends - 1], "target_ts": ts[at], "actual_price": close[at], "actual_return": close[at] / close[ends - 1] - 1, **made})

    return bars.select("symbol", "ts", "close", *named).groupBy("symbol").applyInPandas(run, schema)


def simulate_trades(rows: DataFrame, capital: float = 1e6, fraction: float = 0.05, cost_bps: float = 20.0, edge: float = 0.5, embargo: int = 2, short: bool = False) -> DataFrame:
    """Adds signal, trade_return and equity: each trade risks ``fraction`` of the equity before it, so equity is a running product."""
    w = Window.partitionBy("symbol").orderBy("cutoff")
    nth = F.row_number().over(w) - 1
    up = (F.col("forecast_return") > 0) & (F.col("edge_score") >= edge) & ~F.col("is_extreme")
    down = (F.col("forecast_return") < 0) & (F.col("edge_score") <= -edge) & ~F.col("is_extreme") & F.lit(short)
    d = rows.withColumn("signal", F.when(nth < embargo, "EMBARGO").when(up, "BUY").when(down, "SELL").otherwise("NO_TRADE"))
    side = F.when(F.col("signal") == "BUY", 1.0).when(F.col("signal") == "SELL", -1.0)
    d = d.withColumn("trade_return", F.coalesce(side * F.col("actual_return") - cost_bps / 1e4, F.lit(0.0)))
    growth = F.greatest(F.lit(1e-12), 1 + fraction * F.col("trade_return"))
    d = d.withColumn("equity", capital * F.exp(F.sum(F.log(growth)).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    return d.withColumn("net_pnl", F.col("equity") - F.lag("equity", 1, capital).over(w)).withColumn("cost", F.when(side.isNotNull(), F.lag("equity", 1, capital).over(w) * fraction * cost_bps / 1e4).otherwise(0.0))


def underwater(trades: DataFrame, capital: float = 1e6) -> DataFrame:
    """Adds drawdown from the peak so far and below, the rows since that peak, of the equity curve, which starts at ``capital``; all in the order that the curve itself is made in."""
    w = Window.partitionBy("symbol").orderBy("cutoff")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    d = trades.withColumn("peak", F.greatest(F.lit(capital), F.max("equity").over(so_far))).withColumn("nth", F.row_number().over(w).cast("long"))
    top = F.max(F.when(F.col("equity") >= F.col("peak"), F.col("nth"))).over(so_far)
    return d.withColumn("below", F.col("nth") - F.coalesce(top, F.lit(0))).withColumn("drawdown", (F.col("peak") - F.col("equity")) / F.col("peak")).drop("peak", "nth")


def equity_drawdown(trades: DataFrame, capital: float = 1e6) -> DataFrame:
    """(symbol, max_drawdown, longest run of rows below the peak) of the equity curve, which starts at ``capital``."""
    return underwater(trades, capital).groupBy("symbol").agg(F.max("drawdown").alias("max_drawdown"), F.max("below").alias("duration"))


def backtest_metrics(trades: DataFrame, capital: float = 1e6, horizon: int = 5) -> DataFrame:
    """One row per symbol: accuracy, errors, return, ratios, profit factor, verdict and its reasons."""
    c, year = F.col, math.sqrt(252 / horizon)
    traded, pnl = c("signal").isin("BUY", "SELL"), c("net_pnl")
    moved = (c("forecast_return") != 0) & (c("actual_return") != 0)
    gap, tr = F.abs(c("forecast_return") - c("actual_return")), F.when(traded, c("trade_return"))
    m = underwater(trades, capital).groupBy("symbol").agg(
        F.count("*").alias("observations"), F.count_if(traded).alias("trades"), F.coalesce(F.avg(F.when(moved, (F.signum("forecast_return") == F.signum("actual_return")).cast("double"))), F.lit(0.0)).alias("accuracy"),
        F.avg(gap).alias("mae"), F.avg(gap / F.greatest(F.abs("actual_return"), F.lit(1e-4))).alias("mape"), F.avg(c("is_extreme").cast("double")).alias("extreme_rate"), (F.max_by("equity", "cutoff") / capital - 1).alias("total_return"),
        F.avg(tr).alias("mean_trade"), F.coalesce(F.stddev_samp(tr), F.lit(0.0)).alias("sd_trade"), F.coalesce(F.stddev_samp(F.when(traded & (c("trade_return") < 0), c("trade_return"))), F.lit(0.0)).alias("sd_down"),
        F.count_if(traded & (pnl > 0)).alias("wins"), F.coalesce(F.sum(F.when(pnl > 0, pnl)), F.lit(0.0)).alias("gross_profit"), F.coalesce(-F.sum(F.when(pnl < 0, pnl)), F.lit(0.0)).alias("gross_loss"), F.sum("cost").alias("costs"),
        F.max("drawdown").alias("max_drawdown"), F.max("below").alias("duration"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    m = m.withColumn("annual", c("total_return") * year).withColumn("sharpe", F.coalesce(ratio(c("mean_trade"), c("sd_trade")) * year, F.lit(0.0))).withColumn("sortino", F.coalesce(ratio(c("mean_trade"), c("sd_down")) * math.sqrt(252), F.lit(0.0)))
    m = m.withColumn("calmar", ratio(c("annual"), c("max_drawdown"))).withColumn("win_rate", ratio(c("wins"), c("trades"))).withColumn("profit_factor", F.when(c("gross_loss") > 0, c("gross_profit") / c("gross_loss")).when(c("gross_profit") > 0, float("inf")).otherwise(0.0))
    a, dd, s, wr = c("annual"), c("max_drawdown"), c("sharpe"), c("win_rate")
    first = F.when((a > 0.08) & (dd < 0.12) & (s > 1.2) & (wr > 0.5), "STRONG_EDGE").when((a > 0.05) & (dd < 0.15) & (s > 1.0) & (wr > 0.45), "PROFITABLE").when((a > 0) & (s > 0.5) & (dd < 0.25), "MARGINALLY_PROFITABLE").when(a > -0.05, "BREAKEVEN").otherwise("NOT_PROFITABLE")
    m = m.withColumn("verdict", F.when((c("trades") < 10) & first.isin("STRONG_EDGE", "PROFITABLE"), "MARGINALLY_PROFITABLE").otherwise(first))
    why = [F.when(a <= 0, "no annualized return"), F.when(s <= 0.5, "Sharpe below 0.5"), F.when(dd >= 0.25, "drawdown exceeds 25%"), F.when((wr < 0.45) & (c("trades") > 5), "win rate below 45%"), F.when((c("profit_factor") < 1) & (c("trades") > 0), "profit factor below 1"), F.when(dd < 0.1, "drawdown contained below 10%"), F.when(c("trades") < 10, "insufficient sample of trades")]
    return m.withColumn("reasons", F.filter(F.array(*why), lambda x: x.isNotNull()))


def bootstrap_returns(trades: DataFrame, simulations: int = 1000, fraction: float = 0.05, seed: int = 1, minimum: int = 10) -> DataFrame:
    """Percentiles of the compounded return of resampled trades, per symbol with ``minimum`` trades. Draws are hashes, so they don't depend on the partitioning.

    A symbol's trades are one row of logarithms in order of the cutoffs; a simulation adds up the drawn ones in that row,
    so draws are never rows and only trades are shuffled.
    """
    of = F.sort_array(F.collect_list(F.struct("cutoff", F.log1p(fraction * F.col("trade_return")).alias("x"))))
    t = trades.where(F.col("signal").isin("BUY", "SELL")).groupBy("symbol").agg(F.count("*").alias("n"), of["x"].alias("x")).where(F.col("n") >= minimum)
    drawn = lambda sim: F.aggregate(F.expr("sequence(1, int(n))"), F.lit(0.0), lambda s, draw: s + F.get("x", F.pmod(F.xxhash64(F.lit(seed), "symbol", sim, draw), F.col("n")).cast("int")))
    t = t.withColumn("r", F.sort_array(F.transform(F.sequence(F.lit(1), F.lit(simulations)), lambda sim: F.exp(drawn(sim)) - 1)))
    pick = lambda i: F.element_at("r", i)
    gains = F.size(F.filter("r", lambda r: r > 0)) / simulations
    return t.select("symbol", *[pick(int(simulations * (q / 100)) + 1).alias(f"p{q}") for q in (5, 25, 50, 75, 95)], gains.alias("p_positive"), pick(1).alias("worst"), pick(-1).alias("best"))


KEY = "\x1f"  # between a symbol and the name of one of its runs


def runs_of(bars: DataFrame, **parts) -> DataFrame:
    """Bars of a run: the symbol with the run's ``parts`` behind it, so that every operator takes a run as a symbol of its own."""
    return bars.withColumn("symbol", F.concat_ws(KEY, "symbol", *[p.cast("string") for p in parts.values()]))


def of_runs(df: DataFrame, *names: str) -> DataFrame:
    """The parts of ``runs_of`` as columns again; a symbol may hold anything but the mark between them."""
    part = F.split("symbol", KEY)
    return df.withColumns({n: part[i + 1] for i, n in enumerate(names)}).withColumn("symbol", part[0])


def folds(bars: DataFrame, splits: int, test_splits: int, purge: int, minimum: int) -> DataFrame:
    """Bars by (fold, role): the test part is ``test_splits`` of ``splits`` equal blocks, training the prefix that ends ``purge`` bars before it.

    Folds with less than ``minimum`` training bars are left out. A bar goes to a few folds by its number, without a join.
    """
    w = Window.partitionBy("symbol")
    b = bars.withColumn("idx", F.row_number().over(w.orderBy("ts")) - 1).withColumn("size", F.floor(F.count("*").over(w) / splits)).withColumn("bars", F.count("*").over(w))
    roles = []
    for i in range(splits - test_splits + 1):
        start = F.col("size") * i
        end = F.col("size") * (i + test_splits) if i + test_splits < splits else F.col("bars")
        ok, idx = start - purge >= minimum, F.col("idx")
        roles += [F.when(ok & (idx < start - purge), F.struct(F.lit(i).alias("fold"), F.lit("train").alias("role"))), F.when(ok & (idx >= start) & (idx < end), F.struct(F.lit(i).alias("fold"), F.lit("test").alias("role")))]
    return b.withColumn("at", F.explode(F.filter(F.array(*roles), lambda x: x.isNotNull()))).select(*bars.columns, "at.fold", "at.role")


def purged_cv_backtest(bars: DataFrame, splits: int = 5, test_splits: int = 2, purge: int = 10, horizon: int = 5, step: int = 5, **trade) -> tuple[DataFrame, DataFrame]:
    """(a row per symbol and fold: Sharpe ratio, return, drawdown and verdict of its training and test part, and overfit, the difference of the ratios; a row per symbol: mean, deviation and consistency of the test ratios).

    The training part is tested without purge and embargo, the test part with those of ``walk_forward`` and
    ``simulate_trades``. Folds whose parts are too short for a cutoff are left out.
    """
    f = folds(bars, splits, test_splits, purge, 50)
    got = None
    for role, gaps in (("train", (0, 0)), ("test", (5, 2))):
        rows = walk_forward(runs_of(f.where(F.col("role") == role), fold=F.col("fold")), horizon=horizon, step=step, purge=gaps[0])
        m = of_runs(backtest_metrics(simulate_trades(rows, embargo=gaps[1], **trade), horizon=horizon), "fold")
        m = m.select("symbol", F.col("fold").cast("int").alias("fold"), *[F.col(c).alias(f"{role}_{c}") for c in ("sharpe", "total_return", "max_drawdown", "trades", "verdict")])
        got = m if got is None else got.join(m, ["symbol", "fold"])
    got = got.withColumn("overfit", F.col("train_sharpe") - F.col("test_sharpe"))
    sd = F.coalesce(F.stddev_samp("test_sharpe"), F.lit(0.0))
    summary = got.groupBy("symbol").agg(F.count("*").alias("folds"), F.avg("test_sharpe").alias("mean_sharpe"), sd.alias("sd_sharpe"), F.count_if(F.col("test_sharpe") > 0).alias("positive"))
    return got, summary.withColumn("consistency", F.when(F.col("sd_sharpe") > 0, F.col("mean_sharpe") / F.col("sd_sharpe")).otherwise(0.0))


def regimes(bars: DataFrame, window: int = 63, step: int = 21) -> DataFrame:
    """(symbol, idx, hurst, regime) at every ``step``-th bar: the forecast's Hurst exponent of the ``window`` bars before it."""
    w = Window.partitionBy("symbol").orderBy("ts")

    def label(pdfs):
        for pdf in pdfs:
            h = [prefix_hurst(np.diff(np.log(np.asarray(c)))) for c in pdf["closes"]]
            yield pdf[["symbol", "idx"]].assign(hurst=h)

    b = bars.select("symbol", (F.row_number().over(w) - 1).cast("long").alias("idx"), F.collect_list("close").over(w.rowsBetween(-window, -1)).alias("closes"))
    b = b.where((F.col("idx") >= window) & ((F.col("idx") - window) % step == 0)).mapInPandas(label, "symbol string, idx long, hurst double")
    return b.withColumn("regime", F.when(F.col("hurst") > 0.55, "TREND").when(F.col("hurst") < 0.45, "MEAN_REVERSION").otherwise("RANDOM"))


def regime_backtest(bars: DataFrame, window: int = 63, step: int = 21, horizon: int = 5, least: int = 3, **trade) -> DataFrame:
    """A row per symbol and regime with ``least`` labels: their number and the metrics of a back-test on the bars up to its last label and ``horizon`` more."""
    labels = regimes(bars, window, step).groupBy("symbol", "regime").agg(F.count("*").alias("observations"), F.max("idx").alias("last")).where(F.col("observations") >= least)
    w = Window.partitionBy("symbol").orderBy("ts")
    b = bars.withColumn("idx", F.row_number().over(w) - 1).join(labels.select("symbol", "regime", "last"), "symbol").where(F.col("idx") < F.col("last") + horizon)
    rows = walk_forward(runs_of(b.select(*bars.columns, "regime"), regime=F.col("regime")), horizon=horizon, step=step)
    m = of_runs(backtest_metrics(simulate_trades(rows, **trade), horizon=horizon), "regime")
    return labels.drop("last").join(m.drop("observations"), ["symbol", "regime"])
