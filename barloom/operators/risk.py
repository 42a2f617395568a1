"""Risk of return series, portfolios and positions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .features import log_returns
from .series import kept

YEAR = math.sqrt(252)
#: The stress scenarios (name, shift of the mean, multiple of the volatility).
SCENARIOS = [("2008_crisis", -0.02, 3.0), ("covid_crash", -0.03, 4.0), ("flash_crash", -0.05, 5.0), ("normal", 0.0, 1.0)]


def numbered(bars: DataFrame) -> DataFrame:
    """Returns per symbol with k (from 0 by time), n and mean m of the series."""
    r = log_returns(bars).where("ret is not null")
    w = Window.partitionBy("symbol")
    return r.withColumn("k", F.row_number().over(w.orderBy("ts")) - 1).withColumn("n", F.count("*").over(w)).withColumn("m", F.avg("ret").over(w)).withColumn("s2", F.coalesce(F.var_samp("ret").over(w), F.lit(0.0)))


def garch_sum(alpha: float = 0.1, beta: float = 0.85) -> Column:
    """Closed form of the last conditional variance of a GARCH(1,1) that starts at the sample variance: an aggregate over ``numbered`` rows."""
    omega = F.col("s2") * (1 - alpha - beta)
    terms = F.sum(F.pow(F.lit(beta), F.col("n") - 1 - F.col("k")) * (omega + alpha * F.pow(F.col("ret") - F.col("m"), 2)))
    s2, n = F.max("s2"), F.max("n")
    return F.when(n < 10, s2).otherwise(F.greatest(F.pow(F.lit(beta), n) * s2 + terms, F.lit(1e-10)))


def ewma_variance_sum(keep: float = 0.94, value: Column | None = None, n: Column | None = None, k: Column | None = None) -> Column:
    """Recursive variance from 0, without the first return: an aggregate over ``numbered`` rows, or over deviations with other numbers (null: left out)."""
    n, k, value = F.col("n") if n is None else n, F.col("k") if k is None else k, F.col("ret") - F.col("m") if value is None else value
    return F.coalesce(F.sum(F.when(k >= 1, (1 - keep) * F.pow(F.lit(keep), n - 1 - k) * F.pow(value, 2))), F.lit(0.0))


def ewma_mean_sum(keep: float = 0.94, value: Column | None = None, n: Column | None = None, k: Column | None = None) -> Column:
    n, k, value = F.col("n") if n is None else n, F.col("k") if k is None else k, F.col("ret") if value is None else value
    return F.sum(F.when(k == 0, 1.0).otherwise(1 - keep) * F.pow(F.lit(keep), n - 1 - k) * value)


def drawdown(r: DataFrame) -> DataFrame:
    """Adds the running drawdown of the cumulative log return, from a peak of 0 at least."""
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("cum", F.sum("ret").over(w))
    return r.withColumn("dd", F.greatest(F.max("cum").over(w), F.lit(0.0)) - F.col("cum"))


def risk_profile(bars: DataFrame, confidence: float = 0.99, horizon: int = 1, capital: float = 1e6, reward: float = 2.5, max_position: float = 0.1, max_drawdown: float = 0.15, minimum: int = 30) -> DataFrame:
    """One row per symbol with ``minimum`` returns at least: tail risk, volatilities, Kelly shares, allocation, ratios, and whether a position is authorised."""
    r = drawdown(numbered(bars)).where(F.col("n") >= minimum)
    w = Window.partitionBy("symbol").orderBy("ret")
    r = r.withColumn("nth", F.row_number().over(w) - 1).withColumn("at", F.greatest(F.lit(0), F.floor((F.lit(1.0) - confidence) * F.col("n"))))
    below = F.col("ret") < F.col("m")
    a = r.groupBy("symbol").agg(
        F.max("n").alias("n"), F.max("m").alias("mean"), F.max(F.when(F.col("nth") == F.col("at"), F.col("ret"))).alias("var_ret"), F.avg(F.when(F.col("nth") <= F.col("at"), F.col("ret"))).alias("es"),
        garch_sum().alias("garch"), ewma_variance_sum().alias("ewma"), F.avg((F.col("ret") > 0).cast("double")).alias("win"),
        F.coalesce(F.avg(F.when(F.col("ret") > 0, F.col("ret"))), F.lit(0.0)).alias("avg_win"), F.abs(F.coalesce(F.avg(F.when(F.col("ret") < 0, F.col("ret"))), F.lit(0.0))).alias("avg_loss"),
        F.count_if(below).alias("n_down"), F.sum(F.when(below, F.pow(F.col("ret") - F.col("m"), 2))).alias("ss_down"), F.max("dd").alias("drawdown"),
    )
    c = F.col
    a = a.withColumn("cond_vol", F.sqrt("garch")).withColumn("ewma_vol", F.sqrt("ewma")).withColumn("vol", F.greatest("cond_vol", "ewma_vol"))
    a = a.withColumn("downside", F.when(c("n_down") > 1, F.sqrt(c("ss_down") / (c("n_down") - 1))).otherwise(0.0))
    a = a.withColumn("payoff", F.when(c("avg_loss") > 0, c("avg_win") / c("avg_loss")).otherwise(reward)).withColumn("kelly", (c("win") * c("payoff") - (1 - c("win"))) / c("payoff"))
    a = a.withColumn("var99", F.abs("var_ret") * math.sqrt(horizon)).withColumn("cvar99", F.abs("es") * math.sqrt(horizon)).withColumn("garch_var99", F.sqrt(c("garch") * horizon) * 2.33)
    scaled = F.when(c("vol") > 0, 0.15 / (c("vol") * YEAR)).otherwise(0.0)
    wanted = F.least(F.lit(max_position), F.greatest(F.lit(0.0), F.least(c("kelly") / 2, scaled)))
    limit = F.when(c("cvar99") > 0, max_drawdown / c("cvar99")).otherwise(max_position)
    a = a.withColumn("allocation", F.least(wanted, limit))
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    a = a.withColumn("sharpe", ratio(c("mean"), c("vol")) * YEAR).withColumn("sortino", ratio(c("mean"), c("downside")) * YEAR).withColumn("calmar", ratio(c("mean") * 252, c("drawdown")))
    return a.withColumn("authorized", (c("sharpe") > 0.15) & (c("sortino") > 0.15) & (c("calmar") > 0.15) & (c("allocation") > 0.005)).withColumn("capital_at_risk", capital * c("allocation"))


def stress_test(bars: DataFrame, scenarios: list = SCENARIOS) -> DataFrame:
    """Each symbol under each of the scenarios (name, shift of the mean, multiple of the volatility)."""
    base = log_returns(bars).where("ret is not null").groupBy("symbol").agg(F.avg("ret").alias("mean"), F.coalesce(F.stddev_samp("ret"), F.lit(0.0)).alias("vol"))
    x = base.select("*", F.inline(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(float(m)).alias("mean_shift"), F.lit(float(v)).alias("vol_multiple")) for n, m, v in scenarios])))
    x = x.withColumn("expected_return", F.col("mean") + F.col("mean_shift")).withColumn("volatility", F.col("vol") * F.col("vol_multiple"))
    x = x.withColumn("var99", F.abs(F.col("expected_return") - 2.33 * F.col("volatility"))).withColumn("cvar99", F.abs(F.col("expected_return") - 3.0 * F.col("volatility")))
    return x.withColumn("max_drawdown", 5 * F.col("cvar99")).select("symbol", "scenario", "expected_return", "volatility", "var99", "cvar99", "max_drawdown")


def position_sizing(df: DataFrame, capital: float = 1e6, max_risk: float = 0.02, kelly: float = 0.25, min_size: float = 0.0, max_size: float = 0.1, allow_short: bool = False) -> DataFrame:
    """Adds size, notional and risk_amount to rows of (direction, edge_score, volatility, conviction); no size without volatility."""
    vol = F.col("volatility") * YEAR
    size = F.greatest(F.lit(min_size), F.least(F.lit(max_size), F.least(0.15 / vol, F.abs("edge_score") * kelly * F.col("conviction"), max_risk / vol)))
    size = F.when(F.coalesce(F.col("volatility") <= 0, F.lit(True)), 0.0).when((F.col("direction") == "DOWN") & F.lit(not allow_short), 0.0).otherwise(size)
    return df.withColumn("size", size).withColumn("notional", capital * F.col("size")).withColumn("risk_amount", F.coalesce(F.col("notional") * F.col("volatility") / YEAR * 2.33, F.lit(0.0)))


def portfolio_risk(returns: DataFrame, weights: DataFrame, confidence: float = 0.99) -> DataFrame:
    """One row per asset of a portfolio with its marginal and component risk, and the portfolio's volatility, VaR, CVaR and diversification ratio.

    ``returns``: (symbol, ts, ret); at a time of others that an asset lacks its return is 0 (it has no new price);
    ``weights``: (symbol, w). An asset's row of the covariance matrix times the weights is its covariance with the
    portfolio's return, so the pairs are never formed and the work grows with the rows of ``returns``.
    """
    held = kept(returns.join(weights, "symbol").where(F.col("ret").isNotNull()))  # read three times
    port = kept(held.groupBy("ts").agg(F.sum(F.col("ret") * F.col("w")).alias("pr")))
    # the lowest returns come from each task's lowest; sums from each task's sums
    whole = port.agg(F.count("*").alias("periods"), F.avg("pr").alias("mean"), F.sqrt(F.var_samp("pr")).alias("portfolio_vol"))
    worst = int((1.0 - confidence) * port.count()) + 1
    low = port.orderBy("pr").limit(worst).agg(F.abs(F.max("pr")).alias("portfolio_var"), F.abs(F.avg("pr")).alias("portfolio_cvar"))
    one = lambda d: F.broadcast(d.withColumn("one", F.lit(1)))  # noqa: E731  aggregates without keys: a row each
    tail = one(whole).join(one(low), "one")
    off = port.withColumn("one", F.lit(1)).join(one(whole), "one").select("ts", (F.col("pr") - F.col("mean")).alias("off"), "periods")
    t = F.first("periods")
    rows = held.join(off, "ts").groupBy("symbol", "w").agg(
        (F.sum(F.col("ret") * F.col("off")) / (t - 1)).alias("cw"), (F.greatest(F.lit(0.0), F.sum(F.col("ret") * F.col("ret")) - F.sum("ret") * F.sum("ret") / t) / (t - 1)).alias("own")
    )
    spread = rows.agg(F.sum(F.abs("w") * F.sqrt("own")).alias("apart"))
    out = rows.withColumn("one", F.lit(1)).join(F.broadcast(tail), "one").join(one(spread), "one").withColumn("marginal", F.col("cw") / F.col("portfolio_vol")).withColumn("diversification", F.col("apart") / F.col("portfolio_vol"))
    return out.select("symbol", "w", "marginal", (F.col("w") * F.col("marginal")).alias("component"), "portfolio_vol", "portfolio_var", "portfolio_cvar", "diversification")
