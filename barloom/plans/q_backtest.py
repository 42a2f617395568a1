"""Back-test queries. The forecasts come from a helper per symbol; what follows them is tested on small fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest as B
from .q_market import c
from .testbed import bars, rounded

METRICS = ("accuracy", "mae", "mape", "extreme_rate", "total_return", "sharpe", "sortino", "calmar", "win_rate", "profit_factor", "max_drawdown", "costs")


def trades(spark, sf):
    return B.simulate_trades(B.walk_forward(bars(spark, sf)), edge=0.02)


def walk_forward_forecasts(spark, sf):
    return rounded(B.walk_forward(bars(spark, sf)), "symbol", "cutoff", F.unix_millis("train_end").alias("train_ms"), "is_extreme", **c("forecast_return", "actual_return", "volatility", "hurst", "edge_score"))


def simulate_trades(spark, sf):
    return rounded(trades(spark, sf), "symbol", "cutoff", "signal", **c("trade_return", "equity", "net_pnl"), digits=4)


def equity_drawdown(spark, sf):
    return rounded(B.equity_drawdown(trades(spark, sf)), "symbol", "duration", **c("max_drawdown"))


def backtest_metrics(spark, sf):
    return rounded(B.backtest_metrics(trades(spark, sf)), "symbol", "observations", "trades", **c(*METRICS))


def backtest_verdict(spark, sf):
    return B.backtest_metrics(trades(spark, sf)).select("symbol", "verdict", F.array_join("reasons", "; ").alias("reasons"))


def bootstrap_returns(spark, sf):
    return rounded(B.bootstrap_returns(trades(spark, sf)), "symbol", **c("p5", "p25", "p50", "p75", "p95", "p_positive", "worst", "best"))


QUERIES = {f.__name__: f for f in (walk_forward_forecasts, simulate_trades, equity_drawdown, backtest_metrics, backtest_verdict, bootstrap_returns)}
ORACLES: dict[str, str] = {}
