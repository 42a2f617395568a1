"""SQL of back-tests: the forecast's own SQL over every cutoff's training bars, and what follows from its rows."""

from __future__ import annotations

from .q_market import P
from .q_model import RANK, forecast_ctes
from .testbed import BARS, sql_rounded


def walk(minimum: int = 50, purge: int = 5) -> str:
    """CTE ``wf``: symbol, cutoff, train_end, actual_price, actual_return, forecast_return, volatility, hurst, is_extreme, edge_score."""
    return f"""{BARS},
wb as (select *, row_number() over ({P}) - 1 as i, count(*) over (partition by symbol) as nn from bars),
cu as (select symbol, unnest(range({minimum}, nn - 5, 5)) as cutoff from (select distinct symbol, nn from wb)),
pre as (select b.symbol || '|' || cutoff as symbol, b.ts, b.open, b.high, b.low, b.close, b.volume from cu join wb b on b.symbol = cu.symbol and b.i < cutoff - {purge} where cutoff - {purge} >= {minimum}),
{forecast_ctes('pre').replace('unnest([1, 3, 5, 10, 20])', 'unnest([5])')},
wf0 as (select split_part(symbol, '|', 1) as symbol, split_part(symbol, '|', 2)::bigint as cutoff, last_ts as train_end, last_price, expected_return as forecast_return, volatility, hurst, is_extreme, expected_return / volatility as edge_score from f3),
wf as (select wf0.*, b.close as actual_price, b.close / last_price - 1 as actual_return from wf0 join wb b on b.symbol = wf0.symbol and b.i = cutoff + 5)"""


TRADES = walk() + """,
t0 as (select *, case when row_number() over (partition by symbol order by cutoff) <= 2 then 'EMBARGO' when forecast_return > 0 and edge_score >= 0.02 and not is_extreme then 'BUY' else 'NO_TRADE' end as signal from wf),
t1 as (select *, case when signal = 'BUY' then actual_return - 0.002 else 0 end as trade_return from t0),
t2 as (select *, 1e6 * exp(sum(ln(greatest(1e-12, 1 + 0.05 * trade_return))) over (partition by symbol order by cutoff)) as equity from t1),
tr as (select *, lag(equity, 1, 1e6) over (partition by symbol order by cutoff) as before from t2)"""
DOWN = """,
d0 as (select *, greatest(1e6, max(equity) over (partition by symbol order by cutoff)) as peak from tr),
d1 as (select *, sum((equity >= peak)::int) over (partition by symbol order by cutoff) as island from d0),
d2 as (select symbol, island, count(*) filter (equity < peak) as run, max((peak - equity) / peak) as dd from d1 group by 1, 2),
dd as (select symbol, max(dd) as max_drawdown, max(run) as duration from d2 group by 1)"""
YEAR = "sqrt(252.0 / 5)"
METRICS = TRADES + DOWN + f""",
k0 as (select symbol, count(*) as observations, count(*) filter (signal = 'BUY') as trades, coalesce(avg((sign(forecast_return) = sign(actual_return))::int) filter (forecast_return <> 0 and actual_return <> 0), 0) as accuracy,
       avg(abs(forecast_return - actual_return)) as mae, avg(abs(forecast_return - actual_return) / greatest(abs(actual_return), 1e-4)) as mape, avg(is_extreme::int) as extreme_rate, arg_max(equity, cutoff) / 1e6 - 1 as total_return,
       avg(trade_return) filter (signal = 'BUY') as mt, coalesce(stddev_samp(trade_return) filter (signal = 'BUY'), 0) as st, coalesce(stddev_samp(trade_return) filter (signal = 'BUY' and trade_return < 0), 0) as sd,
       count(*) filter (signal = 'BUY' and equity - before > 0) as wins, coalesce(sum(equity - before) filter (equity > before), 0) as gp, coalesce(-sum(equity - before) filter (equity < before), 0) as gl,
       sum(case when signal = 'BUY' then before * 0.05 * 20 / 1e4 else 0 end) as costs from tr group by symbol),
k1 as (select *, total_return * {YEAR} as annual, case when st > 0 then mt / st else 0 end * {YEAR} as sharpe, case when sd > 0 then mt / sd else 0 end * sqrt(252) as sortino, case when trades > 0 then wins / trades else 0 end as win_rate,
       case when gl > 0 then gp / gl when gp > 0 then 'infinity'::double else 0 end as profit_factor from k0 join dd using (symbol)),
k2 as (select *, coalesce(sharpe, 0) as s, coalesce(sortino, 0) as so, case when max_drawdown > 0 then annual / max_drawdown else 0 end as calmar from k1),
k3 as (select *, case when annual > 0.08 and max_drawdown < 0.12 and s > 1.2 and win_rate > 0.5 then 'STRONG_EDGE' when annual > 0.05 and max_drawdown < 0.15 and s > 1.0 and win_rate > 0.45 then 'PROFITABLE'
       when annual > 0 and s > 0.5 and max_drawdown < 0.25 then 'MARGINALLY_PROFITABLE' when annual > -0.05 then 'BREAKEVEN' else 'NOT_PROFITABLE' end as first from k2),
km as (select *, case when trades < 10 and first in ('STRONG_EDGE', 'PROFITABLE') then 'MARGINALLY_PROFITABLE' else first end as verdict from k3)"""
WALKED = walk(100, 0) + """,
va as (select symbol, cutoff, forecast_return as x, ln(1 + actual_return) as y, (1 + forecast_return) * exp(-1.96 * volatility * sqrt(5)) - 1 as low, (1 + forecast_return) * exp(1.96 * volatility * sqrt(5)) - 1 as high from wf)"""
_NAMES = {"accuracy": "accuracy", "mae": "mae", "mape": "mape", "extreme_rate": "extreme_rate", "total_return": "total_return", "sharpe": "s", "sortino": "so", "calmar": "calmar", "win_rate": "win_rate", "profit_factor": "profit_factor", "max_drawdown": "max_drawdown", "costs": "costs"}

ORACLES = {
    "walk_forward_forecasts": f"with {walk()} select symbol, cutoff, epoch_us(train_end) // 1000 as train_ms, is_extreme, {sql_rounded({x: x for x in ('forecast_return', 'actual_return', 'volatility', 'hurst', 'edge_score')})} from wf",
    "simulate_trades": f"with {TRADES} select symbol, cutoff, signal, {sql_rounded({'trade_return': 'trade_return', 'equity': 'equity', 'net_pnl': 'equity - before'}, 4)} from tr",
    "equity_drawdown": f"with {TRADES}{DOWN} select symbol, duration, {sql_rounded({'max_drawdown': 'max_drawdown'})} from dd",
    "backtest_metrics": f"with {METRICS} select symbol, observations, trades, {sql_rounded(_NAMES)} from km",
}
#: The back-test's own CTEs beside those of the signals: a query inside the query keeps their names apart.
_RANKED = "with recursive " + RANK.replace("{tested}", f"km as materialized (select symbol, accuracy from (with {METRICS} select * from km))")
ORACLES |= {
    "rank_universe": f"{_RANKED} select symbol, signal, rank, {sql_rounded({'score': 'score'}, 9)} from rk",
    "strongest_buy": f"{_RANKED} select symbol, signal, rank, {sql_rounded({'score': 'score'}, 9)} from rk where signal = 'BUY' order by rk.score desc, symbol limit 1",
    "best_blocked": f"{_RANKED} select symbol, signal, rank, {sql_rounded({'score': 'score'}, 9)} from rk where signal <> 'BUY' and rk.score > 0 order by rk.score desc, symbol limit 1",
}
_WHY = ["when annual <= 0 then 'no annualized return'", "when s <= 0.5 then 'Sharpe below 0.5'", "when max_drawdown >= 0.25 then 'drawdown exceeds 25%'", "when win_rate < 0.45 and trades > 5 then 'win rate below 45%'", "when profit_factor < 1 and trades > 0 then 'profit factor below 1'", "when max_drawdown < 0.1 then 'drawdown contained below 10%'", "when trades < 10 then 'insufficient sample of trades'"]
ORACLES |= {
    "backtest_verdict": f"with {METRICS} select symbol, verdict, array_to_string(list_filter([{', '.join(f'case {w} end' for w in _WHY)}], lambda x: x is not null), '; ') as reasons from km",
    "backtest_validation": f"""with {WALKED}, vb as (select *, row_number() over (partition by symbol order by cutoff desc) as back, count(*) over (partition by symbol) as rows_ from va),
        vc as (select *, unnest([0, 20, 50, 100]) as "window" from vb), vd as (select *, x - y as e from vc where "window" = 0 or (back <= "window" and rows_ >= "window"))
        select symbol, "window"::bigint as "window", count(*) as n, {sql_rounded({'mae': 'avg(abs(e))', 'rmse': 'sqrt(avg(e * e))', 'direction_accuracy': 'avg((sign(x) = sign(y))::int)', 'corr': 'coalesce(corr(x, y), 0)', 'theil_u': 'sqrt(avg(e * e)) / (sqrt(avg(x ** 2)) + sqrt(avg(y ** 2)))'})}
        from vd group by symbol, "window" having count(*) >= 10""",
    "backtest_intervals": f"""with {WALKED}, vi as (select symbol, cutoff, (y between low and high)::int as hit, high - low as width from va), vj as (select *, lag(hit) over (partition by symbol order by cutoff) as b from vi)
        select symbol, {sql_rounded({'coverage': 'avg(hit)', 'width': 'avg(width)', 'conditional': 'avg((hit = b)::int)'})} from vj group by 1""",
}
