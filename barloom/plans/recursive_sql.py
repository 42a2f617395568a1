"""SQL of operators that depend on their own past: recursive queries that take every symbol one bar further a round."""

from __future__ import annotations

from .q_market import P, SPLIT
from .testbed import BARS, MS, RET, sql_rounded


def prints(source: str) -> str:
    """CTEs ``walked`` (symbol, idx, acc, rejected) and ``flagged`` over ``source`` (symbol, ts, close, volume)."""
    return f"""
pv as materialized (select symbol, ts, close, volume, row_number() over ({P}) - 1 as idx, avg(volume) over ({P} rows between 20 preceding and 1 preceding) as base from {source}),
walked(symbol, idx, acc, rejected) as (
    select symbol, idx, [close], false from pv where idx = 0
    union all
    select symbol, idx, case when bad then acc else list_append(acc, close)[-5:] end, bad
    from (select v.symbol, v.idx, v.close, w.acc, len(w.acc) >= 2 and list_stddev_pop(w.acc) > 0 and abs(v.close - list_avg(w.acc)) > 3 * list_stddev_pop(w.acc) and coalesce(round(v.volume / nullif(v.base, 0), 9), 'infinity'::double) < 2 as bad
          from walked w join pv v on v.symbol = w.symbol and v.idx = w.idx + 1)),
flagged as (select pv.*, rejected from pv join walked using (symbol, idx))"""


HIT = BARS + f""",
h0 as (select *, row_number() over ({P}) - 1 as idx from bars),
hit as (select symbol, ts, case when idx % 97 = 50 then close * 3 else close end as close, case when idx % 97 <> 50 then volume when symbol::bigint % 2 = 0 then 100000.0 else 10000000.0 end as volume from h0)"""
ADJUSTED = "{name} as (select s.symbol, s.ts, s.close / coalesce(product(a.factor), 1) as close, s.volume * coalesce(product(a.factor), 1) as volume from {source} s left join {actions} a on a.symbol = s.symbol and a.ts > s.ts group by s.symbol, s.ts, s.close, s.volume)"


def jumps(source: str) -> str:
    """CTE ``acts``: the lasting corporate actions of ``source``: without a bar whose close jumps and is back at the next."""
    return f"""
j1 as (select *, lag(close) over ({P}) as c1, lag(close, 2) over ({P}) as c2, lead(close) over ({P}) as cn from {source}),
j2 as (select *, close / c1 as ratio, abs(ln(close / c1)) as move from j1 where c1 is not null),
j3 as (select *, row_number() over (partition by symbol order by move) - 1 as nth, count(*) over (partition by symbol) as n from j2),
j4 as (select *, max(case when nth = n // 2 then move end) over (partition by symbol) as med from j3),
acts as (select symbol, ts, c1 / close as factor from j4 where (ratio <= 0.4 or ratio >= 2.3) and move >= greatest(0.5, 8 * med)
         and coalesce(cn / c1 <= 0.4 or cn / c1 >= 2.3, true) and coalesce(close / c2 <= 0.4 or close / c2 >= 2.3, true))"""


MATRIX = SPLIT + f""",
m0 as (select *, row_number() over ({P}) - 1 as i from split),
m1 as (select *, case when i % 11 <> 0 then close * (1 + 0.002 * (i % 7 = 0)::int) end as base from m0),
reconciled as (select symbol, ts, case when abs(close - base) / base > 0.001 then base else close end as close, volume from m1),{jumps('reconciled')},
{ADJUSTED.format(name='adjusted', source='reconciled', actions='acts')}"""

KALMAN = BARS + f""",
kb as materialized (select symbol, ts, close, volume, row_number() over ({P}) - 1 as idx, count(*) over (partition by symbol) as n from bars),
kf(symbol, idx, estimate, p, q, ahead, recent, innovation) as (
    select symbol, 0::bigint, close, (1 - (1.0 + 1e-5 * greatest(1.0, volume)) / (1.0 + 1e-5 * greatest(1.0, volume) + 1e-2)) * (1.0 + 1e-5 * greatest(1.0, volume)), 1e-5::double, 1.0 + 1e-5 * greatest(1.0, volume), [0.0::double], 0.0::double from kb where idx = 0
    union all
    select symbol, idx, estimate + gain * innov, (1 - gain) * up, case when idx > 10 and ahead > 0 then greatest(1e-8, least(1e-3, q * list_var_samp(recent) / (ahead / 10))) else q end, up, list_append(recent, innov)[-10:], innov
    from (select *, up / (up + 1e-2) as gain from (
        select v.symbol, v.idx, k.estimate, k.q, k.ahead, k.recent, v.close - k.estimate as innov, k.p + k.q * greatest(1.0, v.volume) as up from kf k join kb v on v.symbol = k.symbol and v.idx = k.idx + 1))),
kt as materialized (select kb.symbol, kb.ts, kb.n, kf.* exclude (symbol) from kf join kb on kb.symbol = kf.symbol and kb.idx = kf.idx),
ks(symbol, idx, smoothed) as (
    select symbol, idx, estimate from kt where idx = n - 1
    union all
    select t.symbol, t.idx, t.estimate + t.p / (t.p + t.q) * (k.smoothed - t.estimate) from ks k join kt t on t.symbol = k.symbol and t.idx = k.idx - 1)"""

#: Rescaled range over the 100 returns before each bar: deviations from the window's mean, by segments of 8, 16 and 32 returns.
HURST = RET + """,
hw as (select a.symbol, a.idx, b.ret, b.idx - a.idx + 100 as k, avg(b.ret) over (partition by a.symbol, a.idx) as m from r a join r b on b.symbol = a.symbol and b.idx between a.idx - 100 and a.idx - 1 and b.ret is not null where a.idx >= 101),
hs as (select *, unnest([8, 16, 32]) as scale from hw),
hc as (select symbol, idx, scale, k // scale as seg, ret, sum(ret - m) over (partition by symbol, idx, scale, k // scale order by k) as cum from hs where k // scale < 100 // scale),
hg as (select symbol, idx, scale, seg, greatest(max(cum), 0) - least(min(cum), 0) as rg, stddev_samp(ret) as sd from hc group by symbol, idx, scale, seg),
hp as (select symbol, idx, log2(scale) as x, log2(avg(rg / sd)) as y from hg where sd > 0 group by symbol, idx, scale having count(*) >= 2),
hh as (select symbol, idx, case when count(*) >= 2 then least(1, greatest(0, regr_slope(y, x))) else 0.5 end as h from hp group by symbol, idx)"""

ORACLES = {
    "filter_bad_prints": f"with recursive {HIT},{prints('hit')} select symbol, {MS}, rejected, {sql_rounded({'close': 'close'}, 4)} from flagged",
    "clean_history": f"with recursive {SPLIT}, {ADJUSTED.format(name='adjusted', source='split', actions='actions')},{prints('adjusted')} select symbol, count(*) as bars, count(*) filter (rejected) as rejected from flagged group by symbol",
    "prepare_verified_matrix": f"with recursive {MATRIX},{prints('adjusted')} select symbol, {MS}, true as usable, {sql_rounded({'close': 'close', 'volume': 'volume'}, 4)} from flagged where not rejected",
    "kalman_track": f"with recursive {KALMAN} select symbol, {MS}, {sql_rounded({'filtered': 'estimate', 'innovation': 'innovation', 'covariance': 'p', 'smoothed': 'smoothed'})} from kt join ks using (symbol, idx)",
    "kalman_smooth": f"with recursive {KALMAN} select symbol, {MS}, {sql_rounded({'smoothed': 'smoothed'})} from kt join ks using (symbol, idx)",
    "rolling_hurst_100": f"with {HURST} select r.symbol, {MS.replace('(ts)', '(r.ts)')}, {sql_rounded({'rolling_hurst': 'h'})} from r left join hh on hh.symbol = r.symbol and hh.idx = r.idx",
}
