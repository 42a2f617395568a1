"""SQL of small regressions: normal equations as lists of lists, solved by elimination, one column a round of a recursive query."""

from __future__ import annotations


def solved(name: str, rows: str) -> str:
    """CTEs of the regressions in ``rows`` (symbol, lag, xs, y): ``{name}`` has symbol, lag, m (rows), b (coefficients), rss, mat (products)."""
    return f"""
{name}_s as (select symbol, lag, i, j, sum(xs[i] * xs[j]) as s from (select symbol, lag, xs, len(xs) as p, unnest(range(1, len(xs) + 1)) as i from (select symbol, lag, list_append(xs, y) as xs from {rows})), unnest(range(1, p + 1)) as u(j) group by all),
{name}_r as (select symbol, lag, i, list(s order by j) as r from {name}_s group by all),
{name}_m as (select symbol, lag, list(r order by i) as whole from {name}_r group by all),
{name}_e(symbol, lag, k, n, whole, m) as (
    select symbol, lag, 1, len(whole) - 1, whole, whole[:len(whole) - 1] from {name}_m
    union all
    select symbol, lag, k + 1, n, whole, list_transform(range(1, n + 1), lambda i: case when i = k then list_transform(m[k], lambda v: v / m[k][k]) else list_transform(range(1, n + 2), lambda j: m[i][j] - m[i][k] * m[k][j] / m[k][k]) end)
    from {name}_e where k <= n),
{name}_n as (select symbol, lag, count(*) as m from {rows} group by all),
{name} as (select e.symbol, e.lag, c.m, whole as mat, list_transform(e.m, lambda r: r[n + 1]) as b, greatest(1e-300, whole[n + 1][n + 1] - list_sum(list_transform(range(1, n + 1), lambda i: e.m[i][n + 1] * whole[i][n + 1]))) as rss
           from {name}_e e join {name}_n c using (symbol, lag) where k = n + 1)"""


LAGS = ", ".join(f"lag(ret, {k}) over (partition by symbol order by k) as y{k}" for k in range(1, 14))
#: The unit-root test over ``n0``: the lag of least AIC up to the cube root of the returns (12 at most), with its statistic and critical values.
ADF_LAGS = f"""
al as (select symbol, k, n, ret as y, {LAGS} from n0),
ar_ as materialized (select symbol, lag, [y1, 1.0] || list_transform(range(1, lag + 1), lambda d: y1 - ys[d + 1]) as xs, y from (select symbol, k, y, y1, [{', '.join(f'y{k}' for k in range(1, 14))}] as ys, unnest(range(0, least(12, floor(n ** (1.0 / 3) + 1e-9))::bigint + 1)) as lag from al) where k >= lag + 1),{solved('afit', 'ar_')},
ast as (select symbol, lag, m, b[1] / (sqrt(rss / (m - len(b))) / sqrt(mat[1][1] - mat[1][2] ** 2 / m)) as statistic, m * ln(rss / m) + 2 * len(b) as aic from afit),
adf as (select symbol, lag as lags, statistic, -2.86 + 0.3 / sqrt(m) as cv5, -3.43 + 0.5 / sqrt(m) as cv1, -2.57 + 0.2 / sqrt(m) as cv10 from ast qualify row_number() over (partition by symbol order by aic, lag) = 1)"""
#: Autoregressions of order 1 to 5 over ``n0``: the one of least AIC.
AR = f"""
fl as (select symbol, k, n, ret as y, {LAGS} from n0),
fr as materialized (select symbol, lag, [1.0] || ys[1:lag] as xs, y from (select symbol, k, y, [{', '.join(f'y{k}' for k in range(1, 6))}] as ys, unnest(range(1, 6)) as lag from fl where n >= 15) where k >= lag),{solved('ffit', 'fr')},
fa as (select symbol, lag, b, (select max(n) from fl where fl.symbol = ffit.symbol) as n, rss from ffit),
fit as (select symbol, lag as ar_order, b[1] as intercept, n * ln(rss / n) + 2 * (lag + 1) as aic from fa qualify row_number() over (partition by symbol order by n * ln(rss / n) + 2 * (lag + 1), lag) = 1)"""
