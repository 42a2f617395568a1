"""Feature queries and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import features as X
from .testbed import MS, RET, bars, ms, rounded, sql_rounded

P = "partition by symbol order by ts"


def last(n):
    return f"over ({P} rows between {n - 1} preceding and current row)"


RUN = f"over ({P} rows between unbounded preceding and current row)"


def full(n, e):
    return f"case when idx >= {n - 1} then {e} end"


def ret(n, e):
    return f"case when idx >= {n} then {e} end"


def std(c, n):
    return "0" if n < 2 else f"stddev_samp({c}) {last(n)}"


def ema(c, n):
    """The weighted sum that the recursion comes to, from the oldest value to the newest."""
    k = 2 / (n + 1)
    weights = [k ** (n - 1)] + [(1 - k) * k ** (n - 1 - j) for j in range(1, n)]
    return " + ".join(f"{w!r} * lag({c}, {n - 1 - j}) over ({P})" for j, w in enumerate(weights))


def moments(w):
    m, s = f"avg(ret) {last(w)}", f"stddev_samp(ret) {last(w)}"
    a2, a3, a4 = (f"avg(ret ** {p}) {last(w)}" for p in (2, 3, 4))
    skew = f"case when {s} > 0 then ({a3} - 3 * {m} * {a2} + 2 * ({m}) ** 3) / ({s}) ** 3 else 0 end" if w >= 3 else "0"
    kurt = f"case when {s} > 0 then ({a4} - 4 * {m} * {a3} + 6 * ({m}) ** 2 * {a2} - 3 * ({m}) ** 4) / ({s}) ** 4 - 3 else 0 end" if w >= 4 else "0"
    return {f"ret_skew_{w}": ret(w, skew), f"ret_kurt_{w}": ret(w, kurt)}


#: Decimals in the whole matrix of a mean whose digits end in a 5 where few bars are in it, so that two engines round them apart.
FEWER = {"vwap": 1}
DIGITS = {"vpt": 4, "volume_mean_std_w": 4, "vwap": 8}
W, R, V = X.WINDOWS, X.RETURN_WINDOWS, X.VOLUME_WINDOWS
EWV = " + ".join(f"{0.06 * 0.94 ** (19 - j)!r} * (lag(ret, {19 - j}) over ({P}) - avg(ret) {last(20)}) ** 2" for j in range(1, 20))
Z = "case when stddev_samp({c}) {w} > 0 then ({c} - avg({c}) {w}) / stddev_samp({c}) {w} else 0 end"
FLOW = "tp * volume"

SQL: dict[str, dict[str, str]] = {
    "log_returns": {"ret": "ret"},
    "ret_lag_w": {f"ret_lag_{w}": f"lag(ret, {w}) over ({P})" for w in R},
    "ret_mean_std_w": {k: v for w in R for k, v in ((f"ret_mean_{w}", ret(w, f"avg(ret) {last(w)}")), (f"ret_std_{w}", ret(w, std("ret", w))))},
    "ret_skew_kurt_w": {k: v for w in R for k, v in moments(w).items()},
    "realized_vol_w": {f"realized_vol_{w}": ret(w, std("ret", w)) for w in W},
    "ewma_vol_20": {"ewma_vol_20": ret(20, f"sqrt({EWV})")},
    "parkinson_vol_w": {f"parkinson_vol_{w}": full(w, f"sqrt(sum(ln(high / h1) ** 2) {last(w - 1)} / (4 * ln(2) * {w}))") for w in W},
    "garman_klass_vol_w": {f"garman_klass_vol_{w}": full(w, f"sqrt(greatest(0, avg(0.5 * ln(high / low) ** 2 - (2 * ln(2) - 1) * ln(close / open) ** 2) {last(w)}))") for w in W},
    "sma_w": {f"sma_{w}": full(w, f"avg(close) {last(w)}") for w in W},
    "ema_w": {f"ema_{w}": full(w, ema("close", w)) for w in W},
    "macd": {"macd": "macd", "macd_signal": "macd_signal", "macd_hist": "macd - macd_signal"},
    "adx_14": {"adx_14": f"case when idx >= 27 then avg(dx) {last(14)} end", "plus_di": "plus_di", "minus_di": "minus_di"},
    "aroon_25": {"aroon_up": full(26, f"100 * (25 - (idx - arg_max(idx, (high, -idx)) {last(26)})) / 25"), "aroon_down": full(26, f"100 * (25 - (idx - arg_min(idx, (low, idx)) {last(26)})) / 25")},
    "bollinger_20_2": {
        "bb_mid": full(20, f"avg(close) {last(20)}"), "bb_up": full(20, f"avg(close) {last(20)} + 2 * {std('close', 20)}"), "bb_low": full(20, f"avg(close) {last(20)} - 2 * {std('close', 20)}"),
        "bb_width": full(20, f"4 * {std('close', 20)} / avg(close) {last(20)}"), "bb_pct": full(20, f"(close - avg(close) {last(20)} + 2 * {std('close', 20)}) / nullif(4 * {std('close', 20)}, 0)"),
    },
    "rsi_14": {"rsi_14": "rsi"},
    "stoch_rsi_14": {"stoch_rsi_14": f"case when idx >= 27 then coalesce((rsi - min(rsi) {last(14)}) / nullif(max(rsi) {last(14)} - min(rsi) {last(14)}, 0), 0.5) end"},
    "z_scores_20": {"close_z_20": full(20, Z.format(c="close", w=last(20))), "volume_z_20": full(20, Z.format(c="volume", w=last(20)))},
    "volume_mean_std_w": {k: v for w in V for k, v in ((f"volume_mean_{w}", full(w, f"avg(volume) {last(w)}")), (f"volume_std_{w}", full(w, std("volume", w))))},
    "obv": {"obv": f"sum(case when close > c1 then volume when close < c1 then -volume else 0 end) {RUN}"},
    "vwap": {"vwap": f"coalesce(sum(tp * volume) {RUN} / nullif(sum(volume) {RUN}, 0), tp)"},
    "vpt": {"vpt": f"sum(coalesce(volume * (close - c1) / c1, 0)) {RUN}"},
    "mfi_14": {"mfi_14": ret(14, f"coalesce(100 * sum(case when tp > tp1 then {FLOW} else 0 end) {last(14)} / nullif(sum(case when tp > tp1 then {FLOW} else 0 end) {last(14)} + sum(case when tp < tp1 then {FLOW} else 0 end) {last(14)}, 0), 50)")},
    "hl_spread": {"hl_spread": "(high - low) / close"},
    "amihud": {"amihud_e6": "case when volume > 0 then abs(ret) / volume * 1e6 when ret is not null then 0 end"},
    "roll_spread": {"roll_spread": "case when avg(ret * ret1) over (partition by symbol) < 0 then 2 * sqrt(-avg(ret * ret1) over (partition by symbol)) else 0 end"},
    "calendar_features": {"day_of_week": "dayofweek(ts)", "month": "month(ts) - 1", "quarter": "quarter(ts) - 1"},
}

PARTS = RET + f""",
p0 as (select *, lag(ret) over ({P}) as ret1, lag(high) over ({P}) as h1, lag(low) over ({P}) as l1, (high + low + close) / 3 as tp,
       case when c1 is not null then greatest(high - low, abs(high - c1), abs(low - c1)) end as tr,
       case when idx >= 25 then ({ema('close', 12)}) - ({ema('close', 26)}) end as macd from r),
p1 as (select *, lag(tp) over ({P}) as tp1, case when h1 is null then null when high - h1 > l1 - low and high > h1 then high - h1 else 0 end as pdm,
       case when h1 is null then null when l1 - low > high - h1 and l1 > low then l1 - low else 0 end as mdm,
       case when idx >= 33 then {ema('macd', 9)} end as macd_signal from p0),
p2 as (select *, case when idx >= 14 then 100 * avg(pdm) {last(14)} / avg(tr) {last(14)} end as plus_di, case when idx >= 14 then 100 * avg(mdm) {last(14)} / avg(tr) {last(14)} end as minus_di,
       case when idx >= 14 then 100 - 100 / (1 + coalesce(avg(case when c1 is null then null when close > c1 then close - c1 else 0 end) {last(14)}
            / nullif(avg(case when c1 is null then null when close < c1 then c1 - close else 0 end) {last(14)}, 0), 100)) end as rsi from p1),
p as (select *, case when plus_di is null then null when plus_di + minus_di > 0 then 100 * abs(plus_di - minus_di) / (plus_di + minus_di) else 0 end as dx from p2)"""


def feature_query(key):
    def run(spark, sf_dir):
        f = X.compute_features(bars(spark, sf_dir), [key])
        return rounded(f, "symbol", ms(), digits=DIGITS.get(key, 6), **{n: F.col(n) for n in X.families()[key]})

    run.__name__ = key
    return run


def matrix(spark, sf_dir):
    f = X.feature_matrix(bars(spark, sf_dir))
    cells = [F.col(n) for k in X.families().values() for n in k]
    return f.groupBy("symbol").agg(F.count("*").alias("n_rows"), F.lit(len(cells)).cast("long").alias("n_cols"), *[(F.round(F.avg(n), 5) + 0.0).alias(n) for n in ("rsi_14", "macd", "ema_20", "adx_14", "realized_vol_20")])


def matrix_rows(spark, sf_dir):
    """The matrix itself, every column of every row; ``feature_matrix`` sums five of its columns up."""
    f = X.feature_matrix(bars(spark, sf_dir), digits={n: FEWER.get(k, DIGITS.get(k, 6)) for k, names in X.families().items() for n in names})
    return f.select("symbol", ms(), *[n for names in X.families().values() for n in names])


QUERIES = {k: feature_query(k) for k in SQL} | {"feature_matrix": matrix, "feature_matrix_rows": matrix_rows}
ORACLES = {k: f"with {PARTS} select symbol, {MS}, {sql_rounded(v, DIGITS.get(k, 6))} from p" for k, v in SQL.items()}
_M = {"rsi_14": "rsi", "macd": "macd", "ema_20": SQL["ema_w"]["ema_20"], "adx_14": SQL["adx_14"]["adx_14"], "realized_vol_20": SQL["realized_vol_w"]["realized_vol_20"]}
ORACLES["feature_matrix"] = f"""with {PARTS}, f as (select symbol, idx, count(*) over (partition by symbol) as bars, {', '.join(f'{e} as f_{n}' for n, e in _M.items())} from p)
select symbol, count(*) as n_rows, {sum(map(len, SQL.values()))}::bigint as n_cols, {', '.join(f'round(avg(coalesce(f_{n}, 0)), 5) + 0.0 as {n}' for n in _M)} from f where bars >= 110 and idx >= 1 group by symbol"""
ORACLES["feature_matrix_rows"] = f"""with {PARTS}, f as (select *, count(*) over (partition by symbol) as n_bars, {', '.join(f'({e})::double as f_{n}' for v in SQL.values() for n, e in v.items())} from p)
select symbol, {MS}, {', '.join(f'round(coalesce(case when not isnan(f_{n}) then f_{n} end, 0), {FEWER.get(k, DIGITS.get(k, 6))}) + 0.0 as {n}' for k, v in SQL.items() for n in v)} from f where n_bars >= 110 and idx >= 1"""
