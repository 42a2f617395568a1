"""Small models per symbol, fitted from sums that Spark takes: regressions, principal components, unit-root test, autoregression."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .risk import numbered

#: Critical values (1, 5 and 10 %) of the unit-root test by trend, and their correction over the root of the rows.
CRITICAL = {"nc": (-2.58, -1.95, -1.62), "c": (-3.43, -2.86, -2.57), "ct": (-3.96, -3.41, -3.13)}
CORRECTION, LEVELS = (0.5, 0.3, 0.2), (0.001, 0.025, 0.075, 0.5)
#: Returns kept at either end of a series: twice the longest lag and two more.
EDGE = 28


def gram(df: DataFrame, features: Column, target: Column | None = None, keys: tuple = ("symbol",)) -> DataFrame:
    """(keys, gram array<double>): the sums of products of (1, features, target), row by row.

    Each task adds up its rows of a key before anything is shuffled, so a key with most rows is one small row a batch.
    """
    z = F.concat(F.array(F.lit(1.0)), features.cast("array<double>"), *([F.array(target.cast("double"))] if target is not None else []))
    names = list(keys)

    def partial(pdfs):
        for pdf in pdfs:
            rows = []
            for key, part in pdf.groupby(names, sort=False, dropna=False):
                x = np.stack(part["z"].to_numpy())
                rows.append((*key, (x.T @ x).ravel().tolist()))
            yield pd.DataFrame(rows, columns=[*names, "g"])

    rows = df.select(*names, z.alias("z"))
    parts = rows.mapInPandas(partial, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "z") + ", g array<double>")
    cells = parts.select(*names, F.posexplode("g").alias("pos", "v")).groupBy(*names, "pos").agg(F.sum("v").alias("v"))
    return cells.groupBy(*names).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("gram"))


def each(df: DataFrame, solve, out: str, keys: tuple = ("symbol",)) -> DataFrame:
    """A row per row of ``df``, one a key: the keys and what ``solve`` makes of the row."""
    names = list(keys)
    columns = [c.split()[0] for c in out.split(", ")]

    def run(pdfs):
        for pdf in pdfs:
            yield pd.DataFrame([(*(getattr(r, k) for k in names), *solve(r)) for r in pdf.itertuples(index=False)], columns=[*names, *columns])

    return df.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in names) + ", " + out)


def solved(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """The solution of normal equations, None if they are singular."""
    try:
        x = np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return None
    return x if np.isfinite(x).all() and np.linalg.cond(a) < 1e15 else None


def linear_model(df: DataFrame, features: Column, target: Column, keys: tuple = ("symbol",)) -> DataFrame:
    """(keys, n, intercept, coefficients) of the least squares fit of each key; zeros where it is singular or has too few rows."""

    def solve(r):
        g = np.asarray(r.gram)
        g = g.reshape(math.isqrt(len(g)), -1)
        n, p = int(round(g[0, 0])), len(g) - 2
        x = solved(g[:-1, :-1], g[:-1, -1]) if n >= p + 1 else None
        x = np.zeros(p + 1) if x is None else x
        return n, float(x[0]), x[1:].tolist()

    return each(gram(df, features, target, keys), solve, "n long, intercept double, coefficients array<double>", keys)


def pca_features(df: DataFrame, features: Column, components: int = 10, share: float = 0.95, keys: tuple = ("symbol",)) -> DataFrame:
    """(keys, component, explained, loadings, means) of each key: the fewest principal components with ``share`` of the variance, ``components`` at most.

    A component's largest loading is positive, so that reruns agree.
    """

    def solve(r):
        g = np.asarray(r.gram)
        g = g.reshape(math.isqrt(len(g)), -1)
        n, m = g[0, 0], g[0, 1:] / g[0, 0]
        value, vector = np.linalg.eigh((g[1:, 1:] - n * np.outer(m, m)) / max(1, n - 1))
        value, vector = np.maximum(value[::-1], 0), vector[:, ::-1].T
        part = value / value.sum() if value.sum() > 0 else value
        k = min(components, int(np.searchsorted(np.cumsum(part), share - 1e-12) + 1), len(part))
        vector = vector[:k] * np.sign(vector[np.arange(k), np.abs(vector[:k]).argmax(1)])[:, None]
        return [float(x) for x in part[:k]], vector.tolist(), m.tolist()

    found = each(gram(df, features, None, keys), solve, "explained array<double>, loadings array<array<double>>, means array<double>", keys)
    one = F.posexplode(F.arrays_zip("explained", "loadings")).alias("component", "c")
    return found.select(*keys, one, "means").select(*keys, (F.col("component") + 1).alias("component"), "c.explained", "c.loadings", "means")


def pca_transform(df: DataFrame, features: Column, fitted: DataFrame, keys: tuple = ("symbol",)) -> DataFrame:
    """Adds ``components``: the rows' places along their key's principal components."""
    fit = fitted.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("component", "loadings"))), lambda s: s["loadings"]).alias("l"), F.first("means").alias("m"))
    at = F.zip_with(features.cast("array<double>"), "m", lambda x, m: x - m)
    dot = lambda l: F.aggregate(F.zip_with(F.col("at"), l, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)  # noqa: E731, E741
    return df.withColumn("features_of", features).join(fit, list(keys)).withColumn("at", at).withColumn("components", F.transform("l", dot)).drop("l", "m", "at", "features_of")


def autocovariances(bars: DataFrame, lags: int) -> DataFrame:
    """Per symbol: n, sums of the returns (also times their number) and of their products with the ``lags`` ones before, and both ends of the series."""
    w = Window.partitionBy("symbol").orderBy("k")
    r = numbered(bars).select("symbol", "k", "n", "ret")
    r = r.withColumns({f"b{d}": F.col("ret") * (F.lag("ret", d).over(w) if d else F.col("ret")) for d in range(lags + 1)})
    end = lambda ok: F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct("k", "ret")))), lambda s: s["ret"])
    return r.groupBy("symbol").agg(
        F.max("n").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("k") * F.col("ret")).alias("t"), F.array(*[F.coalesce(F.sum(f"b{d}"), F.lit(0.0)) for d in range(lags + 1)]).alias("c"),
        end(F.col("k") < EDGE).alias("head"), end(F.col("k") >= F.col("n") - EDGE).alias("tail"),
    )


def lagged(r, first: int, lags: int) -> np.ndarray:
    """Sums of products of (y_t, y_t-1, ..., y_t-lags, 1, t - first + 1) over t from ``first`` (``lags`` at least) to the end of a series."""
    n, head, tail, c = int(r.n), np.asarray(r.head), np.asarray(r.tail), np.asarray(r.c)
    at = lambda s: head[s] if s < len(head) else tail[s - n + len(tail)]
    g = np.zeros((lags + 3, lags + 3))
    for i in range(lags + 1):
        out = [*range(first - i), *range(n - i, n)]
        g[i, lags + 1] = r.s - sum(at(s) for s in out)
        g[i, lags + 2] = r.t - sum(s * at(s) for s in out) + (i - first + 1) * g[i, lags + 1]
        for j in range(i, lags + 1):
            d = j - i
            g[i, j] = c[d] - sum(at(s) * at(s - d) for s in out if s >= d)
    m = n - first
    g[lags + 1, lags + 1:] = m, m * (m + 1) / 2
    g[lags + 2, lags + 2] = m * (m + 1) * (2 * m + 1) / 6
    return np.triu(g) + np.triu(g, 1).T


def critical_values(n: int, trend: str) -> list[float]:
    return [a + b / math.sqrt(n) for a, b in zip(CRITICAL[trend], CORRECTION, strict=True)]


def adf_regression(r, lag: int, trend: str, form: str = "level"):
    """(statistic, p value, AIC) of one regression, or None if it is singular.

    Of the level y_t (with form 'diff': of the difference) on y_t-1, a constant, a trend, and the differences of y_t-1
    with the ``lag`` values before it.
    """
    g = lagged(r, lag + 1, lag + 1)
    one = np.eye(len(g))
    y = one[0] - (one[1] if form == "diff" else 0)
    columns = [one[1], *([one[-2]] if trend != "nc" else []), *([one[-1]] if trend == "ct" else []), *(one[1] - one[1 + k] for k in range(1, lag + 1))]
    x = np.stack(columns)
    b = solved(x @ g @ x.T, x @ g @ y)
    m = int(r.n) - lag - 1
    if b is None or m <= len(b):
        return None
    rss = max(1e-300, float(y @ g @ y - b @ (x @ g @ y)))
    spread = g[1, 1] - g[1, -2] ** 2 / m
    se = math.sqrt(rss / (m - len(b))) / math.sqrt(spread or 1)
    stat = float(b[0]) / (se or 1)
    p = next((level for level, cv in zip(LEVELS, critical_values(m, trend), strict=False) if stat < cv), LEVELS[-1])
    return stat, p, m * math.log(rss / m) + 2 * len(b)


def adf_test(bars: DataFrame, max_lag: int | None = None, trend: str = "c", form: str = "level", minimum: int = 20) -> DataFrame:
    """Unit-root test of the log returns of each symbol with ``minimum`` of them: statistic, p_value, lags, critical values, stationary.

    The lag up to ``max_lag`` (12 and the cube root of the returns at most) is that of least AIC. Spark adds up the lagged
    products; each symbol's small regressions are solved from them.
    """

    def solve(r):
        n = int(r.n)
        top = min(12, int(math.floor(n ** (1 / 3) + 1e-9))) if max_lag is None else max_lag
        best = (math.inf, 0.0, 1.0, 0)
        for lag in range(top + 1):
            if (got := adf_regression(r, lag, trend, form)) and got[2] < best[0]:
                best = (got[2], got[0], got[1], lag)
        return best[1], best[2], best[3], critical_values(n, trend), bool(best[2] < 0.05)

    longest = 13 if max_lag is None else max_lag + 1
    sums = autocovariances(bars, longest).where(F.col("n") >= minimum)
    return each(sums, solve, "statistic double, p_value double, lags int, critical array<double>, stationary boolean")


def fit_ar(bars: DataFrame, max_lag: int = 5) -> DataFrame:
    """(symbol, ar_order, intercept, coefficients, aic) of the autoregression of the log returns with least AIC; coefficients from the last return back.

    Symbols with fewer than ``max_lag`` + 10 returns, and those without a regular fit, have order 0.
    """

    def solve(r):
        n, best = int(r.n), (math.inf, 0, 0.0, [])
        for p in range(1, max_lag + 1) if n >= max_lag + 10 else ():
            g = lagged(r, p, p)
            x = np.eye(len(g))[[p + 1, *range(1, p + 1)]]
            b = solved(x @ g @ x.T, x @ g[0])
            if b is not None:
                rss = max(1e-300, float(g[0, 0] - b @ (x @ g[0])))
                aic = n * math.log(rss / n) + 2 * (p + 1)
                if aic < best[0]:
                    best = (aic, p, float(b[0]), b[1:].tolist())
        return best[1], best[2], best[3], best[0], [float(x) for x in r.tail[-max_lag:]]

    return each(autocovariances(bars, max_lag), solve, "ar_order int, intercept double, coefficients array<double>, aic double, recent array<double>")


def forecast_ar(fitted: DataFrame, horizons: tuple) -> DataFrame:
    """(symbol, horizon, ar_forecast): the return forecast for the last bar of each horizon, by its own forecasts of the bars before; 0 without a fit."""
    last = F.reverse("recent")
    step = lambda s, _: F.concat(F.array(F.col("intercept") + F.aggregate(F.zip_with(F.col("coefficients"), F.slice(s, 1, F.size("coefficients")), lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)), s)
    path = F.aggregate(F.sequence(F.lit(1), F.lit(max(horizons))), last, step)
    f = fitted.withColumn("path", F.slice(path, 1, max(horizons)))
    f = f.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    return f.select("symbol", "horizon", F.when(F.col("ar_order") > 0, F.element_at("path", max(horizons) + 1 - F.col("horizon"))).otherwise(0.0).alias("ar_forecast"))
