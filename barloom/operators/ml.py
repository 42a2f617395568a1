"""Preparation of features for models: rows of (symbol, ts, name, x), long rather than wide."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .backtest import KEY, folds, of_runs, runs_of, walk_forward
from .forecast import return_probabilities
from .models import solved
from .running_ml import ASKED, RISK, TASK_BARS, predictions, with_risk
from .series import kept


def unpivot(df: DataFrame, names: list[str], keys: tuple = ("symbol", "ts")) -> DataFrame:
    return df.select(*keys, F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("x")) for n in names])))


def normalize_standard(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol", "name")
    s = F.stddev_samp("x").over(w)
    return df.withColumn("z", F.when(s > 0, (F.col("x") - F.avg("x").over(w)) / s).otherwise(0.0))


def normalize_robust(df: DataFrame) -> DataFrame:
    """By median and interquartile range, all three picked at floor(n q) of the sorted values."""
    w = Window.partitionBy("symbol", "name")
    d = df.withColumn("nth", F.row_number().over(w.orderBy("x")) - 1).withColumn("n", F.count("*").over(w))
    pick = lambda q: F.max(F.when(F.col("nth") == F.floor(F.col("n") * q), F.col("x"))).over(w)
    iqr = pick(0.75) - pick(0.25)
    return d.withColumn("z", F.when(iqr > 0, (F.col("x") - pick(0.5)) / iqr).otherwise(0.0)).drop("nth", "n")


def select_f_regression(df: DataFrame) -> DataFrame:
    """(symbol, name, score) of rows with a target y: F of the regression of y on x."""
    a = df.groupBy("symbol", "name").agg(F.corr("x", "y").alias("r"), F.count("*").alias("n"))
    r2 = F.col("r") * F.col("r")
    return a.select("symbol", "name", F.when(r2 < 1, r2 * (F.col("n") - 2) / (1 - r2)).alias("score"))


def select_mutual_info(df: DataFrame, bins: int = 10) -> DataFrame:
    """(symbol, name, score): mutual information of x and y over a grid of equal-width bins."""
    w = Window.partitionBy("symbol", "name")

    def bin_of(c):
        low, high = F.min(c).over(w), F.max(c).over(w)
        return F.when(high > low, F.least(F.lit(bins - 1), F.floor((F.col(c) - low) / (high - low) * bins))).otherwise(0)

    cells = df.withColumn("bx", bin_of("x")).withColumn("by", bin_of("y")).groupBy("symbol", "name", "bx", "by").agg(F.count("*").alias("n"))
    c = F.col("n")
    cells = cells.withColumn("all", F.sum("n").over(w)).withColumn("nx", F.sum("n").over(Window.partitionBy("symbol", "name", "bx"))).withColumn("ny", F.sum("n").over(Window.partitionBy("symbol", "name", "by")))
    return cells.groupBy("symbol", "name").agg(F.sum(c / F.col("all") * F.log(c * F.col("all") / (F.col("nx") * F.col("ny")))).alias("score"))


def top_features(scores: DataFrame, k: int = 20) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy(F.desc("score"), "name")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def target(horizon: int, kind: str = "return") -> Column:
    """Of rows with ret in order of time: the sum of the next ``horizon`` log returns, whether it is above 0, or their deviation; null without all of them."""
    from .features import by_time

    w = by_time().rowsBetween(1, horizon)
    total = F.sum("ret").over(w)
    value = {"return": total, "direction": (total > 0).cast("double"), "volatility": F.stddev_samp("ret").over(w) if horizon > 1 else F.lit(0.0)}[kind]
    return F.when(F.count("ret").over(w) == horizon, value)


def targets(bars: DataFrame, horizon: int = 5, kind: str = "return") -> DataFrame:
    """Adds y, see ``target``; rows without it go."""
    from .features import log_returns

    return log_returns(bars).withColumn("y", target(horizon, kind)).where("y is not null")


def ml_dataset(bars: DataFrame, names: list[str], lookback: int = 100, horizon: int = 5, kind: str | tuple = "return", minimum_bars: int = 110) -> DataFrame:
    """(symbol, ts, features array, y): the ``lookback`` rows of features before a bar, flattened, and the target after it. Of several kinds of target, each is a column by the name of its kind.

    Rows are those of ``features.feature_matrix``. Features, their rows and the targets are windows over one exchange; the long rows are
    neither joined nor sorted.
    """
    from .features import by_time

    kinds = (kind,) if isinstance(kind, str) else kind
    rows = ml_rows(bars, names).where(F.col("bars") >= minimum_bars)
    w = by_time().rowsBetween(-lookback, -1)
    # the first bar is no row of the matrix, and has no return
    d = rows.withColumns({f"y_{k}": target(horizon, k) for k in kinds}).withColumn("rows", F.collect_list(F.when(F.col("idx") >= 1, F.col("x"))).over(w))
    d = d.where((F.size("rows") == lookback) & (F.col("idx") >= 1))
    for k in kinds:
        d = d.where(F.col(f"y_{k}").isNotNull())
    return d.select("symbol", "ts", F.flatten("rows").alias("features"), *[F.col(f"y_{k}").alias("y" if isinstance(kind, str) else k) for k in kinds])


#: Cutoffs of a block: as many as a task fits with ease, so that all but long series are one block.
BLOCK = 128

PREDICTED = "symbol string, cutoff long, train_end long, train_rows long, predicted_return double, actual_return double, expected_price double, actual_price double, volatility double, hurst double"


class Pipeline:
    """Robust scaling, principal components or the ``features`` columns of highest mutual information or F score, and least squares, fitted on training rows alone.

    With ``components`` (and more columns than that) the fewest components with ``share`` of the variance take the columns'
    place, ``components`` at most; columns are chosen where more than ``features`` are left.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, features: int = 20, selection: str = "mutual_info", bins: int = 10, components: int | None = None, share: float = 0.95):
        s = np.sort(x, axis=0)
        low, self.middle, high = (s[int(len(s) * q)] for q in (0.25, 0.5, 0.75))
        self.spread, self.turn = high - low, None
        z = self.scaled(x)
        if components and z.shape[1] > components:
            self.centre = z.mean(0)
            value, vector = np.linalg.eigh((z - self.centre).T @ (z - self.centre) / max(1, len(z) - 1))
            value = np.maximum(value[::-1], 0)
            part = value / value.sum() if value.sum() > 0 else value
            self.turn = vector[:, ::-1][:, : min(components, int(np.searchsorted(np.cumsum(part), share - 1e-12) + 1))]
            z = (z - self.centre) @ self.turn
        self.chosen = np.arange(z.shape[1])
        if z.shape[1] > features:
            self.chosen = np.argsort(-(mutual_info(z, y, bins) if selection == "mutual_info" else f_score(z, y)), kind="stable")[:features]
        a = np.column_stack([np.ones(len(z)), z[:, self.chosen]])
        b = solved(a.T @ a, a.T @ y) if len(z) > a.shape[1] else None
        self.b = np.zeros(a.shape[1]) if b is None else b

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.divide(x - self.middle, self.spread, out=np.zeros_like(x), where=self.spread > 0)

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = self.scaled(x)
        z = z if self.turn is None else (z - self.centre) @ self.turn
        return self.b[0] + z[:, self.chosen] @ self.b[1:]


def binned(v: np.ndarray, bins: int) -> np.ndarray:
    low, high = v.min(0), v.max(0)
    width = np.where(high > low, high - low, 1)
    return np.minimum(bins - 1, ((v - low) / width * bins).astype(int))


def mutual_info(x: np.ndarray, y: np.ndarray, bins: int = 10) -> np.ndarray:
    """Of each column with y, over grids of equal-width bins."""
    bx, by = binned(x, bins), np.eye(bins)[binned(y, bins)]
    joint = np.stack([(bx == k).T @ by for k in range(bins)]) / len(x)  # bin of x, column, bin of y
    px, py = joint.sum(2, keepdims=True), joint.sum(0, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nansum(np.where(joint > 0, joint * np.log(joint / (px * py)), 0), axis=(0, 2))


class Grids:
    """Mutual information of every column with y over rows that only grow in number: counts of the grids are kept, and taken anew where a range has moved."""

    def __init__(self, x: np.ndarray, y: np.ndarray, bins: int = 10):
        self.x, self.y, self.bins, self.rows = x, y, bins, 0
        p = x.shape[1]
        self.low, self.high = np.full(p, np.inf), np.full(p, -np.inf)
        self.counts, self.span = np.zeros((p, bins * bins), np.int64), None

    def _count(self, columns: np.ndarray, rows: slice) -> np.ndarray:
        low, high = self.low[columns], self.high[columns]
        x, (least, most) = self.x[rows, columns] if isinstance(columns, slice) else self.x[rows][:, columns], self.span
        bx = ((x - low) / np.where(high > low, high - low, 1) * self.bins).astype(np.int64).clip(0, self.bins - 1)
        by = ((self.y[rows] - least) / (most - least if most > least else 1) * self.bins).astype(np.int64).clip(0, self.bins - 1)
        cells = bx * self.bins + by[:, None]
        n, size = len(low), self.bins * self.bins
        return np.bincount((cells + np.arange(n) * size).ravel(), minlength=n * size).reshape(n, size)

    def scores(self, t: int) -> np.ndarray:
        """Over the first ``t`` rows; ``t`` never falls."""
        new = slice(self.rows, t)
        if t > self.rows:
            low, high = np.minimum(self.low, self.x[new].min(0)), np.maximum(self.high, self.x[new].max(0))
            span = (self.y[:t].min(), self.y[:t].max())
            moved = (low < self.low) | (high > self.high)
            self.low, self.high = low, high
            if span != self.span:
                self.span = span
                self.counts = self._count(slice(None), slice(0, t))
            else:
                self.counts += self._count(slice(None), new)
                at = np.flatnonzero(moved)
                if len(at):
                    self.counts[at] = self._count(at, slice(0, t))
            self.rows = t
        # sum of n / t * log(n * t / (nx * ny)), with n log n from a table
        nln = np.arange(t + 1.0)
        nln[1:] *= np.log(nln[1:])
        c = self.counts
        grid = c.reshape(-1, self.bins, self.bins)
        return (nln[c].sum(1) - nln[grid.sum(2)].sum(1) - nln[grid.sum(1)].sum(1) + nln[t]) / t


def f_score(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    xc, yc = x - x.mean(0), y - y.mean()
    with np.errstate(divide="ignore", invalid="ignore"):
        r2 = (xc.T @ yc) ** 2 / ((xc**2).sum(0) * (yc**2).sum())
        return np.nan_to_num(r2 * (len(x) - 2) / (1 - r2))


def ml_rows(bars: DataFrame, names: list[str]) -> DataFrame:
    """Every bar with idx, ret, bars (of its symbol) and ``x``, the values of the features ``names`` (0 where there is none)."""
    from .features import compute_features, families

    f = compute_features(bars, ["log_returns", *sorted(k for k, columns in families().items() if set(names) & set(columns))])
    x = F.array(*[F.coalesce(F.nanvl(F.col(n).cast("double"), F.lit(0.0)), F.lit(0.0)) for n in names])
    return f.select("symbol", "ts", "close", F.col("idx").cast("long").alias("idx"), "ret", x.alias("x"), F.count("*").over(Window.partitionBy("symbol")).alias("bars"))


def with_target(rows: DataFrame, lookback: int = 60, horizons: tuple = (5,), kind: str = "return") -> DataFrame:
    """``ml_rows`` once for each of ``horizons``, with horizon and y (see ``target``); lookback and kind of target are known by the column."""
    wide = rows.withColumns({f"y{h}": target(h, kind) for h in horizons})
    d = wide.select(*rows.columns, F.inline(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"y{h}").alias("y")) for h in horizons])))
    return d.withColumn("y", F.col("y").alias("y", metadata={"lookback": lookback, "kind": kind}))


def ml_frame(bars: DataFrame, names: list[str], lookback: int = 60, horizon: int = 5, kind: str = "return") -> DataFrame:
    """Rows that ``walk_forward_ml`` takes: a model's features are the values of ``names`` at the ``lookback`` bars before a bar."""
    return with_target(ml_rows(bars, names), lookback, (horizon,), kind)


def refitted(frame: DataFrame, lookback: int, minimum: int, step: int, block: int, **pipeline) -> DataFrame:
    """Rows of ``running_ml.ASKED`` and ``RISK`` from a ``Pipeline`` fitted anew on all training rows of each cutoff.

    Mutual information needs the training rows themselves, as its bins move with their range: work grows with the square
    of a series, though counts are kept while a range stays (``Grids``). A group is a symbol and ``block`` cutoffs with the bars before the last of them.
    """
    ahead = F.col("gap") + F.col("horizon")
    cutoffs = F.floor((F.col("bars") - 1 - ahead - minimum) / step) + 1
    last = F.ceil(cutoffs / block) - 1
    first = F.greatest(F.lit(0), F.floor(F.ceil((F.col("idx") - ahead - minimum) / step) / block))  # the first block that needs the bar
    sent = frame.where((cutoffs > 0) & (first <= last)).withColumn("part", F.explode(F.sequence(first, last)))
    rows = sent.select("symbol", "part", "idx", "close", "x", "y", "bars", "horizon", "purge", "gap")
    names = [c.split()[0] for c in ASKED.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        symbol, part, n, horizon, purge, gap = pdf["symbol"].iloc[0], *(int(pdf[c].iloc[0]) for c in ("part", "bars", "horizon", "purge", "gap"))
        close, y, series = pdf["close"].to_numpy(), pdf["y"].to_numpy(float), np.stack(pdf["x"].to_numpy())
        if len(pdf) <= lookback:
            return pd.DataFrame(columns=[*names, *[c.split()[0] for c in RISK.split(", ")]])
        # row i: the bars before it; bars are numbered from 0 without gaps
        x = np.lib.stride_tricks.sliding_window_view(series, lookback, axis=0).transpose(0, 2, 1).reshape(len(series) - lookback + 1, -1)
        by_grids = pipeline["selection"] == "mutual_info" and not pipeline["components"] and x.shape[1] > pipeline["features"]
        grids, same, out = Grids(x, y[lookback:], pipeline.get("bins", 10)), [np.unique(v, return_counts=True)[1].max() for v in series.T], []
        for cutoff in range(minimum + part * block * step, min(minimum + (part + 1) * block * step, n - horizon - gap), step):
            end, t, ask = cutoff - purge, min(cutoff - purge, cutoff - horizon), cutoff + gap
            if end < minimum or t - lookback < 2 or ask < lookback:
                continue
            rows, asked = x[: t - lookback], x[ask - lookback][None]
            if by_grids:
                # scaling moves no value to another cell, but makes columns without a spread 0; that takes one value in half of the rows
                score, n_rows = grids.scores(t - lookback), t - lookback
                for f in np.flatnonzero(np.array(same) > int(n_rows * 0.75) - int(n_rows * 0.25)):
                    s = np.sort(rows[:, f :: len(same)], axis=0)
                    score[f :: len(same)][s[int(n_rows * 0.75)] <= s[int(n_rows * 0.25)]] = 0
                chosen = np.argsort(-score, kind="stable")[: pipeline["features"]]
                rows, asked = rows[:, chosen], asked[:, chosen]
            model = Pipeline(rows, y[lookback:t], **pipeline)
            got = float(model.predict(asked)[0])
            start, goal = float(close[end - 1]), float(close[cutoff + gap + horizon])
            out.append((symbol, cutoff, end, t - lookback, got, float(y[ask]) if gap == 0 else goal / start - 1, start, goal))
        return with_risk(pd.DataFrame(out, columns=names), close, [horizon] * len(out))

    return rows.groupBy("symbol", "part").applyInPandas(run, f"{ASKED}, {RISK}")


def walk_forward_ml(frame: DataFrame, minimum: int = 100, step: int = 5, purge: int = 5, gap: int = 0, block: int = BLOCK, features: int = 20, selection: str = "mutual_info", components: int | None = None, share: float = 0.95, bins: int = 10) -> DataFrame:
    """Rows of PREDICTED: for every ``step``-th cutoff of each symbol of ``frame`` (see ``ml_frame``) the return that a model predicts for it.

    The model is fitted on bars before cutoff - ``purge`` alone, whose targets lie before the cutoff, and asked at bar
    cutoff + ``gap``; fewer than ``minimum`` training bars give no row. With ``components`` its columns are principal
    components of the training rows. ``frame`` may have ``purge`` and ``gap`` as columns, the same in all rows of a symbol. Models of components or F scores come from running sums (``running_ml``), those by
    mutual information are fitted anew (``refitted``). Volatility and Hurst exponent are the forecast's.
    """
    known = frame.schema["y"].metadata
    lookback, kind = known["lookback"], known["kind"]
    frame = frame.withColumns({n: F.lit(v) for n, v in (("purge", purge), ("gap", gap)) if n not in frame.columns})
    if (components and components <= features) or (selection == "f_regression" and not components):
        asked = predictions(frame, lookback, minimum, step, block, features, components, share)
    else:
        asked = refitted(frame, lookback, minimum, step, block, features=features, selection=selection, bins=bins, components=components, share=share)
    if "hurst" not in asked.columns:
        risk = walk_forward(frame.select("symbol", "ts", "close", "horizon", "purge"), minimum=minimum, step=step).select("symbol", "cutoff", "volatility", "hurst")
        ahead = frame.groupBy("symbol").agg(F.first("horizon").alias("horizon"))
        asked = asked.join(risk, ["symbol", "cutoff"]).join(ahead, "symbol")
    return with_prices(asked, kind)


def judged(predicted: DataFrame) -> DataFrame:
    """Adds direction, its outcome, the interval's hit and the error to rows of PREDICTED."""
    c = F.col
    way = F.when(c("predicted_return") > c("volatility") * 0.3, "UP").when(c("predicted_return") < -c("volatility") * 0.3, "DOWN").otherwise("UNCERTAIN")
    was = F.when(c("actual_return") > 0, "UP").when(c("actual_return") < 0, "DOWN").otherwise("FLAT")
    d = predicted.withColumn("direction", way).withColumn("actual_direction", was).withColumn("error", c("predicted_return") - c("actual_return"))
    d = d.withColumn("direction_correct", (c("direction") == c("actual_direction")) | ((c("direction") == "UNCERTAIN") & (c("actual_direction") == "FLAT")))
    width = F.exp(1.96 * c("volatility"))
    return d.withColumn("within", (c("actual_price") >= c("expected_price") / width) & (c("actual_price") <= c("expected_price") * width)).withColumns(return_probabilities(c("predicted_return"), c("volatility")))


def ml_metrics(predicted: DataFrame) -> DataFrame:
    """One row per symbol: observations, direction_accuracy, coverage, mae, rmse, precision, recall, f1 and verdict of rows of PREDICTED."""
    c, right = F.col, F.col("direction_correct")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    up, was = c("direction") == "UP", c("actual_direction") == "UP"
    a = judged(predicted).groupBy("symbol").agg(
        F.count("*").alias("observations"), F.avg(right.cast("double")).alias("direction_accuracy"), F.avg(c("within").cast("double")).alias("coverage"), F.avg(F.abs("error")).alias("mae"), F.sqrt(F.avg(c("error") * c("error"))).alias("rmse"),
        ratio(F.count_if(up & right), F.count_if(up)).alias("precision"), ratio(F.count_if(was & right), F.count_if(was)).alias("recall"),
    )
    a = a.withColumn("f1", ratio(2 * c("precision") * c("recall"), c("precision") + c("recall")))
    acc, cover = c("direction_accuracy"), c("coverage")
    verdict = F.when(c("observations") < 10, "INSUFFICIENT_DATA").when((acc > 0.55) & (c("rmse") < 0.03) & (cover > 0.8), "EXCELLENT").when((acc > 0.52) & (c("rmse") < 0.05) & (cover > 0.7), "GOOD").when(acc > 0.5, "MARGINAL").otherwise("POOR")
    return a.withColumn("verdict", verdict)


def embargo_validation(frame: DataFrame, embargo: int = 5, **options) -> DataFrame:
    """Rows of PREDICTED of models trained up to the cutoff and asked ``embargo`` bars after it; the return counts from the last training close."""
    return walk_forward_ml(frame, purge=0, gap=embargo, **options)


def fold_runs(bars: DataFrame, splits: int, test_splits: int, purge: int, minimum: int, only: str | None = None) -> DataFrame:
    """Training and test parts of every fold (see ``backtest.folds``) as runs of their own, dealt to tasks by run: models take long for their bytes, by which Spark would merge tasks. ``only``: the parts of one role."""
    f = folds(bars, splits, test_splits, purge, minimum)
    f = f.where(F.col("role") == only) if only else f
    return by_run(runs_of(f, fold=F.col("fold"), role=F.col("role")).drop("fold", "role"), bars)


def by_run(runs: DataFrame, bars: DataFrame) -> DataFrame:
    """Bars of ``runs`` in as many tasks as the ``bars`` they come from ask for."""
    tasks = max(bars.sparkSession.sparkContext.defaultParallelism, bars.count() // TASK_BARS + 1)
    return runs.repartition(tasks, "symbol")


def by_fold(metrics: DataFrame, keys: tuple = ("symbol",)) -> tuple[DataFrame, DataFrame]:
    """(a row per fold, test beside training, with their gaps; a row per ``keys``: what the folds come to) of ``metrics`` with fold and role."""
    m, measures = metrics.withColumn("fold", F.col("fold").cast("int")), ("direction_accuracy", "rmse", "coverage")
    side = lambda role: m.where(F.col("role") == role).select(*keys, "fold", *[F.col(c).alias(f"{role}_{c}") for c in ("observations", *measures, "verdict")])
    got = side("train").join(side("test"), [*keys, "fold"])
    for c in measures:
        got = got.withColumn(f"{c}_gap", F.col(f"train_{c}") - F.col(f"test_{c}"))
    sd = {c: F.coalesce(F.stddev_samp(f"test_{c}"), F.lit(0.0)) for c in measures}
    a = got.groupBy(*keys).agg(F.count("*").alias("folds"), F.sum("test_observations").alias("observations"), *[F.avg(f"test_{c}").alias(f"mean_{c}") for c in measures], *[s.alias(f"sd_{c}") for c, s in sd.items()], F.count_if(F.col("test_direction_accuracy") > 0.5).alias("positive"))
    return got, a.withColumn("consistency", F.when(F.col("sd_direction_accuracy") > 0, F.col("mean_direction_accuracy") / F.col("sd_direction_accuracy")).otherwise(0.0))


def purged_kfold_ml(bars: DataFrame, names: list[str], splits: int = 5, test_splits: int = 1, purge: int = 10, horizon: int = 5, minimum: int = 100, lookback: int = 60, kind: str = "return", **options) -> tuple[DataFrame, DataFrame]:
    """(a row per symbol and fold: the metrics of walk-forward models inside its training and inside its test part, and their gaps; a row per symbol: means and deviations of the test metrics, folds right more than half the time, consistency)."""
    modelled = lambda series: walk_forward_ml(ml_frame(series, names, lookback, horizon, kind), minimum=minimum, purge=0, **options)
    if OF_WHOLE & set(names):
        predicted = modelled(fold_runs(bars, splits, test_splits, purge, minimum))
    else:
        predicted = modelled(fold_runs(bars, splits, test_splits, purge, minimum, "test"))
        predicted = predicted.unionByName(of_prefixes(modelled(longest_prefix(bars, splits, test_splits, purge, minimum)), splits, test_splits, purge, minimum, horizon))
    return by_fold(kept(of_runs(ml_metrics(predicted), "fold", "role")))


#: Features of a bar that read later bars too: those of a prefix of a series are not the series' own.
OF_WHOLE = {"roll_spread"}


def longest_prefix(bars: DataFrame, splits: int, test_splits: int, purge: int, minimum: int) -> DataFrame:
    """The longest training part of ``folds``, which begins with all others, as a run of its symbol and the size of a block."""
    w = Window.partitionBy("symbol")
    b = bars.withColumn("idx", F.row_number().over(w.orderBy("ts")) - 1).withColumn("size", F.floor(F.count("*").over(w) / splits))
    n = F.col("size") * (splits - test_splits) - purge
    return by_run(runs_of(b.where((n >= minimum) & (F.col("idx") < n)), size=F.col("size")).select(bars.columns), bars)


def of_prefixes(predicted: DataFrame, splits: int, test_splits: int, purge: int, minimum: int, horizon: int) -> DataFrame:
    """Rows of PREDICTED of every training part from those of ``longest_prefix``: a model sees the bars before its cutoff alone, so it is a part's as long as its outcome lies in the part."""
    d = of_runs(predicted, "size")
    end = lambda i: F.col("size").cast("long") * i - purge
    of_fold = [F.when((end(i) >= minimum) & (F.col("cutoff") < end(i) - horizon), F.lit(i)) for i in range(splits - test_splits + 1)]
    d = d.withColumn("fold", F.explode(F.filter(F.array(*of_fold), lambda i: i.isNotNull())))
    return runs_of(d, fold=F.col("fold"), role=F.lit("train")).select(predicted.columns)


def every_run(bars: DataFrame, names: list[str], horizons: tuple, lookback: int, purge: int, gap: int, splits: int, minimum: int, kind: str) -> DataFrame:
    """A frame for ``walk_forward_ml`` in which every horizon, validation and part of a fold is a run, a series of its own."""
    named = lambda rows, name, gaps: with_target(rows, lookback, horizons, kind).withColumns({"validation": F.lit(name), "purge": F.lit(gaps[0]), "gap": F.lit(gaps[1])})
    rows = kept(ml_rows(bars, names))
    frame = named(rows, "walk_forward", (purge, 0)).unionByName(named(rows, "embargo", (0, gap)))
    # runs have the parts of a fold's run, so that all are told apart in one way
    frame = runs_of(frame, fold=F.lit(0), role=F.lit("test"), validation=F.col("validation"), horizon=F.col("horizon"))
    cv = named(ml_rows(fold_runs(bars, splits, 2, purge * 2, minimum), names), "purged_kfold", (0, 0))
    frame = frame.unionByName(runs_of(cv, validation=F.col("validation"), horizon=F.col("horizon"))).drop("validation")
    return frame.withColumn("y", F.col("y").alias("y", metadata={"lookback": lookback, "kind": kind}))


def shared_runs(bars: DataFrame, names: list[str], horizons: tuple, lookback: int, purge: int, gap: int, splits: int, minimum: int, kind: str, components: int, step: int = 5, block: int = BLOCK, features: int = 20, selection: str = "mutual_info", share: float = 0.95, bins: int = 10) -> DataFrame:
    """Rows of PREDICTED of all runs of ``every_run``, without a series for each: a model's components depend on its training rows alone, so runs with the same rows share them.

    The training part of a fold is a prefix of the series, and its predictions are those of the series (asked without
    purge and gap) as long as their outcome lies in the prefix. Test parts are series of their own, as are training
    parts where a feature reads later bars (``OF_WHOLE``).
    """
    ascending, own = sorted(horizons), bool(OF_WHOLE & set(names))
    parts = fold_runs(bars, splits, 2, purge * 2, minimum, None if own else "test")
    of_fold = [F.when((F.lit(not own)) & (F.floor(F.col("bars") / splits) * i - purge * 2 >= minimum) & (F.col("cutoff") < F.floor(F.col("bars") / splits) * i - purge * 2 - F.col("horizon")), F.concat_ws(KEY, "symbol", F.lit(str(i)), F.lit("train"))) for i in range(splits - 1)]
    none = F.lit(None).cast("string")
    whole = [("walk_forward", h, purge, 0) for h in horizons] + [("embargo", h, 0, gap) for h in horizons] + [("purged_kfold", h, 0, 0) for h in horizons]
    out = None
    for series, runs, prefixes in ((bars, whole, True), (parts, [("purged_kfold", h, 0, 0) for h in horizons], False)):
        frame = ml_rows(series, names)
        frame = frame.withColumn("y", F.array(*[target(h, kind) for h in ascending]))
        d = predictions(frame, lookback, minimum, step, block, features, components, share, [run[1:] for run in runs])
        at = lambda i: F.element_at(F.array(*[F.lit(run[i]) for run in runs]), F.col("run") + 1)  # noqa: B023, E731
        alone = "hurst" in d.columns
        d = d.withColumns({"validation": at(0), "horizon": at(1), "purge": at(2)})
        risk = None
        for p in [] if alone else sorted({run[2] for run in runs}):
            r = walk_forward(series, horizon=min(horizons), minimum=minimum, step=step, purge=p).select("symbol", "cutoff", F.lit(p).alias("purge"), "volatility", "hurst")
            risk = r if risk is None else risk.unionByName(r)
        d = d if alone else d.join(risk, ["symbol", "cutoff", "purge"])
        keys = F.when(F.col("validation") == "purged_kfold", F.array(*of_fold)).otherwise(F.array(F.concat_ws(KEY, "symbol", F.lit("0"), F.lit("test")), none)) if prefixes else F.array("symbol")
        d = d.withColumn("key", F.explode(F.filter(keys, lambda k: k.isNotNull())))
        d = d.withColumn("symbol", F.concat_ws(KEY, "key", "validation", F.col("horizon").cast("string"))).select("symbol", "horizon", "volatility", "hurst", *[c.split()[0] for c in ASKED.split(", ") if not c.startswith("symbol")])
        out = d if out is None else out.unionByName(d)
    return with_prices(out, kind)


def with_prices(asked: DataFrame, kind: str) -> DataFrame:
    """Rows of PREDICTED of rows of ASKED with the horizon and the forecast's volatility and Hurst exponent."""
    said = F.col("predicted_return")
    said = {"return": said, "direction": F.when(said > 0.5, 0.01).otherwise(-0.01), "volatility": F.lit(0.0)}[kind]
    out = asked.withColumn("predicted_return", said)
    return out.select("symbol", "cutoff", "train_end", "train_rows", "predicted_return", "actual_return", (F.col("start_price") * F.exp("predicted_return")).alias("expected_price"), "actual_price", (F.col("volatility") * F.sqrt("horizon")).alias("volatility"), "hurst")


def comprehensive_validation(bars: DataFrame, names: list[str], horizons: tuple = (1, 3, 5, 10, 20), lookback: int = 60, purge: int = 5, embargo: int = 2, splits: int = 5, minimum: int = 100, kind: str = "return", components: int | None = 10, **options) -> tuple[DataFrame, DataFrame]:
    """(a row per symbol, horizon and validation: metrics of walk-forward, embargo and k-fold models; a row per symbol: their averages over the horizons of the walk-forward ones and how many horizons are right more than half the time).

    K-fold: two of ``splits`` blocks are the test part, the purge is doubled, a row has the means over the test parts
    (observations: their sum). Features are computed once for all horizons, and every model of every horizon and
    validation is a run of one pass; components are found once for all runs with the same training rows.
    """
    if components and components <= options.get("features", 20):
        predicted = shared_runs(bars, names, horizons, lookback, purge, embargo * 3, splits, minimum, kind, components, **options)
    else:
        predicted = walk_forward_ml(every_run(bars, names, horizons, lookback, purge, embargo * 3, splits, minimum, kind), minimum=minimum, components=components, **options)
    m = kept(of_runs(ml_metrics(predicted), "fold", "role", "validation", "horizon").withColumn("horizon", F.col("horizon").cast("int")))
    cv = by_fold(m.where("validation = 'purged_kfold'"), ("symbol", "horizon"))[1]
    cv = cv.select("symbol", "horizon", F.lit("purged_kfold").alias("validation"), "observations", *[F.col(f"mean_{c}").alias(c) for c in ("direction_accuracy", "rmse", "coverage")])
    every = m.where("validation <> 'purged_kfold'").drop("fold", "role").unionByName(cv, allowMissingColumns=True)
    acc = F.col("direction_accuracy")
    walk = every.where("validation = 'walk_forward' and observations > 0").groupBy("symbol").agg(F.avg(acc).alias("direction_accuracy"), F.avg("rmse").alias("rmse"), F.avg("coverage").alias("coverage"), F.count_if(acc > 0.5).alias("consistent"), F.count("*").alias("horizons"))
    return every, walk
