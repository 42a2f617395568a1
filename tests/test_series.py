"""Series in buckets against plain loops: scans, speculative chunks, ranks."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import cleaning as C
from barloom.operators import features as X
from barloom.operators import series as S
from barloom.operators import signals as G
from barloom.operators import stats as T

r = np.random.default_rng(12)
N = 400
DAY = dt.datetime(2000, 1, 1)


def prices(seed):
    g = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(0.01 * g.normal(size=N)))
    volume = g.integers(1, 50, size=N) * 1000.0
    hit = g.random(N) < 0.04
    close[hit] *= 1.6
    close[120:150] *= 1.4  # a run of rejects over several cuts
    volume[120:150] = 1000.0
    return close, volume


SERIES = {s: prices(i) for i, s in enumerate(("A", "B"))}


@pytest.fixture(scope="module")
def bars(spark):
    gap = lambda i: i + (200 if i >= 300 else 0)  # noqa: E731  buckets without a bar
    rows = [(s, DAY + dt.timedelta(days=gap(i)), float(c), float(v)) for s, (close, volume) in SERIES.items() for i, (c, v) in enumerate(zip(close, volume, strict=True))]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, close double, volume double").repartition(5).cache()


def by_symbol(df, *names):
    got = {}
    for x in df.orderBy("symbol", "ts").collect():
        got.setdefault(x.symbol, []).append([x[n] for n in names])
    return got


@pytest.mark.parametrize("days", [7, 45, 3650])
def test_bad_prints_are_those_of_one_loop_whatever_the_buckets(bars, days):
    got = by_symbol(C.flag_bad_prints(bars, bucket_days=days), "close", "rejected")
    rejects = 0
    for s, (close, volume) in SERIES.items():
        accepted, want = [], []
        for i, (c, v) in enumerate(zip(close.tolist(), volume.tolist(), strict=True)):
            last, before, bad = accepted[-5:], volume[max(0, i - 20) : i].tolist(), False
            if len(last) >= 2:
                m = sum(last) / len(last)
                sd = math.sqrt(sum((x - m) ** 2 for x in last) / len(last))
                bad = sd > 0 and abs(c - m) > 3 * sd and v / (sum(before) / len(before)) < 2
            want.append([c, bad])
            accepted += [] if bad else [c]
        assert got[s] == want
        rejects += sum(w[1] for w in want)
    assert rejects > 20


@pytest.mark.parametrize("days", [11, 3650])
def test_tracks_and_their_smoothing_are_those_of_one_loop(bars, days):
    got = by_symbol(T.kalman_track(bars, days), "filtered", "innovation", "covariance", "noise", "smoothed")
    for s, (close, volume) in SERIES.items():
        state, rows = None, []
        for c, v in zip(close.tolist(), volume.tolist(), strict=True):
            state, innovation = T.kalman_step(state, c, v)
            rows.append([state[1], innovation, state[2], state[3]])
        smooth = [rows[-1][0]]
        for f, _, p, q in rows[-2::-1]:
            smooth.append(f + p / (p + q) * (smooth[-1] - f))
        np.testing.assert_allclose(got[s], [[*x, y] for x, y in zip(rows, smooth[::-1], strict=True)], rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("keep", [0.02, 0.85, 0.999, 1.0])
@pytest.mark.parametrize("chunk", [5, 4096])
def test_scan_of_an_affine_recursion(bars, monkeypatch, keep, chunk):
    monkeypatch.setattr(S, "CHUNK", chunk)
    got = by_symbol(S.affine_scan(S.bucketed(bars, 30), keep, F.col("close")), "h", "idx", "ret")
    for s, (close, _) in SERIES.items():
        h, want = 0.0, []
        for c in close:
            h = keep * h + c
            want.append(h)
        np.testing.assert_allclose([x[0] for x in got[s]], want, rtol=1e-11)
        assert [x[1] for x in got[s]] == list(range(N)) and got[s][0][2] is None
        np.testing.assert_allclose([x[2] for x in got[s][1:]], np.diff(np.log(close)), rtol=1e-9, atol=1e-15)


@pytest.mark.parametrize("expanding", [False, True])
def test_conditional_volatility_in_many_buckets(bars, expanding):
    got = by_symbol(X.garch_vol(bars, expanding=expanding, bucket_days=25), "garch_vol")
    for s, (close, _) in SERIES.items():
        ret = np.diff(np.log(close))
        n = np.arange(1, N)
        mean = np.cumsum(ret) / n if expanding else np.full(N - 1, ret.mean())
        var = np.array([ret[:k].var(ddof=1) if k > 1 else 0.0 for k in n]) if expanding else np.full(N - 1, ret.var(ddof=1))
        h, want = var[0], []
        for x, m, v in zip(ret, mean, var, strict=True):
            h = v * 0.05 + 0.1 * (x - m) ** 2 + 0.85 * h
            want.append(math.sqrt(max(h, 1e-10)))
        assert got[s][0] == [None]
        np.testing.assert_allclose([x[0] for x in got[s][1:]], want, rtol=1e-8)


def test_ranks_are_those_of_one_sort(spark):
    scores = [float(x) for x in np.round(r.normal(size=500), 1)] + [None, None]
    got = G.ranked(spark.createDataFrame([(i, x) for i, x in enumerate(scores)], "i int, score double").repartition(7)).collect()
    for x in got:
        assert x.rank == 1 + sum(y is not None and (x.score is None or y > x.score) for y in scores)
