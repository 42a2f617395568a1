"""Work of models that is done once for all that share it, and tasks whose size doesn't grow with the input."""

import numpy as np
import pytest

from barloom.operators import running_ml as R
from barloom.plans import testbed

@pytest.mark.parametrize("share", [0.95, 0.3])
def test_leading_components_are_those_of_all_eigenvalues(share):
    x, guess = np.random.default_rng(3).normal(size=(500, 300)) * 0.97 ** np.arange(300), None
    for n in (100, 105, 400):
        a = np.cov(x[:n].T)
        value, vector, guess = R.leading(a, 10, share, guess)
        w, v = np.linalg.eigh(a)
        w, v = w[::-1], v[:, ::-1]
        k = min(10, int(np.searchsorted(np.cumsum(w / w.sum()), share - 1e-12) + 1))
        assert len(value) == k
        np.testing.assert_allclose(value, w[:k], rtol=1e-9)
        np.testing.assert_allclose(vector @ vector.T, v[:, :k] @ v[:, :k].T, atol=1e-7)


def test_a_filter_takes_the_place_of_all_eigenvalues(monkeypatch):
    a, whole = np.cov(np.random.default_rng(3).normal(size=(500, 300)).T * 0.97 ** np.arange(300)[:, None]), []
    eigh = np.linalg.eigh
    monkeypatch.setattr(np.linalg, "eigh", lambda m: whole.append(len(m)) or eigh(m))
    R.leading(a, 10, 0.95)
    assert max(whole) == 20
    R.leading(np.zeros((300, 300)), 10, 0.95)  # nothing to filter
    assert max(whole) == 300


def test_runs_with_the_same_training_rows_meet():
    runs = [(h, p, g) for h in (1, 3, 5, 10, 20) for p, g in ((5, 0), (0, 6), (0, 0))]
    p, n = R.Plan(60, 0, 100, 5, 0, 0, 16, runs), 533
    got = [(t, *q) for part in range(p.parts(n)) for t, asked in p.asked(part, n).items() for q in asked]
    want = []
    for i, (h, purge, gap) in enumerate(runs):
        one = R.Plan(60, h, 100, 5, purge, gap, 16)
        want += [(c - max(h, purge), i, c) for part in range(one.parts(n)) for asked in one.asked(part, n).values() for _, c in asked]
        assert [c for _, k, c in sorted(want) if k == i] == [c for c in range(100, n - h - gap, 5) if c - purge >= 100]
    assert sorted(got) == sorted(want) and len({t for t, *_ in got}) < len(got) / 4


def test_tasks_of_bars_grow_with_the_lines(spark, monkeypatch):
    monkeypatch.setattr(testbed, "TASK_LINES", 500)
    d = testbed.bars(spark, "/root/testdata/sf0.001")
    lines = testbed.table(spark, "/root/testdata/sf0.001", "lineitem").count()
    assert d.rdd.getNumPartitions() == lines // 500 + 1 > 10


def test_moments_of_returns_are_arithmetic_on_a_row(spark):
    from test_market import frame

    from barloom.operators import features as X

    g = np.random.default_rng(7)
    ret = np.concatenate([g.normal(size=40) * 0.02 + 0.5, np.full(25, np.log(2.0)), g.normal(size=30) * 1e-4])
    close = 100 * np.exp(np.cumsum(np.concatenate([[0.0], ret - 0.5])))
    got = X.compute_features(frame(spark, close.tolist()), ["ret_skew_kurt_w"])
    assert "skewness" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows, r = got.orderBy("ts").collect(), np.diff(np.log(close))
    for w in (5, 10, 20):
        assert rows[w - 1][f"ret_skew_{w}"] is None
        for row in [x for x in rows if x.idx >= w and not 41 <= x.idx <= 65]:
            d = r[row.idx - w : row.idx] - r[row.idx - w : row.idx].mean()
            s = d.std(ddof=1)
            np.testing.assert_allclose([row[f"ret_skew_{w}"], row[f"ret_kurt_{w}"]], [(d**3).mean() / s**3, (d**4).mean() / s**4 - 3], atol=1e-8)
    still = X.compute_features(frame(spark, [100.0] * 30), ["ret_skew_kurt_w"]).orderBy("ts").collect()[-1]
    assert still.ret_skew_20 == 0 and still.ret_kurt_20 == 0


def shuffled(spark):
    """Rows written to shuffles so far."""
    jvm, sc = spark._jvm, spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_a_series_of_one_block_sends_no_sums(spark):
    from pyspark.sql import functions as F

    from test_market import frame

    from barloom.operators import ml as L
    from barloom.operators.series import kept

    b = frame(spark, [100.0 + i % 17 + i % 5 for i in range(200)], [1000.0 + i * 37 % 11 for i in range(200)])
    f = kept(L.ml_frame(b, ["rsi_14", "hl_spread"], lookback=6).withColumns({"purge": F.lit(5), "gap": F.lit(0)}))
    cut = sorted(R.predictions(f, 6, 40, 5, 4, 4, None, 0.95).collect())
    before = shuffled(spark)
    whole = sorted(R.predictions(f, 6, 40, 5, 128, 4, None, 0.95).collect())
    assert shuffled(spark) - before <= 210  # the bars and a count, no sums
    assert len(whole) == len(cut) > 20
    assert all(x[:4] == y[:4] and abs(x.predicted_return - y.predicted_return) < 1e-9 for x, y in zip(whole, cut, strict=True))


def test_runs_of_folds_are_tasks_of_their_own(spark, monkeypatch):
    from test_market import frame

    from barloom.operators import ml as L

    monkeypatch.setattr(L, "TASK_BARS", 60)
    d = L.fold_runs(frame(spark, [100.0 + i % 17 for i in range(600)]), 5, 1, 10, 100)
    assert d.rdd.getNumPartitions() == 11


def test_training_parts_of_folds_come_from_one_series(spark, monkeypatch):
    from test_market import frame

    from barloom.operators import ml as L

    close = 100 * np.exp(np.cumsum(np.random.default_rng(2).normal(0, 0.02, 330)))
    bars = frame(spark, close.tolist())
    made, whole = [], L.walk_forward_ml
    monkeypatch.setattr(L, "walk_forward_ml", lambda *a, **o: made.append(whole(*a, **o)) or made[-1])
    options = {"lookback": 4, "minimum": 50, "features": 4}
    digits = lambda row: [round(v, 9) if isinstance(v, float) else v for v in row]  # noqa: E731 # sums of rows in another order
    found = lambda: [sorted(map(digits, d.collect())) for d in L.purged_kfold_ml(bars, ["rsi_14", "hl_spread"], **options)]
    once = found()
    assert len(made) == 2 and sum(d.count() for d in made) < 60
    monkeypatch.setattr(L, "OF_WHOLE", {"rsi_14"})  # each part as a series of its own
    alone = found()
    assert made[2].count() > 80 and once == alone and len(once[0]) == 4
