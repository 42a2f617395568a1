"""Work that a query does once: what is derived is not derived again for each reader."""

from test_market import frame

from barloom.operators import backtest as B
from barloom.plans.testbed import bars
from barloom.sources import pages as P
from barloom.streaming.jobs import Track


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_page_and_its_rows_are_searched_once(spark):
    html = '<table>\n<tr><td data-order="86400">day</td><td>1</td><td>1,200</td><td>3</td><td>4</td><td>5%</td></tr>\n<tr><td data-order="1">x</td><td>n/a</td></tr></table>'
    d = P.parse_history_pages(spark.createDataFrame([("A", html), ("B", None)], "symbol string, html string"))
    assert plan(d).count("regexp_extract_all") == 2
    assert [(r.symbol, r.ts.day, r.open, r.high, r.volume) for r in d.collect()] == [("A", 2, 1.0, 1200.0, 5.0)]


def test_metrics_run_the_forecasts_once(spark):
    b = frame(spark, [100.0 + i + i * 37 % 11 for i in range(90)])
    m = B.backtest_metrics(B.simulate_trades(B.walk_forward(b), edge=0.0))
    assert plan(m).count("FlatMapGroupsInPandas") == 1


def test_bars_are_dealt_once(spark):
    d = bars(spark, "/root/testdata/sf0.001")
    assert d._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


class Value:
    def __init__(self):
        self.v, self.calls = None, 0

    def exists(self):
        self.calls += 1
        return self.v is not None

    def get(self):
        self.calls += 1
        return self.v

    def update(self, v):
        self.calls += 1
        self.v = v

    def clear(self):
        self.v = None


def test_a_batch_of_a_stream_touches_its_state_a_few_times():
    import pandas as pd

    class Handle:
        def __init__(self):
            self.states = {}

        def getValueState(self, name, _):  # noqa: N802
            return self.states.setdefault(name, Value())

        def registerTimer(self, _):  # noqa: N802
            pass

    class Times:
        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 50 * 86_400_000

    h, t = Handle(), Track(lambda s, c, v: ([c + (s[0] if s else 0)], (c,)), ["made"])
    t.init(h)
    ts = pd.to_datetime([d * 86_400_000_000 for d in reversed(range(100))], unit="us")
    list(t.handleInputRows(("A",), iter([pd.DataFrame({"ts": ts, "close": range(100), "volume": 1.0})]), None))
    (out,) = t.handleExpiredTimer(("A",), Times(), None)
    assert out["close"].tolist() == list(range(99, 48, -1)) and len(h.states["waiting"].v[0]) == 49
    assert sum(s.calls for s in h.states.values()) < 12


def test_chunks_come_as_bars_not_as_arrays_of_them(spark):
    from barloom.operators.cleaning import bad_print_step
    from barloom.operators.series import speculative

    d = speculative(frame(spark, [100.0 + i for i in range(30)]), bad_print_step(), "rejected boolean", 60)
    assert dict(d.dtypes)["ts"] == "timestamp" and dict(d.dtypes)["rejected"] == "boolean" and d.count() == 30
