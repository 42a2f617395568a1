"""Structured Streaming forms of batch operators. Each gives the batch operator's rows once its input has ended."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.cleaning import bad_print_step
from ..operators.stats import kalman_chunk_step

BAR = "symbol string, ts timestamp, close double, volume double"


def stream_quotes_dedupe(quotes: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """One quote per symbol and time; a repeat inside the delay is dropped."""
    return quotes.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["symbol", "ts"])


def stream_quote_bars(quotes: DataFrame, width: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Bars of quotes (symbol, ts, close, volume) by window of event time, sent out when the watermark has passed them."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = quotes.withWatermark("ts", delay).groupBy(w, "symbol").agg(
        F.min_by("close", "ts").alias("open"), F.max("close").alias("high"), F.min("close").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    )
    return g.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def stream_reconcile(primary: DataFrame, baseline: DataFrame, tolerance: float = 0.001, delay: str = "1 day") -> DataFrame:
    """Left outer stream-stream join on symbol and time; a bar without a match goes out once its match can't come any more."""
    p = primary.withWatermark("ts", delay).alias("p")
    b = baseline.select(F.col("symbol").alias("b_symbol"), F.col("ts").alias("b_ts"), F.col("close").alias("base_close")).withWatermark("b_ts", delay).alias("b")
    j = p.join(b, (F.col("symbol") == F.col("b_symbol")) & (F.col("ts") == F.col("b_ts")), "leftOuter")
    gap = F.when(F.col("base_close") == 0, 0.0).otherwise(F.abs(F.col("close") - F.col("base_close")) / F.abs("base_close"))
    anomaly = F.coalesce(gap > tolerance, F.lit(False))
    return j.select("symbol", "ts", F.when(anomaly, F.col("base_close")).otherwise(F.col("close")).alias("close"), gap.alias("divergence_score"), anomaly.alias("anomaly"))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Track(StatefulProcessor):
    """A step over each symbol's bars in order of event time, whatever the order in which they come.

    State on the RocksDB store: ``waiting``, the bars that the watermark has not passed, as one value of arrays in the
    order in which they came, so that a batch reads and writes it once however many bars it has (each access goes from
    Python to the JVM and back); ``now``, what the step keeps. A timer at the first waiting bar takes all that the
    watermark has passed through the step; what is later than the watermark allows is dropped by Spark before it gets here.
    """

    def __init__(self, step: Callable, columns: list[str]):
        self.step, self.columns = step, columns

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "ts array<long>, close array<double>, volume array<double>")
        self.now = handle.getValueState("now", "numbers array<double>")

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["symbol", "ts", "close", "volume", *self.columns])
        return out.astype({"symbol": "object"}).assign(ts=pd.to_datetime(out["ts"], unit="us"))

    def held(self) -> list[list]:
        got = self.waiting.get() if self.waiting.exists() else None
        return [list(x) for x in got] if got else [[], [], []]

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        bars, first = self.held(), None
        for pdf in rows:
            came = pdf["ts"].astype("datetime64[us]").astype("int64").tolist(), pdf["close"].tolist(), pdf["volume"].tolist()
            for have, new in zip(bars, came, strict=True):
                have += new
            first = min([*came[0], *([] if first is None else [first])], default=None)
        if first is not None:
            self.waiting.update(tuple(bars))
            self.handle.registerTimer(-(-first // 1000))
        yield self.frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ts, closes, volumes = self.held()
        order = sorted(range(len(ts)), key=ts.__getitem__)  # stable: of one time, in order of arrival
        n = sum(at <= passed for at in ts)
        state, out = list(self.now.get()[0]) if n and self.now.exists() else None, []
        for i in order[:n]:
            state, made = self.step(state, closes[i], volumes[i])
            out.append((key[0], ts[i], closes[i], volumes[i], *made))
        if out:
            self.now.update((state,))
            left = order[n:]
            if left:
                self.waiting.update(tuple([x[i] for i in left] for x in (ts, closes, volumes)))
            else:
                self.waiting.clear()
        if n < len(order):
            self.handle.registerTimer(-(-ts[order[n]] // 1000))
        yield self.frame(out)

    def close(self) -> None:
        pass


def tracked(bars: DataFrame, step: Callable, out: str, delay: str) -> DataFrame:
    bars.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    b = bars.select("symbol", "ts", "close", "volume").withWatermark("ts", delay)
    return b.groupBy("symbol").transformWithStateInPandas(Track(step, [c.split()[0] for c in out.split(", ")]), f"{BAR}, {out}", "Append", "eventTime")


def stream_bad_prints(bars: DataFrame, window: int = 5, volume_window: int = 20, sigma: float = 3.0, delay: str = "1 day") -> DataFrame:
    """``flag_bad_prints`` on a stream of bars (BAR), sent out once the watermark has passed them; bars up to ``delay`` late are put in their place."""
    return tracked(bars, bad_print_step(window, volume_window, sigma), "rejected boolean", delay)


def stream_kalman(bars: DataFrame, delay: str = "1 day") -> DataFrame:
    """``kalman_track`` without the smoothed column on a stream of bars (BAR), sent out once the watermark has passed them."""
    return tracked(bars, kalman_chunk_step, "filtered double, innovation double, covariance double, noise double", delay).drop("volume")


PENDING = "id string, symbol string, ts timestamp, expiry timestamp, anchor_price double, expected_return double, lower double, upper double"


def stream_resolve(predictions: DataFrame, bars: DataFrame, tolerance_days: int = 7, delay: str = "1 day") -> DataFrame:
    """``resolve_outcomes`` on streams of predictions (PENDING) and bars (BAR), in any order inside ``delay``.

    A left outer interval join: a prediction meets the symbol's bars from its expiry to ``tolerance_days`` later, and goes
    out alone once the watermark says that none can come. Of its bars the earliest resolves it: an aggregate that is
    final when the watermark has passed the interval, so a bar that comes late still counts. State holds the predictions
    and bars of the open intervals, by symbol and time.
    """
    p = predictions.withWatermark("expiry", delay)
    b = bars.select(F.col("symbol").alias("b_symbol"), F.col("ts").alias("b_ts"), F.col("close").alias("b_close")).withWatermark("b_ts", delay)
    inside = (F.col("b_ts") >= F.col("expiry")) & (F.col("b_ts") <= F.col("expiry") + F.expr(f"interval {tolerance_days} days"))
    j = p.join(b, (F.col("symbol") == F.col("b_symbol")) & inside, "leftOuter")
    # one event time goes on: that of the expiry
    j = j.select("id", "symbol", "expiry", "anchor_price", "lower", "upper", F.unix_micros("b_ts").alias("at"), "b_close")
    g = j.groupBy("id", "symbol", "expiry", "anchor_price", "lower", "upper").agg(F.min("at").alias("at"), F.min_by("b_close", "at").alias("actual_price"))
    price = F.col("actual_price")
    return g.select(
        "id", "symbol", "expiry", F.when(F.col("at").isNotNull(), "RESOLVED").otherwise("EXPIRED_NO_DATA").alias("status"), F.timestamp_micros("at").alias("actual_ts"), "actual_price",
        (price / F.col("anchor_price") - 1).alias("actual_return"), price.between(F.col("lower"), F.col("upper")).alias("in_interval"),
    )
