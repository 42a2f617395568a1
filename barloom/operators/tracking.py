"""Predictions from storage to outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import add_trading_days


def store_predictions(forecasts: DataFrame, model: str = "ENSEMBLE") -> DataFrame:
    """PENDING records of forecast rows (symbol, last_ts, horizon, last_price, expected_return, expected_price, lower, upper). The id is a hash, so storing twice gives the same id."""
    f = forecasts.withColumn("id", F.sha2(F.concat_ws("|", "symbol", F.unix_millis("last_ts").cast("string"), F.col("horizon").cast("string"), F.lit(model)), 256))
    return f.select("id", "symbol", F.col("last_ts").alias("ts"), "horizon", F.col("last_price").alias("anchor_price"), "expected_return", "expected_price", "lower", "upper", add_trading_days(F.col("last_ts"), F.col("horizon")).alias("expiry"), F.lit("PENDING").alias("status"))


def resolve_outcomes(predictions: DataFrame, bars: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Each pending prediction with the first bar at or after its expiry: a forward as-of join on one ordered stream of events.

    ``as_of`` (now, if not given): predictions that expire later stay PENDING, and later bars are not looked at.
    """
    as_of = F.current_timestamp() if as_of is None else as_of
    bars = bars.where(F.col("ts") <= as_of)
    p = predictions.where("status = 'PENDING'").select("symbol", F.col("expiry").alias("at"), F.struct(*predictions.columns).alias("p"))
    b = bars.select("symbol", F.col("ts").alias("at"), F.struct("ts", "close").alias("b"))
    events = p.withColumn("b", F.lit(None).cast(b.schema["b"].dataType)).unionByName(b.withColumn("p", F.lit(None).cast(p.schema["p"].dataType)))
    ahead = Window.partitionBy("symbol").orderBy("at", F.col("p").isNull()).rowsBetween(0, Window.unboundedFollowing)
    r = events.withColumn("first_bar", F.first("b", True).over(ahead)).where("p is not null").select("p.*", F.col("first_bar.ts").alias("actual_ts"), F.col("first_bar.close").alias("actual_price"))
    found = F.col("actual_price").isNotNull()
    r = r.withColumn("actual_return", F.col("actual_price") / F.col("anchor_price") - 1).withColumn("status", F.when(found, "RESOLVED").when(F.col("expiry") <= as_of, "EXPIRED_NO_DATA").otherwise("PENDING"))
    r = r.withColumn("direction_correct", F.signum("expected_return") == F.signum("actual_return")).withColumn("in_interval", (F.col("actual_price") >= F.col("lower")) & (F.col("actual_price") <= F.col("upper")))
    return r.withColumn("absolute_error", F.abs(F.col("actual_return") - F.col("expected_return")))


def statistics(outcomes: DataFrame, sets: str) -> DataFrame:
    """Counts and accuracy by grouping sets, e.g. ``((symbol), (symbol, horizon))``; ``level`` tells the sets apart."""
    name = "outcomes_by_sets"
    return outcomes.sparkSession.sql(
        f"""select symbol, horizon, cast(grouping_id(symbol, horizon) as bigint) as level, count(*) as total, count_if(status = 'RESOLVED') as resolved, count_if(status = 'EXPIRED_NO_DATA') as expired,
            avg(cast(direction_correct as int)) as direction_accuracy, avg(cast(in_interval as int)) as coverage, avg(absolute_error) as mae, sqrt(avg(absolute_error * absolute_error)) as rmse
            from {{{name}}} group by grouping sets {sets}""",
        **{name: outcomes},
    )


def list_predictions(predictions: DataFrame, status: str | None = None, limit: int = 100) -> DataFrame:
    """The newest ``limit`` predictions of each symbol, of one status if given."""
    p = predictions.where(F.col("status") == status) if status else predictions
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"), "horizon", "id")
    return p.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= limit).drop("nth")


def manual_resolve(predictions: DataFrame, prices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved predictions, rejected prices) for supplied prices (symbol, id, price): unknown ids and predictions that aren't pending are rejected."""
    pending = predictions.where("status = 'PENDING'")
    done = pending.join(prices, ["symbol", "id"]).withColumn("status", F.lit("RESOLVED")).withColumn("actual_return", F.col("price") / F.col("anchor_price") - 1)
    return done, prices.join(pending.select("symbol", "id"), ["symbol", "id"], "left_anti")
