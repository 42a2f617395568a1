"""Streaming jobs as queries: the derived tables are written as files, streamed through the job, and the sink's rows are the result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cleaning import by_time
from ..operators.series import kept, shared_dir
from ..streaming import jobs as J
from . import q_model as Q
from . import recursive_sql as R
from .q_market import BASE, QUOTES, baseline, c, quotes
from .testbed import BARS, MS, bars, ms, rounded, sql_rounded

#: After all of the tables' times, so that the watermark passes every row.
END = "2030-01-01"
#: Rows of a file at least, so that a batch is as many files as a trigger takes and none of them is empty.
FILE_ROWS = 1_000
#: Batches of a stream before the one that ends it.
BATCHES = 3


def streamed(job, *inputs: DataFrame, time: str = "ts", late: int = 0) -> DataFrame:
    """What ``job`` sends out for ``inputs``, which come as three batches of ``time``, and a batch that ends them.

    ``late``: days by which some rows (chosen by hash) come late, so that batches overlap.
    """
    spark = inputs[0].sparkSession
    at = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    streams = []
    for k, df in enumerate(inputs):
        df = kept(df)  # a table is derived once, not again for its range and every batch
        low, high = df.agg(F.min(time), F.max(time)).first()
        came = F.col(time) + F.when(F.pmod(F.xxhash64(time), F.lit(3)) == 0, F.expr(f"interval {late} days")).otherwise(F.expr("interval 0 days"))
        n = F.least(F.lit(BATCHES - 1), F.floor(BATCHES * (F.unix_micros(came) - F.unix_micros(F.lit(low))) / (F.unix_micros(F.lit(high)) - F.unix_micros(F.lit(low)) + 1)))
        end = df.limit(1).withColumns({x: F.lit(END).cast("timestamp") for x, kind in df.dtypes if kind == "timestamp"}).withColumn("symbol", F.lit("END"))
        df = df.withColumn("batch", n)
        rows = {r.batch: r.rows for r in df.groupBy("batch").agg(F.count("*").alias("rows")).collect()}  # a row for each batch
        files = max(1, min(spark.sparkContext.defaultParallelism, min(rows.values(), default=0) // FILE_ROWS))
        for b in sorted(rows):
            df.where(F.col("batch") == b).drop("batch").repartition(files).write.mode("append").parquet(f"{at}/in{k}")
        end.select(*inputs[k].columns).coalesce(1).write.mode("append").parquet(f"{at}/in{k}")
        streams.append(spark.readStream.schema(inputs[k].schema).option("maxFilesPerTrigger", files).parquet(f"{at}/in{k}"))
    out = job(*streams)
    run = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out").where("symbol <> 'END'")


def hit(b: DataFrame) -> DataFrame:
    b = b.withColumn("idx", F.row_number().over(by_time()) - 1)
    off = F.col("idx") % 97 == 50
    return b.select("symbol", "ts", F.when(off, F.col("close") * 3).otherwise(F.col("close")).alias("close"), F.when(off, F.when(F.col("symbol").cast("long") % 2 == 0, 100000.0).otherwise(10000000.0)).otherwise(F.col("volume")).alias("volume"))


def stream_bad_prints(spark, sf):
    return rounded(streamed(lambda s: J.stream_bad_prints(s, delay="60 days"), hit(bars(spark, sf)), late=50), "symbol", ms(), "rejected", digits=4, **c("close"))


def stream_kalman(spark, sf):
    b = bars(spark, sf).select("symbol", "ts", "close", "volume")
    return rounded(streamed(lambda s: J.stream_kalman(s, delay="60 days"), b, late=50), "symbol", ms(), **c("filtered", "innovation", "covariance"))


def stream_reconcile(spark, sf):
    b = bars(spark, sf)
    return rounded(streamed(lambda x, y: J.stream_reconcile(x, y, delay="60 days"), b.select("symbol", "ts", "close"), baseline(b), late=50), "symbol", ms(), "anomaly", **c("close", "divergence_score"))


def stream_quotes_dedupe(spark, sf):
    q = quotes(spark, sf).select("symbol", "ts")
    return streamed(lambda s: J.stream_quotes_dedupe(s, "10 days"), q.unionByName(q), late=5).select("symbol", ms())


def stream_quote_bars(spark, sf):
    q = quotes(spark, sf).select("symbol", "ts", "close", "volume")
    return rounded(streamed(lambda s: J.stream_quote_bars(s, "7 days", delay="10 days"), q, late=5), "symbol", ms(), **c("high", "low", "volume"))


def stream_resolve(spark, sf):
    p = Q.stored(spark, sf).select("id", "symbol", "ts", "expiry", "anchor_price", "expected_return", "lower", "upper")
    b = bars(spark, sf).select("symbol", "ts", "close", "volume")
    return rounded(streamed(lambda x, y: J.stream_resolve(x, y, delay="60 days"), p, b, late=50), "symbol", F.unix_millis("expiry").alias("expiry_ms"), "status", F.unix_millis("actual_ts").alias("actual_ms"), F.coalesce("in_interval", F.lit(False)).alias("in_interval"), **c("actual_price", "actual_return"))


QUERIES = {f.__name__: f for f in (stream_bad_prints, stream_kalman, stream_reconcile, stream_quotes_dedupe, stream_quote_bars, stream_resolve)}

ORACLES = {
    "stream_bad_prints": R.ORACLES["filter_bad_prints"],
    "stream_kalman": f"with recursive {R.KALMAN} select symbol, {MS}, {sql_rounded({'filtered': 'estimate', 'innovation': 'innovation', 'covariance': 'p'})} from kt",
    "stream_reconcile": f"""with {BASE}, z as (select *, case when idx % 11 <> 0 then close * (1 + 0.002 * (idx % 7 = 0)::int) end as base from b0), y as (select *, abs(close - base) / base as div from z)
        select symbol, {MS}, coalesce(div > 0.001, false) as anomaly, {sql_rounded({'close': 'case when div > 0.001 then base else close end', 'divergence_score': 'div'})} from y""",
    "stream_quotes_dedupe": f"with {QUOTES} select distinct symbol, {MS} from q",
    "stream_quote_bars": f"with {QUOTES}, w as (select symbol, (epoch_us(ts) // 604800000000) * 604800000 as ts_ms, close, volume from q) select symbol, ts_ms, {sql_rounded({'high': 'max(close)', 'low': 'min(close)', 'volume': 'sum(volume)'})} from w group by 1, 2",
    "stream_resolve": f"""with {Q.TRACK.split("oc as")[0].rstrip().rstrip(",")}, hits as (select sp.symbol, sp.horizon, min(b.ts) as actual_ts, arg_min(b.close, b.ts) as actual_price from sp left join bars b on b.symbol = sp.symbol and b.ts >= sp.expiry and b.ts <= sp.expiry + interval 7 days group by 1, 2)
        select sp.symbol, epoch_us(expiry) // 1000 as expiry_ms, case when actual_ts is null then 'EXPIRED_NO_DATA' else 'RESOLVED' end as status, epoch_us(actual_ts) // 1000 as actual_ms, coalesce(actual_price between lower and upper, false) as in_interval,
        {sql_rounded({'actual_price': 'actual_price', 'actual_return': 'actual_price / anchor_price - 1'})} from sp join hits using (symbol, horizon)""",
}
