"""Market data derived from the given tables, in Spark and as the same SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CENTRE = 7.64
#: Lines of a task.
TASK_LINES = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by supplier: a random walk of the mean log price of the day's lines.

    Lines are dealt by symbol before they are added up: a day has hardly more than a line, so adding up first saves no
    shuffle, and what follows by symbol (and time, bucket or month) needs no other. Work on bars is long for their bytes,
    so the number of tasks grows with the lines (a count from the files' footers), and a task's part doesn't.
    """
    given = table(spark, sf_dir, "lineitem")
    tasks = max(spark.sparkContext.defaultParallelism, given.count() // TASK_LINES + 1)
    lines = given.select(
        F.col("l_suppkey").cast("string").alias("symbol"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.log(F.col("l_extendedprice") / F.col("l_quantity")).alias("lp"), F.col("l_tax").alias("tax"), F.col("l_discount").alias("disc"), F.col("l_quantity").alias("qty")
    )
    d = lines.repartition(tasks, "symbol").groupBy("symbol", "ts").agg(F.avg("lp").alias("lp"), F.max("tax").alias("tax"), F.max("disc").alias("disc"), F.sum("qty").alias("qty"))
    x = F.sum(0.015 * (F.col("lp") - CENTRE)).over(Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    p = 100 * F.exp("x")
    return d.withColumn("x", x).select(
        "symbol", "ts",
        F.round(p * (1 + (F.col("tax") - F.col("disc")) / 20), 4).alias("open"), F.round(p * (1 + F.col("tax") / 10), 4).alias("high"),
        F.round(p * (1 - F.col("disc") / 10), 4).alias("low"), F.round(p, 4).alias("close"), (F.col("qty") * 10000).alias("volume"),
    )


BARS = """d as (select l_suppkey::varchar as symbol, l_shipdate as ts, avg(ln(l_extendedprice / l_quantity)) as lp, max(l_tax) as tax, max(l_discount) as disc, sum(l_quantity) as qty from lineitem group by 1, 2),
x as (select *, sum(0.015 * (lp - 7.64)) over (partition by symbol order by ts rows between unbounded preceding and current row) as x from d),
bars as (select symbol, ts, round(100 * exp(x) * (1 + (tax - disc) / 20), 4) as open, round(100 * exp(x) * (1 + tax / 10), 4) as high, round(100 * exp(x) * (1 - disc / 10), 4) as low, round(100 * exp(x), 4) as close, qty * 10000 as volume from x)"""

#: bars with the bar's number (from 0), the close before and the log return
RET = BARS + """,
r0 as (select *, row_number() over (partition by symbol order by ts) - 1 as idx, lag(close) over (partition by symbol order by ts) as c1 from bars),
r as (select *, ln(close / c1) as ret from r0)"""


def ms(ts="ts"):
    return F.unix_millis(ts).alias("ts_ms")


MS = "(epoch_us(ts) // 1000) as ts_ms"


def rounded(df: DataFrame, *keys, digits: int = 6, **values) -> DataFrame:
    """Keys as they are, values as doubles of ``digits`` decimals, so that two engines' sums agree; -0 becomes 0."""
    return df.select(*keys, *[(F.round(c.cast("double"), digits) + F.lit(0.0)).alias(n) for n, c in values.items()])


def rounded_off(df: DataFrame, *keys, digits: int = 6, **values) -> DataFrame:
    """``rounded`` by arithmetic, halves away from 0 as in SQL: for very many rows, where the decimals that ``round`` makes of each double take most of the time."""

    def off(c):
        y = c.cast("double") * 10.0**digits
        return F.when(F.abs(y - F.rint(y)) == 0.5, y + F.signum(y) / 2).otherwise(F.rint(y)) / 10.0**digits + F.lit(0.0)

    return df.select(*keys, *[off(c).alias(n) for n, c in values.items()])


def sql_rounded(values: dict[str, str], digits: int = 6) -> str:
    return ", ".join(f"round(({e})::double, {digits}) + 0.0 as {n}" for n, e in values.items())
