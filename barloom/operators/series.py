"""Long series as many tasks: buckets of time, affine recursions as a scan, and recursions with decisions run speculatively.

A series is dealt into buckets of time. One shuffle by (symbol, bucket) brings a bucket together; what a bucket needs from
those before it (their number of bars, the last close, the state of a recursion) comes from a small table with a row for
each bucket, joined back on the same keys, so bars move once and no task holds a whole series.
"""

from __future__ import annotations

import math
import re
import tempfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Days of a bucket: at daily bars as many rows as a task sorts with ease. Shorter for bars of minutes.
BUCKET_DAYS = 3_650.0
#: Rows of a scan's chunk at most; fewer where weights would leave the range of doubles.
CHUNK = 4_096


def bucket_of(days: float, ts: str = "ts") -> Column:
    return F.floor(F.unix_micros(ts) / int(days * 86_400_000_000))


def in_bucket():
    return Window.partitionBy("symbol", "bucket")


def bucketed(bars: DataFrame, bucket_days: float = BUCKET_DAYS) -> DataFrame:
    """``bars`` with bucket, j (number in the bucket), idx (number in the series), c1 (close before) and ret (log return)."""
    w = in_bucket().orderBy("ts")
    b = bars.withColumn("bucket", bucket_of(bucket_days)).withColumn("j", F.row_number().over(w) - 1).withColumn("c1", F.lag("close").over(w))
    ends = b.groupBy("symbol", "bucket").agg(F.count("*").alias("rows"), F.max_by("close", "j").alias("end"))
    s = Window.partitionBy("symbol").orderBy("bucket")
    before = F.coalesce(F.sum("rows").over(s.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select("symbol", "bucket", before.alias("before"), F.lag("end").over(s).alias("c0"))
    d = b.join(ends, ["symbol", "bucket"]).withColumn("idx", F.col("before") + F.col("j")).withColumn("c1", F.coalesce("c1", "c0"))
    return d.withColumn("ret", F.log(F.col("close") / F.col("c1"))).drop("before", "c0")


def chunk_length(keep: float) -> int:
    """Rows over which keep ** row stays above 1e-200, so that weights and their inverses are doubles."""
    return max(1, min(CHUNK, int(200 * math.log(10) / -math.log(keep)) if keep < 1 else CHUNK))


def affine_scan(rows: DataFrame, keep: float, b: Column, name: str = "h") -> DataFrame:
    """Adds ``name``: h(i) = keep * h(i - 1) + b(i), h being 0 before the first row, for rows of ``bucketed``; a null b is 0.

    Each row's step is the map h -> keep * h + b. A chunk's maps are composed by one running sum of b / keep ** row,
    which is its value if it started from 0; the chunks' own maps are composed by doubling over a row for each chunk, and
    each chunk's start goes back to its rows.
    """
    length, kept = chunk_length(keep), F.lit(float(keep))
    d = rows.withColumn("chunk", F.floor(F.col("j") / length)).withColumn("at", F.col("j") - F.col("chunk") * length)
    w = Window.partitionBy("symbol", "bucket", "chunk").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("alone", F.sum(F.coalesce(b, F.lit(0.0)) * F.pow(kept, -F.col("at"))).over(w) * F.pow(kept, F.col("at")))
    maps = d.groupBy("symbol", "bucket", "chunk").agg(F.pow(kept, F.max("at") + 1).alias("a"), F.max_by("alone", "at").alias("b"))
    s = Window.partitionBy("symbol").orderBy("bucket", "chunk")
    # after round r a map stands for 2 ** r chunks; once keep ** rows is 0 as a double, older chunks add nothing
    rounds = math.ceil(math.log2(750 / -math.log(keep))) + 1 if keep < 1 else 40
    for r in range(min(rounds, 20)):
        a0, b0 = F.lag("a", 1 << r).over(s), F.lag("b", 1 << r).over(s)
        maps = maps.select("symbol", "bucket", "chunk", (F.col("a") * F.coalesce(a0, F.lit(1.0))).alias("a"), (F.col("a") * F.coalesce(b0, F.lit(0.0)) + F.col("b")).alias("b"))
    starts = maps.withColumn("start", F.coalesce(F.lag("b").over(s), F.lit(0.0))).groupBy("symbol", "bucket").agg(F.map_from_entries(F.collect_list(F.struct("chunk", "start"))).alias("starts"))
    d = d.join(starts, ["symbol", "bucket"])
    return d.withColumn(name, F.col("alone") + F.pow(kept, F.col("at") + 1) * F.col("starts")[F.col("chunk")]).drop("chunk", "at", "alone", "starts")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; one of our own where all runs in one JVM and none is set."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="spark-"))
    return sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """``df``, computed once and written to the checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Rounds of rows beside each other before they are written as one.
ROUNDS = 6


def speculative(bars: DataFrame, step: Callable, out: str, overlap: int, bucket_days: float = BUCKET_DAYS, finish: Callable | None = None, finished: str = "") -> DataFrame:
    """A recursion over each symbol's bars that depends on its own past decisions, run in chunks: the bars with bucket and the columns ``out``.

    ``step(state, close, volume)`` takes a list of doubles (None at first) and gives (state, values of ``out``). Every
    chunk (a bucket of time) starts from the state that the last ``overlap`` bars before it lead to from nothing. It
    stands if that is, to the last bit, the state in which the chunk before ended; the chunks where it isn't run again
    from there, round after round, until all fit, and only they are written anew. The first chunk of a symbol is right,
    so in the end all are: the result is that of one loop over the series, whatever the buckets. A task's Python holds
    the bars of one chunk, which its bucket bounds.

    The first row of a chunk has begun and ended, its states, and ``more``: ``finish`` takes the lists of ``out`` of a
    chunk and gives (lists of the columns ``finished``, more, a list of doubles).
    """
    names = [c.split()[0] for c in out.split(", ")]
    added = [c.split()[0] for c in finished.split(", ")] if finished else []
    schema = f"symbol string, bucket long, ts timestamp, close double, volume double, {out}{', ' + finished if finished else ''}, begun array<double>, ended array<double>, more array<double>"
    columns = ["symbol", "bucket", "ts", "close", "volume"]

    def walk(pdf, state):
        made = []
        for c, v in zip(pdf["close"].tolist(), pdf["volume"].tolist(), strict=True):
            state, values = step(state, c, v)
            made.append(values)
        return state, [list(x) for x in zip(*made, strict=True)]

    def chunk(pdf: pd.DataFrame, begun) -> pd.DataFrame:
        ended, made = walk(pdf, begun)
        extra, more = finish(*made) if finish else ([], None)
        first = lambda v: pd.Series([v] + [None] * (len(pdf) - 1), index=pdf.index, dtype=object)
        return pdf[columns].assign(**dict(zip([*names, *added], [*made, *extra], strict=True)), begun=first(begun), ended=first(ended), more=first(more))

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        own = ~pdf["warm"].to_numpy()
        if not own.any():
            return pd.DataFrame(columns=[*columns, *names, *added, "begun", "ended", "more"])
        return chunk(pdf[own], walk(pdf[~own], None)[0])

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        return chunk(pdf.sort_values("ts", kind="stable"), list(pdf["was"].iloc[0]))

    b = bars.select("symbol", "ts", F.col("close").cast("double").alias("close"), F.col("volume").cast("double").alias("volume")).withColumn("bucket", bucket_of(bucket_days))
    w = Window.partitionBy("symbol").orderBy("ts")
    end = F.last("bucket").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # the bucket of the bar ``overlap`` bars on, and of the last one near the end: later than its own only before a cut
    b = b.withColumn("next", F.least(F.col("bucket") + 1, F.coalesce(F.lead("bucket", overlap).over(w), end)))
    of = lambda bucket, warm: F.struct(F.col(bucket).alias("bucket"), F.lit(warm).alias("warm"))
    copies = F.when(F.col("next") > F.col("bucket"), F.array(of("bucket", False), of("next", True))).otherwise(F.array(of("bucket", False)))
    dealt = b.withColumn("copies", copies).drop("bucket", "next").select("symbol", "ts", "close", "volume", F.inline("copies"))
    rounds = [kept(dealt.groupBy("symbol", "bucket").applyInPandas(first, schema))]
    was = F.lag("ended").over(Window.partitionBy("symbol").orderBy("bucket"))
    while True:
        every = None
        for n, rows in enumerate(rounds):
            r = rows.withColumn("round", F.lit(n))
            every = r if every is None else every.unionByName(r)
        state = every.where("ended is not null").groupBy("symbol", "bucket").agg(F.max("round").alias("round"), F.max_by("begun", "round").alias("begun"), F.max_by("ended", "round").alias("ended"))
        off = kept(state.withColumn("was", was).where(F.col("was").isNotNull() & ~F.col("was").eqNullSafe(F.col("begun"))).select("symbol", "bucket", "round", "was"))
        key = ["symbol", "bucket", "round"]
        standing = every if len(rounds) == 1 else every.join(state.select(*key), key)
        if off.isEmpty():
            return standing.drop("round")
        if len(rounds) > ROUNDS:
            rounds = [kept(standing.drop("round"))]
            continue
        rounds.append(kept(every.join(off, key).groupBy("symbol", "bucket").applyInPandas(again, schema)))
