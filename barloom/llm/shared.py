"""What the operators of this subpackage share: tables in the cluster's shared folder, and connected components."""

from __future__ import annotations

import functools
import inspect
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; where it is unset and all runs in one JVM (tests), a folder of our own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        named = sc.getCheckpointDir()
    return named


class Scratch:
    """Tables written under the shared folder, so that a lost executor costs no recomputation.

    ``save`` writes a DataFrame as Parquet and returns the reread table; ``drop`` deletes one that is no longer
    needed. What is left goes when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        self._n = 0
        self._at: dict[int, str] = {}

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """Write ``df``, in Arrow batches of few rows (texts are long); the shuffles that led to it go when it is written.

        Where about ``rows`` rows of a few numbers are known to come, they are written in files of some size rather than
        one for each partition: every file costs its task some processes or requests.
        """
        df = df if rows is None else df.coalesce(max(6, -(-rows // 100_000)))
        self._n += 1
        path = f"{self.base}/{self._n}"
        batch, clean = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = {k: self.spark.conf.get(k) for k in (batch, clean)}
        self.spark.conf.set(batch, str(min(int(before[batch]), 1000) if int(before[batch]) > 0 else 1000))
        self.spark.conf.set(clean, "true")
        try:
            df.write.parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        if self._n == 1:
            p, fs = self._fs(self.base)
            fs.deleteOnExit(p)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._at[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := self._at.pop(id(t), None):
                p, fs = self._fs(path)
                fs.delete(p, True)


def tidy(make):
    """A function of Arrow batches (a generator) or of one pandas group that gives back what Arrow keeps for reuse: workers outlive their tasks."""
    if inspect.isgeneratorfunction(make):

        @functools.wraps(make)
        def batches(*args):
            try:
                yield from make(*args)
            finally:
                pa.default_memory_pool().release_unused()

        return batches

    def group(pdf):
        try:
            return make(pdf)
        finally:
            pa.default_memory_pool().release_unused()

    return group


def small(table: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``table`` (saved, of a few numbers a row), to be broadcast if it has no more than ``rows`` rows."""
    return F.broadcast(table) if table.count() <= rows else table


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", scratch: Scratch | None = None, rows: int | None = None, share: int = 10_000, few: int = 100_000) -> DataFrame:
    """``left`` joined with ``right``, which has at most one row for each value of ``keys``, however often ``left`` repeats one.

    A ``right`` of no more than ``few`` rows is broadcast. Else, keys of more than 1 / ``share`` of ``left``'s rows are
    fewer than ``share``, and their rows of ``right`` are broadcast; the others go by a shuffle in which no key has more
    rows than that. Keys are not null. ``right`` is a saved table (of ``rows`` rows, if that is known); ``left`` is one, or
    is saved by ``scratch`` where it has to be read twice. ``how``: 'inner' or 'left'.
    """
    if (right.count() if rows is None else rows) <= few:
        return left.join(F.broadcast(right), keys, how)
    left = left if scratch is None else scratch.save(left)
    n = left.count()
    hot = left.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") * share > n).select(*keys, F.lit(True).alias("__hot"))
    marked = left.join(F.broadcast(hot), keys, "left")
    few = F.broadcast(right.join(F.broadcast(hot), keys, "left_semi"))
    return marked.where("__hot").drop("__hot").join(few, keys, how).unionByName(marked.where("__hot is null").drop("__hot").join(right, keys, how))


def numbered(scratch: Scratch, rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (long, from 0 in each group, by ``order``; nulls first) and ``total`` (long, rows of the group).

    No group has to fit in a task: rows are dealt out by ranges of (group, order), numbered where they lie, and each
    range's start comes from the counts of the ranges before it, a row for each range and group. Rows alike in ``order``
    go to one range; where there may be many, the last column of ``order`` tells them apart. ``rows`` is read twice.
    """
    lain = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    lain = scratch.save(lain.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = lain.groupBy("__part", *group).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    w = Window.partitionBy(*group)
    before = F.coalesce(F.sum("__n").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    names = {k: f"__g{i}" for i, k in enumerate(group)}
    starts = small(scratch.save(counts.select(F.col("__part").alias("__p"), *(F.col(k).alias(n) for k, n in names.items()), (before - F.col("__first")).alias("__start"), F.sum("__n").over(w).alias("total"))))
    on = F.col("__part") == F.col("__p")
    for k, n in names.items():
        on = on & F.col(k).eqNullSafe(F.col(n))
    return lain.join(starts, on).withColumn("pos", F.col("__at") + F.col("__start")).drop("__p", *names.values(), "__start", "__part", "__at")


def components(edges: DataFrame, scratch: Scratch, rows: int | None = None, rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b: long): a row (node, component) for each node with an edge.

    ``component`` is the smallest node reachable. Alternating large-star and small-star steps: the edges shrink to
    stars in a logarithmic number of rounds; each round's edges are written to the shared folder. Self-loops and
    repeated edges do no harm; no edges give no rows. ``rows``: about how many edges there are, if that is known.
    """
    e = scratch.save(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), rows)
    state, rows = None, e.count()
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: every edge now points from the larger node to the smaller
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = scratch.save(small, rows)
        now = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        scratch.drop(e)
        e = new
        if (now.n, now.h) == state:
            break
        state = (now.n, now.h)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
