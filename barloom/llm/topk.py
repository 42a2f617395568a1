"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are dealt into levels of similar length (steps of the logarithm of the length, so their number does not grow
with the data), and a level into buckets of bounded size. A first pass searches each query against the longest candidates
and gives a score that its k-th best can't fall below. From it follows, for each level, the cosine a candidate must reach:
above 1 the level can't hold a result; where it is high, the candidates' largest query coordinates are tested first (a
vector with that cosine can't differ much there); where it is low, candidates are scanned in order of length until they
are too short. What is left is verified with the exact product.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

FOUND = "query long, query_id long, vec_id long, row long, score long"
NOTHING = pd.DataFrame({c.split()[0]: [] for c in FOUND.split(", ")}).astype("int64")
#: Levels to a doubling of the length: lengths of a level differ by 1.1 % at most.
STEPS = 64


def quantised(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, v array<long>, norm double): components floor(scale * x); vectors null or with null or non-finite components go."""
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")))
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))


def best(ids: np.ndarray, rows: np.ndarray, scores: np.ndarray, k: int):
    """The k highest scores; ties to the smaller id (null, a negative row: last), then to the smaller row."""
    o = np.lexsort((rows, ids, rows < 0, -scores))[:k]
    return ids[o], rows[o], scores[o]


def search(queries: pd.DataFrame, candidates: pd.DataFrame, k: int, high: float = 0.8) -> pd.DataFrame:
    """Each query's k best of one bucket; ``floor`` (null: none) is a score that its final k-th best reaches."""
    out = []
    if queries.empty or candidates.empty:
        return NOTHING
    for width, cand in candidates.groupby(candidates["v"].map(len)):
        cand = cand.sort_values("norm", ascending=False, kind="stable")
        C, norms = np.stack(cand["v"].to_numpy()).astype("int64").reshape(len(cand), width), cand["norm"].to_numpy()
        ids, rows_of = cand["vec_id"].to_numpy("int64"), cand["row"].to_numpy("int64")
        if width and np.abs(C).max() * max((np.abs(q).max(initial=0) for q in queries["v"]), default=0) * width < 2**53:
            C = C.astype("float64")  # sums of products stay whole numbers
        unit = C / np.maximum(norms, 1e-300)[:, None]
        some = queries[queries["v"].map(len) == width]
        for query, qid, q, qn, floor in zip(some["query"], some["query_id"], some["v"], some["norm"], some["floor"], strict=True):
            q = np.asarray(q, "int64").reshape(width)
            rows, till = None, len(ids)
            if floor == floor and floor is not None and floor > 0 and qn > 0:
                till = int(np.searchsorted(-norms, -(floor / qn) * (1 - 1e-12), "right"))  # length pruning
                if till == 0:
                    continue
                need = floor / (qn * norms[0]) * (1 - 1e-9)  # the bucket's local cosine threshold
                if need > high:
                    # coordinate pruning: |q/|q| - c/|c||^2 = 2 - 2 cos, so on the query's focus coordinates too
                    at, gap = np.argsort(-np.abs(q), kind="stable")[:8], 2 - 2 * min(1.0, need)
                    rows = np.flatnonzero(((unit[:till, at] - q[at] / qn) ** 2).sum(1) <= gap + 1e-9)
            at = slice(till) if rows is None else rows
            scores, near, names = C[at] @ q, ids[at], rows_of[at]
            keep = names != query
            near, names, scores = near[keep], names[keep], scores[keep].astype("int64")
            if floor == floor and floor is not None and len(scores):
                more = scores >= floor
                near, names, scores = near[more], names[more], scores[more]
            if len(scores) > 64:
                least = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                near, names, scores = near[least], names[least], scores[least]
            near, names, scores = best(near, names, scores, k)
            out.append(pd.DataFrame({"query": query, "query_id": qid, "vec_id": near, "row": names, "score": scores}).astype("int64"))
    return pd.concat(out) if out else NOTHING


def topk(vectors: DataFrame, queries: Column, k: int = 5, bucket_rows: int = 4096, block_rows: int = 1024) -> DataFrame:
    """The k rows of ``vectors`` (vec_id, v, norm) with the highest inner product for each of its rows that meets ``queries``: query_id, rank, vec_id, score.

    Every other row is a candidate, also one that repeats the query's vec_id or its values; a vec_id that is repeated
    among the queries has its ranks once for each row. Ties go to the smaller vec_id, a null one comes last. Rows without
    vec_id are no queries. Vectors of another length than the query's are no candidates. Fewer than k candidates: all. An
    empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession)
    log = F.when(F.col("norm") > 0, F.floor(F.log2("norm") * STEPS)).otherwise(F.lit(-(2**20)))
    rows = vectors.select("vec_id", "v", "norm", log.cast("int").alias("level"), F.coalesce(queries & F.col("vec_id").isNotNull(), F.lit(False)).alias("asks"))
    named = rows.withColumn("row", F.monotonically_increasing_id())
    named = named.withColumn("row", F.when(F.col("vec_id").isNull(), -1 - F.col("row")).otherwise(F.col("row"))).withColumn("vec_id", F.coalesce("vec_id", F.lit(0)))
    rows = scratch.save(named)
    sizes = rows.groupBy("level").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).orderBy(F.desc("level")).collect()  # as many as steps between the lengths
    blocks = max(1, -(-rows.where("asks").count() // block_rows))
    # the longest candidates, enough of them to fill a bucket: whole levels, and one bucket of the last
    table, before = [], 0
    for r in sizes:
        parts = -(-r.n // bucket_rows)
        table.append((r.level, parts, r.longest, parts if before + r.n <= bucket_rows else int(before < bucket_rows)))
        before += r.n
    levels = F.broadcast(vectors.sparkSession.createDataFrame([r[:2] + r[3:] for r in table], "level int, parts int, early int"))
    cand = rows.join(levels, "level").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    cand = scratch.save(cand.select("vec_id", "v", "norm", "row", "level", "part", (F.col("part") < F.col("early")).alias("first")))
    qs = rows.where("asks").select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), "v", "norm", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("q_block"))

    def pairs(q: DataFrame, c: DataFrame) -> DataFrame:
        """Query blocks meet buckets, each meeting a group of bounded size: queries and candidates go to the meetings that take place only."""
        keys = ["level", "part", "q_block"]
        c = q.select(*keys).distinct().join(c, ["level", "part"])
        c = c.select(*[F.col(x).alias(x) for x in c.columns])  # names of its own beside q's
        return q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(lambda left, right: search(left, right, k), FOUND)

    one = {"level": F.lit(0), "part": F.lit(0)}
    found = scratch.save(pairs(qs.withColumn("floor", F.lit(None).cast("double")).withColumns(one), cand.where("first").drop("first").withColumns(one)))
    by = Window.partitionBy("query").orderBy(F.desc("score"), F.col("row") < 0, "vec_id", "row")
    first = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).drop("rank")
    floors = first.groupBy("query").agg(F.min("score").cast("double").alias("floor"), F.count("*").alias("n")).where(F.col("n") == k).drop("n")
    later = [F.struct(F.lit(lv).alias("level"), F.lit(x).alias("longest"), F.lit(e).alias("from"), F.lit(p - 1).alias("to")) for lv, p, x, e in table if e < p]
    if not later:
        found = first
    else:
        reach = lambda x: F.col("floor").isNull() | (F.col("floor") <= 0) | (F.col("floor") <= F.col("norm") * x["longest"] * (1 + 1e-12))
        sent = qs.join(floors, "query", "left").withColumn("at", F.explode(F.filter(F.array(*later), reach)))
        sent = sent.withColumn("part", F.explode(F.sequence("at.from", "at.to")))
        sent = scratch.save(sent.select("query", "query_id", "v", "norm", "floor", "q_block", "at.level", "part"))
        found = first.unionByName(pairs(sent, cand.where(~F.col("first")).drop("first")))
    found = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("row") >= 0, F.col("vec_id")).alias("vec_id"), "score")
