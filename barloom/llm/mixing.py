"""Mixing sources to target weights by cube-method balanced sampling.

Every document of a source has the same expected number of copies, target / size of the source. Its whole part (of rows
alike, that of their sum) is taken for sure; the fraction is an inclusion probability. The cube method moves these
probabilities, three documents at a time, along the null space of two constraints (their number and their words), so that
both totals stay as they are, until a document is in or out. Blocks of a source fly apart from each other, without a few
of their documents; these and what else stays undecided fly together, until one block is left. There the last two
documents land, and single decisions of that block are turned where that brings the words nearer to their total.
"""

from __future__ import annotations

import itertools
import random
import zlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

WORD = r"[^\x20\x09-\x0D]+"
EPS = 1e-9
#: Documents of a block, whatever their length, that wait for the last flight.
SPARE = 32
UNITS = "doc_id string, source string, size long, source_size long, target double, rows long, base long, chance double, block long"


def targets(sized: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, documents, target) of ``sized`` (source, size): weights repeat over the sources by code point, null last.

    Targets share ``share`` of all sizes by weight, none over ``cap`` times its source's size; the excess is shared
    again by weight. With the sources in order of size per weight, those before the level are full.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    nth = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))  # one row a source
    w = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(nth - 1, F.lit(len(weights))) + 1))
    order = Window.orderBy((F.lit(cap) * F.col("source_size") / F.col("weight")), F.col("source").isNull(), "source")
    most = F.lit(cap) * F.col("source_size")
    w = w.withColumn("full", F.sum(most).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    w = w.withColumn("rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    w = w.withColumn("all", F.sum("source_size").over(Window.partitionBy()))
    w = w.withColumn("level", F.max((F.lit(share) * F.col("all") - F.coalesce("full", F.lit(0.0))) / F.col("rest")).over(Window.partitionBy()))
    return w.select("source", "source_size", "documents", F.least(most, F.col("weight") * F.col("level")).alias("target"))


def fly(chance: list[float], size: list[int], draw: random.Random, order) -> None:
    """Moves ``chance`` in place until at most two lie between 0 and 1; the sums of chance and of chance * size stay."""
    open_ = []
    for i in order:
        if EPS < chance[i] < 1 - EPS:
            open_.append(i)
        while len(open_) > 2:
            a, b, c = open_
            u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
            if not any(u):
                u = (1, -1, 0)
            up = min(((1 - chance[k]) / x if x > 0 else -chance[k] / x) for k, x in zip(open_, u, strict=True) if x)
            down = min((chance[k] / x if x > 0 else (chance[k] - 1) / x) for k, x in zip(open_, u, strict=True) if x)
            step = up if draw.random() * (up + down) < down else -down
            for k, x in zip(open_, u, strict=True):
                chance[k] = min(1.0, max(0.0, chance[k] + step * x))
            open_ = [k for k in open_ if EPS < chance[k] < 1 - EPS]


def land(chance: list[float], size: list[int], words: float) -> None:
    """Decides the last open documents so that the words come nearest to ``words``, then turns single decisions, from the longest document down, as long as that brings them nearer."""
    open_ = [i for i, p in enumerate(chance) if EPS < p < 1 - EPS]
    aim, count = sum(chance[i] * size[i] for i in open_), sum(chance[i] for i in open_)
    best = min(itertools.product((0.0, 1.0), repeat=len(open_)), key=lambda x: (abs(sum(a * size[i] for a, i in zip(x, open_, strict=True)) - aim), abs(sum(x) - count), x))
    for i, x in zip(open_, best, strict=True):
        chance[i] = x
    over, turned = sum(p * n for p, n in zip(chance, size, strict=True)) - words, True
    order = sorted(range(len(size)), key=lambda i: (-size[i], i))
    while turned:
        turned = False
        for i in order:
            step = size[i] if chance[i] < 0.5 else -size[i]
            if abs(over + step) < abs(over):
                over, chance[i], turned = over + step, 1 - round(chance[i]), True


def flight(last: bool, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "size", "chance"], kind="stable", na_position="last")
        chance, size = pdf["chance"].tolist(), pdf["size"].tolist()
        name = f"{seed}/{pdf['source'].iloc[0]}/{pdf['block'].iloc[0]}"
        draw = random.Random(zlib.crc32(name.encode("utf-8", "surrogatepass")))
        # the longest fly first, so that short documents are left to land
        order = sorted(range(len(chance)), key=lambda i: (-size[i], draw.random()))
        if not last:
            waiting = set(draw.sample(order, min(SPARE, len(order))))
            order = [i for i in order if i not in waiting]
        words = sum(p * n for p, n in zip(chance, size, strict=True))
        fly(chance, size, draw, order)
        if last:
            land(chance, size, words)
        return pdf.assign(chance=[0.0 if p <= EPS else 1.0 if p >= 1 - EPS else p for p in chance])

    return run


def mix(docs: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block_rows: int = 1000, fan_in: int = 400, many: int = 10_000, seed: int = 7) -> DataFrame:
    """Copies of ``docs`` (doc_id, text, source) to take: a row per document, (doc_id, source, size, source_size, target, copies, taken).

    Rows alike in doc_id, source and size are one unit, of all their copies; what they can't share evenly goes to the
    first of them. Size: words of the whole text (null: 0). copies is 0 to ``cap`` rounded up; taken = copies * size. A source without
    words has target 0; documents without words cost nothing and get copies like others of their source. Null
    doc_ids and sources are values like others; reruns give the same rows; other columns are ignored. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    sized = scratch.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    to = scratch.save(targets(sized, weights, share, cap))
    few = to.count() <= 50_000  # sources; a row has under 100 bytes
    to2 = to.withColumnRenamed("source", "of")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    alike = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))
    units = alike.join(F.broadcast(to2) if few else to2, F.col("source").eqNullSafe(F.col("of")))
    copies = F.col("rows") * expected
    units = units.withColumn("base", F.floor(copies + EPS * F.col("rows"))).withColumn("chance", F.greatest(F.lit(0.0), copies - F.col("base")))
    blocks = F.ceil(F.col("documents") / block_rows)
    units = units.withColumn("block", F.pmod(F.xxhash64("doc_id", "size"), blocks)).select(F.col("doc_id").cast("string").alias("doc_id"), "source", "size", "source_size", "target", "rows", F.col("base").cast("long"), "chance", F.col("block").cast("long"))
    blocks = -(-(to.agg(F.max("documents")).first()[0] or 1) // block_rows)
    done, todo = [], units
    while True:
        last = blocks <= 1
        flown = scratch.save(todo.groupBy("source", "block").applyInPandas(flight(last, seed + len(done)), UNITS))
        open_ = (F.col("chance") > 0) & (F.col("chance") < 1)
        done.append(flown.where(~open_))
        if last:
            break
        todo = flown.where(open_).withColumn("block", F.floor(F.col("block") / fan_in))
        blocks = -(-blocks // fan_in)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out = out.withColumn("all", (F.col("base") + F.col("chance")).cast("long"))
    few = F.col("rows") <= many
    hot = out.where(~few).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / many)))).repartition("doc_id", "source", "size", "chunk")
    out = out.where(few).withColumn("chunk", F.lit(0).cast("long")).unionByName(hot)
    out = out.withColumn("nth", F.explode(F.sequence(F.col("chunk") * many + 1, F.least("rows", (F.col("chunk") + 1) * many))))
    out = out.withColumn("copies", F.floor(F.col("all") / F.col("rows")) + (F.col("nth") <= F.col("all") % F.col("rows")).cast("long"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
