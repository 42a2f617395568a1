"""Near duplicates of embeddings by collision-counting projections.

Each vector is projected on many random lines. Two vectors of cosine at least ``threshold`` are so near that on any line
they fall into a window of fixed half-width around each other with a known probability; others do so less often. Pairs
that collide on at least as many lines as all but a small share of linked pairs (the calibrated count) are verified by
their cosine. Vectors are compared within their label only: a label's vectors are sorted along its first line and cut
into tiles, and a tile meets the tiles within its window. In a meeting, one tile is sorted along every line and each vector of
the other counts those inside its window on the line.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, components


def calibrated(lines: int, width: float, recall: float) -> int:
    """The highest count that a linked pair reaches with probability ``recall``, if it falls into a window with that of ``width`` deviations."""
    p = math.erf(width / math.sqrt(2))
    tail = 0.0
    for c in range(lines, -1, -1):
        tail += math.comb(lines, c) * p**c * (1 - p) ** (lines - c)
        if tail >= recall:
            return c
    return 0


def unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    x = x / np.where(big > 0, big, 1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def valid(vectors: DataFrame) -> DataFrame:
    e = F.col("embedding")
    fine = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return vectors.where(fine & F.col("label").isNotNull() & F.col("vec_id").isNotNull())


def projections(dim: int, lines: int, seed: int) -> np.ndarray:
    r = np.random.Generator(np.random.PCG64([seed, dim])).normal(size=(dim, lines))
    return r / np.sqrt((r * r).sum(0))


class Counter:
    """Counts of bits, place by place, kept as binary digits in arrays of their own: two arrays of bits and a digit make the digit and one carry."""

    def __init__(self, shape: tuple, most: int):
        self.digit = [np.zeros(shape, np.uint64) for _ in range(most.bit_length())]
        self.waiting: list[np.ndarray | None] = [None] * (most.bit_length() + 1)

    def add(self, bits: np.ndarray, at: int = 0) -> None:
        if self.waiting[at] is None:
            self.waiting[at] = bits
            return
        other, self.waiting[at] = self.waiting[at], None
        one = self.digit[at] ^ other
        carry = (self.digit[at] & other) | (one & bits)
        self.digit[at] = one ^ bits
        if at + 1 < len(self.digit):
            self.add(carry, at + 1)

    def at_least(self, least: int) -> np.ndarray:
        """Bits of the places with such a count."""
        for at in range(len(self.digit)):
            if self.waiting[at] is not None:
                rest, self.waiting[at] = self.waiting[at], None
                carry = self.digit[at] & rest
                self.digit[at] = self.digit[at] ^ rest
                if at + 1 < len(self.digit):
                    self.add(carry, at + 1)
        more, same = np.zeros_like(self.digit[0]), np.full_like(self.digit[0], ~np.uint64(0))
        for at in range(len(self.digit) - 1, -1, -1):
            if least >> at & 1:
                same &= self.digit[at]
            else:
                more |= same & self.digit[at]
                same &= ~self.digit[at]
        return more | same


def colliding(queries: np.ndarray, along: np.ndarray, rank: np.ndarray, half: np.float32, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(vector, query) of the pairs that lie within ``half`` of each other on at least ``least`` lines.

    ``queries``: places of the queries on each line; ``along``: the vectors' places on each line, sorted; ``rank``: each
    vector's number in that order. On a line a query's window is a run of that order: its bit is turned at the run's
    both ends, and carried along it. So a pair costs a bit a line rather than a number.
    """
    n, lines = along.shape
    q = np.arange(len(queries))
    words = -(-len(queries) // 64)
    word, bit = q // 64, np.uint64(1) << (q % 64).astype(np.uint64)
    counter = Counter((n, words), lines)
    for k in range(lines):
        turn = np.zeros((n + 1, words), np.uint64)
        np.bitwise_xor.at(turn, (np.searchsorted(along[:, k], queries[:, k] - half), word), bit)
        np.bitwise_xor.at(turn, (np.searchsorted(along[:, k], queries[:, k] + half, "right"), word), bit)
        counter.add(np.bitwise_xor.accumulate(turn[:-1], axis=0)[rank[:, k]])
    found = counter.at_least(least)
    some = np.flatnonzero(found.any(1))
    bits = np.unpackbits(found[some].astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, : len(queries)]
    j, i = np.nonzero(bits)
    return some[j], i


def compare(left: pd.DataFrame, right: pd.DataFrame, same: bool, threshold: float, lines: int, width: float, recall: float, seed: int, rows: int = 512):
    """(ids, links of each, edges of a spanning forest between them) of the pairs of a tile and another, each once."""
    a, b = (unit(np.stack(t["embedding"].to_numpy()).astype(np.float64)) for t in (left, right))
    ia, ib = left["node"].to_numpy("int64"), right["node"].to_numpy("int64")
    wa, wb = left["weight"].to_numpy("int64"), right["weight"].to_numpy("int64")
    line = projections(a.shape[1], lines, seed)
    half = np.float32(width * math.sqrt((2 - 2 * threshold) / a.shape[1]))
    pa_, pb_ = (a @ line).astype(np.float32), (b @ line).astype(np.float32)
    least = calibrated(lines, width, recall)
    na, nb, edges = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), []
    boss: dict[int, int] = {}

    def top(x):
        while boss.get(x, x) != x:
            boss[x] = x = boss.get(boss[x], boss[x])
        return x

    order = np.argsort(pb_, axis=0, kind="stable")  # the right tile sorted along each line
    along, rank = np.take_along_axis(pb_, order, 0), np.argsort(order, axis=0, kind="stable")
    for at in range(0, len(a), rows):
        j, i = colliding(pa_[at : at + rows], along, rank, half, least)
        if same:
            i, j = i[i + at < j], j[i + at < j]
        if not len(i):
            continue
        for s in range(0, len(i), 200_000):
            x, y = i[s : s + 200_000] + at, j[s : s + 200_000]
            ok = (a[x] * b[y]).sum(1) >= threshold
            x, y = x[ok], y[ok]
            np.add.at(na, x, wb[y])  # links count rows: a node stands for its copies
            np.add.at(nb, y, wa[x])
            for u, v in zip(ia[x].tolist(), ib[y].tolist(), strict=True):
                if (p := top(u)) != (q := top(v)):
                    boss[max(p, q)] = min(p, q)
                    edges.append((u, v))
    return ia, ib, na, nb, edges


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, lines: int = 32, width: float = 2.0, recall: float = 0.9999, tile_rows: int = 8192, seed: int = 11) -> DataFrame:
    """A row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    n_links: other vectors of the same label with cosine (double) at least ``threshold``; component_id: the smallest
    vec_id reachable by links, itself included; kept: vec_id = component_id. Vectors that are null, empty, zero or hold
    null or non-finite components, or whose label is null, link with nothing; vectors of different dimensions neither.
    Equal vectors (up to their values) of a label are one node with a weight, so a group of copies costs one
    comparison. Rows that repeat a vec_id count as vectors of their own, those of other values linked under
    their own values only. Linked pairs are found with probability
    ``recall`` at least, those of higher cosine with more. An empty table gives no rows.
    """
    scratch = Scratch(vectors.sparkSession)
    cols = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    good = valid(cols).withColumn("dim", F.size("embedding"))
    nodes = good.groupBy("label", "dim", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"))
    nodes = scratch.save(nodes.withColumn("node", F.xxhash64("label", "embedding")))

    def projected(batches):
        for pdf in batches:
            first = [float(unit(np.asarray(e, np.float64)[None])[0] @ projections(len(e), 1, seed)[:, 0]) for e in pdf["embedding"]]
            yield pdf.assign(at=first)

    placed = nodes.drop("first")
    placed = placed.mapInPandas(projected, T.StructType([*placed.schema.fields, T.StructField("at", T.DoubleType())]))
    # tiles: equal counts along the first line, from the counts of fine steps
    step = F.floor((F.col("at") + 1) * 512).cast("int")
    placed = scratch.save(placed.withColumn("step", step))
    by = Window.partitionBy("label", "dim").orderBy("step")
    steps = placed.groupBy("label", "dim", "step").agg(F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high"))  # 1024 steps a label at most
    steps = steps.withColumn("before", F.sum("n").over(by) - F.col("n")).withColumn("group", F.floor(F.col("before") / tile_rows)).withColumn("parts", F.ceil(F.col("n") / tile_rows))
    parts = F.pmod(F.xxhash64("node"), F.col("parts"))
    tiled = placed.join(steps.select("label", "dim", "step", "group", "parts"), ["label", "dim", "step"]).withColumn("part", parts).select("label", "dim", "embedding", "node", "weight", "at", "group", "part")
    tiled = scratch.save(tiled)
    tiles = tiled.groupBy("label", "dim", "group", "part").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    tiles = scratch.save(tiles.withColumn("tile", F.row_number().over(Window.partitionBy("label", "dim").orderBy("low", "group", "part"))))
    # two vectors of the threshold's cosine are at most this far apart on any line: no pair is lost to the tiles
    reach = math.sqrt(2 - 2 * threshold) + 1e-9
    other = tiles.select("label", "dim", F.col("tile").alias("to"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    meets = tiles.select("label", "dim", "tile", "low", "high").join(other, ["label", "dim"]).where((F.col("tile") <= F.col("to")) & (F.col("low2") <= F.col("high") + reach) & (F.col("low") <= F.col("high2") + reach)).select("label", "dim", "tile", "to")
    member = scratch.save(tiled.join(tiles.select("label", "dim", "group", "part", "tile"), ["label", "dim", "group", "part"]).select("label", "dim", "tile", "node", "weight", "embedding"))
    left = meets.join(member, ["label", "dim", "tile"]).select("label", "dim", "tile", "to", "node", "weight", "embedding")
    right = meets.where("tile <> to").join(member.withColumnRenamed("tile", "to"), ["label", "dim", "to"]).select("label", "dim", "tile", "to", "node", "weight", "embedding")

    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # names of its own beside left's

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty:
            return pd.DataFrame({"kind": [], "a": [], "b": []}).astype("int64")
        same = b.empty
        a = a.sort_values("node")
        b = a if same else b.sort_values("node")
        ia, ib, na, nb, edges = compare(a, b, same, threshold, lines, width, recall, seed)
        out = pd.concat([pd.DataFrame({"kind": 0, "a": ia, "b": na}), pd.DataFrame({"kind": 0, "a": ib, "b": nb}), pd.DataFrame(edges, columns=["a", "b"]).assign(kind=1)])
        return out[(out["kind"] == 1) | (out["b"] > 0)][["kind", "a", "b"]].astype("int64")

    keys = ["label", "dim", "tile", "to"]
    met = scratch.save(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "kind long, a long, b long"))
    links = met.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("far"))
    comp = components(met.where("kind = 1").select("a", "b"), scratch, nodes.count())
    named = nodes.join(links, "node", "left").join(comp, "node", "left").withColumn("c", F.coalesce("component", "node"))
    smallest = named.groupBy("c").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "c").select(F.col("node").alias("is"), (F.coalesce("far", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id", F.col("label").alias("of"), F.col("embedding").alias("like"))
    rows = cols.withColumn("k", F.xxhash64("label", "embedding"))
    out = rows.join(named, (F.col("k") == F.col("is")) & (F.col("label") == F.col("of")) & (F.col("embedding") == F.col("like")) & F.col("vec_id").isNotNull(), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
