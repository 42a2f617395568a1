"""A manifest of a dataset as a Merkle tree, kept as a log of nodes in postorder.

Leaves are dealt to aligned blocks of 256; a builder appends its block's leaves one after the other and writes each node
as soon as it is complete, which is postorder. The blocks' tops are the leaves of the next tier, until one node is left.
Where a node stands in the log follows from its place in the tree alone (``position``), so proofs address the siblings
they need without an index. Every two consecutive nodes become the SHA-256 of their lowercase hex texts; a lone last
node is hashed alone as long as its level has more than one node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .shared import Scratch, numbered, tidy

#: A builder's block has 2 ** LEVELS leaves.
LEVELS = 8
#: Bytes of a step of a path: where the sibling stands (0 left, 1 right, 2 there is none), then its digest.
STEP = 33


def leaf(*fields: Column) -> Column:
    """The digest (hex) of a row: of its fields one after the other, each '-' if null, else UTF-8 byte count, ':' and value."""
    said = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*said), 256)


def height(leaves: int) -> int:
    return max(leaves - 1, 0).bit_length()


def position(first: int, leaves: int, levels: int) -> int:
    """Where the node ``levels`` above its ``leaves`` leaves, of which number ``first`` is the first, stands in the log (from 0).

    Before its subtree come the nodes complete by then: for each power of two as many as it goes into ``first``, in all
    2 * first less the ones in its binary form. The subtree has half the nodes a level, rounded up; its top comes last.
    """
    return 2 * first - first.bit_count() + sum(-(-leaves >> h) for h in range(levels + 1)) - 1


def parent(*nodes: bytes) -> bytes:
    return hashlib.sha256(b"".join(nodes)).hexdigest().encode()


def append(leaves: list[bytes], levels: int) -> tuple[list[bytes], list[tuple[int, int]]]:
    """The log of a block folded ``levels`` times, and each node's (height, index): every node is written when it is complete."""
    log, places = [], []
    waiting = [b""] * (levels + 1)  # at each height the node whose right neighbour is still to come
    for i, node in enumerate(leaves):
        h, closing = 0, i == len(leaves) - 1
        log.append(node)
        places.append((0, i))
        while h < levels and (i & 1 or closing):
            node = parent(waiting[h], node) if i & 1 else parent(node)
            h, i = h + 1, i >> 1
            log.append(node)
            places.append((h, i))
        waiting[h] = node
    return log, places


def steps(leaves: int, levels: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level of a block, of each leaf: where its path's sibling stands, and where that is in the log (0 if there is none)."""
    out = []
    for h in range(levels):
        own = np.arange(leaves) >> h
        first = (own ^ 1) << h
        at = {int(f): position(int(f), min(1 << h, leaves - int(f)), h) for f in np.unique(first) if f < leaves}
        out.append((np.where(first >= leaves, 2, (own & 1) ^ 1).astype(np.uint8), np.array([at.get(int(f), 0) for f in first])))
    return out


def build(levels: int) -> Callable:
    """Of each block's digests, the log and the top."""

    @tidy
    def run(batches):
        for b in batches:
            logs, tops = [], []
            for total, digests in zip(b.column("total").to_pylist(), b.column("digests").to_pylist(), strict=True):
                log, _ = append([d.encode() for d in digests], min(levels, height(total)))
                logs.append(bytes.fromhex(b"".join(log).decode()))
                tops.append(log[-1].decode())
            kept = {n: b.column(n) for n in b.schema.names if n != "digests"}
            yield pa.RecordBatch.from_pydict(kept | {"log": pa.array(logs, pa.binary()), "top": pa.array(tops, pa.string())})

    return run


def blocks(nodes: DataFrame, scratch: Scratch, payload: list[str], levels: int) -> DataFrame:
    """The blocks of ``nodes`` (tree, pos, total, leaves, digest and payload), each built by one call, in a saved table.

    A row: tree, total (the tier's nodes), block (its number), leaves (of the whole tree), own (what each node carries),
    log (the digests of 32 bytes, one after the other), top (hex).
    """
    packed = F.sort_array(F.collect_list(F.struct("pos", "digest", F.struct(F.col("pos").alias("__pos"), *payload).alias("own")))).alias("all")
    grouped = nodes.groupBy("tree", F.shiftright("pos", levels).alias("block")).agg(F.first("total").alias("total"), F.first("leaves").alias("leaves"), packed)
    grouped = grouped.select("tree", "total", "block", "leaves", F.col("all.own").alias("own"), F.col("all.digest").alias("digests"))
    kind = grouped.schema["own"].dataType.simpleString()
    return scratch.save(grouped.mapInArrow(build(levels), f"tree string, total long, block long, leaves long, own {kind}, log binary, top string"))


def grow(nodes: DataFrame, scratch: Scratch, payload: list[str], levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The tiers of every tree of ``nodes`` (tree, pos, total, digest), lowest first, and a row (tree, top, leaves) for each tree."""
    tiers = [blocks(nodes.withColumn("leaves", F.col("total")), scratch, payload, levels)]
    while not (rest := tiers[-1].where(F.col("total") > 1 << levels)).isEmpty():
        up = rest.select("tree", F.col("block").alias("pos"), F.ceil(F.col("total") / (1 << levels)).alias("total"), "leaves", F.col("top").alias("digest"))
        tiers.append(blocks(up, scratch, [], levels))
    tops = [t.where(F.col("total") <= 1 << levels).select("tree", "top", "leaves") for t in tiers]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return tiers, out


def paths_of(names: list[str], levels: int) -> Callable:
    """Of each block (with ``up``, the path of its top) a row for each of its leaves: what the block's row names, its own columns, its path."""

    @tidy
    def run(batches):
        known: dict[tuple[int, int], list] = {}
        for b in batches:
            for r in range(b.num_rows):
                at = lambda n: b.column(n)[r]  # noqa: E731, B023
                own = at("own").values
                up_by = min(levels, height(at("total").as_py()))
                if (len(own), up_by) not in known:
                    known[len(own), up_by] = steps(len(own), up_by)
                log = np.frombuffer(at("log").as_buffer(), np.uint8).reshape(-1, STEP - 1)
                up = np.frombuffer(at("up").as_buffer() or b"", np.uint8)
                path = np.empty((len(own), up_by * STEP + len(up)), np.uint8)
                for h, (side, where) in enumerate(known[len(own), up_by]):
                    path[:, h * STEP] = side
                    path[:, h * STEP + 1 : (h + 1) * STEP] = log[where]
                path[:, up_by * STEP :] = up
                ends = np.arange(len(own) + 1, dtype=np.int32) * path.shape[1]
                cols = {n: pa.array([at(n).as_py()] * len(own), b.schema.field(n).type) for n in names}
                cols |= {f.name: own.field(f.name) for f in own.type if f.name != "__pos"}
                cols["place"] = own.field("__pos")
                cols["path"] = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(path.tobytes())])
                yield pa.RecordBatch.from_pydict(cols)

    return run


def paths(tiers: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """A row for each leaf of the trees: tree, place (its number), its own columns, those of ``tops`` and its path to the root.

    ``tops``: tree, up (path of the tree's top) and more columns, a row for each tree. Blocks meet their tops' paths one
    to one, tier by tier, the highest first.
    """
    more = [c for c in tops.columns if c not in ("tree", "up")]
    above = None
    for k, tier in reversed(list(enumerate(tiers))):
        rows = tier.where(F.col("total") <= 1 << levels).join(tops, "tree")
        if above is not None:
            rows = rows.unionByName(tier.where(F.col("total") > 1 << levels).join(above, ["tree", "block"]))
        own = tier.schema["own"].dataType.elementType
        kinds = StructType([StructField("tree", StringType()), *(tops.schema[c] for c in more), *(f for f in own if f.name != "__pos"), StructField("place", LongType()), StructField("path", BinaryType())])
        out = rows.mapInArrow(paths_of(["tree", *more], levels), kinds)
        above = out.select("tree", F.col("place").alias("block"), F.col("path").alias("up"), *more)
    return out


def siblings(path: Column) -> Column:
    """The digests (hex) of a path, from the leaf up, left ones and right ones."""
    n = (F.length(path) / STEP).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    at = F.filter(at, lambda i: F.substring(path, i * STEP + 1, F.lit(1)) != F.lit(bytearray(b"\x02")))
    return F.transform(at, lambda i: F.lower(F.hex(F.substring(path, i * STEP + 2, F.lit(STEP - 1)))))


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest (hex) and its path give."""
    n = (F.length(path) / STEP).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def step(node, i):
        side, other = F.substring(path, i * STEP + 1, F.lit(1)), F.lower(F.hex(F.substring(path, i * STEP + 2, F.lit(STEP - 1))))
        return F.sha2(F.when(side == F.lit(bytearray(b"\x00")), F.concat(other, node)).when(side == F.lit(bytearray(b"\x01")), F.concat(node, other)).otherwise(node), 256)

    return F.aggregate(at, digest, step)


@dataclass
class Manifest:
    """``tiers``: blocks of every group's tree; ``top_tiers``: of the tree of the groups' roots; ``roots``: tree, top, leaves."""

    tiers: list[DataFrame]
    top_tiers: list[DataFrame]
    roots: DataFrame
    root: DataFrame
    levels: int

    def proofs(self) -> DataFrame:
        """A row for each row of the dataset: its own columns, leaf, subroot, root and path (see ``siblings`` and ``fold``)."""
        root = self.root.select("tree", F.lit(bytearray()).alias("up"), F.col("top").alias("root"))
        groups = paths(self.top_tiers, root, self.levels).select(F.col("group").alias("tree"), F.col("path").alias("up"), "root", F.col("top").alias("subroot"))
        return paths(self.tiers, groups, self.levels).drop("tree", "place")

    def log(self) -> DataFrame:
        """The log: tree, position (gapless from 0 in each tree), height, digest (hex)."""
        out = None
        for k, tier in enumerate(self.tiers):
            rows = tier.select("tree", "total", "block", "leaves", "log").mapInArrow(_log_of(k, self.levels), "tree string, position long, height int, digest string")
            out = rows if out is None else out.unionByName(rows)
        return out


def _log_of(tier: int, levels: int) -> Callable:
    @tidy
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                lowest, unit = r["block"] << levels, tier * levels
                count = min(1 << levels, r["total"] - lowest)
                _, places = append([b""] * count, min(levels, height(r["total"])))
                rows = [(h + unit, (lowest >> h) + i, r["log"][k * 32 : k * 32 + 32].hex()) for k, (h, i) in enumerate(places) if h or not tier]
                at = [position(i << h, min(1 << h, r["leaves"] - (i << h)), h) for h, i, _ in rows]
                yield pa.RecordBatch.from_pydict({"tree": pa.array([r["tree"]] * len(rows), pa.string()), "position": pa.array(at, pa.int64()), "height": pa.array([h for h, _, _ in rows], pa.int32()), "digest": pa.array([d for _, _, d in rows], pa.string())})

    return run


def manifest(rows: DataFrame, digest: Column, group: Column, order: list[str], keep: list[Column], levels: int | None = None) -> Manifest:
    """The trees of ``rows``: one for each value of ``group`` (string, null is a group of its own), and one of their roots.

    Leaves ascend by ``order`` (nulls first) inside a group; rows alike in it come by digest, and rows alike in that too
    have places of their own. Roots of groups ascend by the group's UTF-8 bytes, null first. ``keep``: columns that a
    leaf carries to its proof. An empty table has no tree and no root. Other columns are ignored.

    Positions need no group in one task (``numbered``); a builder sees 2 ** ``levels`` nodes at most (256 by
    default), and each tier has that much fewer nodes than the one below.
    """
    scratch, levels = Scratch(rows.sparkSession), LEVELS if levels is None else levels
    tree = F.coalesce(F.concat(F.lit("+"), group), F.lit("")).alias("tree")
    own = [f"__k{i}" for i in range(len(order))]
    names = [rows.select(c).columns[0] for c in keep]
    base = scratch.save(rows.select(tree, *(F.col(o).alias(n) for o, n in zip(order, own, strict=True)), digest.alias("digest"), *keep).withColumn("leaf", F.col("digest")).withColumn("__row", F.monotonically_increasing_id()))
    placed = numbered(scratch, base, ["tree"], [*own, "digest", "__row"])
    tiers, roots = grow(placed, scratch, [*names, "leaf"], levels)
    roots = scratch.save(roots)
    groups = numbered(scratch, roots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "top", F.col("top").alias("digest")), ["tree"], ["group"])
    top_tiers, root = grow(groups, scratch, ["group", "top"], levels)
    return Manifest(tiers, top_tiers, roots, root, levels)
