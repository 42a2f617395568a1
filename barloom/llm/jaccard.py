"""N-gram Jaccard join: which texts share at least three quarters of their word shingles.

The sets are reduced before any pair is looked at, then joined by a size-aware heavy-light join:

1. every text becomes its set of 64-bit shingle hashes; sets of a batch are sorted together and sent, as packed arrays,
   to ranges of the hash space, where shingles found in two sets at least are counted for each set. A set linked with
   another shares three quarters of its shingles, so sets with fewer shared shingles have no partner;
2. of those left, each distinct set is kept once and counted again among its like;
3. two linked sets have k shingles in common among the first n - ceil(3n/4) + k of either, rarest first. Small sets
   enumerate all 2-subsets of that prefix as keys (a key is shared by few sets); large sets, of which there are few,
   go into inverted lists of single shingles. The boundary is the size at which the estimated cost is least;
4. sets of a list are verified against the list's leader first. Only where a list's sets are then in different
   components are the rest compared, in blocks of sets that are at home in the same list, all overlaps of two blocks at
   once; so a group of n near copies costs about n verifications and no pair is written out.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, components, small, tidy

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACE = b" \t\n\r\x0b\x0c"
#: Words that a worker remembers the hashes of; words of one text hashed at a time, in bytes; shingles of one batch.
REMEMBER, PART_BYTES, BATCH = 60_000, 4 << 20, 1_500_000
MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5), np.uint64(0x85EBCA77C2B2AE63)]
PACKED = "range int, batch string, keys binary, owners binary, sets int, doc_ids array<long>, missing array<int>, hs array<long>, set_of array<int>, nodes array<long>, sizes array<long>"


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > REMEMBER:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


HASHES = Hashes()


def word_hashes(text: str | None):
    """Arrays of the hashes of a text's words, in order; a very long text in several parts."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(LOWER)
    at = 0
    while at < len(data):
        end = at + PART_BYTES
        while end < len(data) and data[end] not in SPACE:
            end += 1
        words = data[at:end].split()
        at = end
        if words:
            yield np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; of fewer words, the one hash of them all; of none, nothing."""
    parts, carry, total = [], np.empty(0, np.uint64), 0
    for words in word_hashes(text):
        total += len(words)
        words = np.concatenate([carry, words])
        if len(words) >= width:
            n = len(words) - width + 1
            h = np.zeros(n, np.uint64)
            for j in range(width):
                h += (words[j : j + n] ^ MIX[(j + 1) % 5]) * MIX[j % 5]
            parts.append(mixed(h))
        carry = words[-(width - 1) :] if width > 1 else words[:0]
    if 0 < total < width:
        h = np.array([total], np.uint64)
        for i in range(total):
            h = mixed(h * MIX[0] + carry[i : i + 1])
        return h
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def node_of(s: np.ndarray) -> int:
    """A set's name: 64 bits of a digest of its members."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _batch(rows) -> pa.RecordBatch:
    t = [pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), t, strict=True)], names=[f.split()[0] for f in PACKED.split(", ")])


def planes(keys: np.ndarray) -> bytes:
    """The upper 48 bits of sorted keys, byte by byte: what sorted keys have alike lies together and compresses."""
    return np.ascontiguousarray((keys >> np.uint64(16)).view("u1").reshape(-1, 8)[:, :6].T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    got = np.frombuffer(data, "u1").reshape(6, -1)
    out = np.zeros((got.shape[1], 8), "u1")
    out[:, :6] = got.T
    return out.reshape(-1).view(np.uint64)


def pack_sets(found, ranges: int):
    """Rows of PACKED from (doc_id, h, node or None, set): of each batch a row for each range of hashes, and one that says whose they are.

    A batch's name is its place in the input, so a task that runs again makes the same rows. Only 48 bits of a hash are
    sent: two that agree there count as shared, which can keep a set but never lose one.
    """
    task, serial = TaskContext.get().partitionId(), 0

    def flush():
        owner = np.repeat(np.arange(len(sets), dtype="<u2"), [len(s) for s in sets])
        keys = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        order = np.argsort(keys)
        keys, owner = keys[order], owner[order]
        name = f"{task}-{serial}"
        step = np.uint64(2**64 // ranges + 1)
        edges = np.append(np.searchsorted(keys, np.arange(ranges, dtype=np.uint64) * step), len(keys))
        missing = [i for i, d in enumerate(doc_ids) if d is None]
        yield [(ranges + zlib.crc32(name.encode()) % ranges, name, None, None, len(sets), [d or 0 for d in doc_ids], missing, hs, set_of, nodes, sizes)]
        rows = []
        for r in range(ranges):
            a, b = int(edges[r]), int(edges[r + 1])
            if a < b:
                rows.append((r, name, planes(keys[a:b]), owner[a:b].tobytes(), len(sets), None, None, None, None, None, None))
        if rows:
            yield rows

    doc_ids, hs, set_of, nodes, sizes, sets, seen, total = [], [], [], [], [], [], {}, 0
    for doc, h, node, s in found:
        node = node_of(s) if node is None else node
        if node not in seen:
            seen[node] = len(sets)
            sets.append(s)
            nodes.append(node)
            sizes.append(len(s))
            total += len(s)
        doc_ids.append(doc)
        hs.append(h)
        set_of.append(seen[node])
        if total >= BATCH or len(doc_ids) >= 50_000:
            for rows in flush():
                yield _batch(rows)
            serial += 1
            doc_ids, hs, set_of, nodes, sizes, sets, seen, total = [], [], [], [], [], [], {}, 0
    if doc_ids:
        for rows in flush():
            yield _batch(rows)


COUNTED = "batch string, sets int, doc_ids array<long>, missing array<int>, hs array<long>, set_of array<int>, nodes array<long>, sizes array<long>, counts binary"


@tidy
def count_range(pdf: pd.DataFrame) -> pd.DataFrame:
    """For one range of hashes: for each batch, how many shingles of each of its sets are in another set too."""
    named = ["batch", "sets", "doc_ids", "missing", "hs", "set_of", "nodes", "sizes"]
    if pdf["keys"].isna().all():
        return pdf[named].assign(counts=None)
    keys = np.concatenate([from_planes(k) for k in pdf["keys"]])
    order = np.argsort(keys)
    same = keys[order]
    same = same[1:] == same[:-1]
    shared = np.empty(len(keys), bool)
    shared[order] = np.append(same, False) | np.append(False, same)
    out, at = [], 0
    for owners, sets in zip(pdf["owners"], pdf["sets"], strict=True):
        o = np.frombuffer(owners, "<u2")
        out.append(np.bincount(o[shared[at : at + len(o)]], minlength=sets).astype("<u4").tobytes())
        at += len(o)
    return pdf[named].assign(counts=out)


@tidy
def sum_batch(pdf: pd.DataFrame) -> pd.DataFrame:
    whose = pdf[pdf["nodes"].notna()].iloc[0]
    total = np.zeros(int(whose["sets"]), "int64")
    for c in pdf["counts"].dropna():
        total += np.frombuffer(c, "<u4")
    at = np.asarray(whose["set_of"], "int64")
    ids = pd.array(np.asarray(whose["doc_ids"], "int64"), "Int64")
    ids[np.asarray(whose["missing"], "int64")] = pd.NA
    return pd.DataFrame({"doc_id": ids, "h": np.asarray(whose["hs"], "int64"), "node": np.asarray(whose["nodes"], "int64")[at], "n": np.asarray(whose["sizes"], "int64")[at], "shared": total[at]})


def shared_counts(packed: DataFrame) -> DataFrame:
    """(doc_id, h, node, n, shared) from rows of PACKED."""
    ranged = packed.groupBy("range").applyInPandas(count_range, COUNTED)
    return ranged.groupBy("batch").applyInPandas(sum_batch, "doc_id long, h long, node long, n long, shared long")


def prefix(n, k: int, tenths: int = 75):
    """How many of the first of n members hold k common ones, if 100 * intersection >= tenths * union."""
    return F.least(n, n - F.ceil(n * tenths / 100) + k).cast("int")


def ranked(sets: DataFrame) -> DataFrame:
    """(node, n, member, place): the members that other sets have too, and their place in their set, rarest first."""
    each = sets.select("node", "n", F.explode("members").alias("member"))
    common = each.groupBy("member").agg(F.count("*").alias("df")).where("df > 1")
    by = Window.partitionBy("node")
    got = each.join(common, "member")
    # members of no other set come before all others: they take the first places
    return got.withColumn("place", F.col("n") - F.count("*").over(by) + F.row_number().over(by.orderBy("df", "member"))).select("node", "n", "member", "place")


def boundary(places: DataFrame, threshold: int, meets: float = 4.0) -> int:
    """The set size up to which sets count as light: where keys made for light sets and list entries met for heavy ones cost least.

    A light set costs its 2-subsets; a heavy one, or one that may meet a heavy one, its prefix times ``meets`` (entries
    that a list's member is set against).
    """
    p1, p2 = prefix(F.col("n"), 1, threshold), prefix(F.col("n"), 2, threshold)
    own = places.where(F.col("place") <= p2).groupBy("node").agg(F.first("n").alias("n"), F.sum((F.col("place") <= p1).cast("int")).alias("k1"), F.count("*").alias("k2"))
    tries = [4, 8, 16, 32, 64, 128]
    cost = [F.sum(F.when(F.col("n") <= x, F.col("k2") * (F.col("k2") - 1) / 2).otherwise(0.0) + F.when(F.col("n") > threshold * x / 100, F.col("k1") * meets).otherwise(0.0)).alias(f"c{x}") for x in tries]
    rows = own.agg(*cost).first()
    return min(tries, key=lambda x: (rows[f"c{x}"] or 0.0, x))


def keys_of(places: DataFrame, x: int, threshold: int) -> DataFrame:
    """(key, node, n): light sets by 2-subsets of their prefix, sets that may meet a heavy one by its single members."""
    p1, p2 = prefix(F.col("n"), 1, threshold), prefix(F.col("n"), 2, threshold)
    light = places.where((F.col("n") <= x) & (F.col("place") <= p2)).groupBy("node", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "member"))), lambda s: s["member"]).alias("p"))
    two = light.select("node", "n", F.posexplode("p").alias("i", "a"), "p").select("node", "n", "a", F.explode(F.slice("p", F.col("i") + 2, F.size("p"))).alias("b")).select(F.xxhash64(F.lit(2), "a", "b").alias("key"), "node", "n")
    # sets so small that one common member is enough, and those that they may meet
    one = places.where((F.col("n") <= x) & (F.col("n") <= (100 // threshold) * 100 / threshold)).select(F.xxhash64(F.lit(1), "member").alias("key"), "node", "n")
    heavy = places.where((F.col("n") > threshold * x / 100) & (F.col("place") <= p1)).select(F.xxhash64(F.lit(0), "member").alias("key"), "node", "n")
    return two.unionByName(one).unionByName(heavy)


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar enough, exactly."""
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("ma"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("mb"))
    both = F.size(F.array_intersect("ma", "mb"))
    return pairs.join(left, "a").join(right, "b").withColumn("both", both).where(100 * F.col("both") >= threshold * (F.size("ma") + F.size("mb") - F.col("both"))).select("a", "b")


def compare_blocks(pdf: pd.DataFrame, threshold: int, every: bool = False) -> pd.DataFrame:
    """Links that join components among the sets of two blocks (or within one): every overlap is counted, none is written out.

    With ``every``: (set, number of its links here) instead.
    """
    pdf = pdf.drop_duplicates(["node", "side"])
    side, node, comp = pdf["side"].to_numpy(), pdf["node"].to_numpy("int64"), pdf["c"].to_numpy("int64")
    sets = [np.frombuffer(m, np.uint64) for m in pdf["packed"]]
    size = np.array([len(s) for s in sets], np.int64)
    left, within = np.flatnonzero(side == 0), not (side == 1).any()
    right = left if within else np.flatnonzero(side == 1)
    keys, which = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(keys, kind="stable")
    keys, which = keys[order], which[order]
    new = np.append(True, keys[1:] != keys[:-1])
    number = np.cumsum(new) - 1
    many = np.bincount(number) > 1
    column = (np.cumsum(many) - 1)[number]
    keep = many[number]
    which, column = which[keep], column[keep]
    both = np.zeros((len(left), len(right)), np.float32)
    at_left, at_right = np.full(len(sets), -1), np.full(len(sets), -1)
    at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
    for c in range(0, int(many.sum()), 4096):  # members by the thousand: 0/1 matrices times each other count overlaps
        a, b = np.searchsorted(column, c), np.searchsorted(column, c + 4096)
        w, col = which[a:b], column[a:b] - c
        x, y = np.zeros((len(left), 4096), np.float32), np.zeros((len(right), 4096), np.float32)
        l, r = at_left[w] >= 0, at_right[w] >= 0
        x[at_left[w][l], col[l]] = 1
        y[at_right[w][r], col[r]] = 1
        both += x @ y.T
    linked = 100 * both >= threshold * (size[left][:, None] + size[right][None, :] - both)
    if within:
        np.fill_diagonal(linked, False)
    if every:
        n, m = linked.sum(1), linked.sum(0)
        return pd.DataFrame({"a": node[left] if within else np.append(node[left], node[right]), "b": n if within else np.append(n, m)})
    i, j = np.nonzero(linked & (comp[left][:, None] != comp[right][None, :]))
    boss: dict[int, int] = {}

    def top(v):
        while boss.get(v, v) != v:
            boss[v] = v = boss.get(boss[v], boss[v])
        return v

    out = []
    for u, v in zip(left[i].tolist(), right[j].tolist(), strict=True):
        p, q = top(int(comp[u])), top(int(comp[v]))
        if p != q:
            boss[max(p, q)] = min(p, q)
            out.append((int(node[u]), int(node[v])))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def all_apart(apart: DataFrame, packed: DataFrame, scratch: Scratch, threshold: int, block_members: int = 40_000, every: bool = False) -> DataFrame:
    """Links (a, b) between sets of ``apart`` (key, node, n, c, in_list) that share a key and are in different components c; see ``compare_blocks``.

    A set is at home in the longest of its lists, so near copies of each other, which share many lists, have one home;
    a home is cut into blocks of bounded size. Two blocks of one home meet; blocks of different homes meet in those sets
    that share a list across them. So each pair of sets is compared once, however many lists it is in.
    """
    home = apart.groupBy("node").agg(F.max_by("key", F.struct("in_list", "key")).alias("home"), F.first("n").alias("n"))
    parts = home.groupBy("home").agg(F.ceil(F.sum(F.greatest("n", F.lit(100))) / block_members).alias("parts"))  # of few sets, however small they are
    rows = apart.count()
    nodes = scratch.save(home.join(parts, "home").select("node", "home", F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("block")), rows // 4)
    each = scratch.save(apart.select("key", "node", "c").join(nodes, "node"), rows)
    met = each.groupBy("key", "home", "block").agg(F.min("c").alias("low"), F.max("c").alias("high")).withColumnsRenamed({"home": "to_home", "block": "to"})
    meets = ((F.col("low") != F.col("c")) | (F.col("high") != F.col("c"))) & ((F.col("home") != F.col("to_home")) | (F.col("key") == F.col("home")))
    pair = [F.least("block", "to").alias("block"), F.greatest("block", "to").alias("to"), (F.col("block") > F.col("to")).cast("int").alias("side")]
    reach = scratch.save(each.join(met, "key").where(meets).select(*pair, "node", "c").distinct(), rows)
    return reach.join(packed, "node").groupBy("block", "to").applyInPandas(lambda pdf: compare_blocks(pdf, threshold, every), "a long, b long")


def jaccard_components(docs: DataFrame, width: int = 5, threshold: int = 75) -> DataFrame:
    """Classes of ``docs`` (doc_id, text) under 100 * intersection >= threshold * union of word shingles.

    A row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included), node (its
    set's name; equal sets have the same), class_id (of its class: the least node) and h (xxhash64 of the text). Null and empty texts have an empty set and link with nothing: their
    component is their own doc_id. Rows without doc_id lend their set to their class but not their id; if a class has
    no id at all its component is null. Repeated rows are copies. Whole texts are read, however long; other columns
    are ignored; an empty table gives no rows. Sets are compared by 64-bit hashes of their shingles.
    """
    scratch = Scratch(docs.sparkSession)
    meta, packed, kept, postings, leaders = candidates(docs, scratch, width, threshold)
    sets, entries = leaders.count(), postings.count()
    links = scratch.save(verified(leaders.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")), kept, threshold), sets)
    # then what is still apart: of each list one set of each component against one of its largest component, then all
    for exhaustive in (False, True):
        comp = components(links, scratch, sets)
        named = postings.join(comp, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
        mixed_lists = named.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
        apart = scratch.save(named.join(mixed_lists, "key").select("key", "node", "n", "c", "in_list"), entries)
        if exhaustive:
            more = scratch.save(all_apart(apart, packed, scratch, threshold))
        else:
            rep = apart.groupBy("key", "c").agg(F.min("node").alias("node"), F.count("*").alias("size"))
            top = rep.groupBy("key").agg(F.max_by(F.struct("node", "c"), F.struct("size", "c")).alias("t"))
            tried = rep.join(top, "key").where("c <> t.c").groupBy(F.col("node").alias("a"), F.col("t.node").alias("b")).agg(F.count("*").alias("votes"))
            more = scratch.save(verified(tried.groupBy("a").agg(F.max_by("b", F.struct("votes", "b")).alias("b")), kept, threshold), sets)
        links = links.unionByName(more)
    comp = scratch.save(components(links, scratch, sets).select(F.col("node").alias("member"), "component"), sets)
    named = meta.join(small(comp), F.col("node") == F.col("member"), "left").withColumn("class_id", F.coalesce("component", "node"))
    classes = named.where("n > 0").groupBy(F.col("class_id").alias("of")).agg(F.min("doc_id").alias("smallest"), F.count("*").alias("rows"))
    classes = scratch.save(classes.where("rows > 1").select("of", "smallest"), meta.count() // 2)
    out = named.join(small(classes), (F.col("class_id") == F.col("of")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id"), "node", "class_id", "h")


def jaccard_links(docs: DataFrame, width: int = 5, threshold: int = 75) -> DataFrame:
    """Every row of ``docs`` with the number of links of its set: doc_id, node, n_shingles, n_links (other distinct sets with 100 * intersection >= threshold * union).

    All sets that share a key are compared, also those of one component; equal sets are one.
    """
    scratch = Scratch(docs.sparkSession)
    meta, packed, _, postings, leaders = candidates(docs, scratch, width, threshold)
    met = all_apart(postings.select("key", "node", "n", F.col("node").alias("c"), "in_list"), packed, scratch, threshold, every=True)
    each = scratch.save(met.groupBy(F.col("a").alias("of")).agg(F.sum("b").alias("n_links")), leaders.count())
    out = meta.join(small(each), F.col("node") == F.col("of"), "left")
    return out.select("doc_id", "node", F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def candidates(docs: DataFrame, scratch: Scratch, width: int, threshold: int):
    """(meta: doc_id, h (hash of the text), node, n, shared of each row; packed and kept: sets that may have a partner; postings: key, node, n, leader, in_list; leaders: node, leader)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("h"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(96, -(-size // (8 << 20)))

    @tidy
    def from_texts(batches):
        def rows():
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    for doc, text, h in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                        yield doc, h, None, shingles(text, width)

        yield from pack_sets(rows(), ranges)

    @tidy
    def from_sets(batches):
        rows = ((None, 0, n, np.frombuffer(m, np.uint64)) for b in batches for n, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        yield from pack_sets(rows, ranges)

    @tidy
    def to_sets(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = [(node, s) for node, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if node_of(s := shingles(text, width)) == node]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1].tobytes() for r in rows], pa.binary())], names=["node", "packed"])

    @tidy
    def new_sets(batches):
        seen = set()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = {}
                for text in b.slice(at, 256).column(0).to_pylist():
                    s = shingles(text, width)
                    if len(s) and (node := node_of(s)) not in seen:
                        seen.add(node)
                        rows[node] = s.tobytes()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array(list(rows.values()), pa.binary())], names=["node", "packed"])

    @tidy
    def unpacked(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                sets = [np.frombuffer(m, np.int64) for m in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "n", "members"])

    # 1: sets with enough shared shingles
    meta = scratch.save(shared_counts(texts.mapInArrow(from_texts, PACKED)))
    enough = (F.col("n") > 0) & (100 * F.col("shared") >= threshold * F.col("n"))
    reps = scratch.save(meta.where(enough & F.col("doc_id").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("doc_id")), meta.count())
    chosen = texts.join(small(reps), "doc_id").select("node", "text")
    found = chosen.mapInArrow(to_sets, "node long, packed binary")
    # sets that only rows without doc_id have
    nameless = scratch.save(meta.where(enough).groupBy("node").agg(F.count("doc_id").alias("ids")).where("ids = 0").select("node"), meta.count())
    if not nameless.isEmpty():
        more = texts.where("doc_id is null").select("text").mapInArrow(new_sets, "node long, packed binary")
        found = found.unionByName(more.join(small(nameless), "node", "left_semi"))
    sets = scratch.save(found)
    # 2: again, among distinct sets only
    again = shared_counts(sets.mapInArrow(from_sets, PACKED)).where(enough).select("node", "n").distinct()
    again = scratch.save(again, meta.count())
    members = again.agg(F.sum("n")).first()[0] or 0
    left = sets.join(small(again.select("node")), "node", "left_semi").dropDuplicates(["node"])
    packed = scratch.save(left)
    kept = scratch.save(packed.mapInArrow(unpacked, "node long, n long, members array<long>"))
    scratch.drop(sets)
    # 3: keys
    places = scratch.save(ranked(kept).where(F.col("place") <= prefix(F.col("n"), 2, threshold)))
    keys = keys_of(places, boundary(places, threshold), threshold).distinct()
    lists = keys.groupBy("key").agg(F.count("*").alias("in_list"), F.min("node").alias("leader")).where("in_list > 1")
    postings = scratch.save(keys.join(lists, "key").select("key", "node", "n", "leader", "in_list"))
    # 4: each set against the leader it shares most keys with
    votes = postings.groupBy("node", "leader").agg(F.count("*").alias("votes"))
    leaders = scratch.save(votes.groupBy("node").agg(F.max_by("leader", F.struct("votes", "leader")).alias("leader")), members // 50)
    return meta, packed, kept, postings, leaders
