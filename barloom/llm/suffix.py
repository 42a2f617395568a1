"""Removal of repeated byte strings by prefix doubling over sampled positions.

A byte goes if a string of ``length`` bytes over it also starts earlier in the corpus. Ranking every position in every
round would sort a row for each byte; here positions are sampled, so that equal strings are sampled at equal places, and
drop out as soon as their rank is unique:

1. of each window of ``length`` bytes the position with the least hash of ``seed`` bytes represents it. Which one that
   is depends on the window's bytes alone, so equal windows are represented by equal strings at equal places. Windows
   next to each other mostly share their representative; together they are a run;
2. a representative's first rank is that of its ``seed`` bytes. Those whose rank is unique drop out with all their
   windows. The rest are ranked by the pair (rank of the seed, rank of all bytes of the run's windows): a run whose pair
   occurs in an earlier document is repeated as a whole. The first run of each pair stays, as the pair's source;
3. where one seed has several pairs, the first runs are ranked again at twice the length, by the pairs (rank, rank at an
   offset of ``seed`` bytes) to the right and to the left. Windows over a string whose rank is now unique drop out;
4. the windows left are ranked one by one, by the full length, which is past the threshold, so the ranking ends: all but
   the earliest of a rank are repeated.

Ranks are 64-bit fingerprints (a sum of byte codes times powers of an odd number); what is removed has two of them equal,
128 bits. A batch of texts sorts its positions together, keeps the earliest of each rank (of each text, where texts of one
id share it), and sends the others to no one; what remains goes, as packed sorted arrays, to ranges of the ranks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, small, tidy

#: Bytes of text, and windows, that are hashed together; texts over it make a batch of their own.
BATCH, WINDOWS = 8 << 20, 1_000_000
PRIME, LAST = np.uint64(0x9E3779B97F4A7C15), 2**63 - 1
PRIMES = [PRIME, np.uint64(0xD1342543DE82EF95)]
CODES = np.random.Generator(np.random.PCG64(20)).integers(0, 2**64, (2, 256), np.uint64, endpoint=False) | np.uint64(1)
PARTS = {"rank": "<u8", "pair": "<u8", "doc": "<i8", "owner": "<u2", "pos": "<u4", "run": "<u2", "back": "<u2"}
PACKED = f"range int, batch string, {', '.join(f'{p} binary' for p in PARTS)}, ids array<long>, hs array<long>, local binary"
NAMES = [f.split()[0] for f in PACKED.split(", ")]
TYPES = [pa.int32(), pa.string(), *[pa.binary()] * len(PARTS), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
#: A run: document in its batch, first window, windows, place of the representative in the first window; kind 1: repeated, 2: to be ranked on.
RUN = np.dtype([("owner", "<u4"), ("pos", "<u4"), ("run", "<u4"), ("back", "<u2"), ("kind", "u1")])


def planes(x: np.ndarray) -> bytes:
    """An array's bytes, all first bytes, then all second ones: equal ones lie together and compress."""
    return np.ascontiguousarray(x.view("u1").reshape(len(x), -1).T).tobytes()


def from_planes(data: bytes, dtype: str) -> np.ndarray:
    w = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, "u1").reshape(w, -1).T).reshape(-1).view(dtype)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd multiplier and of its inverse, as far as the longest text so far."""

    def __init__(self, prime: np.uint64):
        self.prime, self.up, self.down = prime, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def of(self, n: int):
        if len(self.up) < n:
            m = 1 << (n - 1).bit_length()
            inverse = np.uint64(pow(int(self.prime), -1, 2**64))
            self.up = np.cumprod(np.append(np.uint64(1), np.full(m, self.prime)), dtype=np.uint64)
            self.down = np.cumprod(np.append(np.uint64(1), np.full(m, inverse)), dtype=np.uint64)
        return self.up, self.down


POWERS = [Powers(p) for p in PRIMES]


class Prints:
    """Fingerprints of any substrings of ``data``; two kinds that know nothing of each other."""

    def __init__(self, data: bytes, kind: int = 0):
        n = len(data)
        up, self.down = POWERS[kind].of(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(CODES[kind][np.frombuffer(data, "u1")] * up[:n], out=self.sums[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def every(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.down[:n]


def runs_of(data: bytes, length: int, seed: int):
    """(rank of the seed, rank of the run's bytes, first window, windows, representative's place in the first) of each run of a text's windows."""
    if len(data) < length:
        e = np.empty(0, np.uint64)
        return e, e, *[np.empty(0, "int64")] * 3
    prints = Prints(data)
    h = prints.every(seed)
    order = (mixed(h) & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
    width, span = length - seed + 1, 1
    low = order
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    at = (np.uint64(0xFFFFFFFF) - (low & np.uint64(0xFFFFFFFF))).astype("int64")  # the representative of each window
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    count = np.diff(np.append(first, len(at)))
    back = (at[first] - first).astype(np.uint64)  # windows differ where the representative's place in them does
    # of the other kind, as the seed's fingerprint is part of this one's kind: together 128 bits
    whole = mixed(Prints(data, 1).at(first, first + count - 1 + length) ^ (back * PRIME) ^ (count.astype(np.uint64) << np.uint64(48)))
    # the least of many hashes is small: another mix spreads the ranks evenly over the ranges
    return mixed(h[at[first]] ^ PRIME), whole, first, count, at[first] - first


def firsts(doc: np.ndarray, owner: np.ndarray, *ranks: np.ndarray):
    """(order by rank, then document, owner and place, which come in order of owner and place; whether each in this order is not repeated).

    A rank is repeated where it is in a document of smaller id, or earlier in the same text. Texts of one id (all of
    null) are not earlier than each other, so each of them keeps one.
    """
    order = np.lexsort((doc, *ranks[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for r in ranks:
        s = r[order]
        new[1:] |= s[1:] != s[:-1]
    d, o = doc[order], owner[order]
    kept = new.copy()
    kept[1:] |= o[1:] != o[:-1]
    return order, kept & (d == d[new][np.cumsum(new) - 1])


def send(name: str, ranges: int, ids, hs, local: np.ndarray, **parts):
    """Rows of PACKED: for each range of the sorted ``rank`` one, and one that has the batch's documents and ``local`` runs."""
    step = np.uint64(2**64 // ranges + 1)
    rank = parts["rank"]
    edges = np.append(np.searchsorted(rank, np.arange(ranges, dtype=np.uint64) * step), len(rank))
    rows = [(ranges + zlib.crc32(name.encode()) % ranges, name, *[None] * len(PARTS), ids, hs, local.tobytes())]
    parts = [parts[p].astype(t, copy=False) if p in parts else None for p, t in PARTS.items()]
    for r in range(ranges):
        a, b = int(edges[r]), int(edges[r + 1])
        if a < b:
            rows.append((r, name, *(None if p is None else planes(p[a:b]) for p in parts), None, None, None))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES)


def batches_of(rows):
    """Lists of (id, h, bytes, more) of about BATCH bytes, or WINDOWS windows to rank; rows that repeat id and h in a batch go once."""
    some, seen, total, windows = [], set(), 0, 0
    for doc, h, text, *more in rows:
        if (doc, h) in seen:
            continue
        seen.add((doc, h))
        data = (text or "").encode("utf-8", "surrogatepass")
        some.append((doc, h, data, *(split(m) for m in more)))
        total += len(data)
        windows += sum(int(m["run"].sum()) for m in some[-1][3:])
        if total >= BATCH or windows >= WINDOWS or len(some) >= 60_000:
            yield some
            some, seen, total, windows = [], set(), 0, 0
    if some:
        yield some


def split(runs: bytes) -> np.ndarray:
    """Those of a document's runs that are to be ranked on."""
    runs = np.frombuffer(runs, RUN)
    return runs[runs["kind"] == 2]


def columns(batches, *cols):
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            yield from zip(*(part.column(k).to_pylist() for k in cols), strict=True)


def named(runs: np.ndarray, owner, kind: int) -> np.ndarray:
    """RUN rows of a dictionary of arrays or of other RUN rows."""
    out = np.zeros(len(owner), RUN)
    for k in ("pos", "run", "back"):
        out[k] = runs[k]
    out["owner"], out["kind"] = owner, kind
    return out


@tidy
def send_runs(batches, length: int, seed: int, ranges: int):
    task = TaskContext.get().partitionId()
    for serial, some in enumerate(batches_of(columns(batches, 0, 1, 2))):
        found = [runs_of(data, length, seed) for _, _, data in some]
        owner = np.repeat(np.arange(len(some)), [len(p[0]) for p in found])
        rank, pair, pos, run, back = (np.concatenate([p[k] for p in found]) for k in range(5))
        ids = np.array([d for d, _, _ in some], "int64")
        doc = ids[owner]
        order, new = firsts(doc, owner, rank, pair)
        again, kept = order[~new], order[new]
        parts = {"rank": rank, "pair": pair, "doc": doc, "owner": owner, "pos": pos, "run": run, "back": back}
        local = named({k: parts[k][again] for k in ("pos", "run", "back")}, owner[again], 1)
        yield send(f"{task}-{serial}", ranges, ids.tolist(), [h for _, h, _ in some], local, **{k: v[kept] for k, v in parts.items()})


@tidy
def send_doubled(batches, length: int, seed: int, ranges: int):
    """Of each run to be ranked on, the ranks of twice the seed's length to the right (even places) and to the left (odd places) of its representative."""
    task = TaskContext.get().partitionId()
    for serial, some in enumerate(batches_of(columns(batches, 0, 1, 2, 3))):
        ranks, owner, place, local, before = [], [], [], [], 0
        for i, (_, _, data, runs) in enumerate(some):
            at, last = runs["pos"].astype("int64") + runs["back"], runs["back"].astype("int64") - runs["run"] + 1
            prints = Prints(data)
            for side, ok in ((0, last <= length - 2 * seed), (1, runs["back"] >= seed)):
                first = at[ok] - side * seed
                a, b = prints.at(first, first + seed), prints.at(first + seed, first + 2 * seed)
                ranks.append(mixed(mixed(a) * PRIME + b + np.uint64(side)))
                owner.append(np.full(len(first), i))
                place.append(2 * (before + np.flatnonzero(ok)) + side)
            local.append(named(runs, np.full(len(runs), i), 2))
            before += len(runs)
        rank, owner, place = (np.concatenate(x) for x in (ranks, owner, place))
        order = np.argsort(rank)
        yield send(f"{task}-{serial}", ranges, [d for d, *_ in some], [h for _, h, *_ in some], np.concatenate(local), rank=rank[order], owner=owner[order], pos=place[order])


@tidy
def send_windows(batches, length: int, ranges: int):
    task = TaskContext.get().partitionId()
    for serial, some in enumerate(batches_of(columns(batches, 0, 1, 2, 3))):
        ranks, pairs, places = [], [], []
        for _, _, data, runs in some:
            n = runs["run"].astype("int64")
            start = np.repeat(runs["pos"].astype("int64") - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            ranks.append(mixed(Prints(data).at(start, start + length)))
            pairs.append(mixed(Prints(data, 1).at(start, start + length)))
            places.append(start)
        owner = np.repeat(np.arange(len(some)), [len(p) for p in places])
        rank, pair, pos = (np.concatenate(x) for x in (ranks, pairs, places))
        ids = np.array([d for d, *_ in some], "int64")
        doc = ids[owner]
        order, new = firsts(doc, owner, rank, pair)
        again, kept = order[~new], order[new]
        local = named({"pos": pos[again], "run": 1, "back": 0}, owner[again], 1)
        yield send(f"{task}-{serial}", ranges, ids.tolist(), [h for _, h, *_ in some], local, rank=rank[kept], pair=pair[kept], doc=doc[kept], owner=owner[kept], pos=pos[kept])


RANKED = "batch string, ids array<long>, hs array<long>, runs binary"


def unpacked(pdf: pd.DataFrame, *parts: str):
    """(whose batch an entry is, its parts) of one range."""
    out = [np.concatenate([from_planes(x, PARTS[p]) for x in pdf[p]]) if pdf[p].notna().all() else None for p in parts]
    return np.repeat(np.arange(len(pdf)), [len(x) // 8 for x in pdf["rank"]]), *out


def answers(pdf: pd.DataFrame, meta: pd.DataFrame, source: np.ndarray, found: np.ndarray) -> pd.DataFrame:
    """Rows of RANKED: what a range says to each batch, and the batches' own rows."""
    found = found[np.argsort(source, kind="stable")]
    edges = np.searchsorted(np.sort(source), np.arange(len(pdf) + 1))
    rows = [(b, found[edges[i] : edges[i + 1]].tobytes()) for i, b in enumerate(pdf["batch"]) if edges[i] < edges[i + 1]]
    out = pd.DataFrame({"batch": [x[0] for x in rows], "ids": None, "hs": None, "runs": [x[1] for x in rows]}, dtype=object)
    return pd.concat([meta[["batch", "ids", "hs"]].assign(runs=meta["local"]), out]) if len(meta) else out


@tidy
def rerank(pdf: pd.DataFrame) -> pd.DataFrame:
    """For one range of ranks: each batch's runs that occur earlier elsewhere, or whose rank has several pairs."""
    meta, pdf = pdf[pdf["rank"].isna()], pdf[pdf["rank"].notna()]
    if not len(pdf):
        return answers(pdf, meta, np.empty(0, "int64"), np.empty(0, RUN))
    source, rank, pair, doc, owner, pos, run, back = unpacked(pdf, *PARTS)
    order = np.lexsort((doc, pair, rank))
    r, p, d = rank[order], pair[order], doc[order]
    new_rank = np.append(True, r[1:] != r[:-1])
    new_pair = new_rank | np.append(True, p[1:] != p[:-1])
    later = d > d[new_pair][np.cumsum(new_pair) - 1]
    if run is None:  # windows: the last round
        at, kind = order[later], 1
        found = named({"pos": pos[at], "run": 1, "back": 0}, owner[at], 1)
    else:
        several = np.bincount(np.cumsum(new_rank) - 1, weights=new_pair)[np.cumsum(new_rank) - 1] > 1
        kind = np.where(later, 1, np.where(several, 2, 0))
        at, kind = order[kind > 0], kind[kind > 0]
        found = named({"pos": pos[at], "run": run[at], "back": back[at]}, owner[at], kind)
    return answers(pdf, meta, source[at], found)


@tidy
def unique(pdf: pd.DataFrame) -> pd.DataFrame:
    """For one range of ranks: the places of each batch whose rank no other place has."""
    meta, pdf = pdf[pdf["rank"].isna()], pdf[pdf["rank"].notna()]
    if not len(pdf):
        return answers(pdf, meta, np.empty(0, "int64"), np.empty(0, "<u4"))
    source, rank, pos = unpacked(pdf, "rank", "pos")
    order = np.argsort(rank)
    same = rank[order][1:] == rank[order][:-1]
    at = order[~(np.append(False, same) | np.append(same, False))]
    return answers(pdf, meta, source[at], pos[at])


def trim(length: int, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """The runs of a batch without the windows over strings of unique rank."""
        whose = pdf["ids"].notna()
        meta = pdf[whose].iloc[0]
        runs = np.frombuffer(meta["runs"], RUN)
        alone = np.zeros(2 * len(runs), bool)
        for x in pdf["runs"][~whose]:
            alone[np.frombuffer(x, "<u4")] = True
        # a window in which the representative has place k holds the string to its right if k is at most ``right``, that to its left if k is ``seed`` at least
        high, right = runs["back"].astype("int64"), length - 2 * seed
        low = high - runs["run"] + 1
        low2, high2 = np.where(alone[::2], np.maximum(low, right + 1), low), np.where(alone[1::2], np.minimum(high, seed - 1), high)
        left = runs.copy()
        left["pos"] += (high - high2).astype("u4")
        left["run"], left["back"] = np.maximum(0, high2 - low2 + 1), high2
        return per_document(left[high2 >= low2], meta)

    return run


def per_document(runs: np.ndarray, meta) -> pd.DataFrame:
    runs = runs[np.lexsort((runs["pos"], runs["owner"]))]
    owners = np.unique(runs["owner"])
    left, right = np.searchsorted(runs["owner"], owners), np.searchsorted(runs["owner"], owners, "right")
    return pd.DataFrame({"id": np.asarray(meta["ids"], "int64")[owners], "h": np.asarray(meta["hs"], "int64")[owners], "runs": [runs[a:b].tobytes() for a, b in zip(left, right, strict=True)], "split": [bool((runs["kind"][a:b] == 2).any()) for a, b in zip(left, right, strict=True)]})


def by_document(pdf: pd.DataFrame) -> pd.DataFrame:
    return per_document(np.concatenate([np.frombuffer(x, RUN) for x in pdf["runs"]]), pdf[pdf["ids"].notna()].iloc[0])


def ranked(packed: DataFrame, ranks=rerank, gather=by_document) -> DataFrame:
    """(id, h, runs, split) of the documents that have any."""
    return packed.groupBy("range").applyInPandas(ranks, RANKED).groupBy("batch").applyInPandas(gather, "id long, h long, runs binary, split boolean").dropDuplicates(["id", "h"])


def spans_of(runs: bytes, more: bytes | None, length: int, size: int) -> list[tuple[int, int]]:
    """The maximal removed byte ranges of one document."""
    r = np.concatenate([np.frombuffer(x, RUN) for x in (runs, more or b"")])
    r = r[r["kind"] == 1]
    if not len(r):
        return []
    start = r["pos"].astype("int64")
    end = start + r["run"] - 1 + length
    o = np.argsort(start, kind="stable")
    start, end = start[o], np.maximum.accumulate(end[o])
    new = np.append(True, start[1:] > end[:-1])
    return list(zip(start[new].tolist(), end[np.append(new[1:], True)].tolist(), strict=True))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id null sorts last; h tells texts of one id apart."""
    return docs.withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn("h", F.xxhash64("text"))


def repeats(docs: DataFrame, scratch: Scratch, length: int = 100, seed: int = 24) -> DataFrame:
    """(id, h, runs, windows) of the documents of ``keyed`` docs with a repeated string, or that are the source of some."""
    texts = docs.where(F.octet_length("text") >= length).select("id", "h", "text")
    n, size = texts.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    ranges = max(96, -(-(size or 0) // (16 << 20)))
    runs = scratch.save(ranked(texts.mapInArrow(lambda b: send_runs(b, length, seed, ranges), PACKED)), n)

    def with_runs(texts: DataFrame, runs: DataFrame) -> DataFrame:
        ids = small(runs.select("id", "h"))  # the runs stay out of the broadcast
        return texts.join(ids, ["id", "h"], "left_semi").dropDuplicates(["id", "h"]).join(runs, ["id", "h"]).select("id", "h", "text", "runs")

    chosen = scratch.save(with_runs(texts, runs.where("split")), max(n, (size or 0) // 200))
    doubled = scratch.save(ranked(chosen.mapInArrow(lambda b: send_doubled(b, length, seed, ranges), PACKED), unique, trim(length, seed)), n)
    left = with_runs(chosen.select("id", "h", "text"), doubled)
    windows = ranked(left.mapInArrow(lambda b: send_windows(b, length, ranges), PACKED)).select("id", "h", F.col("runs").alias("windows"))
    found = scratch.save(runs.drop("split").join(windows, ["id", "h"], "left"), n)
    scratch.drop(chosen)
    return found


def applied(docs: DataFrame, length: int, seed: int, clean, touched, schema: str) -> DataFrame:
    """``clean`` of the untouched rows of docs together with ``touched`` (a function of Arrow batches: id, h, runs, windows, then the rest) of the others."""
    scratch = Scratch(docs.sparkSession)
    found = repeats(keyed(docs.select("doc_id", "text")), scratch, length, seed)
    ids = small(found.select("id", "h"))
    rest = clean(keyed(docs).join(ids, ["id", "h"], "left_anti"))
    cols = docs.columns
    hit = keyed(docs).join(ids, ["id", "h"], "left_semi").join(found, ["id", "h"]).select("runs", "windows", *cols)
    return rest.unionByName(hit.mapInArrow(touched, schema))


def digest(docs: DataFrame, length: int = 100, seed: int = 24) -> DataFrame:
    """What is removed from each of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes left).

    Null text: empty. A string is earlier in a smaller doc_id (null: after all others) or earlier in the same document;
    rows that repeat a doc_id are not earlier than each other, so both of two equal rows stay. Texts under ``length``
    bytes lose nothing; an empty table gives no rows; other columns are ignored.
    """
    import hashlib

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    @tidy
    def touched(batches):
        for b in batches:
            rows = []
            for runs, more, doc, text in columns([b], 0, 1, 2, 3):
                data = (text or "").encode("utf-8", "surrogatepass")
                found, kept, at = spans_of(runs, more, length, len(data)), hashlib.sha256(), 0
                for a, e in found:
                    kept.update(data[at:a])
                    at = e
                kept.update(data[at:])
                rows.append((doc, len(data), sum(e - a for a, e in found), len(found), kept.hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (*[pa.int64()] * 4, pa.string()), strict=True)], names=[f.split()[0] for f in schema.split(", ")])

    text = F.coalesce("text", F.lit(""))
    clean = lambda d: d.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"))
    return applied(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), length, seed, clean, touched, schema)


def remove(docs: DataFrame, length: int = 100, seed: int = 24) -> DataFrame:
    """``docs`` with repeated bytes removed from ``text``, other columns as they are.

    A character that loses some of its bytes goes as a whole. See ``digest`` for which bytes go.
    """
    schema = docs.schema
    arrow = None

    @tidy
    def touched(batches):
        for b in batches:
            texts = []
            at = b.schema.get_field_index("text")
            for runs, more, text in columns([b], 0, 1, at):
                data, kept, done = (text or "").encode("utf-8", "surrogatepass"), [], 0
                found = spans_of(runs, more, length, len(data))
                for a, e in found:
                    kept.append(data[done:a])
                    done = e
                kept.append(data[done:])
                texts.append(b"".join(kept).decode("utf-8", "ignore") if found else text)
            cols = [pa.array(texts, b.schema.field(i).type) if i == at else b.column(i) for i in range(2, b.num_columns)]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[2:])

    return applied(docs, length, seed, lambda d: d.select(*docs.columns), touched, schema)
