"""Best-fit packing of tokenised documents into fixed-length training sequences.

``pack`` cuts documents into pieces and gives every piece a sequence and an offset. The plan is made on the histogram
of piece lengths (at most ``capacity`` counts, whatever the corpus), so the driver never sees pieces:

1. pieces longer than a third of the capacity fit at most twice into a sequence: from the longest down, each is
   matched with the longest other one that still fits;
2. shorter pieces go, from the longest down, into the tightest gap that holds them, and open new sequences last.

The plan's rows say which ranks of which length go where; Spark numbers the pieces of each length and joins.
"""

from __future__ import annotations

import functools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, tidy

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Bytes of text whose distinct words are encoded together; words whose ids are put together at a time.
BATCH, PART = 8 << 20, 200_000
#: Words that are not safe to encode alone: empty ones, those with white space at an end, and those with a mark of special tokens.
UNSAFE = r"^$|^[\s\x0b\x{85}\p{Z}]|[\s\x0b\x{85}\p{Z}]$|<\|"


class WordEncoder:
    """Token ids of whole texts from the ids of their distinct words.

    A byte-level BPE never merges across a single space between two non-space characters, so a text's ids are the ids
    of its space-led words one after the other; a text with other spacing is encoded whole. The distinct words of some
    texts are encoded as one text; a token that starts with a space begins the next word's ids.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        space = chr(256 + 32)  # what stands for a space in the byte alphabet of byte-level BPE
        self.leads = np.zeros(self.tok.get_vocab_size(with_added_tokens=True), bool)
        for token, i in self.tok.get_vocab().items():
            self.leads[i] = token.startswith(space)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: pa.Array):
        """(which of the words are safe to encode alone, the ids of the safe ones together, where each one's start and how many there are)."""
        safe = ~pc.match_substring_regex(words, UNSAFE).to_numpy(zero_copy_only=False)
        size, start = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        some, ids = words.filter(pa.array(safe)).to_pylist(), [np.empty(0, "<u4")]
        for at in range(0, len(some), 5000):
            ids.append(np.frombuffer(self._ids([" " + " ".join(some[at : at + 5000])])[0], "<u4"))
        ids = np.concatenate(ids)
        first = np.flatnonzero(self.leads[ids])
        if len(first) != len(some):
            raise ValueError("not a byte-level tokenizer that keeps space-led words apart")
        start[safe], size[safe] = first, np.diff(np.append(first, len(ids)))
        return safe, ids, start, size

    def encode(self, texts) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers, for a list or an Arrow array of texts.

        Arrow splits the texts and numbers the distinct words, so only these go through Python.
        """
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        parts = pc.split_pattern(texts.cast(pa.large_string()), " ")
        words, n = parts.flatten(), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(n):
            return []
        ends = np.cumsum(n)
        coded = words.dictionary_encode()
        index = coded.indices.to_numpy()
        safe, ids, start, size = self._words(coded.dictionary)
        later = np.ones(len(index), bool)
        later[ends - n] = False  # a text's first word has no space before it
        count = size[index] * later
        rest = [np.empty(0, "<u4")]
        for at in range(0, len(index), PART):
            c = count[at : at + PART]
            rest.append(ids[np.arange(c.sum()) + np.repeat(start[index[at : at + PART]] - np.cumsum(c) + c, c)])
        rest, till = np.concatenate(rest), np.append(0, np.cumsum(count))
        firsts = words.take(pa.array(ends - n)).to_pylist()
        unsafe = ~safe[index] & later
        whole = set(np.searchsorted(ends, np.flatnonzero(unsafe), "right").tolist())
        whole |= {i for i, first in enumerate(firsts) if n[i] > 1 and (not first or first[-1].isspace())}
        out = [b"" if i in whole else f + rest[till[e - m] : till[e]].tobytes() for i, (f, e, m) in enumerate(zip(self._ids(firsts), ends.tolist(), n.tolist(), strict=True))]
        if whole:
            some = sorted(whole)
            for i, got in zip(some, self._ids([texts[i].as_py() for i in some]), strict=True):
                out[i] = got
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@tidy
def cut(batches, path: str, capacity: int, end_id: int):
    enc, end = encoder(path), np.asarray([end_id], "<u4").tobytes()
    for ids, texts in gathered(batches):
        rows = []
        for doc, got in zip(ids, enc.encode(texts), strict=True):
            data = memoryview(got + end)
            total = len(data) // 4
            start, length = 0, total % capacity or capacity
            piece = 0
            while start < total:
                rows.append((doc, piece, start, length, zlib.crc32(data[4 * start : 4 * (start + length)])))
                start, piece, length = start + length, piece + 1, capacity
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def gathered(batches):
    """(ids, texts) of about BATCH bytes from Arrow batches of any size."""
    ids, texts, total = [], [], 0
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            ids += part.column(0).to_pylist()
            texts.append(part.column(1).fill_null(""))
            total += pc.sum(pc.binary_length(texts[-1])).as_py()
            if total >= BATCH:
                yield ids, pa.concat_arrays(texts)
                ids, texts, total = [], [], 0
    if ids:
        yield ids, pa.concat_arrays(texts)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, ranks, per sequence, first sequence, offset) that place ``counts`` pieces by length.

    Rank r of a row goes to sequence ``first + (r - first rank) // per`` at ``offset + ((r - first rank) % per) * length``.
    The rows' number depends on the capacity alone.
    """
    left = {k: n for k, n in counts.items() if n}
    rows, rank, gaps, sequences = [], defaultdict(int), defaultdict(list), 0

    def put(size, n, per, seq, offset):
        rows.append((size, rank[size], n, per, seq, offset))
        rank[size] += n
        left[size] -= n

    for size in sorted((s for s in left if 3 * s > capacity), reverse=True):
        while left[size]:
            other = next((b for b in range(min(size, capacity - size), capacity // 3, -1) if left.get(b, 0) > (b == size)), None)
            n = left[size] if other is None else left[size] // 2 if other == size else min(left[size], left[other])
            put(size, n, 1, sequences, 0)
            if other is not None:
                put(other, n, 1, sequences, size)
            gaps[capacity - size - (other or 0)].append((sequences, n))
            sequences += n
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            gap = min((g for g in gaps if g >= size and gaps[g]), default=None)
            if gap is None:
                gap, n = capacity, -(-left[size] // (capacity // size))
                gaps[gap].append((sequences, n))
                sequences += n
            seq, n = gaps[gap].pop()
            per = min(gap // size, left[size])
            full = min(n, left[size] // per)
            put(size, full * per, per, seq, capacity - gap)
            gaps[gap - per * size].append((seq, full))
            if full < n:
                gaps[gap].append((seq + full, n - full))
    return rows


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, chunk_rows: int = 50_000) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens: a row per piece.

    Columns: doc_id, piece (from 0), start, length, ids_crc32, sequence_id, offset. A null or empty text is the end id
    alone; repeated rows and null ids are packed like others; an empty table gives no rows. Only documents over the
    capacity are cut: the first piece takes the remainder, the others are full. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    pieces = scratch.save(docs.select("doc_id", "text").mapInArrow(lambda b: cut(b, tokenizer_path, capacity, end_id), PIECES).withColumn("at", F.monotonically_increasing_id()))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    chunks = max(256, -(-sum(counts.values()) // chunk_rows))
    pieces = pieces.withColumn("chunk", F.pmod(F.xxhash64("at"), F.lit(chunks)))
    before = pieces.groupBy("length", "chunk").agg(F.count("*").alias("n")).select("length", "chunk", (F.sum("n").over(Window.partitionBy("length").orderBy("chunk")) - F.col("n")).alias("before"))
    in_chunk = Window.partitionBy("chunk").orderBy("length", "at")
    numbered = pieces.withColumn("row", F.row_number().over(in_chunk)).withColumn("nth", F.col("row") - F.min("row").over(Window.partitionBy("chunk", "length")))
    ranked = numbered.join(before, ["length", "chunk"]).withColumn("rank", F.col("before") + F.col("nth"))
    rows = [(*r, r[1] + r[2]) for r in plan(counts, capacity)]
    placed = spark.createDataFrame(rows, "length long, rank_from long, n long, per long, seq_from long, base long, rank_to long")
    p = F.broadcast(placed.withColumnRenamed("length", "of"))  # rows bounded by the capacity, not by the corpus
    step = F.col("rank") - F.col("rank_from")
    return ranked.join(p, (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("seq_from") + F.floor(step / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("base") + F.pmod(step, F.col("per")) * F.col("length")).cast("long").alias("offset"),
    )


def sequences(docs: DataFrame, packed: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """The token ids of each sequence, (sequence_id, ids array<int>), for ``docs`` with distinct ids that ``pack`` has placed."""

    def slices(batches):
        enc = encoder(tokenizer_path)
        for batch in batches:
            seq, off, text, start, length = (batch.column(k).to_pylist() for k in range(5))
            got = enc.encode([t or "" for t in text])
            ids = [np.append(np.frombuffer(g, "<u4"), end_id)[s : s + n].astype("int32") for g, s, n in zip(got, start, length, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(seq, pa.int64()), pa.array(off, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["sequence_id", "offset", "ids"])

    joined = packed.join(docs.select("doc_id", "text"), "doc_id").select("sequence_id", "offset", "text", "start", "length")
    parts = joined.mapInArrow(slices, "sequence_id long, offset long, ids array<int>")
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
