"""Stupid-backoff scores of documents under the n-gram counts of the whole corpus.

A batch of documents explodes its texts into n-grams of one order and sends each distinct one, with its count in the
batch, to a range of the n-gram hashes. A range sums the counts of all batches - it is one partition of that order's count
table - and answers each batch with the totals of the n-grams it sent. With the answers of every order, the batch joins
the totals to its exploded n-grams, backs off where an n-gram is too rare, and sums the logarithms per document. n-grams
travel as packed sorted arrays, once per batch however often they occur, so a very common one is no larger than others;
equal rows of a task's input travel once, with their number. Orders go one after the other: what one has shuffled is gone
before the next begins.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jaccard import mixed, word_hashes
from .shared import Scratch, tidy
from .suffix import from_planes, planes

PRIME = np.uint64(0x9E3779B97F4A7C15)
SENT = "range int, batch long, keys binary, own binary"
ANSWER = "batch long, n int, range int, tokens long, totals binary"
SCORED = "doc_id long, n_tokens long, log_score double, copies long"
#: Bytes of text of a task's input among which equal rows are counted.
FOLD = 4 << 20


def exploded(texts, order: int):
    """(n-gram hashes of each order, and which of them lie in one text; length of each text) of a list of texts, one after the other."""
    words = [np.concatenate([np.empty(0, np.uint64), *word_hashes(t)]) for t in texts]
    length = np.array([len(w) for w in words], np.int64)
    w = np.concatenate([np.empty(0, np.uint64), *words])
    at = np.arange(len(w)) - np.repeat(np.cumsum(length) - length, length)  # a word's place in its text
    grams, h = [], np.zeros(len(w), np.uint64)
    for n in range(1, order + 1):
        before = np.append(np.uint64(n), h[:-1]) if len(h) else h  # the (n-1)-gram that ends one word earlier
        h = mixed(w * PRIME + np.uint64(n)) if n == 1 else mixed(before * PRIME + w + np.uint64(n))
        grams.append((h, at >= n - 1))
    return grams, length


def edges_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    step = np.uint64(2**64 // ranges + 1)
    return np.append(np.searchsorted(keys, np.arange(ranges, dtype=np.uint64) * step), len(keys))


def narrow(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as their largest takes, that many first."""
    w = 1 if x.max(initial=0) < 2**8 else 2 if x.max() < 2**16 else 4 if x.max() < 2**32 else 8
    return bytes([w]) + planes(x.astype(f"<u{w}"))


def widened(data: bytes) -> np.ndarray:
    return from_planes(data[1:], f"<u{data[0]}").astype(np.int64)


@tidy
def folded(batches):
    """(doc_id as text, text, copies): equal rows near each other in a task's input are one."""

    def rows(some):
        t = (pa.string(), pa.string(), pa.int64())
        cols = zip(*((d, x, n) for (d, x), n in some.items()), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, t, strict=True)], names=["doc_id", "text", "copies"])

    some, size = Counter(), 0
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if (doc, text) not in some:
                size += len(text or "") + 64
            some[doc, text] += 1
            if size >= FOLD:
                yield rows(some)
                some, size = Counter(), 0
    if some:
        yield rows(some)


def scores(docs: DataFrame, order: int = 3, backoff: float = 0.4, min_count: int = 2) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, n_tokens, log_score (sum of natural logarithms; 0 without words).

    Words are runs of non-space characters in ASCII lower case. S(w | context) is count(context w) / count(context) if
    the n-gram occurs ``min_count`` times at least, else ``backoff`` * S(w | shorter context); of the empty context,
    count(w) / words of the corpus. Counts are over all documents; repeated rows count each, are scored alike, and come
    out as often as they came in. Null doc_ids stay null. Null and empty texts have no tokens; an empty table gives no
    rows; whole texts are read; other columns are ignored. n-grams are told apart by 64 bits of a hash.
    """
    scratch = Scratch(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges, batches = max(96, -(-size // (8 << 20))), max(32, -(-size // (8 << 20)))
    # null ids would arrive as floats in pandas: ids travel as text
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").mapInArrow(folded, "doc_id string, text string, copies long")
    some = rows.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)))

    def send(n: int):
        @tidy
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            grams, length = exploded(pdf["text"], n)
            h, ok = grams[-1]
            copies = np.repeat(pdf["copies"].to_numpy("int64"), length)[ok]
            keys, which = np.unique(h[ok], return_inverse=True)
            own = np.bincount(which, weights=copies, minlength=len(keys)).astype(np.int64)
            edges = edges_of(keys, ranges)
            batch = int(pdf["batch"].iloc[0])
            out = [(r, batch, planes(keys[a:b]), narrow(own[a:b])) for r, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]
            return pd.DataFrame(out, columns=["range", "batch", "keys", "own"])

        return run

    def total(n: int):
        @tidy
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            parts = [from_planes(k, "<u8") for k in pdf["keys"]]
            _, which = np.unique(np.concatenate(parts), return_inverse=True)
            own = np.concatenate([widened(c) for c in pdf["own"]])
            totals = np.bincount(which, weights=own).astype(np.int64)[which]
            ends = np.cumsum([len(p) for p in parts])
            out = [(batch, n, r, int(own[a:b].sum()) if n == 1 else 0, narrow(totals[a:b])) for batch, r, a, b in zip(pdf["batch"], pdf["range"], np.append(0, ends[:-1]), ends, strict=True)]
            return pd.DataFrame(out, columns=["batch", "n", "range", "tokens", "totals"])

        return run

    answers = None
    for n in range(1, order + 1):
        got = scratch.save(some.groupBy("batch").applyInPandas(send(n), SENT).groupBy("range").applyInPandas(total(n), ANSWER))
        answers = got if answers is None else answers.unionByName(got)
    tokens = answers.agg(F.sum("tokens")).first()[0] or 1

    def add(pdf: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        grams, length = exploded(pdf["text"], order)
        counts = []
        for n, (h, ok) in enumerate(grams, 1):
            count = np.zeros(len(h), np.int64)
            if ok.any():
                keys, which = np.unique(h[ok], return_inverse=True)
                totals = np.concatenate([widened(t) for t in answer[answer["n"] == n].sort_values("range")["totals"]])
                assert len(totals) == len(keys)
                count[ok] = totals[which]
            counts.append(count)
        log = np.log(np.maximum(counts[0], 1) / tokens) if len(counts[0]) else np.zeros(0)
        for n in range(2, order + 1):
            c, (_, ok) = counts[n - 1], grams[n - 1]
            context = np.append(1, counts[n - 2][:-1]) if len(c) else c
            log = np.where(ok, np.where(c >= min_count, np.log(np.maximum(c, 1) / np.maximum(context, 1)), math.log(backoff) + log), log)
        ends = np.cumsum(length)
        each = [float(np.sum(log[e - m : e])) for e, m in zip(ends, length, strict=True)]
        ids = pd.array([None if x is None else int(x) for x in pdf["doc_id"]], "Int64")
        return pd.DataFrame({"doc_id": ids, "n_tokens": length, "log_score": each, "copies": pdf["copies"]})

    scored = some.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(add, SCORED)
    return scored.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
