"""Quality classifier by positive-unlabelled learning.

Documents marked as good are trusted positives; unmarked documents are unlabelled web text, a mixture of good and bad
ones with an estimated share of good ones (the class prior). A linear model on character and word statistics of the
whole text minimises the non-negative unbiased risk: prior * loss(positives as good) + max(0, loss(unlabelled as bad) -
prior * loss(positives as bad)). It is trained once on a bounded sample, then every document is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import tidy

#: Classes of bytes: lower case and bytes beyond ASCII, upper case, digit, space, line end, then kinds of signs.
CLASS = np.full(256, 15, np.uint8)
for _i, _set in enumerate((bytes(range(97, 123)) + bytes(range(128, 256)), bytes(range(65, 91)), b"0123456789", b" \t", b"\n\r", b".,", b"'\"", b"!", b"?", b"-_", b"|", b"%&$#*@", b"<>{}[]()=", b"/\\:;")):
    CLASS[list(_set)] = _i
WIDTH = 256 + 7
PART = 1 << 20


def features(text: str | None) -> np.ndarray:
    """Shares of pairs of byte classes and word and line statistics of a whole text; of an empty one, zeros."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(WIDTH, np.float32)
    if not data:
        return out
    pairs = np.zeros(256, np.int64)
    words_seen, n, letters, same = set(), 0, 0, 0
    at, last = 0, None
    while at < len(data):  # a long text goes in parts that end at a space
        end = at + PART
        while end < len(data) and data[end] not in b" \n":
            end += 1
        part = data[at:end]
        code = CLASS[np.frombuffer(part, np.uint8)]
        pairs += np.bincount(code[:-1] * 16 + code[1:], minlength=256) if len(code) > 1 else 0
        words = part.split()
        if words:
            n += len(words)
            letters += sum(map(len, words))
            words_seen.update(words)
            same += sum(map(bytes.__eq__, words, words[1:])) + (words[0] == last)
            last = words[-1]
        at = end
    lines = data.split(b"\n")
    out[:256] = np.sqrt(pairs / max(1, pairs.sum()))
    if n:
        out[256:] = (1.0, np.log1p(n) / 10, letters / n / 10, len(words_seen) / n, same / n, len(set(lines)) / len(lines), np.log1p(len(data) / len(lines)) / 10)
    return out


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-2) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """(weights, bias, means, scales) of a linear model that minimises the non-negative unbiased risk."""
    both = np.concatenate([positive, unlabelled]).astype(np.float64)
    mean, scale = both.mean(0), both.std(0) + 0.01
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    w, b = np.zeros(both.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        sp, su = 1 / (1 + np.exp(-np.clip(p @ w + b, -30, 30))), 1 / (1 + np.exp(-np.clip(u @ w + b, -30, 30)))
        # sigmoid loss: of a positive 1 - s as good and s as bad; its slope is s (1 - s)
        bad = su.mean() - prior * sp.mean()
        dp, du = sp * (1 - sp) / len(p), su * (1 - su) / max(1, len(u))
        if bad >= 0:
            gp, gu = -2 * prior * dp, du
        else:  # the bad part's risk has become negative: it overfits, so step back there alone
            gp, gu = prior * dp, -du
        g = np.append(p.T @ gp + u.T @ gu + decay * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b, mean, scale


def sampled(docs: DataFrame, ids: DataFrame, n: int) -> np.ndarray:
    """The features of those of docs (doc_id, text) with the ``n`` of ``ids`` (doc_id) of least hash, or with all if fewer."""

    @tidy
    def run(batches):
        for b in batches:
            rows = [features(t).tobytes() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["f"])

    some = ids.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    rows = docs.join(F.broadcast(some), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))  # one of the rows that repeat an id
    got = rows.select("text").mapInArrow(run, "f binary").collect()
    return np.stack([np.frombuffer(r.f, np.float32) for r in got]) if got else np.zeros((0, WIDTH), np.float32)


def score(docs: DataFrame, labels: DataFrame, fold=None, positives: int = 3000, unlabelled: int = 6000) -> DataFrame:
    """``docs`` (doc_id, text) with score (0 to 1, higher: good likelier) and predicted (1 if score >= 0.5, else 0).

    ``labels`` (doc_id, quality) marks some documents. It learns from at most ``positives`` documents marked 1 and
    ``unlabelled`` others for which ``fold`` (a condition on doc_id) holds; the class prior is the share of 1 among the
    marks of the fold. Labels are the only thing taken from ``labels``; a document with two marks counts as good if
    both say so. Where every document is labelled, those of the fold serve as the unlabelled mixture too. Null and empty
    texts score by their zero features. Without positives every score is the prior (0.5 without marks). Of rows that
    repeat a doc_id one (the least text) can be trained on; rows without doc_id are scored only. Repeated rows are scored alike; an empty table gives no rows; other columns
    are kept.
    """
    inside = F.lit(True) if fold is None else fold
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & inside).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = marks.agg(F.avg("quality").alias("p")).first()["p"]
    prior = min(0.99, max(0.01, share)) if share is not None else 0.5
    text = docs.select("doc_id", "text")
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull() & inside)
    good = sampled(text, ids.join(marks.where("quality = 1"), "doc_id", "left_semi"), positives)
    other = sampled(text, ids.join(labels.select("doc_id"), "doc_id", "left_anti"), unlabelled)
    if not len(other):  # every document is labelled: those of the fold are a mixture too, whatever their marks
        other = sampled(text, ids, unlabelled)
    if len(good) and len(other):
        w, b, mean, scale = train(good, other, prior)
        w, b = w / scale, b - (mean * w / scale).sum()
        sharp = 1 / max(1e-6, float(np.std(other @ w + b)))  # where the loss is flat the margin's scale means nothing
        w, b = (w * sharp * 4).astype(np.float32), float(b * sharp * 4)
    else:
        w, b = np.zeros(WIDTH, np.float32), float(np.log(prior / (1 - prior)))
    names, at = docs.columns, docs.columns.index("text")

    @tidy
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                x = np.stack([features(t) for t in part.column(at).to_pylist()])
                s = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30).astype(np.float64)))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*(names[k] for k in keep), "score", "predicted"])

    keep = [k for k, n in enumerate(names) if n not in ("score", "predicted")]
    fields = [docs.schema[k] for k in keep]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
