"""Toxicity by a factorization machine over hashed terms.

Terms are a text's words and the beginnings of its words, hashed to buckets; a term's value grows with its density. The
score is the logistic of a bias, a weight for each bucket and, for each pair of buckets, the product of their factor
vectors: two terms that are harmless apart (an insult's stem and a group's name) weigh more together than their
weights add up to, which an additive model cannot say. Learning sees a bounded sample of labelled rows and the
buckets that go most with the label; scoring takes all rows and whole texts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bound_batches, materialize
from quillon.llm.hashing import release

#: Hash buckets, buckets that the model keeps, factors of each, and beginnings of words, in bytes of UTF-8 beyond which whole characters follow.
BITS, KEPT, RANK, STEMS = 18, 2048, 8, (4, 5, 6, 7)
#: Labelled rows that learning sees at most (those of the smallest hashed ids). A kept row has KEPT values at most: some 150 MB in all.
FIT_ROWS = 12_000
LEAST, EPOCHS, BATCH, RATE, RIDGE_W, RIDGE_V = 3, 20, 256, 0.02, 1e-4, 1e-3
FOLDS = 5

_STRIP = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def held_out(doc_id: Column) -> Column:
    """Rows whose labels learning never sees; a null id has none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


class Terms:
    """Buckets and counts of a text's terms. Words' buckets are kept, up to a bound, as words repeat."""

    def __init__(self, limit: int = 200_000):
        self.known: dict[bytes, list[int]] = {}
        self.limit = limit

    def _of(self, word: bytes) -> list[int]:
        found = self.known.get(word)
        if found is None:
            s = word.decode("utf-8", "replace")
            names = ["=" + s, *[s[:k] for k in STEMS if len(s) >= k]]
            found = [zlib.crc32(n.encode()) & ((1 << BITS) - 1) for n in names]
            if len(self.known) >= self.limit:
                self.known.clear()
            if len(word) <= 64:
                self.known[word] = found
        return found

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Distinct buckets of a text, and their values: the log of one plus occurrences per 300 words."""
        words = Counter(text.translate(_STRIP).split())
        total = sum(words.values())
        lists = [self._of(w) for w in words]
        flat = np.array([b for x in lists for b in x], dtype=np.int64)
        times = np.repeat(np.array(list(words.values()), dtype=np.float64), [len(x) for x in lists]) if lists else np.zeros(0)
        buckets, inverse = np.unique(flat, return_inverse=True)
        counts = np.bincount(inverse, weights=times, minlength=len(buckets)) if len(buckets) else np.zeros(0)
        return buckets, np.log1p(counts * 300 / max(total, 30))


def _list_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms = Terms()
    for batch in batches:
        for k in range(batch.num_rows):  # one text at a time, whatever its length
            buckets, values = terms(batch.column(1)[k].as_py() or b"")
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([buckets.tolist()], pa.list_(pa.int32())), pa.array([values.tolist()], pa.list_(pa.float32()))], ["y", "buckets", "values"])
    release()


def _keep(position: dict[int, int]):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = np.full(1 << BITS, -1, dtype=np.int32)
        lookup[list(position)] = list(position.values())
        for batch in batches:
            at, values = [], []
            for b, v in zip(batch.column(1), batch.column(2), strict=True):
                own = lookup[b.values.to_numpy()]
                at.append(own[own >= 0])
                values.append(v.values.to_numpy()[own >= 0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["y", "at", "values"])

    return keep


def _raw(bias: float, w: np.ndarray, v: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of rows, and their sums of factors."""
    sums = x @ v
    return bias + x @ w + 0.5 * (sums**2 - (x**2) @ (v**2)).sum(axis=1), sums


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, kept: int, rank: int = RANK, epochs: int = EPOCHS, seed: int = 7) -> dict:
    """A factorization machine by Adam on the logistic loss with ridges; ``rank`` 0 leaves the additive part alone. Rows are dense in one batch at a time only."""
    rng = np.random.default_rng(seed)
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    p = [np.array([np.log(mean / (1 - mean))]), np.zeros(kept), rng.normal(0, 0.05, (kept, rank))]
    m, s, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), BATCH):
            some = order[lo : lo + BATCH]
            x = np.zeros((len(some), kept))
            for k, i in enumerate(some):
                x[k, rows[i][0]] = rows[i][1]
            raw, sums = _raw(p[0][0], p[1], p[2], x)
            g = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[some]) / len(some)
            grads = [np.array([g.sum()]), x.T @ g + RIDGE_W * p[1], x.T @ (g[:, None] * sums) - p[2] * ((x**2).T @ g)[:, None] + RIDGE_V * p[2]]
            t += 1
            for k, grad in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * grad
                s[k] = 0.999 * s[k] + 0.001 * grad**2
                p[k] = p[k] - RATE * (1 - epoch / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return {"bias": float(p[0][0]), "w": p[1], "v": p[2]}


def fit(docs: DataFrame, labels: DataFrame, rank: int = RANK) -> dict:
    """The model, from at most FIT_ROWS labelled rows that are not held out. Without labels of both kinds it says the same of every text.

    Of several labels of one id the mean counts; labels with a null and of unknown ids play no part.
    """
    bound_batches(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.avg("toxic").cast("double").alias("y"))
    some = known.orderBy(F.xxhash64("_id"), "_id").limit(FIT_ROWS)
    text = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").cast("binary").alias("text"))
    sample = text.join(F.broadcast(some), "_id").select("y", "text").mapInArrow(_list_terms, "y double, buckets array<int>, values array<float>")
    sample = materialize(sample, "toxic-sample")
    n, hits = sample.agg(F.count("*"), F.sum("y")).first()
    if not n or not 0 < hits < n:
        return {"bias": 0.0 if not n else float(np.clip(np.log((hits + 0.5) / (n - hits + 0.5)), -5, 5)), "at": {}, "w": np.zeros(0), "v": np.zeros((0, rank))}
    rate = hits / n
    seen = sample.select("y", F.explode("buckets").alias("b")).groupBy("b").agg(F.count("*").alias("n"), F.sum("y").alias("hits")).where(F.col("n") >= LEAST)
    z = F.abs(F.col("hits") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    top = [r.b for r in seen.orderBy(F.round(z, 9).desc(), "b").limit(KEPT).collect()]
    at = {b: k for k, b in enumerate(top)}
    if not at:
        return {"bias": float(np.log(rate / (1 - rate))), "at": {}, "w": np.zeros(0), "v": np.zeros((0, rank))}
    table = sample.mapInArrow(_keep(at), "y double, at array<int>, values array<float>").orderBy("y", F.xxhash64("at", "values")).toArrow()  # FIT_ROWS rows at most, plus repeats of their ids
    rows = [(a.values.to_numpy(), v.values.to_numpy()) for a, v in zip(table["at"], table["values"], strict=True)]
    return train(rows, table["y"].to_numpy(), len(at), rank) | {"at": at}


def scorer(model: dict):
    """A function of a text column: the probability that the label says toxic."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms = Terms()
        lookup = np.full(1 << BITS, -1, dtype=np.int32)
        if model["at"]:
            lookup[list(model["at"])] = list(model["at"].values())
        w, v = model["w"], model["v"]
        for part in texts:
            raw = np.full(len(part), model["bias"])
            for k, text in enumerate(part):
                buckets, values = terms((text or "").encode("utf-8", "replace"))
                own = lookup[buckets]
                own, x = own[own >= 0], values[own >= 0].astype(np.float32).astype(float)
                if len(own):
                    mine = v[own]
                    sums = x @ mine
                    raw[k] += x @ w[own] + 0.5 * (sums @ sums - (x**2) @ (mine**2).sum(axis=1))
            yield pd.Series(1 / (1 + np.exp(-np.clip(raw, -30, 30))))

    return score


def classify(docs: DataFrame, labels: DataFrame, rank: int = RANK) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (to nine places) and ``predicted`` of every row of ``docs`` (``doc_id``, ``text``).

    A score depends on the text alone. Null texts are empty; an empty text has the score of the bias. Null ids are kept and not held
    out; repeated rows give repeated results; other columns play no part; an empty table gives an empty result, and
    without labels every score is one half. Ties at exactly one half count as toxic.
    """
    model = fit(docs, labels, rank)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.round(scorer(model)(F.col("text").cast("string")), 9).alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
