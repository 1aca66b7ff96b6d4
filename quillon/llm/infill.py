"""Fill-in-the-middle over lines, with content-defined chunks as the unit of memory.

A rolling hash over the last 32 bytes cuts a text into chunks wherever its low bits are zero, so a passage that many
documents share falls into the same chunks wherever it stands. A chunk's summary (its code points, its line ends and
the code points up to each) is kept in a cache by the chunk's hash and counts only if the content itself is equal.
A document's lines are the sums of its chunks' counts; the running sums tell which chunk holds a cut, and the chunk's
summary where in it. A cache lives in one task and forgets its oldest chunks beyond a bound, which costs time, never results.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bound_batches
from quillon.llm.hashing import mix64, release, slices

#: Share of documents, in percent, that are transformed at all, and of those that get the suffix first.
RATE, SPM = 100, 50
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes that the rolling hash sees, a chunk's least and mean size, and bytes that a task's cache keeps.
SPAN, LEAST, MEAN, CACHE = 32, 256, 2048, 32 << 20
#: Bytes hashed at a time.
PIECE = 1 << 20
SEED = "7"

_GEAR = mix64(np.arange(1001, 1257, dtype=np.uint64))
_NEWLINE = 10


def cut_points(data: np.ndarray, ends: np.ndarray, least: int = LEAST, mean: int = MEAN) -> np.ndarray:
    """Ends of the chunks of concatenated texts, whose own ends are ``ends``; every text's end is one.

    The hash of a place is the sum of the gear values of its last SPAN bytes, each shifted by its distance; it is
    built by doubling. A text's first SPAN bytes cut nothing, so no hash reaches into the text before.
    """
    found = []
    for lo in range(0, len(data), PIECE):  # a long text's hashes are made piece by piece
        start = max(0, lo - SPAN + 1)
        h = _GEAR[data[start : lo + PIECE]]
        width = 1
        while width < SPAN:
            h[width:] = h[width:] + (h[:-width] << np.uint64(width))
            width *= 2
        zero = np.flatnonzero((h >> np.uint64(40)) & np.uint64(mean - 1) == 0) + start + 1  # the upper bits have seen all of the span
        found += zero[zero > lo].tolist()
    out, at, k = [], 0, 0
    for end in ends.tolist():
        while k < len(found) and found[k] < end:
            if found[k] - at >= max(least, SPAN):
                at = found[k]
                out.append(at)
            k += 1
        out.append(end)
        at = end
    return np.array(out, dtype=np.int64)


class Summaries:
    """What is known of chunks by their content: code points, line ends (bytes up to and with each) and code points up to each."""

    def __init__(self, limit: int = CACHE):
        self.limit, self.held, self.seen, self.hits, self.misses = limit, 0, OrderedDict(), 0, 0

    def __call__(self, chunk: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        key = hash(chunk)
        known = self.seen.get(key)
        if known is not None and known[0] == chunk:  # equal hashes count for nothing by themselves
            self.hits += 1
            return known[1]
        self.misses += 1
        data = np.frombuffer(chunk, dtype=np.uint8)
        points = np.cumsum((data & 0xC0) != 0x80)
        ends = np.flatnonzero(data == _NEWLINE)
        summary = (int(points[-1]) if len(points) else 0, ends + 1, points[ends])
        if known is not None:
            self.held -= self._size(known)
        self.seen[key] = (chunk, summary)
        self.held += self._size(self.seen[key])
        while self.held > self.limit and len(self.seen) > 1:
            self.held -= self._size(self.seen.popitem(last=False)[1])
        return summary

    @staticmethod
    def _size(entry: tuple) -> int:
        return len(entry[0]) + 16 * len(entry[1][1]) + 200


class Lines:
    """The lines of a text from its chunks' summaries: how many, and where the first k of them end, in bytes and code points."""

    def __init__(self, chunks: list[bytes], summaries: Summaries):
        parts = [summaries(c) for c in chunks]
        self.parts = parts
        self.bytes = np.cumsum([0] + [len(c) for c in chunks])
        self.points = np.cumsum([0] + [p[0] for p in parts])
        self.ends = np.cumsum([0] + [len(p[1]) for p in parts])
        self.open = bool(chunks) and bool(chunks[-1]) and chunks[-1][-1] != _NEWLINE
        self.n = int(self.ends[-1]) + self.open

    def end(self, k: int) -> tuple[int, int]:
        if k == 0:
            return 0, 0
        if k > self.ends[-1]:  # the last line has no end of its own
            return int(self.bytes[-1]), int(self.points[-1])
        c = int(np.searchsorted(self.ends, k, side="left")) - 1
        _, at, points = self.parts[c]
        j = k - 1 - int(self.ends[c])
        return int(self.bytes[c] + at[j]), int(self.points[c] + points[j])


def draws(doc_id: int | None, seed: str = SEED) -> tuple[int, int, int, int]:
    """Four numbers that depend on seed and id alone."""
    hex_ = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(hex_[8 * k : 8 * k + 8], 16) for k in range(4))


def transform(text: bytes, lines: Lines, doc_id: int | None, rate: int = RATE, spm: int = SPM, seed: str = SEED) -> tuple[str, bytes, int | None, int | None]:
    """Form, output, and code points of prefix and middle (None if plain)."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", text, None, None
    low, high = sorted((h1 % (lines.n + 1), h2 % (lines.n + 1)))
    (a, a_points), (b, b_points) = lines.end(low), lines.end(high)
    if h4 % 100 < spm:
        return "spm", b"".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b])), a_points, b_points - a_points
    return "psm", b"".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b])), a_points, b_points - a_points


SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"


def _runner(rate: int, spm: int, seed: str, cache: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summaries = Summaries(cache)
        for batch in batches:
            done = 0
            for texts in slices([x or b"" for x in batch.column(1).to_pylist()]):
                ids = batch.column(0).slice(done, len(texts)).to_pylist()
                done += len(texts)
                whole = b"".join(texts)
                ends = np.cumsum([len(t) for t in texts])
                cuts = cut_points(np.frombuffer(whole, dtype=np.uint8), ends)
                upto = np.searchsorted(cuts, ends, side="right").tolist()
                rows, at, k = [], 0, 0
                bounds = cuts.tolist()
                for doc_id, text, last in zip(ids, texts, upto, strict=True):
                    chunks = []
                    while k < last:
                        if bounds[k] > at:
                            chunks.append(whole[at : bounds[k]])
                        at = bounds[k]
                        k += 1
                    lines = Lines(chunks, summaries)
                    rows.append((doc_id, lines.n, *transform(text, lines, doc_id, rate, spm, seed)))
                columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(6)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[4], pa.int64()), pa.array(columns[5], pa.int64()), pa.array(columns[3], pa.binary())],
                    [x.split()[0] for x in SCHEMA.split(", ")],
                )
        release()

    return run


def fill_in_middle(docs: DataFrame, rate: int = RATE, spm: int = SPM, seed: str = SEED, cache: int = CACHE) -> DataFrame:
    """``doc_id``, ``n`` (lines), ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` of every row of ``docs`` (``doc_id``, ``text``).

    A line ends with its newline; a text without a last newline has an open last line. Null texts are empty, and empty
    texts, texts that hold a marker and those beyond ``rate`` stay plain, with null counts of code points. Draws depend on ``seed`` and id; a null id
    counts as an empty string in them. Repeated rows give repeated results; other columns play no part; an empty
    table gives an empty result. No row meets another: there is no shuffle, and a lost task is run again by itself.
    """
    bound_batches(docs.sparkSession)
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(_runner(rate, spm, seed, cache), SCHEMA)
    return made.withColumn("output", F.col("output").cast("string"))


def restored(made: DataFrame) -> DataFrame:
    """``made`` with ``restored``, the text rebuilt from ``output`` and ``form`` alone.

    A marker begins with its only ``<``, so none can arise across a seam before the real one.
    """
    first, last = PREFIX.decode(), MIDDLE.decode()
    rest = F.substring("output", len(first) + 1, 2**31 - 1)

    def parts(second: str) -> tuple[Column, Column, Column]:
        halves = F.split(rest, second, 2)
        tail = F.split(F.try_element_at(halves, F.lit(2)), last, 2)
        return F.element_at(halves, 1), F.try_element_at(tail, F.lit(1)), F.try_element_at(tail, F.lit(2))

    prefix, suffix, middle = parts(SUFFIX.decode())
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(PREFIX.decode())
    spm = F.concat(prefix, middle, suffix)
    return made.withColumn("restored", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("output")))
