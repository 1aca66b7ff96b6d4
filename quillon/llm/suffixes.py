"""Exact substring dedup over suffix arrays built by two-stage sorting.

Texts are packed into chunks of a few megabytes. Each window of ``LENGTH`` bytes has an anchor, its smallest k-gram by
hash, so equal windows have equal anchors; neighbouring windows with one anchor are a run. A first exchange of
packed anchor hashes finds those that occur twice anywhere. Runs of those, each distinct one of a chunk once with
its smallest document, go to the bucket of their anchor. An anchor with too many runs is split: each distinct window
of a chunk goes by itself to the bucket of its own hash, which equal windows share too. Buckets follow the corpus
without a limit. A row of an exchange holds what one chunk has for one bucket, so rows are never more than anchors
or runs, whose number follows the corpus. A bucket's runs form one string whose suffixes are
sorted in two stages: suffixes smaller than their successors directly, all others by scans over the buckets of
first bytes. Adjacent common prefixes of ``LENGTH`` bytes join windows to classes; the smallest document of each class
goes back to the chunks, which cut what a smaller document has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bound_batches, materialize
from quillon.llm.hashing import mix64, prefix_sums, release, spans

LENGTH, GRAM = 50, 20
CHUNK, SLICE = 1 << 20, 1 << 17
#: Bytes of text for each bucket of anchors.
BUCKET_BYTES = 4 << 20
#: Runs of one anchor, distinct within their chunks, beyond which its windows are dealt by their own hashes.
HOT_RUNS = 1 << 12
#: Rows without an id come after all others.
LAST = np.iinfo(np.int64).max

CHUNKS = "chunk long, ids array<long>, lens array<long>, data binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    context = TaskContext.get()
    chunk = (context.partitionId() if context else 0) << 32
    ids: list[int | None] = []
    texts: list[bytes] = []
    held = 0

    def row() -> pa.RecordBatch:
        data = pa.compress(b"".join(texts), codec="zstd", asbytes=True)
        return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(x) for x in texts]], pa.list_(pa.int64())), pa.array([data], pa.binary())], ["chunk", "ids", "lens", "data"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(doc_id), texts.append(text or b"")
            held += len(texts[-1]) + 64
            if held >= CHUNK:
                yield row()
                ids, texts, held, chunk = [], [], 0, chunk + 1
    if texts:
        yield row()
    texts.clear()
    release()


class Chunk:
    """A chunk's bytes, document bounds, and its runs: start, number of windows, and anchor hash."""

    def __init__(self, row: dict) -> None:
        self.ids = np.array([LAST if x is None else x for x in row["ids"]], dtype=np.int64)
        lens = np.array(row["lens"], dtype=np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(lens)])
        raw = pa.decompress(row["data"], decompressed_size=int(self.bounds[-1]), codec="zstd", asbytes=True) if self.bounds[-1] else b""
        self.data = np.frombuffer(raw, dtype=np.uint8)
        found = [self._runs(at) for at in range(0, max(len(self.data) - LENGTH + 1, 0), SLICE)]
        self.start, self.n, self.anchor, self.content = (np.concatenate(x) if found else np.zeros(0, dtype=t) for x, t in zip(zip(*found, strict=True) if found else [()] * 4, (np.int64, np.int64, np.uint64, np.uint64), strict=True))
        self.doc = np.searchsorted(self.bounds, self.start, side="right") - 1

    def _runs(self, at: int) -> tuple[np.ndarray, ...]:
        end = min(at + SLICE, len(self.data) - LENGTH + 1)
        data = self.data[at : end + LENGTH - 1]
        sums = prefix_sums(data)
        place = np.arange(len(data) - GRAM + 1, dtype=np.int64)
        grams = spans(sums, place, place + GRAM, rough=True)
        width, reach = LENGTH - GRAM + 1, 1
        low = (grams & ~np.uint64((1 << 21) - 1)) | place.astype(np.uint64)  # ties go to the leftmost
        while reach < width:
            step = min(reach, width - reach)
            low = np.minimum(low[:-step], low[step:])
            reach += step
        pick = (low & np.uint64((1 << 21) - 1)).astype(np.int64)
        # A window must end within the document that it starts in.
        valid = np.ones(end - at, dtype=bool)
        ends = self.bounds[1:][(self.bounds[1:] > at) & (self.bounds[1:] < end + LENGTH)]
        crossing = (ends[:, None] - at - np.arange(1, LENGTH)).ravel()
        valid[crossing[(crossing >= 0) & (crossing < len(valid))]] = False
        new = valid.copy()
        new[1:] &= (pick[1:] != pick[:-1]) | ~valid[:-1]
        first = np.flatnonzero(new)
        stop = np.flatnonzero(valid & ~np.concatenate([valid[1:] & ~new[1:], [False]]))
        n = stop - first + 1
        return first + at, n, grams[pick[first]], spans(sums, first, first + n + LENGTH - 1) + n.astype(np.uint64)


def _key(buckets: int) -> int:
    """Bytes of an anchor's hash that are exchanged; its bucket takes the rest of eight: 6 up to 65,536 buckets (270 GB), 5 up to 70 TB, 4 beyond."""
    return 6 if buckets <= 1 << 16 else 5 if buckets <= 1 << 24 else 4


def _marks(anchors: np.ndarray, buckets: int) -> np.ndarray:
    """What stands for an anchor between chunks: its bucket above bytes of its hash. Anchors that share it are merely looked at together."""
    low = np.uint64(8 * _key(buckets))
    return ((mix64(anchors) % np.uint64(buckets)) << low) | (anchors & ((np.uint64(1) << low) - np.uint64(1)))


def _cuts(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a sorted array, and the bounds of each."""
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])[: len(sorted_)])
    return sorted_[first], np.append(first, len(sorted_))


def _bucket(marks: np.ndarray, buckets: int) -> np.ndarray:
    return (marks >> np.uint64(8 * _key(buckets))).astype(np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _send_anchors(buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = Chunk(row)
            all_marks = _marks(chunk.anchor, buckets)
            order = np.lexsort((chunk.content, all_marks))
            ranked, content = all_marks[order], chunk.content[order]
            new = np.ones(len(order), dtype=bool)
            new[1:] = (ranked[1:] != ranked[:-1]) | (content[1:] != content[:-1])
            marks, count = np.unique(ranked[new], return_counts=True)
            count = np.minimum(count, np.iinfo(np.uint16).max).astype(np.uint16)
            raw = marks.view(np.uint8).reshape(-1, 8)[:, : _key(buckets)]
            some, at = _cuts(_bucket(marks, buckets))
            ends = list(zip(at[:-1], at[1:], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([row["chunk"]] * len(some), pa.int64()), pa.array([raw[a:b].tobytes() for a, b in ends], pa.binary()), pa.array([count[a:b].tobytes() for a, b in ends], pa.binary())], ["bucket", "chunk", "keys", "runs"])
        release()

    return send


def _mark_common(limit: int, buckets: int):
    def mark(table: pa.Table) -> pa.Table:
        """For each chunk, two bits for each of its anchors in this bucket: another chunk has it too; it has more than ``limit`` runs in all."""
        raw = [np.frombuffer(x, dtype=np.uint8).reshape(-1, _key(buckets)) for x in table["keys"].to_pylist()]
        runs = np.concatenate([np.frombuffer(x, dtype=np.uint16) for x in table["runs"].to_pylist()])
        wide = np.zeros((sum(map(len, raw)), 8), dtype=np.uint8)
        wide[:, : _key(buckets)] = np.concatenate(raw)
        keys = wide.view(np.uint64).ravel()
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
        times = np.diff(np.append(first, len(keys)))
        common, hot = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
        common[order] = np.repeat(times > 1, times)
        hot[order] = np.repeat(np.add.reduceat(runs[order].astype(np.int64), first) > limit, times)
        ends = np.cumsum([len(x) for x in raw])
        bits = [[np.packbits(flag[e - len(x) : e]).tobytes() for x, e in zip(raw, ends, strict=True)] for flag in (common, hot)]
        # Few buckets have an anchor to split.
        hots = [b if any(b) else None for b in bits[1]]
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "bits": pa.array(bits[0], pa.binary()), "hots": pa.array(hots, pa.binary())})

    return mark


def _window_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the LENGTH bytes from each position."""
    out = np.zeros(len(at), dtype=np.uint64)
    for lo in range(0, len(at), 1 << 17):
        part = out[lo : lo + (1 << 17)]
        for word in _words(data, at[lo : lo + (1 << 17)]).T:
            part[:] = mix64(part * np.uint64(0x9E3779B97F4A7C15) + word)
    return out


def _common_runs(chunk: Chunk, marks: list[dict], buckets: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Leaves in ``chunk`` the runs whose anchor occurs twice, those of hot anchors as single windows.

    Returns the distinct run of each, a run for each distinct one, and the buckets of those with their bounds.
    """
    anchors, index, count = np.unique(_marks(chunk.anchor, buckets), return_inverse=True, return_counts=True)
    some, bounds = _cuts(_bucket(anchors, buckets))
    at = {b: (lo, hi) for b, lo, hi in zip(some.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)}
    common, hot = np.zeros(len(anchors), dtype=bool), np.zeros(len(anchors), dtype=bool)
    for m in marks:
        lo, hi = at[m["bucket"]]
        for flag, bits in ((common, m["bits"]), (hot, m["hots"])):
            if bits is not None:
                flag[lo:hi] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=hi - lo).astype(bool)
    runs = np.flatnonzero((common | (count > 1))[index])
    whole, split = runs[~hot[index[runs]]], runs[hot[index[runs]]]
    single = _gather(chunk.start[split], chunk.n[split])
    hashes = _window_hashes(chunk.data, single)
    part = np.concatenate([_bucket(anchors[index[whole]], buckets), _bucket(_marks(hashes, buckets), buckets)])
    content = np.concatenate([chunk.content[whole], hashes])
    chunk.doc = np.concatenate([chunk.doc[whole], np.repeat(chunk.doc[split], chunk.n[split])])
    chunk.start = np.concatenate([chunk.start[whole], single])
    chunk.n = np.concatenate([chunk.n[whole], np.ones(len(single), dtype=np.int64)])
    order = np.lexsort((chunk.ids[chunk.doc], content, part))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (content[order][1:] != content[order][:-1]) | (part[order][1:] != part[order][:-1])
    distinct = np.empty(len(order), dtype=np.int64)
    distinct[order] = np.cumsum(new) - 1
    one = order[new]  # of the smallest document
    return distinct, one, _cuts(part[one])


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all positions of the ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths - starts, lengths)


def _send_runs(buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = Chunk(row)
            _, one, (some, at) = _common_runs(chunk, row["marks"] or [], buckets)
            for b, lo, hi in zip(some, at[:-1], at[1:], strict=True):
                own = one[lo:hi]
                text = chunk.data[_gather(chunk.start[own], chunk.n[own] + LENGTH - 1)].tobytes()
                columns = [[int(b)], [row["chunk"]], [chunk.n[own].astype(np.int32).tobytes()], [chunk.ids[chunk.doc[own]].tobytes()], [pa.compress(text, codec="zstd", asbytes=True)], [len(text)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()), strict=True)], ["bucket", "chunk", "n", "docs", "text", "size"])
        release()

    return send


def _words(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The LENGTH bytes from each position as big-endian words, which compare as the bytes do. ``text`` is padded."""
    out = np.zeros((len(at), -(-LENGTH // 8) * 8), dtype=np.uint8)
    out[:, :LENGTH] = np.lib.stride_tricks.sliding_window_view(text, LENGTH)[at]
    return out.view(">u8").astype(np.uint64)


def two_stage_order(text: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """``wanted`` positions in the order of their suffixes, exact in the first LENGTH bytes at least.

    ``text`` ends with LENGTH zero bytes of padding. A suffix smaller than its successor is sorted directly by its
    first bytes; any other ranks by its first byte and its successor's rank, so its chain of successors,
    up to one that is sorted directly, is ranked along.
    """
    size = len(text) - LENGTH
    step = np.diff(text.astype(np.int16))
    # Equal neighbours go by the next difference; the padding counts as a rise, so that every chain ends.
    step[size - 1 :] = 1
    place = np.where(step != 0, np.arange(len(step)), len(step) - 1)
    rises = step[np.minimum.accumulate(place[::-1])[::-1]] > 0
    need = np.zeros(len(text), dtype=bool)
    need[wanted] = True
    edge = wanted[~rises[wanted]] + 1
    while len(edge := edge[~need[edge]]):
        need[edge] = True
        edge = edge[~rises[edge]] + 1
    at = np.flatnonzero(need)
    direct, induced = at[rises[at]], at[~rises[at]]
    direct = direct[np.lexsort(_words(text, direct).T[::-1])]
    first = np.searchsorted(text[direct], np.arange(257))
    induced = induced[np.argsort(text[induced], kind="stable")]
    second = np.searchsorted(text[induced], np.arange(257))
    rank = np.full(len(text), -1, dtype=np.int64)
    done, out = 0, []

    def put(positions: np.ndarray) -> None:
        nonlocal done
        rank[positions] = np.arange(done, done + len(positions))
        done += len(positions)
        out.append(positions)

    for c in range(256):
        left = induced[second[c] : second[c + 1]]
        while len(left):  # successors in smaller buckets first, then runs of the byte c itself, layer by layer
            ready = rank[left + 1]
            known = ready >= 0
            put(left[known][np.argsort(ready[known])])
            left = left[~known]
        put(direct[first[c] : first[c + 1]])
    order = np.concatenate(out)
    keep = np.zeros(len(text), dtype=bool)
    keep[wanted] = True
    return order[keep[order]]


def _smallest(table: pa.Table) -> pa.Table:
    """For each chunk of a bucket, the smallest document of each window's class."""
    texts = [pa.decompress(t, decompressed_size=s, codec="zstd", asbytes=True) for t, s in zip(table["text"].to_pylist(), table["size"].to_pylist(), strict=True)]
    n = [np.frombuffer(x, dtype=np.int32).astype(np.int64) for x in table["n"].to_pylist()]
    docs = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in table["docs"].to_pylist()])
    text = np.frombuffer(b"".join(texts) + bytes(LENGTH), dtype=np.uint8)
    del texts
    counts = np.concatenate(n)
    begin = np.concatenate([[0], np.cumsum(counts + LENGTH - 1)[:-1]])
    windows = _gather(begin, counts)
    order = two_stage_order(text, windows)
    index = np.empty(len(text), dtype=np.int64)
    index[windows] = np.arange(len(windows))
    index = index[order]
    # Adjacent common prefixes: a class ends where fewer than LENGTH bytes agree.
    new = np.ones(len(order), dtype=bool)
    for lo in range(1, len(order), 1 << 17):
        first = _words(text, order[lo - 1 : lo + (1 << 17)])
        new[lo : lo + (1 << 17)] = (first[1:] != first[:-1]).any(axis=1)
    owner = np.repeat(docs, counts)
    low = np.empty(len(windows), dtype=np.int64)
    low[index] = np.minimum.reduceat(owner[index], np.flatnonzero(new))[np.cumsum(new) - 1]
    ends = np.cumsum([x.sum() for x in n])
    packed = [pa.compress(low[e - x.sum() : e].tobytes(), codec="zstd", asbytes=True) for x, e in zip(n, ends, strict=True)]
    del text, windows, order, index, new, owner, low
    release()
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "low": pa.array(packed, pa.binary())})


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>"


def _cut(buckets: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = Chunk(row)
            distinct, one, (some, at) = _common_runs(chunk, row["marks"] or [], buckets)
            held = {b: (lo, hi) for b, lo, hi in zip(some.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)}
            sizes = chunk.n[one]
            first = np.concatenate([[0], np.cumsum(sizes)])
            low = np.full(first[-1], LAST, dtype=np.int64)
            for m in row["lows"] or []:
                lo, hi = (first[x] for x in held[m["bucket"]])
                low[lo:hi] = np.frombuffer(pa.decompress(m["low"], decompressed_size=int(hi - lo) * 8, codec="zstd", asbytes=True), dtype=np.int64)
            windows = _gather(chunk.start, chunk.n)
            smaller = low[_gather(first[distinct], chunk.n)] < np.repeat(chunk.ids[chunk.doc], chunk.n)
            windows = windows[smaller]
            turn = np.bincount(windows, minlength=len(chunk.data) + 1) - np.bincount(windows + LENGTH, minlength=len(chunk.data) + 1)
            gone = np.cumsum(turn[:-1]) > 0
            out = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "removed": []}
            for k, doc_id in enumerate(row["ids"]):
                lo, hi = chunk.bounds[k], chunk.bounds[k + 1]
                mask = np.concatenate([[False], gone[lo:hi], [False]])
                turns = np.flatnonzero(mask[1:] != mask[:-1])
                part = chunk.data[lo:hi]
                kept = part[~gone[lo:hi]] if len(turns) else part
                values = (doc_id, hi - lo, hi - lo - len(kept), len(turns) // 2, hashlib.sha256(kept.tobytes()).hexdigest(), [{"start": int(a), "end": int(b)} for a, b in zip(turns[::2], turns[1::2], strict=True)])
                for column, value in zip(out.values(), values, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))
        release()

    return cut


def _gathered(df: DataFrame, name: str, *values: str) -> DataFrame:
    """What the buckets say of each chunk: one entry for each bucket at most."""
    return df.groupBy("chunk").agg(F.collect_list(F.struct("bucket", *values)).alias(name))


def cut_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): what is left without bytes covered by LENGTH-byte strings of smaller documents.

    Texts count as UTF-8 bytes, null as none; matches never cross documents and are judged on the input.
    Rows with equal ids never cut each other; rows with null ids come after all others; repeated rows give
    repeated results; other columns play no part; an empty table gives an empty result. ``removed`` lists the
    maximal removed runs, ends exclusive.
    """
    bound_batches(docs.sparkSession)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    chunks = materialize(text.mapInArrow(_pack, CHUNKS), "repeat-chunks", "uncompressed")
    total = chunks.agg(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = int(max(-(-total // BUCKET_BYTES), 8))
    sent = chunks.mapInArrow(_send_anchors(buckets), "bucket long, chunk long, keys binary, runs binary")
    marks = materialize(_gathered(sent.groupBy("bucket").applyInArrow(_mark_common(HOT_RUNS, buckets), "chunk long, bucket long, bits binary, hots binary"), "marks", "bits", "hots"), "repeat-marks")
    marked = chunks.join(marks, "chunk", "left").select("chunk", "ids", "lens", "data", "marks")
    runs = marked.mapInArrow(_send_runs(buckets), "bucket long, chunk long, n binary, docs binary, text binary, size long")
    lows = materialize(_gathered(runs.groupBy("bucket").applyInArrow(_smallest, "chunk long, bucket long, low binary"), "lows", "low"), "repeat-lows")
    return marked.join(lows, "chunk", "left").select("chunk", "ids", "lens", "data", "marks", "lows").mapInArrow(_cut(buckets), RESULT)
