"""Vectorised hashing of byte strings: words by a mixing step for every eight bytes, byte ranges of one text by polynomials modulo 2^64."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

_BASE = 0x5851F42D4C957F2D | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads each value over all 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: What each byte value stands for in a polynomial.
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
#: The tables of powers, kept by each process.
_TABLES: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    if not _TABLES or len(_TABLES["powers"][0]) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        up, down = np.full(size, _BASE, dtype=np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _TABLES["powers"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    up, down = _TABLES["powers"]
    return up[:n], down[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """s with s[j] - s[i] = hash of data[i:j] times base^i."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray, rough: bool = False) -> np.ndarray:
    """Hashes of the byte ranges [start, end); ``rough`` ones are spread by one multiplication."""
    _, down = powers(len(sums))
    out = (sums[end] - sums[start]) * down[start]
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) if rough else mix64(out)


def slices(texts: list[bytes], limit: int = 1 << 20) -> Iterator[list[bytes]]:
    """Runs of texts of about ``limit`` bytes in all, or one longer text."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text) > limit:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


#: Words of more bytes are hashed one by one, by a digest.
LONG = 64


def _chained(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges of LONG bytes at most: their length, then eight bytes at a time, each mixed in before the next. ``data`` has eight spare bytes."""
    out = mix64(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    lanes = np.arange(8)
    live = np.arange(len(start))
    for at in range(0, LONG, 8):
        live = live[size[live] > at]
        if not len(live):
            break
        chunk = data[(start[live] + at)[:, None] + lanes].view("<u8")[:, 0].astype(np.uint64)
        spare = (8 * np.maximum(at + 8 - size[live], 0)).astype(np.uint64)
        out[live] = mix64((out[live] ^ ((chunk << spare) >> spare)) * np.uint64(0xD6E8FEB86659FD93))
    return out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts (split at ASCII white space, A-Z lower-cased), in order, and the text that each is of."""
    whole = b" ".join(texts).lower()
    data = np.frombuffer(whole + b" " * 8, dtype=np.uint8)
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    turn = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = turn[::2], turn[1::2]
    size = end - start
    out = _chained(data, start, np.minimum(size, LONG))
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(whole[start[k] : end[k]], digest_size=8).digest(), "little")
    ends = np.cumsum([len(x) + 1 for x in texts])
    return out, np.searchsorted(ends, start, side="right")


def release() -> None:
    """Gives memory that a finished task no longer needs back to the system; workers live on between tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
