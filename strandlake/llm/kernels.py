"""Vectorised text kernels (numpy over UTF-8 buffers), used inside Arrow map functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_C1, _C2, _C3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: Bytes of text that the kernels take at once: bounds a worker's memory whatever the batch holds.
SLICE_BYTES = 4 << 20


def give_back() -> None:
    """Return freed memory to the system, where the C library can: a reused worker would hold its largest need for ever."""
    global _TRIM
    if _TRIM is None:
        import ctypes

        _TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) or (lambda _: 0)
    _TRIM(0)


_TRIM = None


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * _C2
    x = (x ^ (x >> U64(27))) * _C3
    return x ^ (x >> U64(31))


def slices(ids: list, texts: list, limit: int = SLICE_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """Cut rows into runs of about `limit` bytes of UTF-8; a null text counts as empty."""
    a, b, size = [], [], 0
    for i, t in zip(ids, texts):
        raw = b"" if t is None else t.encode("utf-8", "surrogatepass")
        if b and size + len(raw) > limit:
            yield a, b
            a, b, size = [], [], 0
        a.append(i)
        b.append(raw)
        size += len(raw)
    if b:
        yield a, b


def row_slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES):
    """(ids, UTF-8 texts) runs of batches whose first two columns are an id and a text."""
    for batch in batches:
        n, step = batch.num_rows, 256
        for at in range(0, n, step):
            part = batch.slice(at, step)
            yield from slices(part.column(0).to_pylist(), part.column(1).to_pylist(), limit)


def separators(table: str) -> np.ndarray:
    """A table of 256 flags. 'blank': 0x20 and 0x09-0x0D. 'alnum': ASCII other than letters and digits."""
    out = np.zeros(256, bool)
    if table == "blank":
        out[[0x20, 9, 10, 11, 12, 13]] = True
    else:
        out[:128] = True
        out[0x30:0x3A] = out[0x41:0x5B] = out[0x61:0x7B] = False
    return out


BLANK = separators("blank")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words of several texts: starts and ends in `buf`, `doc` as the text's index, `first` as each text's first word."""

    def __init__(self, raws: list[bytes], lower: bool = False, sep: np.ndarray = BLANK):
        joined = b"\n".join(raws) + b"\n" + bytes(16)
        self.buf = np.frombuffer(joined, np.uint8)
        if lower:
            self.buf = _LOWER[self.buf]
        sizes = np.fromiter((len(r) + 1 for r in raws), np.int64, len(raws))
        ends = np.cumsum(sizes)
        gap = sep[self.buf[: ends[-1]]]
        inside = np.zeros(len(gap) + 1, np.int8)
        inside[1:] = ~gap
        edge = np.diff(inside)
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        if len(self.end) < len(self.start):
            self.end = np.append(self.end, len(gap))
        self.doc = np.searchsorted(ends, self.start, side="right")
        self.first = np.searchsorted(self.doc, np.arange(len(raws) + 1))

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word, eight bytes at a time."""
        length = self.end - self.start
        h = mix(length.astype(np.uint64) * _C1 + U64(seed))
        wide = np.ndarray((len(self.buf) - 7,), "<u8", self.buf.data if self.buf.flags.c_contiguous else self.buf.tobytes(), 0, (1,))
        live, k = np.arange(len(h)), 0
        while len(live):
            left = length[live] - 8 * k
            chunk = wide[self.start[live] + 8 * k]
            short = left < 8
            keep = (U64(1) << (np.where(short, left, 0).astype(np.uint64) * U64(8))) - U64(1)
            chunk = np.where(short, chunk & keep, chunk)
            h[live] = mix((h[live] ^ chunk) * _C1 + U64(k + 1))
            live, k = live[left > 8], k + 1
        return h


def rolling(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of k consecutive word hashes (order matters); len(h) - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out + h[j : j + n]) * _C2 + U64(seed)
    return mix(out)
