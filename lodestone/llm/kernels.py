"""Array kernels over whole UTF-8 texts: words, word hashes and window hashes.

A batch of texts is one byte buffer with offsets, as Arrow keeps it, and all
work is done on numpy arrays over that buffer, so the cost per word is a few
nanoseconds and no Python object is made per word.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; all bytes of a
multi-byte UTF-8 character are above 0x7F, so splitting bytes equals splitting
characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_MASK = (1 << 64) - 1

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(size, U64)
            done, step = 1, b
            while done < size:
                p[done : 2 * done] = p[:done] * U64(step)
                done, step = 2 * done, step * step & _MASK
            out.append(p)
        have = _powers[base] = (out[0], out[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits, so that every bit depends on all."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


class Words:
    """The words of a batch of texts.

    data: all bytes; start, end: of each word in data; first: the index of the
    first word of each text, one longer than the texts; doc: the text of each
    word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, blank: np.ndarray = IS_SPACE):
        self.data = data = LOWER[data] if lower else data
        self.offsets = offsets
        solid = np.empty(len(data) + 1, bool)
        solid[:-1] = ~blank[data]
        solid[-1] = False
        begin = solid.copy()
        begin[1:] &= ~solid[:-1]
        stop = np.zeros(len(data) + 1, bool)
        stop[1:] = solid[:-1] & ~solid[1:]
        cut = offsets[1:-1]
        if len(cut):
            inner = cut[(cut > 0) & (cut < len(data))]
            begin[inner] = solid[inner]
            stop[inner] = solid[inner - 1]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop)
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return span_hashes(self.data, self.start, self.end)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes from each start to its end."""
    if not len(start):
        return np.empty(0, U64)
    up, down = powers(_BASES[0], len(data) + 1)
    total = np.empty(len(data) + 1, U64)
    total[0] = 0
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    h += (end - start).astype(U64) * U64(_BASES[1])
    return mix(h)


def windows(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The hash of the n words from each word on; the last n - 1 have none."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, U64)
    up, down = powers(_BASES[1 + seed], len(hashes) + 1)
    total = np.empty(len(hashes) + 1, U64)
    total[0] = 0
    np.cumsum(mix(hashes + U64(seed)) * up[: len(hashes)], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[:m])


def inside(counts: np.ndarray, n: int) -> np.ndarray:
    """The words from which n words of the same text go on."""
    left = np.repeat(np.cumsum(counts), counts) - np.arange(int(counts.sum()))
    return np.flatnonzero(left >= n)


def minimum(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    done = 1
    while done < w:
        step = min(done, w - done)
        h = np.minimum(h[:-step], h[step:])
        done += step
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column; a null is empty."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind, wide = np.int32, False
    else:
        kind, wide = np.int64, True
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offs, data = column.buffers()
    n, at = len(column), column.offset
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, kind, count=n + 1, offset=at * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8, count=o[-1] - o[0], offset=o[0]) if data is not None and o[-1] > o[0] else np.empty(0, np.uint8)
    return raw, o - o[0]


def slices(batch: pa.RecordBatch, text: int, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `most` bytes of text; a longer text is alone."""
    _, offsets = buffers(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to
