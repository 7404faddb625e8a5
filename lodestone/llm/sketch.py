"""A distributed repeat sketch: count-min with counters that stop at two.

Every task counts its own hashes, sends each touched cell once (gaps between
sorted cells, one byte each as a rule) and the sketches are merged by range of
cells, adding and stopping at two. What is left is one bit per cell, "two or
more". A count-min counter never understates, so a hash seen twice always has
its bit set in every row; a hash seen once may have it too.

The width follows the size of the texts and ends at MOST_BITS, so what is
broadcast has a fixed bound (depth * 2**MOST_BITS / 8 bytes). Beyond that size
the sketch lets more single hashes through; results stay the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import kernels as K

LEAST_BITS, MOST_BITS, CHUNK_BITS = 16, 29, 20
_ODD = (0x9FB21C651E98DF25, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)
SCHEMA = "chunk int, ones binary, twos binary"


def bits_for(n: float) -> int:
    """Bits of width so that n different hashes fill less than half."""
    return int(min(MOST_BITS, max(LEAST_BITS, np.ceil(np.log2(max(1.0, 2.0 * n))))))


def cells(h: np.ndarray, bits: int, row: int) -> np.ndarray:
    return (K.mix(h * K.U64(_ODD[row])) >> K.U64(64 - bits)).astype(np.int64)


def pack(sorted_cells: np.ndarray) -> bytes:
    """Gaps between sorted distinct numbers; 255 means 255 more to come."""
    gap = np.diff(sorted_cells, prepend=-1) - 1
    many = gap // 255
    out = np.full(int((many + 1).sum()), 255, np.uint8)
    out[np.cumsum(many + 1) - 1] = gap % 255
    return out.tobytes()


def unpack(b: bytes) -> np.ndarray:
    gap = np.frombuffer(b, np.uint8)
    last = gap < 255
    return np.cumsum(gap, dtype=np.int64)[last] + np.arange(int(last.sum()))


def count(hashes: Iterator[np.ndarray], bits: int, depth: int) -> Iterator[pa.RecordBatch]:
    """One task's sketch, by chunk of cells; a hash counts each time it is given."""
    wide = min(bits, CHUNK_BITS)
    per_row = 1 << (bits - wide)
    have = [(np.empty(0, np.int64), np.empty(0, np.int64))] * depth
    held: list[np.ndarray] = []

    def fold() -> None:
        h = np.concatenate(held) if held else np.empty(0, K.U64)
        held.clear()
        for r in range(depth):
            ones, twos = have[r]
            c = np.sort(np.concatenate([cells(h, bits, r), ones, twos, twos]))
            new = np.empty(len(c), bool)
            new[:1] = True
            new[1:] = c[1:] != c[:-1]
            again = np.zeros(len(c), bool)
            again[:-1] = new[:-1] & ~new[1:]
            have[r] = (c[new & ~again], c[again])

    size = 0
    for h in hashes:
        held.append(h)
        size += len(h)
        if size > 1 << 21:
            fold()
            size = 0
    fold()
    for r in range(depth):
        ones, twos = have[r]
        o, t = (np.searchsorted(x, np.arange(per_row + 1) << wide) for x in (ones, twos))
        for k in range(per_row):
            if o[k] < o[k + 1] or t[k] < t[k + 1]:
                yield pa.RecordBatch.from_pydict({
                    "chunk": pa.array([r * per_row + k], pa.int32()),
                    "ones": pa.array([pack(ones[o[k]:o[k + 1]] - (k << wide))], pa.binary()),
                    "twos": pa.array([pack(twos[t[k]:t[k + 1]] - (k << wide))], pa.binary()),
                })


def _merge(batches: Iterator[pa.RecordBatch], wide: int) -> Iterator[pa.RecordBatch]:
    seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        for k, ones, twos in zip(*(c.to_pylist() for c in b.columns), strict=True):
            any_, two = seen.setdefault(k, (np.zeros(1 << wide, bool), np.zeros(1 << wide, bool)))
            one = unpack(ones)
            two[one] |= any_[one]
            two[unpack(twos)] = True
            any_[one] = True
            any_[two] = True
    for k, (_, two) in seen.items():
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()), "bits": pa.array([np.packbits(two, bitorder="little").tobytes()], pa.binary())})


class Repeats:
    """The merged sketch, as workers see it."""

    def __init__(self, planes: Broadcast, bits: int, depth: int):
        self.planes, self.bits, self.depth = planes, bits, depth

    def maybe(self, h: np.ndarray) -> np.ndarray:
        """Whether each hash may have been counted twice or more; never wrongly no."""
        out = np.ones(len(h), bool)
        for r in range(self.depth):
            c = cells(h, self.bits, r)
            out &= (self.planes.value[r][c >> 3] >> (c & 7).astype(np.uint8) & 1).astype(bool)
        return out


def repeats(docs: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], bits: int, depth: int) -> Repeats:
    """Sketches what `hashes` gives for every batch of docs and merges the tasks' sketches."""
    spark = docs.sparkSession
    wide = min(bits, CHUNK_BITS)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return count(hashes(batches), bits, depth)

    chunks = depth << (bits - wide)
    n = max(1, min(chunks, 64))
    rows = docs.mapInArrow(task, SCHEMA).repartition(n, F.col("chunk")).mapInArrow(lambda b: _merge(b, wide), "chunk int, bits binary").collect()
    planes = [np.zeros(max(1, (1 << bits) // 8), np.uint8) for _ in range(depth)]
    for row in rows:
        r, k = divmod(row["chunk"], 1 << (bits - wide))
        part = np.frombuffer(row["bits"], np.uint8)
        at = (k << wide) // 8
        planes[r][at : at + len(part)] = part
    return Repeats(spark.sparkContext.broadcast(planes), bits, depth)
