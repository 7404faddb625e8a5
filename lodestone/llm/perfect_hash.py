"""Minimal perfect hashes of 64-bit keys, built in shards and looked up by arrays.

A shard places its keys in levels of bits, each twice as wide as the keys left:
a key whose bit no other key shares stays there, the others go to the next
level. The number of set bits before a key's own is its slot, so n keys have
the slots 0 to n - 1. The keys themselves are stored by slot; a looked-up key
that differs from the one stored at its slot is not in the set.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import kernels as K
from lodestone.llm.common import written

SCHEMA = "shard int, n long, widths binary, bits binary, stored binary"
#: Keys of a shard, bits of a key's hash that choose it at most, and keys that are broadcast at once.
SHARD, SHARD_BITS, MOST = 1 << 17, 16, 1 << 22
_STEP = 0x9E3779B97F4A7C15


def top(keys: np.ndarray) -> np.ndarray:
    """The bits of each key's hash that choose its shard."""
    return (K.mix(keys.astype(K.U64)) >> K.U64(64 - SHARD_BITS)).astype(np.int32)


def _place(h: np.ndarray, level: int, width: np.ndarray | int) -> np.ndarray:
    g = K.mix(h + K.U64(_STEP * (level + 1) & (1 << 64) - 1)) >> K.U64(32)
    return (g * np.asarray(width, K.U64) >> K.U64(32)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct keys: the width of each level, all levels' bits in words, the keys by slot."""
    widths, words, stored = [], [], []
    left = keys.astype(K.U64)
    while len(left):
        width = -(-2 * len(left) // 64) * 64
        at = _place(K.mix(left), len(widths), width)
        alone = np.bincount(at, minlength=width) == 1
        mine = alone[at]
        widths.append(width)
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        stored.append(left[mine][np.argsort(at[mine])])
        left = left[~mine]
    return np.array(widths, np.int64), np.concatenate(words), np.concatenate(stored)


class Slots:
    """Several shards as one hash; slots count on from shard to shard from `base`."""

    def __init__(self, parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], shards: int, base: int = 0):
        """parts: shard, widths, bits and stored keys, in the order of shards; shards: how many there are in all."""
        self.base, self.shift = base, SHARD_BITS - (shards - 1).bit_length()
        self.widths = np.zeros((shards, max((len(p[1]) for p in parts), default=0)), np.int64)
        self.start = np.zeros_like(self.widths)
        at = 0
        for shard, widths, bits, _ in parts:
            self.widths[shard, : len(widths)] = widths
            self.start[shard, : len(widths)] = at * 64 + np.cumsum(widths) - widths
            at += len(bits)
        joined = lambda i: np.concatenate([p[i] for p in parts]) if parts else np.empty(0, K.U64)
        self.bits, self.stored = joined(2), joined(3)
        self.before = np.cumsum(np.bitwise_count(self.bits), dtype=np.int64) - np.bitwise_count(self.bits)

    def __len__(self) -> int:
        return len(self.stored)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot; -1 for keys that aren't stored."""
        out = np.full(len(keys), -1, np.int64)
        keys = keys.astype(K.U64)
        todo, h = np.arange(len(keys)), K.mix(keys)
        shard = (h >> K.U64(64 - SHARD_BITS)).astype(np.int64) >> self.shift
        for level in range(self.widths.shape[1]):
            width = self.widths[shard, level]
            todo, h, shard, width = (x[width > 0] for x in (todo, h, shard, width))
            if not len(todo):
                break
            at = self.start[shard, level] + _place(h, level, width)
            word, bit = self.bits[at >> 6], (at & 63).astype(K.U64)
            hit = (word >> bit & K.U64(1)).astype(bool)
            slot = self.before[at >> 6] + np.bitwise_count(word & ((K.U64(1) << bit) - K.U64(1)))
            same = hit.copy()
            same[hit] = self.stored[slot[hit]] == keys[todo[hit]]
            out[todo[same]] = slot[same] + self.base
            todo, h, shard = todo[~hit], h[~hit], shard[~hit]
        return out


@dataclass
class Index:
    """The written shards of a set of keys, and groups of shards of bounded size with their first slots."""

    table: DataFrame
    shards: int
    sizes: dict[int, int]
    groups: list[tuple[list[int], int]]

    def __len__(self) -> int:
        return sum(self.sizes.values())

    def slots(self, group: int) -> Slots:
        """A group's hash on the driver, to be broadcast."""
        shards, base = self.groups[group]
        rows = self.table.where(F.col("shard").between(shards[0], shards[-1])).collect()
        read = lambda b, kind: np.frombuffer(b, kind)
        return Slots([(r.shard, read(r.widths, "<i8"), read(r.bits, "<u8"), read(r.stored, "<u8")) for r in sorted(rows, key=lambda r: r.shard)], self.shards, base)

    def numbered(self) -> DataFrame:
        """Every key with its slot."""
        first, at = {}, 0
        for s in sorted(self.sizes):
            first[s], at = at, at + self.sizes[s]

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for shard, stored in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    keys = np.frombuffer(stored.as_buffer(), "<i8")
                    yield pa.RecordBatch.from_pydict({"key": keys, "slot": first[shard] + np.arange(len(keys))})

        return self.table.select("shard", "stored").mapInArrow(rows, "key long, slot long")


def index(keys: DataFrame, most: int = MOST, shard_keys: int = SHARD) -> Index:
    """The index of distinct keys (`key`, a long, and `top`, from `top`), each shard built in a task."""
    n = keys.count()
    bits = min(SHARD_BITS, max(0, (-(-n // shard_keys) - 1).bit_length()))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        at = None

        def done() -> pa.RecordBatch:
            parts = build(np.concatenate(held).view(K.U64))
            return pa.RecordBatch.from_pydict({"shard": pa.array([at], pa.int32()), "n": [len(parts[2])], **{c: pa.array([x.astype(f"<{x.dtype.kind}8").tobytes()], pa.binary()) for c, x in zip(("widths", "bits", "stored"), parts, strict=True)}})

        for b in batches:
            s, k = (np.asarray(c) for c in b.columns)
            cuts = [0, *(np.flatnonzero(np.diff(s)) + 1), len(s)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i < j:
                    if at is not None and s[i] != at:
                        yield done()
                        held.clear()
                    at = int(s[i])
                    held.append(k[i:j])
        if held:
            yield done()

    shard = F.shiftright("top", SHARD_BITS - bits).alias("shard")
    dealt = keys.select(shard, "key").repartition("shard").sortWithinPartitions("shard")
    table = written(dealt.mapInArrow(shards, SCHEMA), "perfect-hash")
    sizes = dict(table.select("shard", "n").collect())
    groups: list[tuple[list[int], int]] = []
    at = held = 0
    for s in sorted(sizes):
        if not groups or held + sizes[s] > most:
            groups.append(([], at))
            held = 0
        groups[-1][0].append(s)
        held, at = held + sizes[s], at + sizes[s]
    return Index(table, 1 << bits, sizes, groups)
