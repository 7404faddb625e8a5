"""Packing by best-fit decreasing.

A document's ids (with an end id) are cut into full windows first; what is left
of each goes, longest first, into the open window with the least sufficient
room, found by a segment tree over the remaining capacities. Texts never move:
each task encodes its own and writes a row per piece; the pieces, a few numbers
each, are dealt evenly into groups of about `group` and each group is packed by
itself, so a group leaves at most one window worse than needed and no task
sees more than its group.

Edge cases: a null or empty text is its end id alone; no piece is empty; rows
that share an id are packed each by itself; an empty table gives an empty
result; other columns than the id are dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import kernels as K
from lodestone.llm.common import written
from lodestone.llm.tokens import default_path, encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Room:
    """Open windows by remaining capacity; a segment tree counts them per range."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, window: int, room: int) -> None:
        self.open[room].append(window)
        i = self.leaves + room
        while i:
            self.tree[i] += 1
            i >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """A window with the least room that suffices, and that room."""
        t, i = self.tree, self.leaves + length
        while not t[i]:  # to the right of here, at the first ancestor that has any
            while i & 1:
                i >>= 1
                if i <= 1:
                    return None
            i += 1
        while i < self.leaves:
            i = 2 * i if t[2 * i] else 2 * i + 1
        room = i - self.leaves
        while i:
            t[i] -= 1
            i >>= 1
        return self.open[room].pop(), room


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The window of each piece and its place there."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room, n = Room(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        if found := room.take(length):
            w, left = found
        else:
            w, left, n = n, capacity, n + 1
        window[i], offset[i] = w, capacity - left
        if left > length:
            room.put(w, left - length)
    return window, offset


def pieces(docs: DataFrame, path: str, end: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for b in K.slices(batch, 1, 4 << 20):
                ids, at = enc.encode(*K.buffers(b.column(1)), end=end)
                raw = memoryview(ids.astype("<u4").tobytes())
                size = np.diff(at)
                many = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), many)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * capacity
                length = np.minimum(capacity, size[doc] - start)
                begin = at[doc] + start
                crc = [zlib.crc32(raw[4 * i : 4 * (i + n)]) for i, n in zip(begin.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).take(pa.array(doc)), "start": start, "length": length, "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": size[doc]})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(task, PIECES)


def pack(docs: DataFrame, capacity: int = 2048, end: int = 1, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", group: int = 50_000) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""
    cut = written(pieces(docs, path or default_path(), end, capacity, id_col, text_col), "pieces")
    groups = max(1, -(-cut.count() // group))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = list(batches)
        if not have:
            return
        t = pa.Table.from_batches(have).combine_chunks()
        window, offset = best_fit(np.asarray(t.column("length")), capacity)
        t = t.append_column("sequence_id", pa.array(window + (TaskContext.get().partitionId() << 36))).append_column("offset", pa.array(offset))
        yield from t.to_batches(max_chunksize=20_000)

    return cut.repartition(groups).mapInArrow(task, f"{PIECES}, sequence_id long, offset long")
