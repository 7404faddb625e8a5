"""Substring dedup: every run of words that starts with a repeated window goes.

A window is `window` consecutive words of one text. Words covered by a window
whose words also start earlier (a smaller id, or the same text further up) are
removed; windows are judged on the texts as given.

How: the tasks build count-min sketches and their merged counters overestimate
how often a window occurs. What is counted is the window's anchor, its least
run of words by hash: equal windows have equal anchors at equal places, and
different starts of one window have different places of its anchor, so a
window's count is never above its anchor's. A second pass sends only windows
estimated repeated, groups them exactly by 96 bits of hash and finds the first
row of each; a third takes these back to the texts and cuts. A row is known by
its id and a hash of its text, so a row is joined with its own windows only.

Edge cases: a null text has no words; texts shorter than a window lose
nothing; a null id counts as the least id and comes back as null; rows that
share an id are documents of their own, ordered by a hash of their texts; rows
that agree in id and text are one document told twice, and lose the same words;
all columns are kept and the added ones replace any of their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import kernels as K
from lodestone.llm import sketch
from lodestone.llm.common import LEAST_ID, col, id_key, packed

ADDED = ("n_words", "n_removed", "kept_text")


def _anchors(hashes: np.ndarray, window: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the window from each word on: its anchor's hash and place."""
    g = K.windows(hashes, run)
    at = np.arange(len(g))
    width, done = window - run + 1, 1
    while done < width:
        step = min(done, width - done)
        later = g[step:] < g[:-step]
        at = np.where(later, at[step:], at[:-step])
        g = np.where(later, g[step:], g[:-step])
        done += step
    return g, at


def _of(batch: pa.RecordBatch, text: int) -> tuple[K.Words, np.ndarray]:
    w = K.Words(*K.buffers(batch.column(text)))
    return w, w.hashes()


def _scan(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from K.slices(b, text)


def _repeated(w: K.Words, h: np.ndarray, window: int, run: int, seen: sketch.Repeats) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows estimated repeated, and both hashes of all windows."""
    starts = K.inside(w.counts, window)
    if not len(starts):
        return starts, np.empty(0, K.U64)
    anchor = _anchors(h, window, run)[0][starts]
    new = np.ones(len(anchor), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    return starts[seen.maybe(anchor[new])[np.cumsum(new) - 1]], K.windows(h, window)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, depth: int = 2) -> DataFrame:
    """docs with n_words, n_removed and kept_text (the kept words, one space between)."""
    run = max(1, window * 2 // 5)
    names = [c for c in docs.columns if c not in ADDED]
    own_text = dict(docs.dtypes)[text_col] == "string"  # else the column comes back as it is
    others = [c for c in names if c != text_col or not own_text]
    text = col(text_col).cast("string")
    own = F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseXOR(F.lit(LEAST_ID))  # in unsigned order
    keyed = docs.select(id_key(id_col).alias("k"), own.alias("o"), text.alias("text"))
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = sketch.bits_for(size / 6 * 2 / (window - run + 2))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in _scan(batches, 0):
            w, h = _of(b, 0)
            starts = K.inside(w.counts, window)
            if len(starts):
                g, at = _anchors(h, window, run)
                at = at[starts]
                new = np.ones(len(at), bool)
                new[1:] = at[1:] != at[:-1]
                yield g[starts][new]

    seen = sketch.repeats(keyed.select("text"), places, bits, depth)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _scan(batches, 2):
            w, h = _of(b, 2)
            starts, a = _repeated(w, h, window, run, seen)
            if len(starts):
                second = (K.windows(h, window, 1)[starts] >> K.U64(32)).astype(np.uint32).view(np.int32)
                ids, own = (np.asarray(b.column(c))[w.doc[starts]] for c in (0, 1))
                for i in range(0, len(starts), 1 << 18):
                    j = slice(i, i + (1 << 18))
                    yield pa.RecordBatch.from_pydict({"a": a[starts[j]].view(np.int64), "b": second[j], "k": ids[j], "o": own[j]})

    firsts = keyed.mapInArrow(candidates, "a long, b int, k long, o long").groupBy("a", "b").agg(F.min(F.struct("k", "o")).alias("x"))
    firsts = firsts.groupBy("x.k", "x.o").agg(F.collect_list("a").alias("firsts"))
    row = docs.select(packed(others).alias("row"), text.alias("text"), id_key(id_col).alias("k"), own.alias("o"))
    joined = row.join(firsts.hint("shuffle_hash"), ["k", "o"], "left").select("row", "text", "firsts")
    schema = T.StructType([*joined.schema.fields[:2], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _scan(batches, 1):
            w, h = _of(b, 1)
            starts, a = _repeated(w, h, window, run, seen)
            n = len(w.start)
            lost = np.zeros(n + 1, bool)
            if len(starts):
                lost[starts] = True
                by = np.searchsorted(starts, w.first)
                own = b.column(2)
                for d in np.flatnonzero(np.diff(by)):
                    first = own[int(d)].values
                    if first is not None and len(first):
                        mine = starts[by[d] : by[d + 1]]
                        hashes, at = np.unique(a[mine], return_index=True)
                        kept = np.isin(hashes, np.asarray(first).view(K.U64))
                        lost[mine[at[kept]]] = False
            total = np.concatenate([[0], np.cumsum(lost[:n])])
            i = np.arange(n)
            gone = total[i + 1] > total[np.maximum(0, i + 1 - window)]
            removed = np.concatenate([[0], np.cumsum(gone)])[w.first]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(w.counts.astype(np.int64)), pa.array(np.diff(removed).astype(np.int64)), _joined(w, ~gone)], ["row", "text", *ADDED])

    return joined.mapInArrow(cut, schema).select(*(F.col("text").alias(c) if c not in others else F.col("row").getField(c).alias(c) for c in names), *ADDED)


def _joined(w: K.Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text with one space between."""
    doc = w.doc[keep]
    start, end = w.start[keep], w.end[keep]
    last = np.ones(len(doc), bool)
    last[:-1] = doc[1:] != doc[:-1]
    mark = np.zeros(len(w.data) + 1, np.int8)
    mark[start] += 1
    np.add.at(mark, end, -1)
    take = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
    data = w.data.copy()
    gaps = end[~last]
    data[gaps] = 32
    take[gaps] = True
    length = np.zeros(len(w.counts), np.int64)
    np.add.at(length, doc, end - start + ~last)
    offsets = np.concatenate([[0], np.cumsum(length)])
    return pa.Array.from_buffers(pa.large_string(), len(length), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[take])]).cast(pa.string())
