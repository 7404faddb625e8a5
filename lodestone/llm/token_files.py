"""Token ids written to files of coded blocks and read back.

File format: Parquet, one row per frame. A frame holds whole documents in
ascending id order: part and rel_start (its place: ids before it within its
part), doc_ids, doc_tokens, n_ids, and blocks, each coded on its own by
`coder` with its count and CRC-32 in front. Parts are id ranges in order, so
ids before a document are those of earlier parts, earlier in its part and
earlier in its frame. Spark's commit protocol makes the files appear whole or
not at all, and any frame decodes without another.

Edge cases: a null or empty text is its end id alone; null ids come first; of
rows that share an id the order follows a hash of the text; a document longer
than a frame is a frame of many blocks; an empty table writes no frame and
reads back as an empty result; other columns than the id are dropped. Parts
are ranges of (id, hash of the text), so rows that share an id spread out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import coder
from lodestone.llm import kernels as K
from lodestone.llm.tokens import default_path, encoder

FRAME = 1 << 16
AT_ONCE = 7 << 20
PART_BYTES = 32 << 20
TEXT_AT_ONCE = 4 << 20
#: Spark samples keys for each part on the driver, so their number has a bound; beyond it parts grow.
MOST_PARTS = 20_000
FRAMES = "part int, rel_start long, doc_ids array<long>, doc_tokens array<int>, n_ids long, blocks array<binary>"


def _frames(ids: np.ndarray, at: np.ndarray, names: list, part: int, before: int) -> Iterator[pa.RecordBatch]:
    """Frames of the documents ids[at[i]:at[i + 1]], whole documents each."""
    first, cuts = 0, [0]
    for i in range(1, len(at)):
        if at[i] - at[first] >= FRAME or i == len(at) - 1:
            cuts.append(i)
            first = i
    ends = [np.append(np.arange(at[a], at[b], coder.BLOCK), at[b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    blocks = iter(coder.encode(ids, np.concatenate([[0], *(e[1:] for e in ends)])))
    for a, b, e in zip(cuts, cuts[1:], ends, strict=False):
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "rel_start": pa.array([before + int(at[a])], pa.int64()),
            "doc_ids": pa.array([names[a:b]], pa.list_(pa.int64())), "doc_tokens": pa.array([np.diff(at[a : b + 1])], pa.list_(pa.int32())),
            "n_ids": pa.array([int(at[b] - at[a])], pa.int64()), "blocks": pa.array([[next(blocks) for _ in range(len(e) - 1)]], pa.list_(pa.binary())),
        })


def write_ids(docs: DataFrame, to: str, end: int = 2, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text, appends the end id and writes frames in ascending id order."""
    path = path or default_path()
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, min(MOST_PARTS, -(-size // PART_BYTES)))
    by = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    sorted_ = source.repartitionByRange(parts, *by).sortWithinPartitions(*by)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        names: list = []
        before = size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal before, size, held, names
            if names:
                steps = np.concatenate([np.diff(a) for _, a in held])
                yield from _frames(np.concatenate([x for x, _ in held]), np.concatenate([[0], np.cumsum(steps)]), names, part, before)
            before, size, held, names = before + size, 0, [], []

        for batch in batches:
            for b in K.slices(batch, 1, TEXT_AT_ONCE):
                x, at = enc.encode(*K.buffers(b.column(1)), end=end)
                held.append((x, at))
                names += b.column(0).to_pylist()
                size += len(x)
                if size >= AT_ONCE:
                    yield from flush()
        yield from flush()

    sorted_.mapInArrow(task, FRAMES).write.parquet(to)


def read_ids(spark: SparkSession, at: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, unless left out, ids (array<int>) of every document in the files."""
    frames = spark.read.schema(FRAMES).parquet(at)
    ends = {r[0]: r[1] for r in frames.groupBy("part").agg(F.sum("n_ids")).collect()}
    before, n = [], 0
    for p in range(max(ends, default=-1) + 1):
        before.append(n)
        n += ends.get(p, 0)

    def decode(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows)
        blocks = [b for frame in t.column("blocks").to_pylist() for b in frame]
        ids, _ = coder.decode(blocks)
        docs = t.column("doc_ids").combine_chunks().flatten()
        size = np.asarray(t.column("doc_tokens").combine_chunks().flatten()).astype(np.int64)
        stop = np.cumsum(size)
        many = np.asarray(pc.list_value_length(t.column("doc_ids")))
        first = np.cumsum(many) - many
        start = stop - size
        base = np.asarray(t.column("rel_start")) + np.array([before[p] for p in t.column("part").to_pylist()], np.int64) - start[first]
        start_all = start + np.repeat(base, many)
        raw = memoryview(ids.astype("<u4").tobytes())
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
        for i in range(0, len(size), 512):
            j = slice(i, min(i + 512, len(size)))
            out = {"doc_id": docs.slice(i, len(size[j])), "start": start_all[j], "n_tokens": size[j], "ids_crc32": pa.array(crc[j], pa.int64())}
            if with_ids:
                offsets = np.concatenate([start[j], stop[j][-1:]]) - start[i]
                out["ids"] = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids[start[i] : stop[j][-1]].astype(np.int32)))
            yield pa.RecordBatch.from_pydict(out)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                held.append(batch.slice(i, 1))
                size += batch.column(4)[i].as_py()
                if size >= AT_ONCE:
                    yield from decode(held)
                    held, size = [], 0
        if held:
            yield from decode(held)

    return frames.mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)

