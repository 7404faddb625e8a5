"""A versioned chunk index in Parquet.

Chunks are dealt into buckets by document hash. A change writes the buckets it
touches anew and then a numbered manifest that names every bucket's folder;
readers take the highest manifest, so they see one version or the next, and a
writer that dies leaves the last one as it was.

Writers don't wait for each other: a change is planned on one manifest and must
be the next after it. Where another writer was first, the change moves on to
the newer manifest if that left the buckets it read or rewrites as they were
and what it looked for in other buckets hasn't appeared there; else it is
planned anew. So each of two changes is whole, and none undoes another.

What makes an index
compatible (embedding model, dimension, chunking version, metric) is stamped
beside it, and opening it otherwise is an error, not a migration.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.ingest import coverage, replaced, summaries
from lodestone.operators.retrieval import nearest
from lodestone.sources.shared import Notes

STAMP = ("index_version", "embedding_model", "dimension", "chunking_version", "metric")
CHUNKS = (
    "chunk_id string, text string, document_id string, document_hash string, candidate_id string, candidate_name string, "
    "professional_title string, source_filename string, source_path string, section_name string, page_numbers string, "
    "chunk_index int, document_chunk_count int, embedding array<float>"
)
#: How many buckets a new index has unless told; a change rewrites those of its documents.
BUCKETS = 1024
#: How often a change is planned before it gives up to other writers.
TRIES = 20


@dataclass(frozen=True)
class Snapshot:
    """A manifest's number and its folder of each bucket."""

    number: int
    folders: dict[str, str]


@dataclass
class Change:
    """rows: all chunks of the touched buckets from now on. still: whether what these other buckets
    hold now leaves the change as it is."""

    touched: list[str]
    rows: DataFrame | None
    still: Callable[[DataFrame], bool] = lambda _: True
    value: object = None


class ChunkIndex:
    def __init__(self, spark: SparkSession, path: str, stamp: dict, buckets: int = BUCKETS):
        """buckets: of a new index, so many that one is rewritten in a task or a few; an index keeps its number."""
        if set(stamp) != set(STAMP):
            raise ValueError(f"a stamp has {', '.join(STAMP)}")
        self.spark, self.path, self.stamp = spark, path.rstrip("/"), stamp
        self._stamps = Notes(spark, f"{self.path}/stamp")
        self._manifests = Notes(spark, f"{self.path}/manifests")
        text = json.dumps(stamp, sort_keys=True)
        if not self._stamps.write("stamp", text) and json.loads(self._stamps.read("stamp")) != stamp:
            raise ValueError(f"the index at {path} is stamped {self._stamps.read('stamp')}")

        self._stamps.write("buckets", str(buckets))
        self.bucket = f"pmod(xxhash64(document_hash), {int(self._stamps.read('buckets'))})"

    def _snapshot(self) -> Snapshot:
        n = self._manifests.number()
        return Snapshot(n, json.loads(self._manifests.read(f"{n:012d}")) if n else {})

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], CHUNKS)
        return self.spark.read.schema(CHUNKS).parquet(*(f"{self.path}/data/{f}" for f in sorted(folders)))

    def chunks(self) -> DataFrame:
        return self._read([*self._snapshot().folders.values()])

    def _touched(self, rows: DataFrame) -> list[str]:
        """Buckets of the rows' documents; there are no more than the index has."""
        return [str(r[0]) for r in rows.select(F.expr(self.bucket).alias("b")).distinct().collect()]

    def _of(self, at: Snapshot, buckets: Iterable[str]) -> DataFrame:
        return self._read([at.folders[b] for b in buckets if b in at.folders])

    def _change(self, plan: Callable[[Snapshot], Change | None]) -> object:
        """Plans a change on the newest manifest and commits it, as often as other writers make that necessary."""
        for _ in range(TRIES):
            at = self._snapshot()
            change = plan(at)
            if change is None:
                return None
            if self._committed(at, change):
                return change.value
        raise RuntimeError(f"other writers were first {TRIES} times")

    def _committed(self, at: Snapshot, change: Change) -> bool:
        version, new = uuid4().hex, {}
        if change.rows is not None:
            columns = [c.split()[0] for c in CHUNKS.split(", ")]
            change.rows.select(columns).withColumn("bucket", F.expr(self.bucket)).write.partitionBy("bucket").parquet(f"{self.path}/data/{version}")
            data = Notes(self.spark, f"{self.path}/data/{version}")
            new = {b: f"{version}/bucket={b}" for b in change.touched if data.exists(f"bucket={b}")}
        now = at
        while True:
            folders = {b: f for b, f in now.folders.items() if b not in change.touched} | new
            if self._manifests.follow(now.number, json.dumps(folders, sort_keys=True)):
                return True
            now = self._snapshot()
            moved = {b for b in {*at.folders, *now.folders} if at.folders.get(b) != now.folders.get(b)}
            if moved & {*change.touched} or not change.still(self._of(now, moved)):
                if change.rows is not None:
                    data.fs.delete(data.at(""), True)
                return False

    def upsert(self, new: DataFrame) -> None:
        """Adds or replaces chunks by id; ids must not repeat, vectors must have the stamped length and norm one."""
        size = self.stamp["dimension"]
        square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        wrong = new.where((F.size("embedding") != size) | (F.abs(F.sqrt(square) - 1) > 1e-3))
        if wrong.limit(1).count():
            raise ValueError("vectors must have the index's dimension and norm one")
        if new.groupBy("chunk_id").count().where("count > 1").limit(1).count():
            raise ValueError("a chunk id occurs twice")
        counted = new.drop("document_chunk_count").join(new.groupBy("document_hash").agg(F.count("*").cast("int").alias("document_chunk_count")), "document_hash")
        ids, own = new.select("chunk_id"), self._touched(new)

        def plan(at: Snapshot) -> Change:
            before = self._of(at, at.folders).join(ids, "chunk_id", "left_semi")
            touched = sorted({*own, *self._touched(before)})
            rows = self._of(at, touched).join(ids, "chunk_id", "left_anti").unionByName(counted)
            return Change(touched, rows, lambda other: not other.join(ids, "chunk_id", "left_semi").limit(1).count())

        self._change(plan)

    def delete(self, document_hash: str) -> int:
        """Removes a document's chunks and says how many there were."""
        touched = self._touched(self.spark.range(1).select(F.lit(document_hash).alias("document_hash")))

        def plan(at: Snapshot) -> Change | None:
            have = self._of(at, touched)
            n = have.where(F.col("document_hash") == document_hash).count()
            return Change(touched, have.where(F.col("document_hash") != document_hash), value=n) if n else None

        return self._change(plan) or 0

    def delete_replaced(self, current: DataFrame) -> None:
        """Drops older revisions of the documents in current (document_hash, source_path, candidate_id)."""

        def plan(at: Snapshot) -> Change | None:
            old = replaced(self._of(at, at.folders), current)
            touched = self._touched(old)
            if not touched:
                return None
            return Change(touched, self._of(at, touched).join(old.select("chunk_id"), "chunk_id", "left_anti"), lambda other: not replaced(other, current).limit(1).count())

        self._change(plan)

    def refresh(self, names: DataFrame) -> None:
        """New names and paths by document_hash, vectors untouched (document_hash, source_filename, source_path)."""
        n = names.select("document_hash", F.col("source_filename").alias("f"), F.col("source_path").alias("p"))
        touched = self._touched(n)

        def plan(at: Snapshot) -> Change:
            out = self._of(at, touched).join(n, "document_hash", "left").withColumn("source_filename", F.coalesce("f", "source_filename")).withColumn("source_path", F.coalesce("p", "source_path"))
            return Change(touched, out.drop("f", "p"))

        self._change(plan)

    def reset(self) -> None:
        """An empty index under the same stamp."""
        self._change(lambda at: Change([*at.folders], None))

    def info(self) -> DataFrame:
        """One row: the stamp, and how many chunks, documents and candidates the index holds."""
        c = self.coverage().select("n_records", "n_documents", "n_candidates")
        return c.select(F.lit(self.path).alias("path"), *(F.lit(self.stamp[k]).alias(k) for k in STAMP), "*")

    def summaries(self) -> DataFrame:
        return summaries(self.chunks())

    def coverage(self) -> DataFrame:
        return coverage(self.chunks())

    def nearest(self, query: list[float], k: int) -> DataFrame:
        if len(query) != self.stamp["dimension"]:
            raise ValueError("the query's dimension is not the index's")
        return nearest(self.chunks(), query, k, self.stamp["metric"])

    def healthy(self) -> bool:
        """Some records and candidates, and no incomplete document."""
        c = self.coverage().first()
        return bool(c["n_records"] and c["n_candidates"] and not c["n_incomplete"])
