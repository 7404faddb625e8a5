"""Incremental, idempotent ingestion as a stream.

A file stream of documents feeds batches whose new hashes are appended to a
ledger partitioned by batch; a batch that runs again overwrites its own
partition, so replays change nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window as W

from lodestone.operators.chunking import chunk_documents, page_text
from lodestone.operators.ingest import classify, document_id, fingerprint, flattened, replaced, summaries
from lodestone.sources.shared import Notes, written
from lodestone.sources.store import ChunkIndex

LEDGER = "document_hash string, key string, batch long"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LEDGER)


def files(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the rows of a Parquet file or folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if fs.getFileStatus(p).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())


def start(stream: DataFrame, key: str, content: str, path: str, checkpoint: str, each: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Records every content once, under the first key that brought it; `each` gets the new rows."""

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        hashed = df.select(F.col(key).cast("string").alias("key"), fingerprint(F.col(content)).alias("document_hash"), *[c for c in df.columns if c not in (key, "key", "document_hash")])
        first = hashed.withColumn("__n", F.row_number().over(W.partitionBy("document_hash").orderBy("key"))).where("__n = 1").drop("__n")
        seen = ledger(spark, path).where(F.col("batch") != n).select("document_hash")
        new = first.join(seen, "document_hash", "left_anti")
        new.select("document_hash", "key").write.mode("overwrite").parquet(f"{path}/batch={n}")
        if each:
            each(new)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts(stream: DataFrame, time: str, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events per type and window, late ones dropped after the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count("*").alias("n"))


def into_index(index: ChunkIndex, embed: Callable[[DataFrame], DataFrame], text: str, candidate: str) -> Callable[[DataFrame], None]:
    """What `start` calls for each batch: new documents become chunks with vectors in the index.

    embed adds the column `embedding` to chunks; a document is one page.
    """

    def each(new: DataFrame) -> None:
        rows = _chunked(new.select("key", "document_hash", F.col(candidate).cast("string").alias("candidate_id"), F.col(text).alias("text")))
        index.upsert(written(embed(rows), "embedded"))

    return each


#: What a batch decides for each document that it brings.
PLAN = "key string, document_hash string, candidate_id string, status string"


class Revisions:
    """Ingestion of a stream of files that are added, revised, renamed and repeated.

    Of each batch a plan is written first: `duplicate_input` (a content that the batch
    has already), `superseded` (the same key or candidate comes again in a later
    version), `skipped` (stored as it is), `metadata_refreshed` (stored under another
    name), `replaced` (a new content whose key or candidate has an older one) or
    `indexed`. Then the index is changed by the plan, in steps that may be repeated:
    upsert, refresh, removal of older revisions. A batch that runs again, after a
    failure at any point, follows the plan it wrote, so statuses and index come out
    as if it had run once. Contents no longer listed go by `removed`.
    """

    def __init__(self, index: ChunkIndex, embed: Callable[[DataFrame], DataFrame], path: str, text: str, candidate: str, version: str | None = None):
        """embed adds `embedding` to chunks; version: a column by which the last of several rows of a key counts."""
        self.index, self.embed, self.path = index, embed, path.rstrip("/")
        self.text, self.candidate, self.version = text, candidate, version

    def start(self, stream: DataFrame, key: str, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(lambda df, n: self.batch(df, key, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def statuses(self) -> DataFrame:
        return self.index.spark.read.schema(PLAN + ", batch long").parquet(f"{self.path}/plan")

    def batch(self, df: DataFrame, key: str, n: int) -> None:
        order = F.col(self.version).cast("string") if self.version else F.lit("")
        rows = df.select(F.col(key).cast("string").alias("key"), fingerprint(F.col(self.text)).alias("document_hash"), F.col(self.candidate).cast("string").alias("candidate_id"), order.alias("version"), F.col(self.text).alias("text"))
        done = Notes(df.sparkSession, f"{self.path}/plan/batch={n}")
        if not done.exists("_SUCCESS"):
            self._plan(rows.drop("text")).write.mode("overwrite").parquet(f"{self.path}/plan/batch={n}")
        self._apply(rows, df.sparkSession.read.schema(PLAN).parquet(f"{self.path}/plan/batch={n}"))

    def _plan(self, rows: DataFrame) -> DataFrame:
        """One status per row."""
        later = [F.desc("version"), F.desc("key"), F.desc("document_hash")]
        one = W.partitionBy("document_hash").orderBy(*later)
        marked = rows.withColumn("copy", F.row_number().over(one))
        first = marked.where("copy = 1")
        # Of one key, and then of one candidate, the last version counts.
        last = first.withColumn("of_key", F.row_number().over(W.partitionBy("key").orderBy(*later)))
        by_candidate = W.partitionBy(F.coalesce("candidate_id", F.concat(F.lit("key "), F.col("key"))), F.col("of_key") == 1).orderBy(*later)
        last = last.withColumn("current", (F.col("of_key") == 1) & (F.row_number().over(by_candidate) == 1))
        chunks = self.index.chunks()
        names = chunks.groupBy("document_hash").agg(F.min("source_path").alias("stored_name"))
        have = summaries(chunks).select("document_hash", "complete").join(names, "document_hash")
        current = last.where("current")
        state = classify(current.withColumn("name", F.col("key")), have, ["key"]).drop("name")
        older = replaced(chunks, current.select("document_hash", F.col("key").alias("source_path"), "candidate_id")).select("source_path", "candidate_id", F.col("document_hash").alias("old")).distinct()
        by_key = state.alias("s").join(older.alias("o"), (F.col("s.key") == F.col("o.source_path")) & (F.col("s.document_hash") != F.col("o.old")), "left_semi").select("s.key")
        by_owner = state.alias("s").join(older.alias("o"), (F.col("s.candidate_id") == F.col("o.candidate_id")) & (F.col("s.document_hash") != F.col("o.old")), "left_semi").select("s.key")
        newer = by_key.union(by_owner).distinct().withColumn("newer", F.lit(True))
        status = F.when(F.col("status") != "pending", F.col("status")).when(F.coalesce("newer", F.lit(False)), "replaced").otherwise("indexed")
        judged = state.join(newer, "key", "left").withColumn("status", status)
        rest = last.where("NOT current").withColumn("status", F.lit("superseded"))
        copies = marked.where("copy > 1").withColumn("status", F.lit("duplicate_input"))
        columns = [c.split()[0] for c in PLAN.split(", ")]
        return judged.select(columns).unionByName(rest.select(columns)).unionByName(copies.select(columns))

    def _apply(self, rows: DataFrame, plan: DataFrame) -> None:
        new = plan.where("status IN ('indexed', 'replaced')").select("key", "document_hash")
        texts = rows.join(new, ["key", "document_hash"]).dropDuplicates(["document_hash"])
        if texts.limit(1).count():
            self.index.upsert(written(self.embed(_chunked(texts)), "embedded"))
        moved = plan.where("status = 'metadata_refreshed'").select("document_hash", F.col("key").alias("source_filename"), F.col("key").alias("source_path"))
        if moved.limit(1).count():
            self.index.refresh(moved)
        current = plan.where("status IN ('indexed', 'replaced', 'metadata_refreshed')").select("document_hash", F.col("key").alias("source_path"), "candidate_id")
        if current.limit(1).count():
            self.index.delete_replaced(written(current, "current-revisions"))

    def removed(self, listed: DataFrame) -> int:
        """Drops documents whose key is in no row of listed (key); says how many there were."""
        have = self.index.chunks().select("document_hash", F.col("source_path").alias("key")).distinct()
        gone = [r[0] for r in have.join(listed.select(F.col("key").cast("string")), "key", "left_anti").select("document_hash").distinct().toLocalIterator()]
        return sum(self.index.delete(h) > 0 for h in gone)


def _chunked(texts: DataFrame) -> DataFrame:
    """Chunks of (key, document_hash, candidate_id, text), a document being one page."""
    pages = texts.select("document_hash", F.lit(1).alias("page_number"), page_text(F.col("text")).alias("text"))
    owners = texts.select("document_hash", "candidate_id", F.col("key").alias("source_path"))
    chunks = flattened(chunk_documents(pages)).drop("page_label").join(owners, "document_hash")
    none = F.lit(None).cast("string")
    return chunks.withColumns({"document_id": document_id(F.col("document_hash")), "candidate_name": none, "professional_title": none, "source_filename": F.col("source_path")})
