"""A stream of files that are added, revised, renamed and repeated, also when it is killed between its steps."""

import pytest
from pyspark.sql import functions as F

from lodestone.sources.store import ChunkIndex
from lodestone.streaming.ingest import Revisions, files

STAMP = {"index_version": "1", "embedding_model": "m", "dimension": 2, "chunking_version": "section-v1", "metric": "cosine"}


def embed(c):
    return c.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>"))


def text(what):
    return f"Ada\n\nSKILLS\nPython and {what}\n\nEDUCATION\nMSc in {what}"


BATCHES = [
    [("a.pdf", "maths", "k1", 1), ("b.pdf", "physics", "k2", 1), ("copy.pdf", "maths", "k9", 0), ("c.pdf", "early", "k3", 1), ("c.pdf", "late", "k3", 2)],
    [("a.pdf", "maths", "k1", 2), ("b.pdf", "chemistry", "k2", 2), ("moved.pdf", "late", "k3", 3), ("d.pdf", "art", "k4", 1)],
]
WANT = [
    {("a.pdf", "k1", "indexed"), ("b.pdf", "k2", "indexed"), ("copy.pdf", "k9", "duplicate_input"), ("c.pdf", "k3", "superseded"), ("c.pdf", "k3", "indexed")},
    {("a.pdf", "k1", "skipped"), ("b.pdf", "k2", "replaced"), ("moved.pdf", "k3", "metadata_refreshed"), ("d.pdf", "k4", "indexed")},
]


def feed(spark, tmp_path, i):
    rows = [(k, text(t), who, v) for k, t, who, v in BATCHES[i]]
    spark.createDataFrame(rows, "name string, text string, who string, at int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")


def flow(spark, tmp_path):
    index = ChunkIndex(spark, f"file://{tmp_path}/index", STAMP, 16)
    return index, Revisions(index, embed, f"file://{tmp_path}/state", "text", "who", "at")


def held(index):
    return {(r.source_path, r.candidate_id, r.text) for r in index.chunks().where("section_name = 'skills'").collect()}


def run(spark, tmp_path, revisions):
    q = revisions.start(files(spark, f"file://{tmp_path}/docs"), "name", f"file://{tmp_path}/checkpoint")
    q.awaitTermination()


def statuses(revisions, batch):
    return {(r.key, r.candidate_id, r.status) for r in revisions.statuses().where(F.col("batch") == batch).collect()}


AFTER = [
    {("a.pdf", "k1", "Python and maths"), ("b.pdf", "k2", "Python and physics"), ("c.pdf", "k3", "Python and late")},
    {("a.pdf", "k1", "Python and maths"), ("b.pdf", "k2", "Python and chemistry"), ("moved.pdf", "k3", "Python and late"), ("d.pdf", "k4", "Python and art")},
]


@pytest.mark.parametrize("die", [None, "upsert", "refresh", "delete_replaced"])
def test_revisions(spark, tmp_path, monkeypatch, die):
    index, revisions = flow(spark, tmp_path)
    for i in range(2):
        feed(spark, tmp_path, i)
        if die and i == 1:
            plain = getattr(index, die)

            def failing(*a, plain=plain):
                plain(*a)
                raise RuntimeError("killed")

            monkeypatch.setattr(index, die, failing)
            with pytest.raises(Exception, match="killed"):
                run(spark, tmp_path, revisions)
            index, revisions = flow(spark, tmp_path)
        run(spark, tmp_path, revisions)
        assert statuses(revisions, i) == WANT[i]
        assert held(index) == {(k, c, t) for k, c, t in AFTER[i]}
    assert index.healthy()
    if die is None:
        before = held(index)
        for n in (0, 1):  # a replay changes nothing
            revisions.batch(spark.createDataFrame([(k, text(t), who, v) for k, t, who, v in BATCHES[n]], "name string, text string, who string, at int"), "name", n) if n else None
        assert held(index) == before
        listed = spark.createDataFrame([("a.pdf",), ("moved.pdf",)], "key string")
        assert revisions.removed(listed) == 2
        assert {k for k, _, _ in held(index)} == {"a.pdf", "moved.pdf"}
