"""Writers of one index that meet."""

import threading

import pytest
from pyspark.sql import functions as F

from lodestone.sources.shared import Notes
from lodestone.sources.store import ChunkIndex
from tests.test_operators import STAMP, _chunks


def rows(spark, *given):
    return _chunks(spark, [(c, t, h, k, "skills", 0, [1.0, 0.0]) for c, t, h, k in given])


def index(spark, path, buckets=64):
    return ChunkIndex(spark, f"file://{path}/i", STAMP, buckets)


def held(ix):
    return {(r.chunk_id, r.text) for r in ix.chunks().collect()}


def between(monkeypatch, ix, act, times=1):
    """Lets `act` run after the index's change is planned and before it is committed."""
    plain, left = ix._committed, [times]

    def committed(at, change):
        if left[0]:
            left[0] -= 1
            act()
        return plain(at, change)

    monkeypatch.setattr(ix, "_committed", committed)


def test_interleaved_upserts_both_survive(spark, tmp_path, monkeypatch):
    a, b = index(spark, tmp_path), index(spark, tmp_path)
    between(monkeypatch, a, lambda: b.upsert(rows(spark, ("cb", "b", "hb", "kb"))))
    a.upsert(rows(spark, ("ca", "a", "ha", "ka")))
    assert held(a) == held(b) == {("ca", "a"), ("cb", "b")}


def test_one_bucket_for_both_is_planned_anew(spark, tmp_path, monkeypatch):
    a, b = index(spark, tmp_path, 1), index(spark, tmp_path, 1)
    between(monkeypatch, a, lambda: b.upsert(rows(spark, ("cb", "b", "hb", "kb"))), times=3)
    a.upsert(rows(spark, ("ca", "a", "ha", "ka")))
    assert held(a) == {("ca", "a"), ("cb", "b")}


def test_delete_against_upsert_and_refresh(spark, tmp_path, monkeypatch):
    a, b = index(spark, tmp_path), index(spark, tmp_path)
    a.upsert(rows(spark, ("c1", "x", "h1", "k1"), ("c2", "y", "h2", "k2")))
    between(monkeypatch, a, lambda: b.upsert(rows(spark, ("c1", "new", "h1", "k1"), ("c3", "z", "h3", "k3"))))
    assert a.delete("h1") == 1
    assert held(b) == {("c2", "y"), ("c3", "z")}
    names = spark.createDataFrame([("h2", "n.pdf", "/n")], "document_hash string, source_filename string, source_path string")
    between(monkeypatch, a, lambda: b.delete("h2"))
    a.refresh(names)
    assert held(a) == {("c3", "z")}


def test_an_id_that_appears_elsewhere_meanwhile_is_replaced(spark, tmp_path, monkeypatch):
    a, b = index(spark, tmp_path, 1 << 20), index(spark, tmp_path)
    between(monkeypatch, a, lambda: b.upsert(rows(spark, ("c1", "old", "h7", "k7"))))
    a.upsert(rows(spark, ("c1", "new", "h1", "k1")))
    assert held(b) == {("c1", "new")}


def test_an_older_revision_that_appears_meanwhile_goes(spark, tmp_path, monkeypatch):
    a, b = index(spark, tmp_path), index(spark, tmp_path)
    a.upsert(rows(spark, ("c1", "x", "h1", "k1"), ("c4", "w", "h4", "k4")))
    between(monkeypatch, a, lambda: b.upsert(rows(spark, ("c2", "y", "h2", "k1"))))
    a.delete_replaced(spark.createDataFrame([("h9", "/h9", "k1")], "document_hash string, source_path string, candidate_id string"))
    assert held(b) == {("c4", "w")}


def test_threads(spark, tmp_path):
    wrong = []

    def work(i):
        try:
            ix = index(spark, tmp_path, 4)
            for j in range(2):
                ix.upsert(rows(spark, (f"c{i}-{j}", f"t{i}", f"h{i}-{j}", f"k{i}")))
            ix.delete(f"h{i}-0")
        except Exception as e:  # noqa: BLE001
            wrong.append(e)

    threads = [threading.Thread(target=work, args=(i,)) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not wrong
    assert held(index(spark, tmp_path)) == {(f"c{i}-1", f"t{i}") for i in range(3)}
    assert index(spark, tmp_path, 9).bucket.endswith(", 4)")


def test_a_writer_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    ix = index(spark, tmp_path)
    ix.upsert(rows(spark, ("c1", "x", "h1", "k1")))

    def die(*_):
        raise RuntimeError("gone")

    monkeypatch.setattr(ix._manifests, "follow", die)
    with pytest.raises(RuntimeError):
        ix.upsert(rows(spark, ("c2", "y", "h2", "k2")))
    assert held(index(spark, tmp_path)) == {("c1", "x")}


def test_a_name_is_given_once(spark, tmp_path):
    notes = [Notes(spark, f"file://{tmp_path}/n") for _ in range(8)]
    told = []
    threads = [threading.Thread(target=lambda i=i: told.append((notes[i].write("a", f"text {i}"), f"text {i}"))) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert [t for ok, t in told if ok] == [notes[0].read("a")]
    assert notes[0].names() == ["a"]
    assert [notes[0].follow(0, "x"), notes[1].follow(0, "y"), notes[1].follow(1, "z")] == [True, False, True]
    assert notes[2].number() == 2 and notes[2].latest() == "z"


def test_nothing_to_do(spark, tmp_path):
    ix = index(spark, tmp_path)
    assert ix.delete("h1") == 0
    ix.delete_replaced(spark.createDataFrame([("h9", "/x", "k2")], "document_hash string, source_path string, candidate_id string"))
    ix.upsert(ix.chunks().where(F.lit(False)))
    assert held(ix) == set()
