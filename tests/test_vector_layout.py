"""A layout by centroid gives what a scan of all gives, from a part of the cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import retrieval
from lodestone.sources.vector_layout import VectorLayout, bound_holds


def rows(spark, n=1500, wide=8, spread=0.15, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, wide)) * 2
    x = [(f"c{i:05d}", (centres[i % 20] + spread * rng.normal(size=wide)).tolist(), i % 7) for i in range(n)]
    return spark.createDataFrame(x, "chunk_id string, embedding array<double>, n int"), [v for _, v, _ in x[:3]]


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_exact_from_a_part(spark, tmp_path, metric):
    df, queries = rows(spark)
    layout = VectorLayout.build(df, f"file://{tmp_path}/v", metric, cells=40, sample=700)
    assert layout.count.sum() == 1500
    for q in queries:
        want = [(r.chunk_id, r["rank"], round(r.distance, 9), r.n) for r in retrieval.nearest(df, q, 10, metric).orderBy("rank").collect()]
        got = [(r.chunk_id, r["rank"], round(r.distance, 9), r.n) for r in layout.nearest(q, 10).orderBy("rank").collect()]
        assert got == want
        cells = layout.plan(q, 10)
        assert layout.read(cells).count() == sum(c for c, k in zip(layout.count, layout.cells, strict=True) if k in cells)
        if metric != "ip":
            assert len(cells) <= len(layout.cells) / 4
        assert all(r.bound <= r.least + 1e-12 for r in bound_holds(layout, q).collect())
    plan = layout.read(layout.plan(queries[0], 10))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    assert 0.9 <= layout.recall(queries, 10, 6) <= 1.0


def test_more_than_there_are_ties_and_odd_vectors(spark, tmp_path):
    odd = [("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 0.0]), ("d", None), ("e", [float("nan"), 1.0]), ("f", [0.0, 2.0]), ("g", [None, 1.0])]
    df = spark.createDataFrame(odd, "chunk_id string, embedding array<double>")
    layout = VectorLayout.build(df, f"file://{tmp_path}/v", "cosine", cells=2)
    assert [r.chunk_id for r in layout.nearest([1.0, 0.1], 9).orderBy("rank").collect()] == ["a", "b", "f"]
    l2 = VectorLayout.build(df, f"file://{tmp_path}/w", "l2", cells=3)
    assert [r.chunk_id for r in l2.nearest([1.0, 0.1], 3).orderBy("rank").collect()] == ["a", "b", "c"]
    empty = VectorLayout.build(df.where(F.lit(False)), f"file://{tmp_path}/e")
    assert empty.cells == []
    with pytest.raises(ValueError, match="no rows"):
        empty.nearest([1.0, 0.0], 3)
    with pytest.raises(ValueError, match="distance"):
        VectorLayout.build(df, f"file://{tmp_path}/x", "cubic")
