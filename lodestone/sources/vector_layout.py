"""Vectors laid out by nearest centroid, so that a query reads a part of them and still answers exactly.

Centroids are fitted on a bounded sample (`sample` rows at most, by a hash of
the id; Lloyd's steps). Every row goes to the folder of its nearest centroid, and
each cell keeps how far its nearest and farthest row are from the centroid. By
the triangle inequality no row of a cell can be nearer to a query than the
distance between query and centroid allows, so a query first reads the cells
that look nearest, until they hold k rows, and with the k-th distance found there
only those that can still hold a nearer row. Cosine distances are those of unit
vectors; for inner products the bound is the query's product with the centroid
plus its length times the radius.

`most_cells` reads no more than so many cells and gives up exactness; `recall`
says what that costs. The layout is written once; centroids and bounds are a
small table (at most MOST_CELLS rows) that a reader holds on the driver.

Edge cases: rows without a vector, or with a null, non-finite or, for cosine,
zero one, are left out; an empty table has no cells and answers nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import vectors
from lodestone.operators import retrieval

MOST_CELLS = 4096
#: Bounds are widened by this much, so that rounding can't hide a row.
SLACK = 1e-9


def _fitted(x: np.ndarray, cells: int, steps: int, seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), min(cells, len(x)), replace=False))]
    for _ in range(steps):
        own = _nearest(x, centres)[0]
        total, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(total, own, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid and its distance from it."""
    own = np.concatenate([np.argmin((centres * centres).sum(1) - 2 * (x[i : i + 4096] @ centres.T), axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)
    return own, np.sqrt(((x - centres[own]) ** 2).sum(1))


def _placed(x: np.ndarray, metric: str) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True) if metric == "cosine" else x


class VectorLayout:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        rows = spark.read.parquet(f"{self.path}/cells").orderBy("cell").collect()
        self.metric = rows[0].metric if rows else "cosine"
        self.cells = [r.cell for r in rows]
        self.centres = np.array([r.centre for r in rows], np.float64) if rows else np.zeros((0, 1))
        self.near, self.far, self.count = (np.array([r[c] for r in rows], np.float64) for c in ("near", "far", "n"))

    @staticmethod
    def build(rows: DataFrame, path: str, metric: str = "cosine", cells: int | None = None, sample: int = 50_000, steps: int = 8, id_col: str = "chunk_id") -> VectorLayout:
        """Writes rows (with `embedding`) by cell; by default about the square root of their number of cells."""
        if metric not in ("cosine", "ip", "l2"):
            raise ValueError(f"unknown distance: {metric}")
        spark, path = rows.sparkSession, path.rstrip("/")
        fine = F.forall("embedding", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
        given = rows.where(F.col("embedding").isNotNull() & fine & (F.exists("embedding", lambda x: x != 0) | F.lit(metric != "cosine")))
        n = given.count()
        wanted = min(MOST_CELLS, cells or max(1, round(n**0.5)))
        some = given if n <= sample else given.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 40)) < int(sample / n * (1 << 40)))
        x = np.array([r.embedding for r in some.select(id_col, "embedding").orderBy(id_col).collect()], np.float64)
        centres = _fitted(_placed(x, metric), wanted, steps) if len(x) else np.zeros((0, 1))
        shared = spark.sparkContext.broadcast(centres)
        kept = given.select(F.struct(id_col, *(c for c in given.columns if c != id_col)).alias("row"), "embedding")

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = np.array(b.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(b.num_rows, -1)
                own, d = _nearest(_placed(v, metric), shared.value)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.astype(np.int32)), pa.array(d)], ["row", "cell", "apart"])

        schema = f"row {kept.schema['row'].dataType.simpleString()}, cell int, apart double"
        laid = kept.mapInArrow(task, schema) if len(x) else spark.createDataFrame([], schema)
        laid.select("row.*", "cell", "apart").repartition("cell").write.partitionBy("cell").parquet(f"{path}/rows")
        found = spark.read.parquet(f"{path}/rows") if len(x) else laid.select("cell", "apart")
        bounds = found.groupBy("cell").agg(F.min("apart").alias("near"), F.max("apart").alias("far"), F.count("*").alias("n")).collect()
        table = [(r.cell, centres[r.cell].tolist(), r.near, r.far, r.n, metric) for r in bounds]
        spark.createDataFrame(table, "cell int, centre array<double>, near double, far double, n long, metric string").coalesce(1).write.parquet(f"{path}/cells")
        return VectorLayout(spark, path)

    def read(self, cells: list[int]) -> DataFrame:
        """The rows of these cells; other folders aren't listed among the files read."""
        return self.spark.read.parquet(f"{self.path}/rows").where(F.col("cell").isin(cells)).drop("cell", "apart")

    def bounds(self, query: list[float]) -> np.ndarray:
        """How small the distance between the query and a row of each cell can be."""
        q = np.array(query, np.float64)
        if self.metric == "ip":
            return 1 - (self.centres @ q + np.linalg.norm(q) * self.far) - SLACK
        q = _placed(q[None], self.metric)
        d = np.sqrt(((self.centres - q) ** 2).sum(1))
        least = np.maximum(0.0, np.maximum(d - self.far, self.near - d))
        return least**2 / (2 if self.metric == "cosine" else 1) - SLACK

    def plan(self, query: list[float], k: int, most_cells: int | None = None) -> list[int]:
        """The cells that a query has to read: those nearest to it that hold k rows, and all whose bound is below the k-th distance there."""
        least = self.bounds(query)
        q = np.array(query, np.float64)
        apart = -(self.centres @ q) if self.metric == "ip" else ((self.centres - _placed(q[None], self.metric)) ** 2).sum(1)
        order = np.argsort(apart, kind="stable")
        held = np.cumsum(self.count[order])
        first = order[: int(np.searchsorted(held, k)) + 1]
        if most_cells is not None:
            return [self.cells[i] for i in order[:most_cells]]
        if len(first) >= len(order):
            return list(self.cells)
        found = retrieval.nearest(self.read([self.cells[i] for i in first]), query, k, self.metric, self._id()).agg(F.max("distance")).first()[0]
        return [c for c, b in zip(self.cells, least, strict=True) if b <= found]

    def _id(self) -> str:
        return self.spark.read.parquet(f"{self.path}/rows").columns[0]

    def nearest(self, query: list[float], k: int, most_cells: int | None = None) -> DataFrame:
        """The k nearest rows with distance and rank, as from a scan of all; ties by the first column."""
        if not self.cells:
            raise ValueError("the layout has no rows")
        return retrieval.nearest(self.read(self.plan(query, k, most_cells)), query, k, self.metric, self._id())

    def recall(self, queries: list[list[float]], k: int, most_cells: int) -> float:
        """The share of the true k nearest that `most_cells` cells give, over some queries."""
        hit = total = 0
        for q in queries:
            true = {r[0] for r in self.nearest(q, k).select(self._id()).collect()}
            hit += len(true & {r[0] for r in self.nearest(q, k, most_cells).select(self._id()).collect()})
            total += len(true)
        return hit / max(1, total)


def bound_holds(layout: VectorLayout, query: list[float]) -> DataFrame:
    """Per cell its bound and the least distance of its rows, to check a layout."""
    rows = layout.spark.read.parquet(f"{layout.path}/rows")
    d = vectors.distance(F.col("embedding"), F.array(*(F.lit(float(x)) for x in query)), layout.metric)
    given = layout.spark.createDataFrame([(c, float(b)) for c, b in zip(layout.cells, layout.bounds(query), strict=True)], "cell int, bound double")
    return rows.groupBy("cell").agg(F.min(d).alias("least")).join(given, "cell")
