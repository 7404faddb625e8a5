"""Recall and hybrid merge: exact k-NN, supplements, dedupe and ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.functions import vectors

SUPPLEMENTS, BLOCK = 50, 4096


def nearest(index: DataFrame, query: list[float], k: int, metric: str = "cosine", id_col: str = "chunk_id") -> DataFrame:
    """The k nearest rows with distance and rank; ties by id. One scan and a top-k per task."""
    d = vectors.distance(F.col("embedding"), F.array(*(F.lit(float(x)) for x in query)), metric)
    top = index.withColumn("distance", d).orderBy("distance", id_col).limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy("distance", id_col)))


def _packed(rows: DataFrame, id_col: str, vector: str, names: tuple[str, str]) -> DataFrame:
    """Vectors of an Arrow batch as one row: their ids, in order, and their numbers one after another."""
    kind = rows.schema[id_col].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                part = part.take(pc.sort_indices(part.column(0)))
                flat = part.column(1).flatten().cast(pa.float64())
                both = (pa.array([part.column(0).to_pylist()], pa.list_(part.column(0).type)), pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat))
                yield pa.RecordBatch.from_arrays(list(both), list(names))

    return rows.select(id_col, vector).where(F.col(vector).isNotNull()).mapInArrow(task, f"{names[0]} array<{kind}>, {names[1]} array<double>")


def nearest_many(index: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "chunk_id") -> DataFrame:
    """The k nearest of every query (question_id, query), all in one job.

    The stated queries meet all rows in blocks: one matrix product for each pair
    of blocks, of which the k nearest of each query go on. Distances are compared
    to twelve places, ties go to the least id.
    """
    if metric not in ("cosine", "ip", "l2"):
        raise ValueError(f"unknown distance: {metric}")
    kind, asked = index.schema[id_col].dataType.simpleString(), queries.schema["question_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, qids = b.column(0)[i].values, b.column(2)[i].values
                x, q = (np.asarray(b.column(c)[i].values).reshape(len(n), -1) for c, n in ((1, ids), (3, qids)))
                dot = q @ x.T
                if metric == "cosine":
                    d = 1 - dot / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1))
                elif metric == "ip":
                    d = 1 - dot
                else:
                    d = (q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * dot
                near = np.nan_to_num(np.round(d, 12), nan=np.inf)
                last = min(k, near.shape[1]) - 1
                at, flat = np.nonzero(near <= np.partition(near, last, axis=1)[:, last : last + 1])  # ties of the last stay, in order of ids
                order = np.lexsort((flat, near[at, flat], at))
                at, flat = at[order], flat[order]
                place = np.arange(len(at)) - np.searchsorted(at, at)
                at, flat = at[place < k], flat[place < k]
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(at)), ids.take(pa.array(flat)), pa.array(d[at, flat])], ["question_id", id_col, "distance"])

    met = _packed(index, id_col, "embedding", ("ids", "x")).crossJoin(_packed(queries, "question_id", "query", ("qids", "q")))
    part = met.mapInArrow(task, f"question_id {asked}, {id_col} {kind}, distance double")
    rank = F.row_number().over(W.partitionBy("question_id").orderBy(F.round("distance", 12), id_col))
    return part.withColumn("rank", rank).where(F.col("rank") <= k)


def semantic_candidates(hits: DataFrame, candidate: str, metric: str = "cosine") -> DataFrame:
    """Candidates by their best relevance, then best rank, then id."""
    rel = vectors.relevance(F.col("distance"), metric)
    out = hits.groupBy(candidate).agg(F.max(rel).alias("best_relevance"), F.count("*").alias("n_hits"), F.min("rank").alias("best_rank"))
    order = W.orderBy(F.desc("best_relevance"), "best_rank", candidate)
    return out.withColumn("candidate_rank", F.row_number().over(order))


def supplements(stored: DataFrame, hits: DataFrame, has_numbers: bool, limit: int = SUPPLEMENTS) -> DataFrame:
    """Stored chunks outside the semantic hits with exact evidence, best first."""
    gate = F.col("numeric") > 0 if has_numbers else F.col("lexical") > 0
    rest = stored.join(hits.select("chunk_id"), "chunk_id", "left_anti").where(gate)
    return rest.orderBy(F.desc("contextual"), F.desc("numeric"), F.desc("lexical"), F.desc("combined"), F.desc("chunk_id")).limit(limit)


def merge(hits: DataFrame, extra: DataFrame, text_key: Column, most_rank: int = 10000) -> DataFrame:
    """Hits and supplements, one per (candidate, text), ranked from 1."""
    pool = hits.withColumn("is_supplemental", F.lit(False)).unionByName(extra.withColumn("is_supplemental", F.lit(True)).withColumn("raw_rank", F.lit(None).cast("int")), allowMissingColumns=True)
    place = F.coalesce("raw_rank", F.lit(most_rank))
    first = W.partitionBy("candidate_id", text_key).orderBy(F.desc("combined"), "is_supplemental", place, F.desc("chunk_id"))
    kept = pool.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    order = W.orderBy(F.desc("combined"), F.desc("contextual"), F.desc("numeric"), F.desc("lexical"), F.desc("semantic"), place, F.desc("chunk_id"))
    return kept.withColumn("rank", F.row_number().over(order))
