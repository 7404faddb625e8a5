"""Connected components of an undirected graph, as tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import discard, written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the least node reachable.

    Alternates large-star and small-star steps: each hangs a node's neighbours
    on the least one, so that every component ends as a star around its least
    node after a number of rounds that grows with the logarithm of its
    diameter; without that within `most_rounds` it is an error. Least neighbours
    are partial aggregates; a node with very many edges has them joined with its
    one least neighbour in one task, two numbers an edge, in the first round only:
    then they hang on other nodes. Each round is a written table, and the one
    before it is removed.
    """
    e = written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        before, e = e, written(small.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        discard(before)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.union(stars.select(F.col("label").alias("node"), "label").distinct())
