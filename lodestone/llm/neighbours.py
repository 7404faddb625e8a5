"""Nearest neighbours by inner product, from a forest of random-projection trees.

Trees are fitted on a bounded sample of the vectors: a node's direction is the
difference of two sampled vectors below it, its threshold the median of the
sample's projections. Every vector has a leaf in each tree. A query meets the
leaves of all trees in the order of one priority queue, least sum of squared
distances to the thresholds crossed first, until `leaves` leaves have been met.
Their vectors are reranked by their exact inner products in double precision.

`leaves` is measured, not guessed: for a bounded sample of queries the true
neighbours are found among all vectors, in blocks, and it becomes the least
number with which at least `recall` of these are met. Longer vectors would win
by length alone, so trees see each vector with one coordinate more, which makes
all of one length (this changes no order of inner products).

How it is spread: branches of at most about 4 * `block` vectors are dealt out
over tasks, each with the branch's vectors in order of their leaves. A query
goes once to each branch in which it meets a leaf, with one bit for each leaf
of it; leaf by leaf, the vectors are multiplied with the queries that meet it.
A query's k + 1st best among the seeds it meets (seeds: a sixteenth of the
vectors, as far as SEED_BYTES go) is a bound that its answer can't fall below,
so only vectors that reach it leave the task. Of equal vectors only the first
k + 1 ids can be an answer, so no others are indexed, and equal queries are
searched once. Leaves of more than about `block` vectors are split and asked in
parts.

Bounds: the sample is at most about `fit` vectors, so the broadcast forest has
at most trees * fit / LEAF_SAMPLE directions; `asked` bounds the sampled queries.
Where vectors have no clusters a query meets a fixed share of all of them, so
the products grow with queries times vectors, in tasks of bounded size.

Equality of the 64-bit hash of a query's vector stands for its equality.

Edge cases: vectors that are null or zero or have null or non-finite components
take no part, nor do those without an id, or of another length than most (ties:
the longer). Rows that share an id are one item with several vectors; its
score is the best of any pair. An empty table gives no rows; with fewer
candidates than k all are returned; equal scores are ordered by id; other
columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import col, written

LEAF_SAMPLE = 16
PACK = "tree int, branch int, part int, asks boolean, ids binary, vectors binary, leaves binary, least binary"
BEST = "q long, v long, score double"
HELD = 1 << 19
#: Units of work there are at least, where trees are deep enough; bytes of the seeds at most; scores held at once.
LEAST_BRANCHES, SEED_BYTES, SCORES = 16, 1 << 26, 1 << 21


class Forest:
    """Complete binary trees; node i has the children 2 i + 1 and 2 i + 2, leaves are counted from the left."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, longest: float, seed: int = 7):
        self.trees, self.depth, self.longest = trees, depth, longest
        rng = np.random.default_rng(seed)
        nodes, wide = (1 << depth) - 1, sample.shape[1] + 1
        self.direction = np.zeros((trees, nodes, wide))
        self.threshold = np.zeros((trees, nodes))
        x = self.lifted(sample)
        for t in range(trees):
            below = [np.arange(len(x))]
            for i in range(nodes):
                rows = below[i]
                if len(rows) > 1:
                    a, b = x[rng.choice(rows, 2, replace=False)]
                    d = a - b
                    d = d / np.linalg.norm(d) if np.any(d) else rng.normal(size=wide)
                    p = x[rows] @ d
                    self.direction[t, i], self.threshold[t, i] = d, np.median(p)
                    right = p >= self.threshold[t, i]
                    below += [rows[~right], rows[right]]
                else:
                    below += [rows, rows[:0]]

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Vectors with a coordinate that brings all to the longest one's length, scaled to one."""
        y = x / self.longest
        return np.column_stack([y, np.sqrt(np.maximum(0.0, 1.0 - (y * y).sum(1)))])

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        x = self.lifted(x)
        out = np.zeros((len(x), self.trees), np.int64)
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                p = np.einsum("ij,ij->i", x, self.direction[t, node])
                node = 2 * node + 1 + (p >= self.threshold[t, node])
            out[:, t] = node - ((1 << self.depth) - 1)
        return out

    def costs(self, x: np.ndarray) -> np.ndarray:
        """Of each query, what each leaf of each tree costs: the squared distances to all thresholds crossed."""
        q = np.column_stack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))])
        out = np.zeros((len(q), self.trees, 1))
        if not self.depth:
            return out
        margin = (q @ self.direction.reshape(-1, q.shape[1]).T).reshape(len(q), self.trees, -1) - self.threshold
        for level in range(self.depth):
            gap = margin[:, :, (1 << level) - 1 : (2 << level) - 1]
            cost, near = gap * gap, gap >= 0
            out = np.stack([out + cost * near, out + cost * ~near], axis=-1).reshape(len(q), self.trees, -1)
        return out

    def visits(self, x: np.ndarray, leaves: int) -> Iterator[list[tuple[int, int]]]:
        """Of each query, the (tree, leaf)s in the order in which the shared queue gives them."""
        for at in range(0, len(x), 256):
            cost = self.costs(x[at : at + 256])
            order = np.argsort(cost.reshape(len(cost), -1), axis=1, kind="stable")[:, :leaves]
            for row in order.tolist():
                yield [(i >> self.depth, i & ((1 << self.depth) - 1)) for i in row]

    def met(self, x: np.ndarray, leaves: int) -> np.ndarray:
        """Of each query, whether a leaf of a tree is among the first `leaves` (with all that cost as much as the last)."""
        cost = self.costs(x)
        flat = cost.reshape(len(x), -1)
        leaves = min(leaves, flat.shape[1])
        return cost <= np.partition(flat, leaves - 1, axis=1)[:, leaves - 1, None, None]


def _matrix(column: pa.Array, wide: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, wide)


def _best(q: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, each candidate once."""
    order = np.lexsort((-s, v, q))
    q, v, s = q[order], v[order], s[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1])
    q, v, s = q[new], v[new], s[new]
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    first = np.ones(len(q), bool)
    first[1:] = q[1:] != q[:-1]
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return q[rank < k], v[rank < k], s[rank < k]


class _Kept:
    """The best of what was offered, folded now and then."""

    def __init__(self, k: int, ids: np.ndarray | None = None, asks: np.ndarray | None = None, least: np.ndarray | None = None):
        """ids, asks and least: of the queries that `reach` is called for, the least score that counts."""
        self.k, self.parts, self.size, self.room = k, [], 0, HELD
        self.ids, self.asks, self.least = ids, asks, None if least is None else least.copy()

    def reach(self, rows: np.ndarray, vids: np.ndarray, vectors: np.ndarray) -> None:
        """Vectors for some of the queries, by their places: what is as near as the least or nearer."""
        step, long = max(1, SCORES // len(vids)), np.sqrt((vectors * vectors).sum(1).max())
        for at in range(0, len(rows), step):
            r = rows[at : at + step]
            asks, least = self.asks[r], self.least[r]
            room = 1e-9 * (1 + np.abs(least)) + 1e-12 * long * np.linalg.norm(asks, axis=1)
            i, j = np.nonzero(asks @ vectors.T >= (least - room)[:, None])
            if len(i):
                self.parts.append((self.ids[r[i]], vids[j], (asks[i] * vectors[j]).sum(1)))
                self.size += len(i)
            if self.size > self.room:
                self.fold()
                self.room = max(HELD, 2 * self.size)
                q, _, s = self.parts[0]
                order = np.argsort(self.ids)
                full, last = np.unique(q, return_index=True)[0], np.flatnonzero(np.append(q[1:] != q[:-1], True))
                whole = np.diff(np.append(-1, last)) == self.k
                place = order[np.searchsorted(self.ids, full[whole], sorter=order)]
                self.least[place] = np.maximum(self.least[place], s[last[whole]])

    def offer(self, ids: np.ndarray, asks: np.ndarray, vids: np.ndarray, vectors: np.ndarray) -> None:
        for at in range(0, len(ids), 512):
            score = asks[at : at + 512] @ vectors.T
            keep = min(self.k + 4, score.shape[1])
            top = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
            # equal scores at the edge: all of them stay candidates
            edge = np.take_along_axis(score, top, 1).min(1, keepdims=True)
            i, j = np.nonzero(score >= edge - 1e-9 * (1 + np.abs(edge)))
            s = (asks[at : at + 512][i] * vectors[j]).sum(1)
            self.parts.append(_best(ids[at : at + 512][i], vids[j], s, self.k))
            self.size += len(self.parts[-1][0])
            if self.size > HELD:
                self.fold()

    def fold(self) -> None:
        self.parts = [_best(*(np.concatenate([p[i] for p in self.parts]) for i in range(3)), self.k)]
        self.size = len(self.parts[0][0])

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self.fold()
            q, v, s = self.parts[0]
            for at in range(0, len(q), 1 << 17):
                yield pa.RecordBatch.from_pydict({"q": q[at : at + (1 << 17)], "v": v[at : at + (1 << 17)], "score": s[at : at + (1 << 17)]})


def _usable(v: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.forall(v, lambda x: F.coalesce(fine(x), F.lit(False))) & F.exists(v, lambda x: x != 0)


def _sampled(rows: DataFrame, n: int, most: int) -> DataFrame:
    """About `most` of n rows, chosen by a hash of id and vector; all, if there are no more."""
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64("v", "id"), F.lit(1 << 40)) < int(most / n * (1 << 40)))


def _ranked(best: DataFrame, k: int) -> DataFrame:
    """Of each q the k best v, each once."""
    once = best.groupBy("q", "v").agg(F.max("score").alias("score"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "v"))).where(F.col("place") <= k)


def _leaves(forest: Forest, rows: DataFrame, asked: DataFrame, wide: int, k: int, recall: float) -> int:
    """The least number of leaves with which `recall` of the sampled queries' true neighbours are met."""
    spark = rows.sparkSession
    sample = asked.select("q", "id", "v").orderBy("q").collect()
    numbers, q = np.array([r.q for r in sample], np.int64), np.array([r.v for r in sample], np.float64).reshape(-1, wide)
    given = spark.sparkContext.broadcast((numbers, q))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Kept(k + 1)
        for b in batches:
            kept.offer(*given.value, np.asarray(b.column(0)), _matrix(b.column(1), wide))
        yield from kept.rows()

    true = _ranked(rows.select("id", "v").mapInArrow(exact, BEST), k + 1).select("q", F.col("v").alias("id"))
    own = {r.q: r.id for r in sample}
    met = [r for r in true.join(rows, "id").select("q", "id", "v").collect() if r.id != own[r.q]]
    whole = forest.trees << forest.depth
    if not met:
        return whole
    order = {i: {x: n for n, x in enumerate(m, 1)} for i, m in zip(numbers.tolist(), forest.visits(q, whole), strict=True)}
    at = forest.leaf(np.array([r.v for r in met], np.float64).reshape(-1, wide)).tolist()
    need = sorted(min(order[r.q][t, leaf] for t, leaf in enumerate(own)) for r, own in zip(met, at, strict=True))
    return need[min(len(need) - 1, int(np.ceil(recall * len(need))))]


def _seeds(base: DataFrame, n: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """A sixteenth of the vectors, as far as the bytes go: ids, each once, and vectors."""
    rows = _sampled(base, n, min(n // 16, SEED_BYTES // (8 * wide))).select("id", "v").toArrow().combine_chunks().to_batches()
    if not rows:
        return np.empty(0, np.int64), np.empty((0, wide))
    ids, first = np.unique(np.asarray(rows[0].column(0)).astype(np.int64), return_index=True)
    return ids, _matrix(rows[0].column(1), wide)[first]


def _least(q: np.ndarray, met: np.ndarray, seeds: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Each query's kth best score among the seeds in leaves that it meets; own: the leaf of each seed in each tree."""
    out = np.full(len(q), -np.inf)
    step = max(1, SCORES // max(1, len(seeds)))
    for at in range(0, len(q) if len(seeds) >= k else 0, step):
        some = met[at : at + step]
        here = np.zeros((len(some), len(seeds)), bool)
        for t in range(some.shape[1]):
            here |= some[:, t].take(own[:, t], axis=1)
        score = np.where(here, q[at : at + step] @ seeds.T, -np.inf)
        out[at : at + step] = np.partition(score, len(seeds) - k, axis=1)[:, len(seeds) - k]
    return out


def _pack(tree: int, branch: np.ndarray, part: int, asks: bool, *columns: list[bytes]) -> pa.RecordBatch:
    """Rows of a tree, one for each of the branches."""
    n, heads = len(branch), (np.int32(tree), None, np.int32(part))
    first = [pa.array(branch.astype(np.int32) if h is None else np.full(n, h)) for h in heads]
    return pa.RecordBatch.from_arrays([*first, pa.array([asks] * n, pa.bool_()), *(pa.array(c, pa.binary()) for c in columns)], names=["tree", "branch", "part", "asks", "ids", "vectors", "leaves", "least"])


def nearest(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = 20, recall: float = 0.94, trees: int = 4, leaf: int = 512, fit: int = 20_000, asked: int = 200, block: int = 1 << 14) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of each row whose id is divisible by `every`."""
    spark = rows.sparkSession
    single = dict(rows.dtypes)[vec_col] == "array<float>"
    given = rows.select(col(id_col).cast("long").alias("id"), col(vec_col).cast("array<float>" if single else "array<double>").alias("v")).where(F.col("id").isNotNull() & _usable(F.col("v")))
    lengths = given.groupBy(F.size("v").alias("wide")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("wide")).first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    wide = lengths.wide
    given = given.where(F.size("v") == wide)
    firsts = Window.partitionBy("v").orderBy("id")
    base = written(given.withColumn("place", F.row_number().over(firsts)).where(F.col("place") <= k + 1).select("id", "v"), "vectors")
    queries = written(given.where(F.col("id") % every == 0).select("id", "v"), "vector-queries")
    one = written(queries.groupBy("v").agg(F.min("id").alias("id")).select(F.xxhash64("v").alias("q"), "id", "v"), "vector-questions")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    n, longest = base.agg(F.count("*"), F.max(length)).first()
    m = one.count()
    if not m:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = np.array([r.v for r in _sampled(base, n, fit).orderBy("id", "v").collect()], np.float64).reshape(-1, wide)
    depth = int(max(0, np.floor(np.log2(max(1.0, min(n / leaf, len(sample) / LEAF_SAMPLE))))))
    forest = Forest(sample, trees if depth else 1, depth, longest)
    leaves = _leaves(forest, base, _sampled(one, m, asked), wide, k, recall)
    parts = max(1, -(-n // (block << depth)))
    # branches start at level `top`, with `below` levels in each
    top = min(depth, max(int(np.ceil(np.log2(LEAST_BRANCHES))), int(np.ceil(np.log2(max(1.0, n / (4 * block)))))))
    below = depth - top
    kind, most = "<f4" if single else "<f8", k + 1
    seeds = _seeds(base, n, wide)[1]
    shared = spark.sparkContext.broadcast((forest, seeds, forest.leaf(seeds)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value[0]
        for b in batches:
            ids, x = np.asarray(b.column(0)).astype("<i8"), _matrix(b.column(1), wide)
            at, part = own.leaf(x), ids % parts
            for t in range(own.trees):
                for p in np.unique(part):
                    rows = np.flatnonzero(part == p)
                    rows = rows[np.argsort(at[rows, t], kind="stable")]
                    leaf = at[rows, t].astype("<i4")
                    branch, first = np.unique(leaf >> below, return_index=True)
                    spans = list(zip(first.tolist(), [*first[1:].tolist(), len(rows)], strict=True))
                    yield _pack(t, branch, int(p), False, *([c[i:j].tobytes() for i, j in spans] for c in (ids[rows], x[rows].astype(kind), leaf)), [b""] * len(spans))

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seeds, seeds_at = shared.value
        step = max(1, min(4096, (1 << 22) // (own.trees << depth)))
        for b in batches:
            for some in range(0, b.num_rows, step):
                c = b.slice(some, step)
                ids, x = np.asarray(c.column(0)).astype("<i8"), _matrix(c.column(1), wide)
                met = own.met(x, leaves)
                least = _least(x, met, seeds, seeds_at, most) - 1e-12 * own.longest * np.linalg.norm(x, axis=1)
                inside = met.reshape(len(x), own.trees, 1 << top, 1 << below)
                for t in range(own.trees):
                    branch = np.flatnonzero(inside[:, t].any((0, 2)))
                    rows = [np.flatnonzero(inside[:, t, i].any(1)) for i in branch]
                    columns = [[ids[r].tobytes() for r in rows], [x[r].astype(kind).tobytes() for r in rows], [np.packbits(inside[r, t, i], axis=1).tobytes() for r, i in zip(rows, branch, strict=True)], [least[r].astype("<f8").tobytes() for r in rows]]
                    for p in range(parts):
                        yield _pack(t, branch, p, True, *columns)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for b in batches:
            for tree, branch, part, asks, i, v, at, least in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (tree, branch, part) != key:
                    key, held = (tree, branch, part), []
                i, v = np.frombuffer(i, "<i8"), np.frombuffer(v, kind).reshape(-1, wide)
                if not asks:
                    held.append((i, v, np.frombuffer(at, "<i4") & ((1 << below) - 1)))
                elif held:
                    if len(held) > 1:
                        ids, x, leaf = (np.concatenate(c) for c in zip(*held, strict=True))
                        order = np.argsort(leaf, kind="stable")
                        held = [(ids[order], x[order], leaf[order])]
                    ids, x, leaf = held[0]
                    cut = np.searchsorted(leaf, np.arange((1 << below) + 1)).tolist()
                    met = np.unpackbits(np.frombuffer(at, np.uint8).reshape(len(i), -1), axis=1, count=1 << below).astype(bool)
                    kept = _Kept(most, i, v.astype(np.float64), np.frombuffer(least, "<f8"))
                    for n, (start, end) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                        if start < end:
                            kept.reach(np.flatnonzero(met[:, n]), ids[start:end], x[start:end].astype(np.float64))
                    yield from kept.rows()

    packs = base.mapInArrow(placed, PACK).unionByName(one.select("q", "v").repartition("q").mapInArrow(asking, PACK))
    units = min((forest.trees << top) * parts, 2000)
    found = packs.repartition(units, "tree", "branch", "part").sortWithinPartitions("tree", "branch", "part", "asks").mapInArrow(search, BEST).repartition("q")
    best = _ranked(found, k + 1).groupBy("q").agg(F.collect_list(F.struct("v", "score")).alias("best"))
    own = queries.select("id", F.xxhash64("v").alias("q")).join(best, "q").select("id", F.explode("best").alias("x")).where("x.v <> id")
    answer = own.select(F.col("id").alias("q"), "x.v", "x.score")
    return _ranked(answer, k).select(F.col("q").alias("query_id"), F.col("place").cast("int").alias("rank"), F.col("v").alias("vec_id"), "score")
