import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import neighbours as M


def plain(rows, every, k):
    """The same over all rows: of each query its k best, by score and id."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    out = {}
    for i in sorted({int(i) for i in ids if i % every == 0}):
        best = {}
        for row in np.flatnonzero(ids == i):
            for j, s in zip(ids.tolist(), (x * x[row]).sum(1).tolist(), strict=True):
                if j != i:
                    best[j] = max(s, best.get(j, -math.inf))
        out[i] = sorted(((s, j) for j, s in best.items()), key=lambda r: (-r[0], r[1]))[:k]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    assert all([a[0] for a in x] == list(range(1, len(x) + 1)) for x in out.values())
    return {q: [(s, j) for _, s, j in x] for q, x in out.items()}


def same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [j for _, j in got[q]] == [j for _, j in want[q]]
        assert all(abs(a - b) < 1e-12 for (a, _), (b, _) in zip(got[q], want[q], strict=True))


def clusters(n, wide, seed=0, scale=0.2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, wide))
    return [(i, (centres[i % 12] * (1 + i % 3) + scale * rng.normal(size=wide)).tolist()) for i in range(n)]


def frame(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)


@pytest.mark.parametrize("wide", [1, 2, 16])
def test_all_leaves_give_the_exact_answer(spark, wide):
    rows = clusters(300, wide)
    same(answers(M.nearest(frame(spark, rows), every=7, k=5, recall=1.0, leaf=8, trees=3, asked=10_000, block=4)), plain(rows, 7, 5))


def test_ties_copies_and_shared_ids(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(240)]
    rows = [(i, v if any(v) else [1.0, 0.0, 0.0]) for i, v in rows]
    rows += [(i, [1.0, 1.0, 0.0]) for i in range(240, 400)] + rows[:30] + [(20, [0.0, 0.0, 2.0]), (40, [1.0, 1.0, 0.0])]
    got = answers(M.nearest(frame(spark, rows), every=20, k=9, recall=1.0, leaf=4, trees=2, asked=10_000, block=8))
    same(got, plain(rows, 20, 9))


def test_vectors_that_take_no_part(spark):
    nan, inf = math.nan, math.inf
    good = [(i, [float(i), 1.0]) for i in range(12)]
    bad = [(20, None), (40, [0.0, 0.0]), (60, [1.0, None]), (80, [nan, 1.0]), (100, [1.0, inf]), (120, [1.0, 2.0, 3.0]), (None, [9.0, 9.0]), (140, [])]
    got = answers(M.nearest(frame(spark, good + bad), every=5, k=20))
    same(got, plain(good, 5, 20))
    assert all(len(x) == 11 for x in got.values())
    assert M.nearest(frame(spark, bad[:5])).count() == 0
    assert M.nearest(frame(spark, good[:0])).count() == 0
    assert M.nearest(frame(spark, [(1, [1.0]), (2, [2.0])]), every=20).count() == 0
    assert M.nearest(frame(spark, [(20, [1.0])])).count() == 0


def test_clashing_columns(spark):
    rows = clusters(80, 3)
    odd = frame(spark, rows).withColumns({c: F.lit(1) for c in ("id", "v", "q", "place", "wide", "score", "rank", "a.b")})
    same(answers(M.nearest(odd, every=5, k=3, recall=1.0)), plain(rows, 5, 3))


@pytest.mark.parametrize("given", ["clusters", "sphere", "table"])
def test_recall_with_few_leaves(spark, sf, given):
    if given == "table":
        rows = [tuple(r) for r in spark.read.parquet(f"{sf.replace('0.001', '0.1')}/embeddings.parquet").select("vec_id", "embedding").collect()]
    elif given == "clusters":
        rows = clusters(4000, 24, scale=1.0)
    else:
        rng = np.random.default_rng(3)
        rows = list(enumerate((x := rng.normal(size=(3000, 12))) / np.linalg.norm(x, axis=1, keepdims=True)))
        rows = [(i, v.tolist()) for i, v in rows]
    got, want = answers(M.nearest(frame(spark, rows), leaf=64, trees=3)), plain(rows, 20, 20)
    hit = sum(len({j for _, j in got[q]} & {j for _, j in want[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    scores = {q: dict((j, s) for s, j in plain(rows, q, len(rows))[q]) for q in list(want)[1:3]}
    assert all(abs(scores[q][j] - s) < 1e-12 for q in scores for s, j in got[q])


def test_the_queue_gives_leaves_in_order_of_cost():
    x = np.random.default_rng(1).normal(size=(400, 5))
    f = M.Forest(x, 3, 4, float(np.linalg.norm(x, axis=1).max()))
    q = np.column_stack([x[:6] / np.linalg.norm(x[:6], axis=1, keepdims=True), np.zeros(6)])
    for row, met in zip(q, f.visits(x[:6], 48), strict=True):
        assert sorted(met) == [(t, i) for t in range(3) for i in range(16)]
        cost = []
        for t, leaf in met:
            node, total = leaf + 15, 0.0
            while node:
                up = (node - 1) // 2
                gap = f.direction[t, up] @ row - f.threshold[t, up]
                total += 0.0 if (gap >= 0) == (node == 2 * up + 2) else gap * gap
                node = up
            cost.append(total)
        assert all(a <= b + 1e-12 for a, b in zip(cost, cost[1:], strict=False))


def test_queries_go_to_branches_and_not_to_each_leaf(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]
    moved = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = moved()
    got, want = answers(M.nearest(frame(spark, rows), every=2, leaf=16)), plain(rows, 100, 20)
    assert len(got) == 3000 and sum(len({j for _, j in got[q]} & {j for _, j in want[q]}) for q in want) >= 0.9 * 20 * len(want)
    assert moved() - before < 40_000_000
