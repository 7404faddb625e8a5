import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import collocations as M
from lodestone.llm import perfect_hash as P

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, longest, least, top):
    """The same, by counting every phrase."""
    counts = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    counts["und" if lang is None else lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        n = sum(v for k, v in f.items() if len(k) == 1)
        kept = {x: a for x, a in f.items() if len(x) > 1 and a >= least}
        inside = {x[i:j] for x, a in kept.items() for i in range(len(x)) for j in range(i + 2, len(x) + 1) if j - i < len(x) and a >= f[x[i:j]]}
        ranked = []
        for x, a in kept.items():
            if x not in inside:
                score, _, l, r = min((1000 * a * n // (f[x[:k]] * f[x[k:]]), k, f[x[:k]], f[x[k:]]) for k in range(1, len(x)))
                ranked.append((-score, -a, " ".join(x).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


def rows(seed=1, n=400):
    rng = random.Random(seed)
    words = ["of", "The", "new", "york", "city", "étoile", "a b", "x", "Ünder", "Ab", "\xa0", "tab\tbed"]
    fixed = ["new york city hall", "out of the blue", "étoile du nord"]
    out = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randrange(0, 25))]
        text = "".join(p + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!", "\r\n", "\x0b"]) for p in parts)
        out.append((text, rng.choice(["en", "de", "", None])))
    return [*out, (None, "en"), ("", None), (" .,", "fr"), ("only once here", "xx")]


@pytest.mark.parametrize(("longest", "least", "top", "most", "shard"), [(5, 3, 2000, 1 << 22, 1 << 17), (5, 2, 40, 64, 16), (3, 10, 5, 200, 50), (2, 1, 100, 1 << 22, 8)])
def test_equals_counting_every_phrase(spark, monkeypatch, longest, least, top, most, shard):
    monkeypatch.setattr(P.index, "__defaults__", (most, shard))
    given = rows()
    docs = spark.createDataFrame([(t, la, 1, 2) for t, la in given], "text string, lang string, slot int, h int").repartition(3)
    got = sorted(map(tuple, M.collocations(docs, longest=longest, least=least, top=top, most=most).collect()))
    assert got == plain(given, longest, least, top)


@pytest.mark.parametrize("most", [1 << 22, 64])
def test_short_slices_and_pieces_change_nothing(spark, monkeypatch, most):
    monkeypatch.setattr(P.index, "__defaults__", (most, 16))
    monkeypatch.setattr(M, "SLICE", 60, raising=False)
    monkeypatch.setattr(M, "PIECE", 5, raising=False)
    given = rows(seed=2, n=150)
    docs = spark.createDataFrame([(t, la) for t, la in given], "text string, lang string").repartition(3)
    assert sorted(map(tuple, M.collocations(docs, least=3, most=most).collect())) == plain(given, 5, 3, 2000)


def test_rows_of_runs_are_short(spark, monkeypatch):
    """Parquet holds pages of a hundred rows at least, so rows of runs must not grow with the text."""
    sizes, written = [], M.written

    def seen(df, name):
        out = written(df, name)
        if name == "phrase-runs":
            sizes.extend(out.select(F.max(F.octet_length("run"))).first())
        return out

    monkeypatch.setattr(M, "written", seen)
    docs = spark.range(1).select(F.repeat(F.lit("new york, of the city. "), 20_000).alias("text"), F.lit("en").alias("lang"))
    got = {r.phrase: r.a for r in M.collocations(docs).collect()}
    assert got == {"new york": 20_000, "of the city": 20_000}
    assert sizes and max(sizes) < 64_000


def test_large_products_are_exact(spark):
    big = (1 << 40) + 7
    row = spark.range(1).select(F.lit(big).alias("a"), F.lit(big * 9000).alias("n"), F.array(F.lit(big + 2)).alias("firsts"), F.array(F.lit(big + 11)).alias("lasts"))
    got = row.select(M._lowest(F.lit(2)).alias("c")).first().c
    assert got.score == 1000 * big * (big * 9000) // ((big + 2) * (big + 11)) and (got.l, got.r) == (big + 2, big + 11)


def test_empty_tables_and_nothing_frequent(spark):
    docs = spark.createDataFrame([("a b c", "en"), (None, None)], "text string, lang string")
    assert M.collocations(docs).count() == 0
    assert M.collocations(docs.limit(0)).count() == 0
    assert M.collocations(docs, least=1).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    lonely = spark.createDataFrame([("a. a. a. b.", "en")], "text string, lang string")
    assert M.collocations(lonely, least=2).count() == 0


def test_a_phrase_in_a_third_of_the_rows(spark):
    docs = spark.range(600).select(F.when(F.col("id") % 3 == 0, "the same old song again and again").otherwise(F.concat(F.lit("w"), F.col("id") % 7, F.lit(" v"), F.col("id") % 5)).alias("text"), F.lit("en").alias("lang"))
    assert sorted(map(tuple, M.collocations(docs, least=20).collect())) == plain([(r.text, "en") for r in docs.collect()], 5, 20, 2000)


@pytest.mark.parametrize("n", [1, 2, 63, 1000, 20_000])
def test_slots_are_minimal_and_strangers_are_none(n):
    rng = np.random.default_rng(n)
    keys = np.unique(np.concatenate([rng.integers(0, 1 << 62, n), np.arange(n // 2)])).astype(np.uint64)
    tops = P.top(keys) >> (P.SHARD_BITS - 3)
    parts = [(int(s), *P.build(keys[tops == s])) for s in np.unique(tops)]
    slots = P.Slots(parts, 8, base=5)
    assert sorted(slots.of(keys).tolist()) == list(range(5, 5 + len(keys)))
    assert (slots.stored[slots.of(keys) - 5] == keys).all()
    others = np.setdiff1d(rng.integers(0, 1 << 63, 1000).astype(np.uint64), keys)
    assert (slots.of(others) == -1).all()
