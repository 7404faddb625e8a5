import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import fill_in_middle as M

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text, seed=42, rate=50, spm=80):
    """The same, one text at a time."""
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in M.MARKERS) or h[2] % 100 >= rate:
        return n, "plain", None, None, None, text
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(5)
    odd = ["a", "é", " ", "\n", "\t", "\x0b", "<", "P", "S", "M", ">", "<P", "wörd", " ", " ", "𝒳", "\x1f", "\x00", "  "]
    out = ["".join(rng.choices(odd, k=rng.randrange(0, 60))) for _ in range(300)]
    return [*out, None, "", " ", "a", "<P>", "<S", "x <M> y", "<<P>", "< P>", "é" * 50, "wort " * 3000, " " * 400]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i % 17 else None, t) for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[5], rows[-2], rows[-2], (5, "an other text")], "doc_id long, text string")


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 64, 1 << 15])
def test_equals_one_text_at_a_time(docs, chunk):
    got = M.fill_in_middle(docs, chunk=chunk).select("doc_id", "text", "n", "form", "prefix", "middle", "suffix", "output").collect()
    want = [(r.doc_id, r.text, *plain(r.doc_id, r.text)) for r in docs.collect()]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_rates_and_seed(docs):
    for seed, rate, spm in ((1, 100, 0), (2, 100, 100), (3, 0, 50)):
        got = M.fill_in_middle(docs, seed=seed, rate=rate, spm=spm).select("doc_id", "text", "form", "output").collect()
        want = [(r.doc_id, r.text, *[plain(r.doc_id, r.text, seed, rate, spm)[i] for i in (1, 5)]) for r in docs.collect()]
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_texts_are_rebuilt(docs):
    got = M.fill_in_middle(docs, rate=100).select(F.coalesce("text", F.lit("")).alias("t"), M.restored(F.col("output"), F.col("form")).alias("r"), "form").collect()
    assert all(r.t == r.r for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_composition_is_associative_and_finds_entries():
    import numpy as np

    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choices("ab <PSM>\n", k=rng.randrange(2, 60))).encode()
        data = np.frombuffer(text, np.uint8)
        cuts = np.array(sorted({0, len(text), *rng.choices(range(len(text) + 1), k=5)}))
        f = M.functions(data, cuts)
        whole = M.functions(data, np.array([0, len(text)]))
        total = M.scanned(f)
        assert [x[-1].tolist() for x in total] == [x[0].tolist() for x in whole]
        one = lambda i: tuple(x[i : i + 1] for x in f)
        if len(cuts) > 3:
            left = M.compose(M.compose(one(0), one(1)), one(2))
            right = M.compose(one(0), M.compose(one(1), one(2)))
            assert [x.tolist() for x in left] == [x.tolist() for x in right]
        s = M.states(data, np.zeros(1, np.int64), M.START)
        assert [int(M.NEXT[s[-1], data[-1]])] == whole[0][0, :1].tolist()


def test_clashing_names_empty_table_and_hot_copies(spark, docs):
    odd = docs.withColumns({c: F.lit(7) for c in ("n", "form", "k", "i", "r", "row", "h1", "draw", "a", "marks", "p.q")}).withColumn("at", F.array(F.lit(1)))
    got = M.fill_in_middle(odd, chunk=16)
    assert got.columns == [c for c in odd.columns if c not in M.ADDED] + list(M.ADDED)
    assert got.where("k = 7 and i = 7 and r = 7 and row = 7 and draw = 7 and at[0] = 1 and `p.q` = 7").count() == docs.count()
    assert M.fill_in_middle(docs.limit(0)).count() == 0
    hot = spark.range(200).select(F.lit(9).alias("doc_id"), F.lit("same words again " * 50).alias("text"))
    assert M.fill_in_middle(hot, chunk=100).groupBy("n", "output").count().collect()[0]["count"] == 200
