"""The pipeline against a brute-force chain; only the learned verdicts and the
contaminated ids come from the operators, which have tests of their own."""

import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from lodestone.llm.decontamination import decontaminate
from lodestone.llm.quality_rules import quality_rules
from lodestone.llm.tokens import Encoder, default_path


def words(t):
    return (t or "").encode().split()


def shingles(t, n=5):
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in words(t)]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def without_copies(rows):
    sets = {k: shingles(t) for k, t in rows}
    ids = sorted(sets)
    least = dict(zip(ids, ids, strict=True))

    def find(k):
        while least[k] != k:
            k = least[k]
        return k

    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                least[y] = x
    return [(k, t) for k, t in rows if find(k) == k]


def without_repeats(rows, n=20):
    first, out = {}, []
    for k, t in sorted(rows):
        w = words(t)
        for i in range(len(w) - n + 1):
            first.setdefault(tuple(w[i : i + n]), (k, i))
    for k, t in rows:
        w, gone = words(t), set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] != (k, i):
                gone.update(range(i, i + n))
        out.append((k, b" ".join(x for i, x in enumerate(w) if i not in gone).decode() if gone else t))
    return out


def test_run_equals_brute_force(spark, sf):
    read = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    verdict = {r.doc_id for r in quality_rules(read("documents"), read("labels")).where("kept").select("doc_id").collect()}
    rows = [(r.doc_id, r.text) for r in read("documents").collect() if r.doc_id in verdict]
    rows = without_repeats(without_copies(rows))
    leaks = {r.doc_id for r in decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), read("benchmark")).collect()}
    want, encode = Counter(), Encoder(default_path()).tokenizer.encode
    for k, t in rows:
        if k not in leaks:
            ids = [*encode(t or "", add_special_tokens=False).ids, 1]
            for s in range(0, len(ids), 2048):
                p = np.array(ids[s : s + 2048], "<u4")
                want[k, s, len(p), zlib.crc32(p.tobytes()), len(ids)] += 1
    got = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want
    assert leaks
    assert len(rows) < len(verdict) < read("documents").count()


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.schema == docs.schema, name
        stage(spark, docs.limit(0), sf).collect()


def test_near_duplicates_keep_one_row(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text), (1, text), (1, text), (None, "a b c d e f g h"), (9, None), (10, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == Counter([(1, text), (None, "a b c d e f g h"), (9, None), (10, "")])
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_near_duplicates_leave_texts_where_they_are(spark, monkeypatch):
    """With few keys that go or repeat no text is shuffled by its key; with many the same rows come."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text), (1, text), (1, text), (None, "a b c d e f g h"), (9, None), (10, ""), (10, ""), (11, text + " z")]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = Counter([(1, text), (None, "a b c d e f g h"), (9, None), (10, "")])
    plans = []
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (1 << 21, 0):
            monkeypatch.setattr(corpus_pipeline, "FEW", most, raising=False)
            out = corpus_pipeline.near_duplicates(spark, docs, "")
            assert Counter((r.doc_id, r.text) for r in out.collect()) == want
            plans.append(out._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "SortMergeJoin" not in plans[0]
    assert "SortMergeJoin" in plans[1]


def test_rows_with_repeated_or_null_ids(spark, sf):
    w = [f"w{i}" for i in range(80)]
    a, near_a, b, near_b, c = " ".join(w[:40]), " ".join([*w[:39], "x"]), " ".join(w[40:]), " ".join([*w[40:79], "y"]), " ".join(f"c{i}" for i in range(40))
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in [(5, a), (5, near_a), (None, b), (None, near_b), (7, b), (4, a + " z"), (4, c), (4, c)]], kind)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    kept_b = b if got[None, b] else near_b
    assert got == Counter([(4, a + " z"), (4, c), (None, kept_b)])
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in [(None, f"so. {item} Yes"), (None, a), (3, f"so. {item} No"), (3, c)]], kind)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.decontamination(spark, docs, sf).collect())
    assert got == Counter([(None, a), (3, c)])
