"""The training-data operators against brute force, on fixtures with nulls,
empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import coder, kernels, sketch
from lodestone.llm import decontamination as DC
from lodestone.llm import html_text as H
from lodestone.llm import language_model as LM
from lodestone.llm.components import components
from lodestone.llm.decontamination import decontaminate
from lodestone.llm.language_model import score
from lodestone.llm.ngram_join import ngram_join
from lodestone.llm.packing import best_fit, pack
from lodestone.llm.quality_rules import Rule, fit, quality_rules, statistics
from lodestone.llm.quality_rules import Test as Threshold
from lodestone.llm.sharding import shard
from lodestone.llm.substring_dedup import substring_dedup
from lodestone.llm.token_files import read_ids, write_ids
from lodestone.llm.token_rollup import TokenRollup, changes, token_counts
from lodestone.llm.tokens import Encoder, default_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, 5000, n)]


def fixture_rows():
    base = words(120, 1)
    near = [*base[:60], "changed", *base[61:]]
    far = [*base[:30], *words(90, 2)]
    rows = [
        (5, " ".join(base)), (3, " ".join(base)), (9, " ".join(near)), (11, " ".join(far)), (12, None), (13, ""), (14, "one two"),
        (15, "One  two\n"), (16, "tick tock " * 30), (17, "É" * 40 + " x y \x0b z"), (18, " ".join(words(3000, 3))),
        (19, "head " + " ".join(base[40:80]) + " tail"), (20, " \t\n"), (None, "no id at all " * 12), (14, "one two"),
    ]
    return [(k, t, "en", f"s{i % 3}", len(t or "")) for i, (k, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(t):
    return (t or "").encode().split()


# --- kernels and sketch ---


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n\x0b\x0c\ré  ", max_size=30), max_size=8))
def test_words_equal_split(texts):
    w = kernels.Words(*kernels.buffers(pa.array(texts, pa.string())))
    got = [[w.data[w.start[j] : w.end[j]].tobytes() for j in range(w.first[i], w.first[i + 1])] for i in range(len(texts))]
    assert got == [t.encode().split() for t in texts]
    h = w.hashes()
    flat = [x for t in got for x in t]
    assert len({*zip(flat, h.tolist(), strict=True)}) == len(set(flat)) == len(set(h.tolist()))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=50, unique=True))
def test_pack_round_trip(cells):
    c = np.array(sorted(cells), np.int64) * 97
    assert sketch.unpack(sketch.pack(c)).tolist() == c.tolist()


def test_sketch_never_misses_a_repeat(spark):
    rows = [(f"k{i % 700}",) for i in range(1000)] + [(f"u{i}",) for i in range(500)]
    df = spark.createDataFrame(rows, "text string").repartition(5)

    def hashes(batches):
        for b in batches:
            yield kernels.Words(*kernels.buffers(b.column(0))).hashes()

    for bits, depth in ((16, 2), (8, 1)):
        seen = sketch.repeats(df, hashes, bits, depth)
        h = kernels.Words(*kernels.buffers(pa.array([f"k{i}" for i in range(300)]))).hashes()
        assert seen.maybe(h).all()
        if bits == 16:
            once = kernels.Words(*kernels.buffers(pa.array([f"u{i}" for i in range(500)]))).hashes()
            assert seen.maybe(once).mean() < 0.1


# --- 1 substring dedup ---


def brute_dedup(rows, n=20, order=lambda t: 0):
    """order: of rows that share an id; rows that agree in it are one document."""
    first = {}
    for k, t in rows:
        w = split(t)
        for i in range(len(w) - n + 1):
            place = (k if k is not None else -(1 << 63), order(t), i)
            first[tuple(w[i : i + n])] = min(place, first.get(tuple(w[i : i + n]), place))
    out = []
    for k, t in rows:
        w, kk = split(t), k if k is not None else -(1 << 63)
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < (kk, order(t), i):
                gone.update(range(i, i + n))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_substring_dedup(docs):
    clash = docs.withColumn("kept_text", F.lit("mine")).withColumn("k", F.lit(1)).withColumn("firsts", F.lit(2))
    out = substring_dedup(clash)
    assert set(out.columns) == {*docs.columns, "k", "firsts", "n_words", "n_removed", "kept_text"}
    got = Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in out.collect())
    want = brute_dedup([(r[0], r[1]) for r in fixture_rows()])
    assert got == want
    assert sum(x[2] for x in want) > 150


def test_substring_dedup_of_rows_that_share_an_id(spark):
    """Thousands of rows without an id, each text twice, and some other ids: time and memory stay in proportion."""
    texts = [" ".join(words(60, i) + words(25, i % 7)) for i in range(2500)]
    rows = [(None, t) for t in texts] * 2 + [(i % 3, " ".join(words(30, 10_000 + i) + words(25, i % 7))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    hashes = {r.text: r.h for r in df.selectExpr("text", "shiftrightunsigned(xxhash64(text), 24) AS h").distinct().collect()}
    got = Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substring_dedup(df).collect())
    assert got == brute_dedup(rows, order=hashes.__getitem__)


def test_substring_dedup_empty(empty):
    assert substring_dedup(empty).count() == 0


# --- 2 quality rules ---


def brute_statistics(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def test_statistics(spark, docs):
    more = spark.createDataFrame([(30, "a b c a b c\na b\na b\n\n #*$ %&|<>", "", "", 0), (31, "x x x x", "", "", 0), (32, "x y", "", "", 0)], SCHEMA)
    rows = docs.union(more)
    out = statistics(rows).where("n_words >= 0").collect()
    assert len(out) == 18
    text = {r.doc_id: r.text for r in rows.collect()}
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_statistics(text[r.doc_id]), r.doc_id


def test_decision_list_learns_a_conjunction():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    bad = (x["a"] > 0.7) & (x["b"] <= 0.4)
    rules = fit(x, bad, rng.random(3000) < 0.67)
    got = np.zeros(3000, bool)
    for r in rules:
        hit = np.ones(3000, bool)
        for t in r.tests:
            hit &= t.holds(x)
        got |= hit
    assert (got & bad).sum() / bad.sum() > 0.9
    assert (got & ~bad).sum() / max(1, got.sum()) < 0.05


def test_quality_rules_held_out(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = labels.where("pmod(xxhash64(doc_id, 7), 4) = 0")
    out = quality_rules(docs.select("doc_id", "text"), labels.join(held.select("doc_id"), "doc_id", "left_anti"))
    c = out.join(held, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.avg(F.col("base_failed").cast("int")).alias("failed")).collect()
    rate = {r.quality: r for r in c}
    assert rate[0].kept < 0.1
    assert rate[1].kept > 0.99 - rate[1].failed


def test_verdict_equals_the_list_in_plain_python(docs):
    """Both kinds of rules, in order; labels don't matter where rules are given."""
    listed = [
        Rule((Threshold("words", True, 100.0), Threshold("mean_word", True, 4.5)), 1.0, 1, True), Rule((Threshold("words", True, 100.0),), 1.0, 1), Rule((Threshold("mark_rate", True, 0.5),), 1.0, 1, True),
        Rule((Threshold("repeat_rate", False, 0.1), Threshold("upper_rate", False, 0.9)), 1.0, 1), Rule((Threshold("dup_line_rate", True, 0.2),), 1.0, 1), Rule((Threshold("line_words", True, 3.0),), 1.0, 1),
    ]
    clash = docs.withColumn("kept", F.lit("x")).withColumn("n_words", F.lit("y"))
    out = quality_rules(clash, None, rules=listed).collect()
    assert len(out) == len(fixture_rows())
    seen = Counter()
    for r in out:
        words_, chars, symbols, dups, repeats = brute_statistics(r.text)
        t = r.text or ""
        lines = len([x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
        rate = lambda a, b: a / b if b else 0.0
        x = {"words": words_, "mean_word": rate(chars, words_), "symbol_rate": rate(symbols, words_), "dup_line_rate": rate(dups, lines), "repeat_rate": rate(repeats, words_), "upper_rate": rate(sum("A" <= c <= "Z" for c in t), chars), "mark_rate": rate(sum(c in "!?" for c in t), words_), "line_words": rate(words_, lines)}
        x = {k: np.array([float(v)]) for k, v in x.items()}
        first = next((k for k in listed if all(u.holds(x)[0] for u in k.tests)), None)
        assert r.base_failed == (words_ < 50 or 100 * repeats > 50 * words_)
        assert r.kept == (not r.base_failed and (first is None or first.keeps)), r.doc_id
        seen[first] += 1
    assert len(seen) > 2


def test_exceptions_come_before_their_rule():
    rng = np.random.default_rng(1)
    x = {"a": rng.integers(0, 2, 6000).astype(float), "b": rng.integers(0, 20, 6000).astype(float)}
    bad = (x["a"] == 1) & (x["b"] < 19)
    rules = fit(x, bad, rng.random(6000) < 0.67, longest=1)
    assert [r.keeps for r in rules[:2]] == [True, False]
    first = np.full(6000, -1)
    for i, r in reversed(list(enumerate(rules))):
        first[np.all([t.holds(x) for t in r.tests], axis=0)] = i
    rejected = np.array([i >= 0 and not rules[i].keeps for i in first])
    assert (rejected == bad).all()


def test_several_labels_of_one_id(spark, docs):
    many = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert quality_rules(docs.select("doc_id", "text"), many).count() == len(fixture_rows())


def test_quality_rules_without_labels(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality_rules(docs.select("doc_id", "text"), none).collect()
    assert all(r.kept != r.base_failed for r in rows)
    assert quality_rules(empty, none).count() == 0


# --- 3 sharding ---


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_shards(spark, law):
    rows = [(i, "same text") for i in range(300)] + [(i, f"t{i} " * (i % 40)) for i in range(300, 900)] + [(None, None), (None, None), (7, "same text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("x")).repartition(5)
    out = shard(df, 10, law, ranges=20).collect()
    assert len(out) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in rows)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    weight = [sum(r.size if law == "bytes" else 1 for r in by[s]) for s in range(10)]
    most = max(r.size for r in out) if law == "bytes" else 1
    assert max(weight) - min(weight) <= 2 * most if law == "bytes" else max(weight) - min(weight) <= 1


def test_shards_empty(empty):
    assert shard(empty).count() == 0


# --- 4 decontamination ---


def test_decontamination(spark):
    item = "If Alice Smith buys 12 apples for 3 dollars each and sells 12 apples to Bob, how much money does Alice Smith make in total?"
    bench = spark.createDataFrame([(1, item), (1, item), (2, "a short item here now"), (3, None), (None, "x y z a b c d e f")], "item_id long, text string")
    rows = [
        (10, "Well. If Maria buys 47 apples for 9 dollars each and sells 47 apples to Tom Jones, how much money does Maria make in total? Yes"),
        (11, "If Maria buys 47 apples for 9 dollars each and sells 48 apples to Maria, how much money does Maria make in total?"),
        (12, "it is a short item here now"), (13, None), (14, ""), (None, item), (15, "so " + item + " ok"), (16, "Nothing of the kind, with 12 apples for 3 dollars each."),
        (17, "x y z a b c d e f"), (15, "so " + item + " ok"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item", F.lit(1)).withColumn("h", F.lit(2))
    got = {(r.doc_id, r.item_id): r.exact for r in decontaminate(docs, bench).collect()}
    assert got == {(10, 1): False, (15, 1): True, (12, 2): True}
    assert decontaminate(docs, bench.limit(0)).count() == 0
    assert decontaminate(docs.limit(0), bench).count() == 0


def test_decontamination_inside_running_text(spark):
    items = [(1, "What gas do plants take from the air by day?"), (2, "Alice Smith sells her old bike to the man from the north"), (3, "Which old river runs through the town of Paris")]
    rows = []
    for k, t in items:
        rows += [(10 * k, f"lorem ipsum. {t} dolor"), (10 * k + 1, f"lorem ipsum dolor {t} dolor"), (10 * k + 2, f"lorem, ipsum Dolor {t} Sit amet"), (10 * k + 3, f"lorem {t[:-9]} dolor")]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.exact for r in decontaminate(docs, bench).collect()}
    assert got == {(10 * k + i, k): True for k in (1, 2, 3) for i in (0, 1, 2)}


def test_decontamination_of_items_with_few_words(spark):
    items = [(1, "Calculate 12 + 7 - 3 + 9 - 4 + 8."), (2, "Take 3 apples, 4 pears, 5 plums, 6 figs and then add 7."), (3, "Define osmosis."), (4, "2 + 2"), (5, "..."), (6, "7 km")]
    rows = [
        (10, "So: calculate 12 + 7 - 3 + 9 - 4 + 8. Good"), (11, "please Calculate 12 + 7 - 3 + 9 - 4 + 8"), (12, "calculate 12 + 7 - 3 + 9 - 4 + 9"),
        (20, "Now. Take 13 apples, 14 pears, 15 plums, 16 figs and then add 17. Done"), (21, "now Take 3 apples, 4 pears, 5 plums, 6 figs and then add 7"), (22, "Take 3 apples, 3 pears, 5 plums, 6 figs and then add 7."), (23, "take 3 apples, 4 pears, 5 plums, 6 figs"),
        (30, "one should Define osmosis. Now"), (31, "define the osmosis"), (40, "is 2 + 2 four"), (41, "is 2 + 3 four or 2.2"), (60, "it is 7 km away"), (61, "it is 2.7 km away"),
    ]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.exact for r in decontaminate(docs, bench).collect()}
    assert got == {(10, 1): True, (11, 1): True, (20, 2): False, (21, 2): True, (30, 3): True, (40, 4): True, (60, 6): True}


def _questions(rng, n):
    """Questions with slots for numbers, units and names, and the same with other values."""
    names = ["Alice", "Bob", "Carla", "Dmitri", "Elena", "Farid", "Grace", "Hugo", "Ines", "Jonas", "Karim", "Lena"]
    units = ["km", "kg", "hours", "dollars", "miles", "minutes", "litres", "percent"]
    plain = [f"w{i}ord" for i in range(400)]
    for k in range(n):
        body, slots = [], 0
        for i in range(int(rng.integers(14, 40))):
            r = rng.random()
            if i and r < 0.12:
                body.append(("n", slots))
                slots += 1
            elif i and r < 0.2:
                body.append(("u", slots))
                slots += 1
            elif i and r < 0.28 and body[-1][0] == "w":
                body.append(("a", slots))
                slots += 1
            else:
                body.append(("w", plain[rng.integers(len(plain))]))
        def fill(body=body, slots=slots):
            number, name = rng.permutation(900)[: slots + 1] + 2, rng.permutation(names)
            return " ".join(str(x) if kind == "w" else str(number[x]) if kind == "n" else f"{number[x]} {units[x % 8]}" if kind == "u" else name[x % 12] for kind, x in body)
        first = fill()
        yield first[0].upper() + first[1:], fill(), slots


def test_decontamination_recall_of_questions_with_other_values(spark):
    """Numbers, amounts with units and names replaced: nine of ten are found, clean texts aren't."""
    rng = np.random.default_rng(11)
    made = list(_questions(rng, 200))
    bench = spark.createDataFrame([(i, a) for i, (a, _, _) in enumerate(made)], "item_id long, text string")
    filler = lambda: " ".join(f"f{x}" for x in rng.integers(0, 3000, 30))
    rows = [(i, f"{filler()}. {b}. {filler()}") for i, (_, b, _) in enumerate(made)] + [(1000 + i, f"{filler()} {rng.integers(99)} km {filler()}") for i in range(200)]
    rows += [(None, made[0][1]), (5000, ""), (5001, None), (5002, filler() * 3000 + ". " + made[7][1] + "."), (5002, filler())]
    got = {(r.doc_id, r.item_id) for r in decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    found = sum((i, i) in got for i in range(200))
    assert found >= 180, found
    assert not {d for d, _ in got if 1000 <= d < 5000}
    assert (5002, 7) in got
    assert sum(s > 0 for _, _, s in made) > 150


def test_decontamination_equals_brute_force(spark):
    """Windows, diagonals and consistent slots in plain Python, from the same templates."""
    rng = np.random.default_rng(12)
    made = list(_questions(rng, 25)) + [("Define osmosis.", "define osmosis", 0), ("Add 3 and 4.", "add 3 and 5", 2)]
    bench = spark.createDataFrame([(i, a) for i, (a, _, _) in enumerate(made)], "item_id long, text string")
    texts = []
    for i, (a, b, _) in enumerate(made):
        w = b.split()
        texts += [a, f"so. {b}.", " ".join(w[: len(w) // 2] + ["x"] + w[len(w) // 2 :]), " ".join(w[: max(9, len(w) * 2 // 3)]), a + " " + b, re.sub(r"\d+", "7", b)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    width, plain, least, mark = 8, 4, 5, DC.MARK
    kind = lambda v: [x[:2] if x.startswith(mark) else x for x in v]
    slots = lambda v: [x for x in v if x.startswith(mark)]

    def whole(v, equal):
        return [mark + "a" if equal and i in (0, len(v) - 1) and x.startswith(mark + "a") else x if equal else k for i, (x, k) in enumerate(zip(v, kind(v), strict=True))]

    want = set()
    forms = [(r["item"], r.v) for r in DC._forms(bench, "item_id", "text").collect()]
    for d in DC._templates(docs, "doc_id", "text").collect():
        for item, v in forms:
            places = [i for i in range(len(v) - width + 1) if width - len(slots(v[i : i + width])) >= plain]
            small = len(v) < width or len(places) < min(least, len(v) - width + 1)
            equal = small and len(v) - len(slots(v)) < plain
            w, starts = (len(v), [0]) if small else (width, places)
            lines = defaultdict(list)
            for i in starts:
                for j in range(len(d.v) - w + 1):
                    if whole(v[i : i + w], equal) == whole(d.v[j : j + w], equal):
                        lines[j - i].append(i)
            for gap, at in lines.items():
                pairs = set()
                for i in at:
                    for b, x in zip(slots(v[i : i + w]), slots(d.v[i + gap : i + gap + w]), strict=True):
                        inside = b.startswith(mark + "a") and f"_{b[2:]}_" in f"_{x[2:]}_"
                        pairs.add((b, b if inside else x))
                exact = all(b == x for b, x in pairs)
                if len({b for b, _ in pairs}) == len(pairs) == len({x for _, x in pairs}) and len(at) >= min(least, len(starts)) and (exact or not equal):
                    want.add((d.doc_id, item))
    got = {(r.doc_id, r.item_id) for r in decontaminate(docs, bench).collect()}
    assert got == want
    assert len(want) > 50


def test_decontamination_finds_all_verbatim_items(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = {(d.doc_id, b.item_id) for d in docs.collect() for b in bench.collect() if b.text in d.text}
    got = {(r.doc_id, r.item_id) for r in decontaminate(docs, bench).collect()}
    assert want <= got
    assert len(got - want) <= 0.1 * len(got)


# --- 5 rollups ---


def test_rollup(spark, docs, tmp_path):
    r = TokenRollup(spark, f"file://{tmp_path}/r")
    assert r.totals().count() == 0
    counts = token_counts(docs)
    assert r.commit("a", changes(counts, "insert"))
    before = sorted(map(str, r.totals().collect()))
    assert not r.commit("a", changes(counts, "insert"))
    assert sorted(map(str, r.totals().collect())) == before
    n = sum(len(split(t)) for _, t, *_ in fixture_rows())
    assert r.totals().where("tokenizer = 'words-1'").agg(F.sum("n_tokens")).first()[0] == n
    assert r.commit("empty", changes(counts.limit(0), "insert"))
    more = counts.withColumn("new_words", F.coalesce("text_words", F.lit(0)) + 1).withColumn("new_bpe", F.coalesce("text_bpe", F.lit(0)) + 2)
    assert r.commit("b", changes(more, "revise", ("text_words", "text_bpe"), ("new_words", "new_bpe")))
    t = {x.tokenizer: (x.d, x.t) for x in r.totals().groupBy("tokenizer").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t")).collect()}
    assert t["words-1"] == (15, n + 15)
    assert r.commit("c", changes(more, "delete", ("new_words", "new_bpe"), None))
    assert r.totals().count() == 0
    with pytest.raises(Exception, match="unknown kind"):
        r.commit("d", changes(counts, "replace"))
    with pytest.raises(ValueError, match="name"):
        r.commit("../x", changes(counts, "insert"))


def test_rollup_with_two_committers(spark, docs, tmp_path):
    """Both have staged the batch before either publishes it; it counts once."""
    one, two = (TokenRollup(spark, f"file://{tmp_path}/r") for _ in range(2))
    batch = changes(token_counts(docs), "insert")
    a, b = one.stage(batch), two.stage(batch)
    assert one.publish("x", a)
    want = sorted(map(str, one.totals().collect()))
    assert not two.publish("x", b)
    assert not two.commit("x", batch)
    assert sorted(map(str, two.totals().collect())) == want
    # A note that both write at the same moment: one text stays, and one folder counts.
    notes = one._batches
    notes.fs.delete(notes.at("x"), False)
    seen = notes.exists
    notes.exists = lambda name: False
    two._batches.write("x", b)
    assert notes.write("x", a) == (notes.read("x") == a)
    notes.exists = seen
    assert sorted(map(str, two.totals().collect())) == want
    for i in range(3):
        assert one.commit(f"y{i}", batch)
    before = sorted(map(str, one.totals().collect()))
    one.compact()
    assert two.commit("z", batch) and not one.commit("y1", batch)
    two.compact()
    assert len(one._state()[0]) == 1
    assert one.totals().agg(F.sum("n_docs")).first()[0] == 5 * 2 * 15
    assert sum(eval(str(r), {"Row": lambda **k: k})["n_docs"] for r in before) == 4 * 2 * 15


def test_rollup_totals_of_every_group(spark, sf):
    """op5's totals against whole texts encoded one by one, per source, language and tokenizer."""
    from lodestone.llm.queries import op5_token_rollups

    tok = Encoder(default_path()).tokenizer
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    labels = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        q, t = labels.get(r.doc_id, (9, 0))
        labels[r.doc_id] = min(q, r.quality), max(t, r.toxic)
    want = defaultdict(lambda: [0, 0])
    for d in docs:
        quality, toxic = labels.get(d.doc_id, (9, 0))
        if toxic == 1:
            continue
        text = d.text or ""
        if quality == 0:
            text = "\n".join(dict.fromkeys(text.split("\n")))
        for name, n in (("words-1", len(split(text))), ("word_bpe_49k", len(tok.encode(text, add_special_tokens=False).ids))):
            g = want[d.source, d.lang, name]
            g[0], g[1] = g[0] + 1, g[1] + n
    got = {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens] for r in op5_token_rollups(spark, sf).collect()}
    assert got == dict(want)


# --- tokens, 6 token files, 7 packing ---


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_word_wise_ids_equal_whole_texts(texts):
    enc = Encoder(default_path())
    texts = [*texts, "don't 's I'LL x́ a1b2!? <|endoftext|>  \u0085 y", "İ ΑΣ Σ ﬁ"]
    for some in (texts, [*texts[:-2], "A Å K É'S ǅ", texts[-1]]):
        ids, at = enc.encode(*kernels.buffers(pa.array(some, pa.string())), end=7)
        for i, t in enumerate(some):
            assert ids[at[i] : at[i + 1]].tolist() == [*enc.tokenizer.encode(t, add_special_tokens=False).ids, 7]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abé1 .,'\"!?€$-)x\u0308", max_size=30), max_size=4))
def test_closing_marks_are_parts_of_their_own(texts):
    enc = Encoder(default_path())
    assert enc.closing
    ids, at = enc.encode(*kernels.buffers(pa.array(texts, pa.string())))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids


def test_encoder_starts_anew_when_full():
    enc = Encoder(default_path(), most=50)
    for n in range(6):
        texts = [f"word{n}{i}, and" for i in range(40)]
        ids, at = enc.encode(*kernels.buffers(pa.array(texts, pa.string())))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert enc.index.n < 130


def test_table_of_hashes():
    from lodestone.llm.tokens import Table

    rng = np.random.default_rng(3)
    t, keys = Table(2), (rng.integers(1, 40, 30).astype(np.uint64) << np.uint64(8)) | np.uint64(3)
    keys = np.unique(keys)
    t.add(keys[:5])
    t.add(keys[5:])
    assert t.find(keys).tolist() == list(range(len(keys)))
    assert t.find(keys + np.uint64(1)).tolist() == [-1] * len(keys)


def test_a_tokenizer_that_keeps_white_space():
    import public_tokenizers

    enc = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["Two  words", "", " \n x"]
    ids, at = enc.encode(*kernels.buffers(pa.array(texts)), end=5)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [[*enc.tokenizer.encode(t, add_special_tokens=False).ids, 5] for t in texts]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0, 1, 7, 255, 2047, 2048, 40000, 65535]), max_size=300), max_size=5))
def test_coder_round_trip(parts):
    ids = np.array([x for p in parts for x in p], np.int32)
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    blocks = coder.encode(ids, at)
    back, where = coder.decode(blocks)
    assert back.tolist() == ids.tolist()
    assert where.tolist() == at.tolist()


def test_coder_checks_and_learns():
    rng = np.random.default_rng(0)
    repeated = np.tile(rng.integers(0, 50000, 40), 100).astype(np.int32)
    noise = rng.integers(0, 65536, 4096).astype(np.int32)
    a, b = coder.encode(np.concatenate([repeated, noise]), np.array([0, 4000, 8096]))
    assert len(a) < 1000
    assert len(b) < 4096 * 2.6
    with pytest.raises(ValueError, match="check"):
        coder.decode([a[:20] + bytes([a[20] ^ 1]) + a[21:]])
    with pytest.raises(ValueError, match="2\\*\\*32"):
        coder.encode(np.array([1 << 32]), np.array([0, 1]))
    with pytest.raises(ValueError, match="at most"):
        coder.encode(np.zeros(9000, np.int32), np.array([0, 9000]))


@pytest.mark.parametrize("seen", [0, 1, 50, 118, 500])
def test_coder_ranges_begin_where_they_should(seen):
    """Also where shares fill nearly the whole scale; a block's starts don't depend on its neighbours."""
    m = coder._Model(3)
    m.counts.reshape(3, -1)[:, 5] += 8 * seen
    m._refresh(3)
    cum = m.cum.reshape(3, -1)[:, : coder.RANGES].astype(int)
    want = [[int((c <= 8 * slot).sum()) - 1 for slot in range(512)] for c in cum]
    assert m.start.reshape(3, 512).tolist() == want
    assert all((np.diff([*c, 4096]) > 0).all() for c in cum)


def test_coder_takes_large_ids():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 1 << 32, 500), rng.integers(0, 65536, 300), [65536, 0, (1 << 32) - 1]])
    at = np.array([0, 100, 100, 500, 800, 803])
    back, where = coder.decode(coder.encode(ids, at))
    assert back.tolist() == ids.tolist() and where.tolist() == at.tolist()


def test_coder_survives_damage():
    """A damaged byte ends in an error, or changes no id: the last words say more than is needed."""
    ids = np.tile(np.arange(50), 4).astype(np.int32)
    (block,) = coder.encode(ids, np.array([0, 200]))
    found = 0
    for i in range(4, len(block)):
        try:
            back, _ = coder.decode([block[:i] + bytes([block[i] ^ 0x55]) + block[i + 1 :]])
            assert back.tolist() == ids.tolist()
        except ValueError:
            found += 1
    assert found >= len(block) - 4 - 8


def _ids(end):
    tok = Encoder(default_path()).tokenizer
    return [(k, [*tok.encode(t or "", add_special_tokens=False).ids, end]) for k, t, *_ in fixture_rows()]


def test_token_files(spark, docs, empty, tmp_path):
    write_ids(docs, f"file://{tmp_path}/t")
    out = read_ids(spark, f"file://{tmp_path}/t").orderBy("start").collect()
    want = _ids(2)
    assert Counter((r.doc_id, tuple(r.ids)) for r in out) == Counter((k, tuple(x)) for k, x in want)
    n = 0
    for r in out:
        assert (r.start, r.n_tokens) == (n, len(r.ids))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        n += r.n_tokens
    ids = [r.doc_id for r in out]
    assert ids == sorted(ids, key=lambda k: (k is not None, k))
    write_ids(empty, f"file://{tmp_path}/e")
    assert read_ids(spark, f"file://{tmp_path}/e").count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit(lengths):
    x = np.array(lengths, np.int64)
    window, offset = best_fit(x, 64)
    rooms, want = [], {}
    for i in np.argsort(-x, kind="stable"):
        fits = [(r, w) for w, r in enumerate(rooms) if r >= x[i]]
        if fits:
            w = min(fits)[1]
        else:
            w = len(rooms)
            rooms.append(64)
        rooms[w] -= x[i]
        want[i] = w
    # Windows with equal room may be taken in any order; what they hold in the end is the same.
    assert sorted(np.bincount(window, x).tolist() if len(x) else []) == sorted(64 - r for r in rooms)
    for w in set(window.tolist()):
        end = 0
        for o, n in sorted((offset[i], x[i]) for i in np.flatnonzero(window == w)):
            assert o == end
            end += n
        assert end <= 64


def test_pack(docs, empty):
    want = _ids(1)
    rows = pack(docs.withColumn("start", F.lit("x"))).collect()
    pieces = Counter()
    for _, x in want:
        for s in range(0, len(x), 2048):
            p = x[s : s + 2048]
            pieces[s, len(p), zlib.crc32(np.array(p, "<u4").tobytes()), len(x)] += 1
    assert Counter((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == pieces
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        end = 0
        for o, n in sorted(v):
            assert o == end
            end += n
        assert end <= 2048
    assert pack(empty).count() == 0


# --- 8 language model ---


def test_language_model(spark, empty, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(None, None), (-1, ""), (-2, "Never seen zzzzqq")], "doc_id long, text string"))
    rows = docs.collect()
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2
    tok = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())), None]
    c = Counter(w for r in rows if not held(r.doc_id) for w in tok(r.text))
    n, v = sum(c.values()), len(c)
    out = {r.doc_id: r for r in score(docs).collect()}
    assert len(out) == len(rows)
    for r in rows:
        t, o = tok(r.text), out[r.doc_id]
        assert (o.held_out, o.n_tokens, o.n_known, o.train_tokens) == (held(r.doc_id), len(t), sum(c[w] > 0 for w in t), n)
        assert o.base_score == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
        assert np.isfinite(o.score) and o.score < 0
    tested = [o for o in out.values() if o.held_out]
    assert sum(o.score for o in tested) > sum(o.base_score for o in tested)
    assert score(empty).count() == 0


# --- 9 pages ---


def test_dictionary_takes_the_most_frequent_words(spark):
    rows = [(i, 1000 - i) for i in range(300)] + [(1000 + i, 3) for i in range(400)] + [(5000 + i, 1) for i in range(2000)]
    counts = spark.createDataFrame(rows, "h long, c long").repartition(4)
    top = {r.h for r in LM._most_frequent(counts, 500).collect()}
    assert set(range(300)) <= top and 300 < len(top) <= 500 and max(top) < 5000
    assert LM._most_frequent(counts, 5000).count() == 2700
    assert 0 < LM._most_frequent(counts, 100).count() <= 100
    assert LM._most_frequent(counts.limit(0), 5).count() == 0


def test_language_model_grows(spark, monkeypatch):
    small, large = LM.sizes(LM.BASE), LM.sizes(LM.BASE << 8)
    assert LM.sizes(0) == small and all(y >= 4 * x - 1 for x, y in zip(small, large, strict=True))
    assert LM._row(np.array([0, 2**64 - 1], np.uint64), 1 << 20).tolist() == [0, (1 << 20) - 1]
    monkeypatch.setattr(LM, "BASE", 50)
    texts = [(i, " ".join(words(200, i))) for i in range(70)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    keyed = docs.selectExpr("text", "false AS held_out")
    m = LM.train(keyed, LM._counted(keyed), 1)
    assert m.size == len(set(" ".join(t for _, t in texts).split())) + 2 > 1024
    one = np.full(m.size, m.keys[0])
    assert np.isclose(np.exp(m.forward(one, one, np.arange(m.size))[0].astype(float)).sum(), 1, atol=1e-3)
    assert score(docs).count() == 70


def test_language_model_equals_a_plain_one(spark):
    """Scores against the formula in plain Python; the probabilities of all words sum to one; rounds learn."""
    texts = [(i, f"v{i} " + " ".join(words(40, i % 2)) + (" x" * (i % 3)), False) for i in range(90)] + [(99, "w1 w2 never w1", True), (98, "", True), (97, None, True)]
    keyed = spark.createDataFrame(texts, "doc_id long, text string, held_out boolean").selectExpr("doc_id", "held_out", "coalesce(text, '') AS text")
    counts = LM._counted(keyed.where("NOT held_out"))
    m = LM.train(keyed, counts, 1, rounds=3)
    assert len(m.losses) == 3 and m.losses[2] > m.losses[0]
    m = m.sent().worker()
    classes = len(m.class_bias)
    count = {int(r.h): r.c for r in counts.collect()}
    hashes = lambda t: kernels.Words(*kernels.buffers(pa.array([t])), lower=True).hashes()

    def plain(t):
        h = [*hashes(t).tolist(), int(LM.END)]
        known = {int(k): int(s) for k, s in zip(m.keys, m.symbols, strict=True)}
        feature = [x if x in known or x == int(LM.END) else int(LM.RARE) for x in h]
        total = 0.0
        for i, x in enumerate(h):
            one, two = (feature[i - k] if i >= k else int(LM.BEGIN) for k in (1, 2))
            symbol = m.end_symbol if x == int(LM.END) else known.get(x, 0)
            cls, member = symbol % classes, symbol // classes
            c, w = m.rows(np.array([one], np.uint64), np.array([two], np.uint64), np.array([cls]))
            p = np.exp(m.class_bias.astype(float) + sum(m.class_rows[r[0]].astype(float) for r in c))
            q = np.exp(m.word_bias[cls].astype(float) + sum(m.word_rows[r[0]].astype(float) for r in w))
            total += np.log10(p[cls] / p.sum()) + np.log10(q[member] / q.sum())
            if symbol == 0:
                total += np.log10((count.get(int(np.uint64(x).view(np.int64)), 0) + 1) / (m.n_rare + m.v_rare + 1))
        return total

    out = {r.doc_id: r.score for r in LM._scores(keyed, counts, m).collect()}
    for k, t, _ in texts:
        assert out[k] == pytest.approx(plain(t or ""), rel=1e-4, abs=1e-4), k
    one, two = np.full(m.size, m.keys[0]), np.full(m.size, m.keys[1])
    assert np.exp(m.forward(one, two, np.arange(m.size))[0].astype(float)).sum() == pytest.approx(1, abs=1e-4)


def test_main_text():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=1>Home</a></nav>
    <article><h1>The&nbsp;Title</h1><p>First, a   long paragraph &amp; more, of some length. It goes on.<p>Second <b>one</b>, also long enough, so there.</p>
    <div class="ad">Buy now, cheap, today!</div><ul><li>item one</li><li>item two</li></ul><section class="comments"><p>I agree, totally.</p></section></article>
    <aside>More, stories.</aside><form><p>Mail, please.</p></form><footer>Copyright, all.</footer><script>var x="<p>no</p>"</script></body></html>"""
    assert H.main_text(page) == "The Title\nFirst, a long paragraph & more, of some length. It goes on.\nSecond one, also long enough, so there.\nitem one\nitem two"
    assert H.main_text(None) == H.main_text("") == H.main_text("<p></p>") == ""
    assert H.main_text("a &lt; b") == "a < b"
    assert H.main_text("<div><p>x" * 3000)


def test_main_text_inside_the_article():
    page = """<body><article><div class="article-header"><h1>Title</h1></div><p>Long enough, this <span class="ad">Buy <span>now</span></span>text is. And on.</p>
    <p>More of it, <a class="share" href=1>Share</a>here<ins class="adsbygoogle">x</ins>.</p></article></body>"""
    assert H.main_text(page) == "Title\nLong enough, this text is. And on.\nMore of it, here."


def test_main_text_in_wrappers_with_telling_names():
    body = "<h1>Title</h1><p>Long enough, this text is. And on, it goes.</p><p>More of it, here, is to read.</p>"
    more = '<div class="sidebar"><p>Side, note.</p></div>'
    want = "Title\nLong enough, this text is. And on, it goes.\nMore of it, here, is to read."
    for wrap in ('div class="content has-sidebar"', 'div id=page class="no-sidebar"', 'div class="post widget-area-right"', 'section class="story share-enabled"', "form method=post", 'div class="widget"><div class="social"'):
        tag = wrap.split()[0]
        assert H.main_text(f"<body><{wrap}>{body}{more}</{tag}></div></body>") == want, wrap
        assert H.main_text(f"<body><{wrap}><article>{body}</article>{more}</{tag}></div></body>") == want, wrap
    talk = '<div class="comments"><h3>Say</h3>' + "<p>I think so too, and at some length, as it happens.</p>" * 9 + "</div>"
    assert H.main_text(f"<body><div>{body}</div>{talk}</body>") == want
    assert H.main_text(f'<body><div class="share-enabled">{body}</div>{talk}</body>') == want
    assert H.main_text(f'<body><div class="post comments-open">{body}{talk}</div></body>') == want
    assert H.main_text(f'<body><div class="related"><article><p>Teaser, one.</p></article></div><article>{body}</article></body>') == want


def test_main_text_keeps_all_content():
    p = [f"Paragraph {i} is long enough, as it seems, and ends with a point. So it goes on, until {i}." for i in range(12)]
    html = lambda part: "".join(f"<p>{x}</p>" for x in part)
    page = f"<body><nav><a href=1>Home</a></nav><div><h1>Title</h1>{html(p[:1])}</div><div class=body>{html(p[1:])}</div></body>"
    assert H.main_text(page) == "\n".join(["Title", *p])
    page = f"<body><article><h2>One</h2>{html(p[:7])}</article><article><h2>Two</h2>{html(p[7:])}</article></body>"
    assert H.main_text(page) == "\n".join(["One", *p[:7], "Two", *p[7:]])
    page = f"<body><div class=lead>{html(p[:2])}</div><article>{html(p[2:])}</article><footer>No, not this.</footer></body>"
    assert H.main_text(page) == "\n".join(p)


def test_main_text_selects_paths_inside_the_article():
    head = "<h1>Title</h1><p>Long enough, this text is. And on, it goes.</p><p>More of it, here, is to read, and so on.</p>"
    want = "Title\nLong enough, this text is. And on, it goes.\nMore of it, here, is to read, and so on."
    for part, text in (
        ("<div class=x><a href=1>Home</a> <a href=2>Away</a></div>", None), ('<div class="notice">Subscribe now!</div>', None),
        ("<ul class=more><li><a href=1>One more</a></li><li><a href=2>Two more</a></li></ul>", None),
        ('<div class="legal-analysis side"><p>A paragraph of legal analysis, which is long enough, and says something.</p></div>', "A paragraph of legal analysis, which is long enough, and says something."),
        ('<h2><a href="#s">Part</a></h2><p>And more, after the heading, in its part.</p>', "Part\nAnd more, after the heading, in its part."),
        ("<p>Short.</p><p><a href=x>Read the report</a></p>", "Short.\nRead the report"), ("<table><tr><td>a<td>1</table>", "a\n1"),
    ):
        assert H.main_text(f"<article>{head}{part}</article>") == (want if text is None else f"{want}\n{text}"), part
    assert H.main_text('<body><div class="register"><h1>T</h1><p>The parish register, kept since 1600, is here.</p></div></body>') == "T\nThe parish register, kept since 1600, is here."


def test_main_text_of_deep_pages():
    """Time and memory in proportion to the page, however it nests."""
    import time
    import tracemalloc

    began = time.time()
    tracemalloc.start()
    for page, n in (("<div>" * 100_000 + "x", 1), ("<div><p>x" * 20_000, 39_999), ("<nav>" * 50_000 + "x", 0), ("<ul><li>" * 50_000 + "x", 1), ("<p>" + "<object>" * 50_000 + "<p>y", 1), ("<a " * 100_000, 299_999), ("</div>" * 100_000 + "x", 1)):
        assert len(H.main_text(page)) == n, page[:12]
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert time.time() - began < 120


def _labelled_pages():
    """Pages of many layouts with the blocks of their articles: (html, wanted blocks, unwanted)."""
    rng = np.random.default_rng(4)
    prose = lambda n: " ".join(f"{'Word' if i % 9 == 0 else 'word'}{rng.integers(999)}{',' if i % 7 == 3 else '.' if i % 9 == 8 else ''}" for i in range(n)) + "."
    for i in range(120):
        body = [f"Title {i} of it", *(prose(int(rng.integers(6, 80))) for _ in range(int(rng.integers(3, 9)))), f"Heading {i}", prose(40), f"item {i}", prose(20)]
        inner = f"<h1>{body[0]}</h1>" + "".join(f"<p>{x}</p>" for x in body[1:-4]) + f"<h2>{body[-4]}</h2><p>{body[-3]}</p><ul><li>{body[-2]}</li></ul><p>{body[-1]}</p>"
        wrap = [("<article>", "</article>"), ("<main><div class=content>", "</div></main>"), ("<div id=page class=no-sidebar><div class=post>", "</div></div>"), ('<div class="story register">', "</div>"), ("<table><tr><td>", "</td></tr></table>")][i % 5]
        bad = [f"menu{i}", prose(12), f"share{i}", prose(30), prose(25), f"Copyright {i}, all."]
        side = ["<aside><p>{}</p></aside>", "<div class=sidebar><p>{}</p></div>", "<div role=complementary>{}</div>"][i % 3]
        page = f"<html><head><title>t</title></head><body><nav><a href=1>{bad[0]}</a></nav><div class=ad>{bad[1]}</div>{wrap[0]}{inner}<div class=share><a href=2>{bad[2]}</a></div>{wrap[1]}{side.format(bad[3])}<section class=comments><p>{bad[4]}</p></section><footer>{bad[5]}</footer></body></html>"
        yield page, body, bad


def test_main_text_recall_and_precision():
    found = wanted = right = 0
    for page, good, bad in _labelled_pages():
        out = H.main_text(page).split("\n")
        found, wanted, right = found + len(out), wanted + len(good), right + len(set(out) & set(good))
        assert not set(out) & set(bad)
    assert right / wanted > 0.98 and right / found > 0.98, (right / wanted, right / found)


def test_extract(spark, sf):
    pages = spark.createDataFrame([(1, "u", "<article><p>Ab, c.</p></article>"), (2, None, None), (None, "v", "")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    assert sorted(map(tuple, H.extract(pages).fillna(-1).fillna("").collect())) == [(-1, "v", "", 0), (1, "u", "Ab, c.", 6), (2, "", "", 0)]
    assert H.extract(pages.limit(0)).count() == 0


# --- 10 n-gram join ---


def brute_join(rows, n=5):
    s = []
    for _, t in rows:
        w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in split(t)]
        s.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least.setdefault(find(i), []).append(k)
    low = {r: None if None in v else min(v) for r, v in least.items()}
    return Counter((k, len(s[i]), low[find(i)]) for i, (k, _) in enumerate(rows))


def test_ngram_join(spark, docs, empty):
    rng = np.random.default_rng(5)
    rows = [(r[0], r[1]) for r in fixture_rows()]
    base = words(60, 9)
    for i in range(60):  # a group of near copies at many distances
        w = list(base)
        for j in rng.choice(60, int(rng.integers(0, 9)), replace=False):
            w[j] = f"n{rng.integers(0, 40)}"
        rows.append((100 + i, " ".join(w)))
    for i in range(12):  # a chain: each links to the next only
        rows.append((300 - i, " ".join(base[:5] + [f"c{x}" for x in range(i * 5, i * 5 + 60)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("token", F.lit(1)).repartition(3)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join(df, chunk=7).collect())
    assert got == brute_join(rows)
    assert ngram_join(empty).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(100, 50), (50, 70), (5, 5)], "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {i: 1 for i in range(1, 31)} | {100: 50, 70: 50, 50: 50}
