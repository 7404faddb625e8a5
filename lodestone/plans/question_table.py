"""Many questions in one plan: questions and their conditions are rows, not literals of a plan.

`parsed` turns (question_id, text) into what a question asks for, as arrays and
structs. Every step that `ask` takes for one question is taken here for all at
once: nearest hits, exact supplements, merge, typed conditions, coverage and
support, each window within its question. A hit meets its question's
conditions in a join on question_id; what a condition tests follows from its
kind and payload columns.

Supplements need every text's exact evidence for every question. The stated
questions meet all different texts in blocks of BLOCK, each small enough to
broadcast, and a text goes on only with the questions for which it has evidence.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.functions import text as T
from lodestone.functions import vectors
from lodestone.operators import evidence as E
from lodestone.operators import ranking, retrieval
from lodestone.plans.ask import DEGREE_MARKS, DEGREE_SECTIONS, OWN_SECTIONS, ROLE_PREFIX, Limits
from lodestone.plans.questions import Condition, Question, analyze, conditions, role_token
from lodestone.sources.shared import written

NUMBER = "struct<value: double, operator: string, relation: string, context: array<array<string>>>"
PARSED = f"units array<array<string>>, languages array<struct<language: string, level: string>>, phrases array<string>, numbers array<{NUMBER}>"
CONDITION = f"key string, kind string, weight double, place int, names array<string>, number {NUMBER}, language string, level string, degrees array<array<string>>, fields array<string>, role array<string>, term string, family array<string>"
#: Questions that are broadcast together.
BLOCK = 1000
ID = ["question_id"]


def _number(n) -> dict:
    return {"value": n.value, "operator": n.operator, "relation": n.relation, "context": [E.family(c) for c in n.context]}


def _facts(q: Question) -> tuple:
    units = [E.family(t) for t in q.terms if not any(t in r for r in q.languages)]
    return units, [{"language": a, "level": b} for a, b in q.languages], list(q.phrases), [_number(n) for n in q.numbers]


def parsed(questions: DataFrame, strict: bool = False) -> DataFrame:
    """questions (question_id, text, ..) with the facts that each asks for."""
    names = [c.split()[0] for c in PARSED.split(", ") if c.split()[0] in ("units", "languages", "phrases", "numbers")]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in questions.schema.fields)

    def task(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            facts = [_facts(analyze(t or "", strict)) for t in p["text"]]
            yield p.assign(**{c: [f[i] for f in facts] for i, c in enumerate(names)})

    return questions.mapInPandas(task, f"{fields}, {PARSED}")


def _payload(c: Condition, place: int) -> dict:
    out = dict.fromkeys(("names", "number", "language", "level", "degrees", "fields", "role", "term", "family"))
    out |= {"key": c.key, "kind": c.kind, "weight": c.weight, "place": place}
    if c.kind == "identity":
        out["names"] = list(c.payload)
    elif c.kind == "numeric":
        out["number"] = _number(c.payload)
    elif c.kind == "relation":
        out["language"], out["level"] = c.payload
    elif c.kind == "education":
        out["degrees"], out["fields"] = [a.split() for a in c.payload[0]], [role_token(f) for f in c.payload[1]]
    elif c.kind in ("role", "phrase"):
        out["role"] = [role_token(w) for w in c.payload]
    else:
        out["term"], out["family"] = c.payload, E.family(c.payload)
    return out


def condition_rows(questions: DataFrame, strict: bool = False) -> DataFrame:
    """One row per condition of (question_id, text, names: the candidates that a question may name)."""
    kind = questions.schema["question_id"].dataType.simpleString()
    columns = ["question_id", *(c for c in _payload(Condition("", "term", 0.0, ""), 0))]

    def task(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for i, t, names in zip(p["question_id"], p["text"], p["names"], strict=True):
                given = sorted(n for n in (() if names is None else names) if n)
                rows += [{"question_id": i, **_payload(c, n)} for n, c in enumerate(conditions(analyze(t or "", strict), given))]
            yield pd.DataFrame(rows, columns=columns)

    order = ["question_id", *(f.split()[0] for f in "key kind weight place names number language level degrees fields role term family".split())]
    return questions.select("question_id", "text", "names").mapInPandas(lambda b: (x[order] for x in task(b)), f"question_id {kind}, {CONDITION}")


def named(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(question_id, name): every name (column name) whose normal form stands in a question's (question_id, text).

    It may begin or end within a word of the question, as a plain search of the text
    would find it. No question meets all names: the different words of all questions are
    joined by equality with the names' first words (which may end them) and last words
    (which may begin them). A stretch of a question's words is looked up among the names
    only from such a first to such a last word, so a question has few stretches.
    """
    wanted = names.select("name", T.normalized(F.col("name")).alias("normal")).where("normal <> ''").distinct()
    wanted = written(wanted.withColumn("w", F.split("normal", " ")).withColumn("n", F.size("w")), "names")
    sizes = sorted(r[0] for r in wanted.select("n").distinct().collect())
    if not sizes:
        return questions.select("question_id").crossJoin(wanted.select("name")).limit(0)
    asked = written(questions.select("question_id", T.tokens(F.col("text")).alias("words")).withColumn("form", F.xxhash64("words")), "questions-words")
    key = ["question_id", "form"]
    upto = F.sequence(F.lit(1), F.length("word"))
    word = asked.select(F.explode("words").alias("word")).distinct()
    ends, begins = F.transform(upto, lambda i: F.right("word", i)), F.transform(upto, lambda i: F.left("word", i))
    inner = F.flatten(F.transform(upto, lambda i: F.transform(F.sequence(F.lit(1), F.length("word") - i + 1), lambda n: F.substring(F.col("word"), i, n))))

    def parts(kind: str, cuts: Column, of: Column, which: str) -> DataFrame:
        known = wanted.where(which).select(of.alias("part")).distinct()
        return word.select("word", F.explode(F.array_distinct(cuts)).alias("part")).join(known, "part").select("word", F.lit(kind).alias("kind"), "part")

    known = parts("first", ends, F.element_at("w", 1), "n > 1").union(parts("last", begins, F.element_at("w", -1), "n > 1")).union(parts("whole", inner, F.col("normal"), "n = 1"))
    of = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.col("part"))).alias(kind)
    known = written(known.groupBy("word").agg(of("first"), of("last"), of("whole")), "names-parts")
    marks = asked.select(*key, F.posexplode("words").alias("at", "word")).join(known, "word").groupBy(*key).agg(*(F.collect_list(F.struct("at", kind)).alias(kind) for kind in ("first", "last", "whole")))
    some = lambda kind: F.filter(kind, lambda x: F.size(x[kind]) > 0)

    def stretches(n: int) -> Column:
        """From every first word the stretches of n words that end in a last one."""
        def keys(a: Column) -> Column:
            ends_at = F.filter("last", lambda b: b["at"] == a["at"] + (n - 1))
            middle = F.slice("words", a["at"] + 2, n - 2)
            said = lambda x, y: F.array_join(F.concat(F.array(x), middle, F.array(y)), " ")
            return F.flatten(F.transform(ends_at, lambda b: F.flatten(F.transform(a["first"], lambda x: F.transform(b["last"], lambda y: said(x, y))))))

        return F.flatten(F.transform("first", keys))

    whole = F.flatten(F.transform("whole", lambda x: x["whole"]))
    marks = marks.select(*key, *(some(kind).alias(kind) for kind in ("first", "last", "whole"))).join(asked.dropDuplicates(key), key)
    said = marks.select("question_id", F.explode(F.array_distinct(F.concat(whole, *(stretches(n) for n in sizes if n > 1)))).alias("normal"))
    # Neither side is broadcast by a guess: an exploded side is far larger than its source.
    return written(said, "questions-stretches").join(wanted.select("name", "normal"), "normal").select("question_id", "name").distinct()


def prepared(chunks: DataFrame) -> DataFrame:
    """chunks with tokens, canonical tokens, clauses and their numbers, once for all questions."""
    return chunks.withColumns({"tokens": T.tokens(F.col("text")), "clauses": T.clauses(F.col("text"))}).withColumns({"normal": F.array_join("tokens", " "), "plain": F.transform("tokens", T.canonical), "plain_clauses": F.transform("clauses", lambda c: F.transform(c, T.canonical)), "stated": E.numbers(F.col("clauses"))})


def _share(items: Column, test) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + F.when(test(x), 1.0).otherwise(0.0))


def scores(q: Column) -> dict[str, Column]:
    """lexical, numeric and contextual of a prepared chunk for the question in the struct q."""
    plain = F.col("plain")
    units, languages, phrases, numbers = (q[c] for c in ("units", "languages", "phrases", "numbers"))
    n = F.size(units) + F.size(languages)
    got = _share(units, lambda u: F.arrays_overlap(plain, u)) + _share(languages, lambda x: E.language_relation(F.col("plain_clauses"), x["language"], x["level"], True))
    said = _share(phrases, lambda p: F.instr(F.col("normal"), p) > 0) / F.greatest(F.size(phrases), F.lit(1))
    lexical = F.least(F.lit(1.0), F.when(n > 0, got / n).otherwise(0.0) + 0.15 * said)
    each = F.transform(numbers, lambda x: E.numeric_of(F.col("stated"), x["value"], x["operator"], x["relation"], x["context"]))
    numeric = F.when(F.size(numbers) > 0, F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(numbers)).otherwise(0.0)
    return {"lexical": lexical, "numeric": numeric, "contextual": F.exists(each, lambda x: x == 1.0)}


def combined(q: Column) -> Column:
    s = [F.col(c) for c in ("semantic", "lexical", "numeric")]
    return F.when(F.size(q["numbers"]) > 0, E.combined(*s)).otherwise(E.combined(*s[:2]))


def _question(facts: DataFrame) -> Column:
    return F.struct(*(F.col(c) for c in ("question_id", "units", "languages", "phrases", "numbers"))).alias("q")


def _slices(questions: DataFrame) -> list[DataFrame]:
    """The questions in parts of about BLOCK by a hash of the id, so that each may be broadcast."""
    parts = -(-questions.count() // BLOCK)
    return [questions.where(F.pmod(F.xxhash64("question_id"), F.lit(parts)) == i) for i in range(parts)]


def _texts(chunks: DataFrame) -> DataFrame:
    """The different texts, prepared, each with the last of its chunks' ids, which stands for it."""
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = chunks.groupBy("text").agg(F.max("chunk_id").alias("last")).repartition(parts, "last")
    return written(prepared(texts).drop("tokens", "clauses"), "question-texts")


def _supplements(chunks: DataFrame, facts: DataFrame, hits: DataFrame, limit: int) -> DataFrame:
    """Per question the chunks outside its hits with the best exact evidence, at most `limit`.

    Copies have the same evidence, so each different text is scored once. The best `most`
    chunks are of the best `most` texts, by scores and then the last chunk of each.
    """
    scored = ["contextual", "numeric", "lexical", "combined"]
    first = lambda c: W.partitionBy(*ID).orderBy(*map(F.desc, [*scored, c]))
    most = limit + Limits().raw_most
    texts = _texts(chunks)
    out = None
    for part in _slices(facts):
        packed = part.groupBy(F.pmod(F.xxhash64("question_id"), F.lit(64)).alias("block")).agg(F.collect_list(_question(part)).alias("qs")).select("qs")
        each = F.filter(F.transform("qs", lambda q: F.struct(q["question_id"].alias("question_id"), q.alias("q"), *(v.alias(k) for k, v in scores(q).items()))), lambda x: F.when(F.size(x["q"]["numbers"]) > 0, x["numeric"] > 0).otherwise(x["lexical"] > 0))
        met = texts.crossJoin(F.broadcast(packed)).select("last", F.inline(each)).withColumn("semantic", F.lit(0.0))
        best = met.withColumn("combined", combined(F.col("q"))).drop("q", "semantic").withColumn("place", F.row_number().over(first("last"))).where(F.col("place") <= most).drop("place")
        out = best if out is None else out.unionByName(best)
    best = written(out, "question-best-texts")
    found = texts.join(best.select("last").distinct(), "last").select("text", "last")
    copies = chunks.select("text", "chunk_id").join(found, "text").select("last", "chunk_id")
    copies = copies.withColumn("place", F.row_number().over(W.partitionBy("last").orderBy(F.desc("chunk_id")))).where(F.col("place") <= most).drop("place")
    rest = best.join(copies, "last").join(hits.select("question_id", "chunk_id"), ["question_id", "chunk_id"], "left_anti")
    return rest.withColumn("place", F.row_number().over(first("chunk_id"))).where(F.col("place") <= limit).select("question_id", "chunk_id")


def assisted(chunks: DataFrame, facts: DataFrame, k: int = 50, metric: str = "cosine", limit: int = retrieval.SUPPLEMENTS) -> DataFrame:
    """Hits and supplements of every question, one per candidate and text, ranked within the question.

    facts: from `parsed`, with the column `query`, the question's vector.
    """
    near = retrieval.nearest_many(chunks, facts.select("question_id", "query"), k, metric)
    near = written(near.select("question_id", "chunk_id", "distance", F.col("rank").alias("raw_rank")), "question-hits")
    own = near.withColumn("semantic", vectors.relevance(F.col("distance"), metric)).drop("distance").withColumn("is_supplemental", F.lit(False))
    extra = _supplements(chunks, facts, near, limit).withColumns({"semantic": F.lit(0.0), "raw_rank": F.lit(None).cast("int"), "is_supplemental": F.lit(True)})
    # Written, as only the chunks that were found are prepared.
    found = written(own.unionByName(extra).join(chunks.drop("embedding"), "chunk_id"), "question-found")
    pool = prepared(found).join(facts.select("question_id", _question(facts)), "question_id").withColumns(scores(F.col("q"))).withColumn("combined", combined(F.col("q"))).drop("q")
    place = F.coalesce("raw_rank", F.lit(10_000))
    first = W.partitionBy(*ID, "candidate_id", "normal").orderBy(F.desc("combined"), "is_supplemental", place, F.desc("chunk_id"))
    order = W.partitionBy(*ID).orderBy(F.desc("combined"), F.desc("contextual"), F.desc("numeric"), F.desc("lexical"), F.desc("semantic"), place, F.desc("chunk_id"))
    return pool.withColumn("copy", F.row_number().over(first)).where("copy = 1").drop("copy").withColumn("rank", F.row_number().over(order))


def _degree(tokens: Column, degrees: Column, fields: Column) -> Column:
    """One of the degrees' names and then, before the next degree, a word for every field."""

    def after(words: Column) -> Column:
        n = F.size(words)
        places = F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1)))
        begin = F.get(F.filter(places, lambda i: F.slice(tokens, i, n) == words), F.lit(0)) + n
        rest = F.slice(tokens, begin, F.greatest(F.size(tokens) - begin + 1, F.lit(0)))
        ends = F.filter(F.transform(rest, lambda t, i: F.when(t.isin(*DEGREE_MARKS), i)), lambda i: i.isNotNull())
        segment = F.transform(F.slice(rest, 1, F.coalesce(F.get(ends, F.lit(0)), F.size(rest))), T.role_token)
        return F.coalesce(begin.isNotNull() & F.forall(fields, lambda f: F.exists(segment, lambda t: t.startswith(f))), F.lit(False))

    return F.exists(degrees, after)


def _role(tokens: Column, words: Column) -> Column:
    roles = lambda t: F.filter(F.transform(t, T.role_token), lambda x: x != "")
    out = T.ordered_subsequence(roles(T.tokens(F.coalesce("professional_title", F.lit("")))), words)
    for section, most in ROLE_PREFIX.items():
        here = (F.col("section_name") == section) & T.ordered_subsequence(F.slice(roles(tokens), 1, most), words)
        out = out | (here if section == "identity" else here & (words != F.array(F.lit("engineer"))))
    return F.coalesce(out, F.lit(False))


def strength(c: Column) -> Column:
    """How much a hit supports the condition in the struct c; 0 where it doesn't meet it."""
    plain, tokens = F.col("plain"), F.col("tokens")
    whole = T.clamp(E.strength(F.col("lexical"), F.col("semantic"), F.col("combined")))
    n = c["number"]
    same = F.get(tokens, (F.array_position(plain, c["term"]) - 1).cast("int")) == c["term"]
    term = F.coalesce(same, F.lit(False)) | (F.arrays_overlap(plain, c["family"]) & F.col("section_name").isin(*OWN_SECTIONS))
    met = lambda x: F.when(F.coalesce(x, F.lit(False)), whole).otherwise(0.0)
    return (
        F.when(c["kind"] == "identity", F.when(F.array_contains(c["names"], T.normalized(F.coalesce("candidate_name", F.lit("")))), 1.0).otherwise(0.0))
        .when(c["kind"] == "numeric", F.when(E.numeric_of(F.col("stated"), n["value"], n["operator"], n["relation"], n["context"]) == 1.0, T.clamp(F.col("numeric"))).otherwise(0.0))
        .when(c["kind"] == "relation", met(E.language_relation(F.col("plain_clauses"), c["language"], c["level"], True)))
        .when(c["kind"] == "education", met(F.col("section_name").isin(*DEGREE_SECTIONS) & _degree(tokens, c["degrees"], c["fields"])))
        .when(c["kind"].isin("role", "phrase"), met(_role(tokens, c["role"])))
        .otherwise(met(term))
    )


def matches(hits: DataFrame, wanted: DataFrame) -> DataFrame:
    """The best hit of each question, candidate and condition; wanted: from `condition_rows`."""
    c = F.struct(*(F.col(x) for x in wanted.columns if x != "question_id")).alias("c")
    met = hits.join(wanted.select("question_id", c), "question_id").withColumn("strength", strength(F.col("c"))).where("strength > 0")
    order = F.struct("strength", "combined", "semantic", (-F.col("rank")).alias("r"))
    out = met.groupBy("question_id", "candidate_id", F.col("c.key").alias("condition"), F.col("c.kind").alias("kind"), F.col("c.weight").alias("weight"), F.col("c.place").alias("place")).agg(F.max(order).alias("m"), F.max_by("chunk_id", order).alias("chunk_id"))
    return out.select("question_id", "candidate_id", "condition", "kind", "weight", "place", "chunk_id", F.col("m.strength").alias("strength"), (-F.col("m.r")).alias("rank"))


def candidates(hits: DataFrame, best: DataFrame, wanted: DataFrame, limit: int = 15) -> DataFrame:
    """Each question's candidates by score."""
    total = wanted.groupBy(*ID).agg(F.sum("weight").alias("total"), F.count("*").alias("n_conditions"))
    base = hits.groupBy("question_id", "candidate_id").agg(F.max("semantic").alias("semantic_support"), F.max("combined").alias("best_combined"), F.min("rank").alias("best_rank"), F.count("*").alias("n_hits"), F.min("candidate_name").alias("candidate_name"), F.min("professional_title").alias("professional_title"))
    got = best.groupBy("question_id", "candidate_id").agg(ranking.steady_sum(F.col("weight")).alias("w"), ranking.steady_sum(F.col("weight") * F.col("strength")).alias("s"), F.count("*").alias("n_matched"))
    df = base.join(total, "question_id", "left").join(got, ["question_id", "candidate_id"], "left").fillna(0, ["w", "s", "n_matched", "n_conditions"])
    some = F.col("n_conditions") > 0
    df = df.withColumns({"coverage": F.when(some, T.clamp(F.col("w") / F.col("total"))).otherwise(0.0), "quality": F.when(some, T.clamp(F.col("s") / F.col("total"))).otherwise(0.0)})
    score = F.when(some, 0.55 * F.col("coverage") + 0.30 * F.col("quality") + 0.15 * F.col("semantic_support")).otherwise(0.75 * F.col("best_combined") + 0.25 * F.col("semantic_support"))
    order = W.partitionBy(*ID).orderBy(F.desc("score"), F.desc("coverage"), F.desc("quality"), F.desc("semantic_support"), "best_rank", "candidate_id")
    ranked = df.withColumn("score", T.clamp(score)).drop("w", "s", "total", "best_combined")
    return ranked.withColumn("candidate_rank", F.row_number().over(order)).where(F.col("candidate_rank") <= limit)


def ask_all(chunks: DataFrame, questions: DataFrame, k: int | None = None, pool: int = 15, limit: int | None = None, metric: str = "cosine") -> DataFrame:
    """Supported (or partly supported) candidates of every question (question_id, text, query), best first."""
    return supported(*evidence(chunks, questions, k, metric), pool, limit)


def evidence(chunks: DataFrame, questions: DataFrame, k: int | None = None, metric: str = "cosine") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each question's merged hits, its conditions, and the best hit of each candidate and condition."""
    facts = written(parsed(questions), "question-facts")
    hits = written(assisted(chunks, facts, Limits().raw(k), metric), "question-pool")
    clash = ranking.conflicts(hits.select(F.concat_ws(" in ", "candidate_id", "question_id").alias("candidate_id"), "candidate_name", "professional_title"))
    if bad := clash.orderBy("candidate_id").head(1):
        raise ValueError(f"candidate {bad[0]['candidate_id']} has conflicting names or titles")
    names = hits.groupBy(*ID).agg(F.collect_set("candidate_name").alias("names"))
    wanted = written(condition_rows(facts.select("question_id", "text").join(names, "question_id", "left")), "question-conditions")
    return hits, wanted, written(matches(hits, wanted), "question-matches")


def supported(hits: DataFrame, wanted: DataFrame, best: DataFrame, pool: int = 15, limit: int | None = None) -> DataFrame:
    """The candidates that answer each question: complete ones, else partial ones."""
    ranked = candidates(hits, best, wanted, pool)
    full = (F.col("n_matched") == F.col("n_conditions")) & (F.col("score") >= ranking.FULL_SCORE) & (F.col("n_conditions") > 0)
    part = (F.col("n_matched") >= 1) & (F.col("coverage") >= ranking.PART_COVERAGE) & (F.col("score") >= ranking.PART_SCORE)
    judged = ranked.withColumns({"full": full, "part": part}).withColumn("any_full", F.max("full").over(W.partitionBy(*ID))).where("full OR (part AND NOT any_full)")
    out = judged.withColumn("outcome", F.when(F.col("any_full"), "supported").otherwise("partial")).drop("full", "part", "any_full")
    return out.withColumn("final_rank", F.row_number().over(W.partitionBy(*ID).orderBy("candidate_rank"))).where(F.col("final_rank") <= Limits().final(limit))


def answers(chunks: DataFrame, questions: DataFrame, k: int | None = None, metric: str = "cosine", **budget: int) -> DataFrame:
    """Of every question the outcome and the context of its supported candidates' evidence (`ranking.contexts`).

    chunks may have source_filename and page_label; questions: question_id, text, query.
    """
    hits, wanted, best = evidence(chunks, questions, k, metric)
    found = written(supported(hits, wanted, best), "question-answers")
    label = F.struct("place", "condition")
    labels = best.groupBy("question_id", "candidate_id").agg(F.transform(F.array_sort(F.collect_list(label)), lambda x: x["condition"]).alias("labels"))
    found = found.join(labels, ["question_id", "candidate_id"], "left")
    proven = best.groupBy("question_id", "candidate_id", "chunk_id").agg(F.collect_list(F.struct(F.col("condition").alias("key"), "weight", "kind")).alias("conditions"))
    pool = hits.join(found.select("question_id", "candidate_id"), ["question_id", "candidate_id"], "left_semi")
    chosen = ranking.select_evidence(pool.join(proven, ["question_id", "candidate_id", "chunk_id"], "left"), question=ID)
    given = {c: F.lit(None).cast("string") for c in ("source_filename", "page_label") if c not in hits.columns}
    texts = hits.withColumns(given).select("question_id", "chunk_id", "text", "section_name", "source_filename", "page_label")
    return ranking.contexts(questions, found, chosen.join(texts, ["question_id", "chunk_id"]), **budget)
