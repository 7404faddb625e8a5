"""Candidate ranking: conditions, coverage, support gate, evidence and budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.functions.text import clamp

#: Fixed values of the support gate and of the context budget.
FULL_SCORE, PART_SCORE, PART_COVERAGE = 0.45, 0.30, 0.65
MOST_CHUNKS, MOST_CHARS, MOST_EVIDENCE, LEAST_LEFT = 12, 7000, 900, 40


def best_matches(scored: DataFrame) -> DataFrame:
    """The best hit per (candidate, condition) of rows with a positive strength.

    scored: candidate_id, condition, weight, chunk_id, strength, combined,
    semantic, rank.
    """
    order = F.struct("strength", "combined", "semantic", (-F.col("rank")).alias("r"))
    out = scored.where("strength > 0").groupBy("candidate_id", "condition", "weight").agg(F.max(order).alias("m"), F.max_by("chunk_id", order).alias("chunk_id"))
    return out.select("candidate_id", "condition", "weight", "chunk_id", F.col("m.strength").alias("strength"), (-F.col("m.r")).alias("rank"))


def conflicts(hits: DataFrame) -> DataFrame:
    """Candidates whose chunks disagree on name or title: (candidate_id, n_names, n_titles)."""
    n = hits.groupBy("candidate_id").agg(F.countDistinct("candidate_name").alias("n_names"), F.countDistinct("professional_title").alias("n_titles"))
    return n.where("n_names > 1 OR n_titles > 1")


def reject_conflicts(hits: DataFrame) -> None:
    """An error if one candidate has two names or titles in its chunks."""
    if bad := conflicts(hits).orderBy("candidate_id").head(1):
        raise ValueError(f"candidate {bad[0]['candidate_id']} has conflicting names or titles")


def steady_sum(x: Column) -> Column:
    """A sum of a group's few numbers in one order, so that equal numbers have equal sums."""
    return F.aggregate(F.array_sort(F.collect_list(x)), F.lit(0.0), lambda a, b: a + b)


def candidates(hits: DataFrame, matches: DataFrame, total_weight: float, n_conditions: int, limit: int = 15) -> DataFrame:
    """Candidates by score: coverage, quality and semantic support, each in [0, 1]."""
    base = hits.groupBy("candidate_id").agg(F.max("semantic").alias("semantic_support"), F.max("combined").alias("best_combined"), F.min("rank").alias("best_rank"), F.count("*").alias("n_hits"))
    got = matches.groupBy("candidate_id").agg(steady_sum(F.col("weight")).alias("w"), steady_sum(F.col("weight") * F.col("strength")).alias("q"), F.count("*").alias("n_matched"))
    df = base.join(got, "candidate_id", "left").fillna(0, ["w", "q", "n_matched"])
    if n_conditions:
        df = df.withColumn("coverage", clamp(F.col("w") / total_weight)).withColumn("quality", clamp(F.col("q") / total_weight))
        score = 0.55 * F.col("coverage") + 0.30 * F.col("quality") + 0.15 * F.col("semantic_support")
    else:
        df = df.withColumn("coverage", F.lit(0.0)).withColumn("quality", F.lit(0.0))
        score = 0.75 * F.col("best_combined") + 0.25 * F.col("semantic_support")
    df = df.withColumn("score", clamp(score)).drop("w", "q", "best_combined")
    top = df.orderBy(F.desc("score"), F.desc("coverage"), F.desc("quality"), F.desc("semantic_support"), "best_rank", "candidate_id").limit(limit)
    order = W.orderBy(F.desc("score"), F.desc("coverage"), F.desc("quality"), F.desc("semantic_support"), "best_rank", "candidate_id")
    return top.withColumn("candidate_rank", F.row_number().over(order))


def support(ranked: DataFrame, n_conditions: int, question: list[str] = ()) -> DataFrame:
    """Complete candidates, else partial ones, with the question's outcome."""
    full = (F.col("n_matched") == n_conditions) & (F.col("score") >= FULL_SCORE) & F.lit(n_conditions > 0)
    part = (F.col("n_matched") >= 1) & (F.col("coverage") >= PART_COVERAGE) & (F.col("score") >= PART_SCORE)
    any_full = F.max(F.col("full")).over(W.partitionBy(*(question or [F.lit(1)])))
    kept = ranked.withColumn("full", full).withColumn("part", part).withColumn("any_full", any_full)
    kept = kept.where("full OR (part AND NOT any_full)")
    return kept.withColumn("outcome", F.when(F.col("any_full"), "supported").otherwise("partial")).drop("full", "part", "any_full")


def select_evidence(hits: DataFrame, limit: int = 4, question: list[str] = ()) -> DataFrame:
    """A few chunks per candidate that cover its conditions, heaviest gain first;
    free places go to the strongest others unless all matches are structured.

    hits: candidate_id, chunk_id, combined, semantic, rank, conditions (array of
    struct key, weight, kind), and the columns of question. A candidate's hits are
    bounded by the pool; they are folded with the open conditions as the state.
    """
    none = F.array().cast("array<struct<key: string, weight: double, kind: string>>")
    given = F.coalesce("conditions", none)
    hit = F.struct(F.lit(0.0).alias("gain"), "combined", "semantic", (-F.col("rank")).alias("r"), "chunk_id", given.alias("conditions"))
    rows = hits.groupBy(*question, "candidate_id").agg(F.collect_list(hit).alias("rest"))
    keys = lambda c: F.transform(c, lambda x: x["key"])
    every = F.flatten(F.transform("rest", lambda x: x["conditions"]))

    def with_gain(x: Column, left: Column) -> Column:
        gain = F.aggregate(x["conditions"], F.lit(0.0), lambda a, c: a + F.when(F.array_contains(left, c["key"]), c["weight"]).otherwise(0.0))
        return F.struct(gain.alias("gain"), *(x[c].alias(c) for c in ("combined", "semantic", "r", "chunk_id", "conditions")))

    def step(state: Column, _: Column) -> Column:
        # The best hit by gain, then strength; a struct's fields compare in their order.
        best = F.array_max(F.transform(state["rest"], lambda x: with_gain(x, state["left"])))
        helps = F.coalesce(F.arrays_overlap(keys(best["conditions"]), state["left"]), F.lit(False))
        return F.when(helps, F.struct(
            F.array_except(state["left"], keys(best["conditions"])).alias("left"),
            F.filter(state["rest"], lambda x: x["chunk_id"] != best["chunk_id"]).alias("rest"),
            F.concat(state["chosen"], F.array(best)).alias("chosen"),
        )).otherwise(state)

    start = F.struct(F.array_distinct(keys(every)).alias("left"), F.col("rest"), F.slice("rest", 1, 0).alias("chosen"))
    done = rows.withColumn("kinds", F.transform(every, lambda c: c["kind"])).withColumn("s", F.aggregate(F.sequence(F.lit(1), F.lit(limit)), start, step))
    free = (F.size("kinds") == 0) | F.array_contains("kinds", "term")
    others = F.slice(F.sort_array(F.col("s.rest"), asc=False), 1, F.greatest(limit - F.size("s.chosen"), F.lit(0)))
    chosen = F.concat("s.chosen", F.when(free, others).otherwise(F.slice("rest", 1, 0)))
    out = done.select(*question, "candidate_id", F.posexplode(chosen).alias("i", "x"))
    return out.select(*question, "candidate_id", "x.chunk_id", (F.col("i") + 1).cast("long").alias("evidence_order"), F.array_join(F.array_sort(keys(F.col("x.conditions"))), ",").alias("condition_keys"))


def within_budget(evidence: DataFrame, order: list[Column], most_chunks: int = MOST_CHUNKS, most_chars: int = MOST_CHARS, most_text: int = MOST_EVIDENCE, question: list[str] = ()) -> DataFrame:
    """Evidence in order while count and characters last; the last is cut to what is left, or dropped if under LEAST_LEFT."""
    w = W.partitionBy(*(question or [F.lit(1)])).orderBy(*order)
    size = F.least(F.length("text"), F.lit(most_text))
    df = evidence.withColumn("place", F.row_number().over(w)).withColumn("before", F.coalesce(F.sum(size).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    left = F.lit(most_chars) - F.col("before")
    used = F.least(size, left)
    df = df.where(F.col("place") <= most_chunks).withColumn("used_chars", used)
    return df.where((F.col("used_chars") == size) | (F.col("used_chars") >= LEAST_LEFT)).drop("before")


#: How a context is written, and what it says of its outcome.
SAYS = {
    "supported": "One or more candidates have complete source-backed coverage of the parsed recruiter requirements.",
    "partial": "No candidate has complete coverage; the context contains only high-confidence partial matches and must be described as partial.",
    "unsupported": "The indexed CV collection does not contain sufficiently supported evidence for this question.",
    "exhausted": "Candidate evidence met scoring thresholds but could not fit within the configured final context budget.",
}
EVIDENCE_MARK, LEAST_HEAD, EVIDENCE_EACH = "\nEVIDENCE: ", 80, 4


def preamble(question: Column, outcome: Column, says: Column) -> Column:
    return F.concat(F.lit("QUESTION: "), question, F.lit("\nRETRIEVAL OUTCOME: "), outcome, F.lit("\nQUALITY BOUNDARY: "), says)


def contexts(questions: DataFrame, found: DataFrame, evidence: DataFrame, most_chunks: int = MOST_CHUNKS, most_chars: int = MOST_CHARS, most_text: int = MOST_EVIDENCE, each: int = EVIDENCE_EACH) -> DataFrame:
    """One context per question: its candidates in order, each with as much of its evidence as the budget holds.

    questions: question_id, text; found: question_id, final_rank, candidate_id,
    candidate_name, professional_title, score, coverage, outcome, labels (array);
    evidence: question_id, candidate_id, evidence_order, condition_keys, chunk_id, text,
    section_name, source_filename, page_label. Returns question_id, outcome,
    context_text, chunk_ids (of what it holds), n_candidates and budget_exhausted.

    The fold goes through candidates and, within each, evidence; its state is what
    the context holds so far. A chunk's text is cut to what is left, or ends the
    candidate if that is under LEAST_LEFT; a candidate that has no room ends the context.
    """
    first = F.when(F.col("condition_keys") == "", 1).otherwise(0).alias("bare")
    block = F.struct(first, "evidence_order", "chunk_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"), F.concat_ws(" | ", "source_filename", F.concat(F.lit("page "), F.coalesce("page_label", F.lit(""))), "section_name", "chunk_id").alias("source"), F.when(F.col("condition_keys") == "", "support-only").otherwise(F.regexp_replace("condition_keys", ",", ", ")).alias("supports"))
    blocks = evidence.groupBy("question_id", "candidate_id").agg(F.slice(F.array_sort(F.collect_list(block)), 1, each).alias("blocks"))
    level = F.when(F.col("outcome") == "supported", "complete").otherwise("partial")
    named = F.concat_ws(" | ", F.coalesce("candidate_name", F.lit("Unknown candidate")), F.coalesce("professional_title", F.lit("Unknown title")), "candidate_id")
    scored = F.concat(F.lit("\nSUPPORT: "), level, F.format_string(" | candidate_score=%.4f | coverage=%.4f", "score", "coverage"))
    header = F.concat(F.lit("CANDIDATE "), F.col("final_rank").cast("string"), F.lit(": "), named, scored, F.lit("\nMATCHED REQUIREMENTS: "), F.coalesce(F.nullif(F.array_join("labels", "; "), F.lit("")), F.lit("none")))
    entry = F.struct("final_rank", "candidate_id", header.alias("header"), F.coalesce("blocks", F.slice(F.array(F.lit(None).cast(blocks.schema["blocks"].dataType.elementType)), 1, 0)).alias("blocks"))
    per = found.join(blocks, ["question_id", "candidate_id"], "left").groupBy("question_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"), F.min("outcome").alias("outcome"))
    df = questions.select("question_id", F.col("text").alias("question")).join(per, "question_id", "left").withColumn("outcome", F.coalesce("outcome", F.lit("unsupported")))
    says = F.create_map(*(F.lit(x) for pair in SAYS.items() for x in pair))

    def add_block(c: Column, b: Column, whole: Column, n: Column) -> Column:
        head = F.concat(F.lit("SOURCE "), (F.size(c["ids"]) + 1).cast("string"), F.lit(": "), b["source"], F.lit("\nSUPPORTS: "), b["supports"], F.lit(EVIDENCE_MARK))
        room = F.least(F.lit(most_text), most_chars - F.length(whole) - 2 - F.length(c["text"]) - 1 - F.length(head))
        full = (n + F.size(c["ids"]) >= most_chunks) | (room < LEAST_LEFT)
        cut = F.when(F.length(b["text"]) > room, F.concat(F.rtrim(F.substring(b["text"], F.lit(1), room - 3)), F.lit("..."))).otherwise(b["text"])
        more = F.struct(F.concat(c["text"], F.lit("\n"), head, cut).alias("text"), F.concat(c["ids"], F.array(b["chunk_id"])).alias("ids"), F.lit(False).alias("full"))
        return F.when(c["full"], c).when(full, c.withField("full", F.lit(True))).otherwise(more)

    def add_candidate(s: Column, e: Column) -> Column:
        start = F.struct(e["header"].alias("text"), F.array().cast("array<string>").alias("ids"), F.lit(False).alias("full"))
        c = F.aggregate(e["blocks"], start, lambda c, b: add_block(c, b, s["text"], F.size(s["ids"])))
        no_room = (F.size(s["ids"]) >= most_chunks) | (most_chars - F.length(s["text"]) <= F.length(e["header"]) + LEAST_HEAD) | (F.size(c["ids"]) == 0)
        more = F.struct(F.concat(s["text"], F.lit("\n\n"), c["text"]).alias("text"), F.concat(s["ids"], c["ids"]).alias("ids"), (s["n"] + 1).alias("n"), (s["short"] | c["full"]).alias("short"), F.lit(False).alias("stop"))
        end = s.withField("stop", F.lit(True)).withField("short", F.lit(True))
        return F.when(s["stop"], s).when(no_room, end).otherwise(more)

    begin = F.struct(preamble(F.col("question"), F.col("outcome"), says[F.col("outcome")]).alias("text"), F.array().cast("array<string>").alias("ids"), F.lit(0).alias("n"), F.lit(False).alias("short"), F.lit(False).alias("stop"))
    df = df.withColumn("s", F.aggregate(F.coalesce("entries", F.slice(F.array(F.lit(None).cast(per.schema["entries"].dataType.elementType)), 1, 0)), begin, add_candidate))
    held = F.col("s.n") > 0
    why = F.when(F.col("outcome") == "unsupported", "unsupported").otherwise("exhausted")
    empty = F.substring(F.concat(preamble(F.col("question"), F.lit("unsupported"), says[why]), F.lit("\nCANDIDATES: none")), 1, most_chars)
    return df.select("question_id", F.when(held, F.col("outcome")).otherwise("unsupported").alias("outcome"), F.when(held, F.col("s.text")).otherwise(empty).alias("context_text"), F.col("s.ids").alias("chunk_ids"), F.col("s.n").alias("n_candidates"), F.coalesce(F.col("s.short"), F.lit(False)).alias("budget_exhausted"))
