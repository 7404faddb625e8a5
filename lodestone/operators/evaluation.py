"""Evaluation: result policies, paraphrase consistency and report totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def meets(policy: Column, expected: Column, returned: Column, least: Column) -> Column:
    """Whether the returned ids satisfy the policy and the least number."""
    missing = F.size(F.array_except(expected, returned)) == 0
    extra = F.size(F.array_except(returned, expected)) == 0
    ok = (
        F.when(policy == "exact", missing & extra)
        .when(policy == "contains_all", missing)
        .when(policy == "subset", extra)
        .when(policy == "any_of", F.arrays_overlap(expected, returned))
        .when(policy == "none", F.size(returned) == 0)
    )
    return F.coalesce(ok, F.lit(False)) & (F.size(returned) >= least)


def families(runs: DataFrame) -> DataFrame:
    """Per family: questions, passes, and whether outcomes and candidate sets agree."""
    ids = F.array_join(F.array_sort("returned"), ",")
    out = runs.groupBy("family").agg(F.count("*").alias("n_questions"), F.count_if("passed").alias("n_passed"), F.countDistinct("outcome").alias("n_outcomes"), F.countDistinct(ids).alias("n_sets"))
    return out.select("family", "n_questions", "n_passed", ((F.col("n_outcomes") == 1) & (F.col("n_sets") == 1)).alias("consistent"))


def traceable(evidence: DataFrame, contexts: DataFrame) -> DataFrame:
    """(question_id, source_traceable): every returned chunk belongs to its candidate, names its
    document, file, section and pages, and stands with its file's name in the question's context.

    evidence: question_id, returned_id, candidate_id, document_id, document_hash, source_filename,
    section_name, page_numbers (array), chunk_id; contexts: question_id, context.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    whole = F.coalesce(F.size("page_numbers") > 0, F.lit(False)) & (F.col("candidate_id") == F.col("returned_id"))
    for c in ("document_id", "document_hash", "source_filename", "section_name", "chunk_id"):
        whole = whole & said(c)
    inside = F.contains("context", "chunk_id") & F.contains("context", "source_filename")
    ok = F.coalesce(whole & inside, F.lit(False))
    return evidence.join(contexts, "question_id", "left").groupBy("question_id").agg(F.min(ok).alias("source_traceable"))


def scenarios(wanted: DataFrame, runs: DataFrame) -> DataFrame:
    """Each scenario with what is missing, what wasn't expected and whether it passed.

    wanted: scenario_id, expected (ids; none if nothing must be supported); runs:
    scenario_id, outcome, returned (ids), source_traceable, n_chars, most_chars,
    n_chunks, most_chunks. A scenario without a run failed.
    """
    ids = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    df = wanted.join(runs, "scenario_id", "left").withColumns({"expected": ids("expected"), "returned": ids("returned"), "outcome": F.coalesce("outcome", F.lit("error"))})
    df = df.withColumn("missing", F.array_except("expected", "returned")).withColumn("unexpected", F.array_except("returned", "expected"))
    within = F.coalesce((F.col("n_chars") <= F.col("most_chars")) & (F.col("n_chunks") <= F.col("most_chunks")), F.lit(False))
    right = F.when(F.size("expected") > 0, ~F.col("outcome").isin("unsupported", "error") & (F.size("missing") == 0)).otherwise((F.col("outcome") == "unsupported") & (F.size("returned") == 0))
    passed = right & F.coalesce("source_traceable", F.lit(False)) & within
    return df.select("scenario_id", "outcome", "missing", "unexpected", within.alias("budget_compliant"), passed.alias("passed"))


def totals(evaluated: DataFrame) -> DataFrame:
    """One row: how many scenarios, passed ones, failed ones, and by problem."""
    return evaluated.agg(
        F.count("*").alias("n_scenarios"), F.count_if("passed").alias("n_passed"), F.count_if(~F.col("passed")).alias("n_failed"), F.count_if(F.col("outcome") == "error").alias("n_errors"),
        F.count_if(F.size("missing") > 0).alias("n_with_missing"), F.count_if(~F.col("budget_compliant")).alias("n_over_budget"),
    )


def label_gaps(candidates: DataFrame, wanted: DataFrame, final: DataFrame) -> DataFrame:
    """(question_id, candidate_id, missing, selected): which of a question's condition labels a ranked
    candidate lacks, and whether it is among the final ones.

    candidates: question_id, candidate_id, labels (array); wanted: question_id, labels; final: question_id, candidate_id.
    """
    chosen = final.select("question_id", "candidate_id", F.lit(True).alias("selected")).distinct()
    df = candidates.join(wanted.select("question_id", F.col("labels").alias("wanted")), "question_id").join(chosen, ["question_id", "candidate_id"], "left")
    return df.select("question_id", "candidate_id", F.array_except("wanted", "labels").alias("missing"), F.coalesce("selected", F.lit(False)).alias("selected"))
