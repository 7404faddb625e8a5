"""Answer sources and the checks of citations against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def source_id(candidate: Column, order: Column) -> Column:
    return F.concat(candidate.cast("string"), F.lit("-source-"), order.cast("string"))


def citation_problems(citations: DataFrame, sources: DataFrame, required: DataFrame) -> DataFrame:
    """(candidate_id, source_id, problem): unknown or another candidate's source,
    a source cited twice, and required labels that no cited source supports.

    citations: candidate_id, source_id; sources: source_id, owner, label;
    required: candidate_id, label.
    """
    known = sources.select("source_id", "owner").distinct()
    met = citations.join(known, "source_id", "left")
    bad = met.where("owner IS NULL").select("candidate_id", "source_id", F.lit("unknown_source").alias("problem"))
    cross = met.where("owner <> candidate_id").select("candidate_id", "source_id", F.lit("other_candidate").alias("problem"))
    twice = citations.groupBy("candidate_id", "source_id").count().where("count > 1").select("candidate_id", "source_id", F.lit("repeated").alias("problem"))
    proven = citations.join(sources, "source_id").where("owner = candidate_id").select("candidate_id", "label").distinct()
    gaps = required.join(proven, ["candidate_id", "label"], "left_anti").select("candidate_id", F.col("label").alias("source_id"), F.lit("uncovered_label").alias("problem"))
    return bad.union(cross).union(twice).union(gaps)


def default_citations(sources: DataFrame) -> DataFrame:
    """Per candidate its directly supporting sources, else its first."""
    direct = F.filter(F.array_sort(F.collect_list(F.struct("place", "source_id", "direct"))), lambda x: x["direct"])
    first = F.min_by("source_id", "place")
    return sources.groupBy("candidate_id").agg(direct.alias("d"), first.alias("f")).select("candidate_id", F.when(F.size("d") > 0, F.array_join(F.transform("d", lambda x: x["source_id"]), ",")).otherwise(F.col("f")).alias("cited"))


def draft(name: Column, outcome: Column, n: Column) -> Column:
    """Deterministic wording of a candidate's line."""
    return F.when(outcome == "supported", F.concat(name, F.lit(" meets all "), n.cast("string"), F.lit(" requirements."))).when(outcome == "partial", F.concat(name, F.lit(" meets "), n.cast("string"), F.lit(" of the requirements."))).otherwise(F.lit("No candidate is supported by the evidence."))


def presented(ranked: DataFrame, cited: DataFrame, sources: DataFrame) -> DataFrame:
    """Ranked candidates with the sources cited for them, in order (candidate_id; candidate_id, source_id; source_id, place, page_label)."""
    own = cited.join(sources, "source_id").groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct("place", "source_id", "page_label"))).alias("sources"))
    return ranked.join(own, "candidate_id", "left").withColumn("first_page", F.regexp_extract(F.get("sources", 0)["page_label"], r"^\d+", 0))


def draft_problems(draft: DataFrame, ranked: DataFrame, most: int = 2000) -> DataFrame:
    """(candidate_id, problem) of a drafted answer (candidate_id, place, text): unknown, missing, out of order, empty or long."""
    met = draft.join(ranked.select("candidate_id", "final_rank"), "candidate_id", "full_outer")
    checks = F.array(
        F.when(F.col("final_rank").isNull(), "unknown_candidate"),
        F.when(F.col("place").isNull(), "missing_candidate"),
        F.when(F.col("place") != F.col("final_rank"), "out_of_order"),
        F.when(F.col("place").isNotNull() & (F.coalesce(F.length(F.trim("text")), F.lit(0)) == 0), "empty"),
        F.when(F.length("text") > most, "too_long"),
    )
    return met.select("candidate_id", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("problem"))


def sources(evidence: DataFrame, labels: DataFrame) -> DataFrame:
    """Evidence (candidate_id, place, chunk_id, keys: of the conditions that it proves) as sources: with
    source_id and supports, the labels of its keys in their order; a key without a label (key, label) is left out."""
    rows = evidence.withColumn("source_id", source_id(F.col("candidate_id"), F.col("place")))
    said = rows.select("source_id", F.posexplode("keys").alias("i", "key")).join(labels.select("key", "label"), "key")
    supports = said.groupBy("source_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "label"))), lambda x: x["label"]).alias("supports"))
    return rows.join(supports, "source_id", "left").withColumn("supports", F.coalesce("supports", F.array().cast("array<string>")))


def answer_problems(answers: DataFrame, cited: DataFrame, sources: DataFrame, expected: DataFrame) -> DataFrame:
    """(question_id, subject, problem) of whole answers: citations where nothing is supported, none where
    something is, unknown sources, and returned candidates without a citation.

    answers: question_id, outcome; cited: question_id, source_id; sources: question_id,
    source_id, owner; expected: question_id, candidate_id.
    """
    met = cited.join(answers, "question_id").join(sources.select("question_id", "source_id", "owner").distinct(), ["question_id", "source_id"], "left")
    none = F.lit(None).cast("string")
    open_ = answers.where("outcome <> 'unsupported'")
    idle = met.where("outcome = 'unsupported'").select("question_id", none.alias("subject"), F.lit("citation_when_unsupported").alias("problem")).distinct()
    bare = open_.join(cited.select("question_id"), "question_id", "left_anti").select("question_id", none, F.lit("no_citation"))
    unknown = met.where("outcome <> 'unsupported' AND owner IS NULL").select("question_id", "source_id", F.lit("unknown_answer_source")).distinct()
    named = met.where("owner IS NOT NULL").select("question_id", F.col("owner").alias("candidate_id")).distinct()
    left = expected.distinct().join(open_.select("question_id"), "question_id", "left_semi").join(named, ["question_id", "candidate_id"], "left_anti")
    return idle.union(bare).union(unknown).union(left.select("question_id", "candidate_id", F.lit("missing_candidate")))


def referenced(answers: DataFrame, *columns: str) -> DataFrame:
    """(question_id, source_id): the different sources that any of the array columns names."""
    every = F.flatten(F.array(*(F.coalesce(F.col(c), F.array().cast("array<string>")) for c in columns)))
    return answers.select("question_id", F.explode(every).alias("source_id")).distinct()


#: The wording of an answer that no model writes.
IDENTIFIES = "The indexed CV evidence identifies {names} as {subject} with complete coverage of the supported requirements."
PARTIAL = "No candidate has complete coverage. The indexed evidence identifies these high-confidence partial matches: {names}."
NOBODY = "I could not identify any candidate with sufficiently supported evidence for this question in the indexed CV collection."


def _said(form: str, **parts: Column) -> Column:
    pieces = form.replace("{", "\x00{").replace("}", "\x00").split("\x00")
    return F.concat(*(parts[p[1:]] if p[:1] == "{" else F.lit(p) for p in pieces if p))


def templated(questions: DataFrame, found: DataFrame, limitations: dict[str, str]) -> DataFrame:
    """An answer to every question (question_id) in fixed words, from the candidates found for it.

    found: question_id, final_rank, candidate_id, candidate_name, professional_title,
    outcome, labels and citations (arrays). Returns question_id, outcome, answer,
    answer_citations (each once, in order), candidates (array of struct, in order, with an
    assessment each) and limitations (what an outcome but `supported` says of itself).
    """
    level = F.when(F.col("outcome") == "supported", "Complete match").otherwise("Partial match")
    name = F.coalesce("candidate_name", F.lit("Unknown candidate"))
    assessed = F.concat(level, F.lit(": the indexed CV evidence supports "), F.array_join("labels", ", "), F.lit("."))
    one = F.struct("final_rank", "candidate_id", name.alias("candidate_name"), F.coalesce("professional_title", F.lit("Unknown title")).alias("professional_title"), assessed.alias("assessment"), F.col("labels").alias("matched_requirements"), "citations")
    per = found.groupBy("question_id").agg(F.min("outcome").alias("outcome"), F.array_sort(F.collect_list(one)).alias("candidates"))
    df = questions.select("question_id").join(per, "question_id", "left").withColumn("outcome", F.coalesce("outcome", F.lit("unsupported")))
    names = F.array_join(F.transform("candidates", lambda c: c["candidate_name"]), ", ")
    subject = F.when(F.size("candidates") == 1, "a candidate").otherwise("candidates")
    answer = F.when(F.col("outcome") == "supported", _said(IDENTIFIES, names=names, subject=subject)).when(F.col("outcome") == "partial", _said(PARTIAL, names=names)).otherwise(NOBODY)
    cited = F.coalesce(F.array_distinct(F.flatten(F.transform("candidates", lambda c: c["citations"]))), F.array().cast("array<string>"))
    says = F.create_map(*(F.lit(x) for pair in limitations.items() for x in pair))
    short = F.when(F.col("outcome") == "supported", F.array().cast("array<string>")).otherwise(F.array(says[F.col("outcome")]))
    return df.select("question_id", "outcome", answer.alias("answer"), cited.alias("answer_citations"), "candidates", short.alias("limitations"))
