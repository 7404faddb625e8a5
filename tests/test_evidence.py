"""Behaviour vectors of the evidence scores."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import vectors
from lodestone.operators import evidence as E
from lodestone.plans import questions as Q


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("text", "value", "want"),
    [
        ("Managed a team of 8 engineers.", 8, 1.0),
        ("Supervised eight employees across two sites", 8, 1.0),
        ("Team leadership: 8 people", 8, 1.0),
        ("8 direct reports", 8, 1.0),
        ("Team size: 8 members", 8, 1.0),
        ("Led eight developers", 8, 1.0),
        ("Led the platform for 8 years with a team", 8, 0.0),
        ("Managed 6 engineers and delivered 8 projects", 8, 0.0),
        ("Phone 8 8 8. Managed engineers", 8, 0.0),
        ("Managed more than 8 engineers", 8, 0.0),
        ("8 engineers attended", 8, 0.0),
        ("Led a team. 8 people came", 8, 0.0),
    ],
)
def test_team_size(spark, text, value, want):
    assert one(spark, E.numeric(T.clauses(F.lit(text)), float(value), "eq", "team_size")) == want


@pytest.mark.parametrize(("op", "text", "want"), [("gte", "9 cloud projects", 1.0), ("gt", "8 cloud projects", 0.0), ("lte", "over 5 cloud projects", 0.0), ("lt", "7 cloud projects", 1.0), ("eq", "Room 8", 0.1), ("eq", "Room 9", 0.0)])
def test_generic_number(spark, op, text, want):
    assert one(spark, E.numeric(T.clauses(F.lit(text)), 8.0, op, "generic", ["cloud", "project"])) == want


def test_operator_words_are_substrings_in_order(spark):
    clause = F.array(*map(F.lit, ["no", "more", "than", "5"]))
    assert one(spark, E.operator_before(clause, F.lit(3))) == "gt"
    clause = F.array(*map(F.lit, ["discovered", "5"]))
    assert one(spark, E.operator_before(clause, F.lit(1))) == "gt"


@pytest.mark.parametrize(("text", "want"), [("German (native), English (fluent)", True), ("Native speaker of German", True), ("German clients; cloud-native stack", False), ("Cloud-native German", False)])
def test_language_relation(spark, text, want):
    assert one(spark, E.language_relation(T.clauses(F.lit(text)), "german", "native")) is want


def test_lexical_and_combined(spark):
    terms = T.canonical_terms(F.lit("Python services and SQL"))
    assert one(spark, E.lexical(terms, F.lit(""), ["python", "sql"])) == 1.0
    assert one(spark, E.combined(F.lit(0.5), F.lit(1.0))) == pytest.approx(0.65)
    assert one(spark, E.combined(F.lit(0.5), F.lit(1.0), F.lit(1.0))) == pytest.approx(0.8)


@pytest.mark.parametrize(("metric", "d", "want"), [("cosine", 0.25, 0.75), ("ip", 0.25, 0.75), ("l2", 3.0, 0.25), ("cosine", 4.0, 0.0)])
def test_relevance(spark, metric, d, want):
    assert one(spark, vectors.relevance(F.lit(d), metric)) == want


def test_text_scalars_agree_with_the_question_side(spark):
    samples = ["Leaders' teams: C++, C# and .NET—naïve Straße résumés", "Accessible companies; natively 4.5 years", "", "node.js/React (ÀÉÎ)"]
    for s in samples:
        assert one(spark, T.normalized(F.lit(s))) == Q.normalize(s)
        assert one(spark, T.canonical_terms(F.lit(s))) == [c for c in map(Q.canonical, Q.normalize(s).split()) if c]


def test_clause_split_takes_a_point_as_an_end(spark):
    assert one(spark, T.clauses(F.lit("4.5 years in node.js"))) == [["4"], ["5", "years", "in", "node"], ["js"]]


def test_helpers(spark):
    t = F.array(*map(F.lit, "a b c d".split()))
    assert one(spark, T.contains_sequence(t, ["b", "c"])) is True
    assert one(spark, T.contains_sequence(t, ["b", "d"])) is False
    assert one(spark, T.ordered_subsequence(t, ["a", "d"])) is True
    assert one(spark, T.ordered_subsequence(t, ["d", "a"])) is False
    assert one(spark, T.truncate(F.lit("one  two three"), 9)) == "one tw..."
    assert one(spark, T.number(F.lit("ninety"))) == 90.0
    assert one(spark, T.slug(F.lit("José  Núñez!"))) == "jose-nunez"
    assert one(spark, T.window(t, F.lit(0), 1)) == ["a", "b"]


def test_questions():
    q = Q.analyze("Which candidates have managed at least 8 engineers and speak German natively?")
    assert [(n.value, n.operator, n.relation) for n in q.numbers] == [(8.0, "gte", "team_size")]
    assert ("german", "native") in q.languages
    kinds = {c.kind for c in Q.conditions(q)}
    assert {"numeric", "relation"} <= kinds
    assert Q.analyze("MSc in computer science").education == (("master_science", ("computer", "science")),)
    assert Q.analyze("teams in Berlin").education
    assert not Q.analyze("teams in Berlin", strict=True).education
    assert [n.operator for n in Q.analyze("5+ years of experience").numbers] == ["gte"]
    assert Q.conditions(Q.analyze("Does Ada Lovelace know Python?"), ["Ada Lovelace"])[0].kind == "identity"
    assert Q.conditions(Q.analyze("who is the")) == []
