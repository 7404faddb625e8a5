import pytest

from lodestone.operators import answers, profile_checks, ranking


def test_answers_in_fixed_words(spark):
    found = [
        (1, 2, "k2", None, None, "supported", ["a", "b"], ["k2-source-1"]), (1, 1, "k1", "Ada L", "Engineer", "supported", ["a", "b"], ["k1-source-1", "k1-source-2"]),
        (2, 1, "k1", "Ada L", "Engineer", "supported", ["a"], ["k1-source-1"]), (3, 1, "k3", "Alan T", None, "partial", ["b"], ["k3-source-1", "k3-source-1"]),
    ]
    df = spark.createDataFrame(found, "question_id long, final_rank int, candidate_id string, candidate_name string, professional_title string, outcome string, labels array<string>, citations array<string>")
    questions = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "question_id long")
    got = {r.question_id: r for r in answers.templated(questions, df, ranking.SAYS).collect()}
    assert got[1].answer == "The indexed CV evidence identifies Ada L, Unknown candidate as candidates with complete coverage of the supported requirements."
    assert got[1].answer_citations == ["k1-source-1", "k1-source-2", "k2-source-1"] and got[1].limitations == []
    assert [c.assessment for c in got[1].candidates] == ["Complete match: the indexed CV evidence supports a, b."] * 2
    assert got[1].candidates[1].professional_title == "Unknown title"
    assert "identifies Ada L as a candidate with" in got[2].answer
    assert got[3].answer == "No candidate has complete coverage. The indexed evidence identifies these high-confidence partial matches: Alan T."
    assert got[3].answer_citations == ["k3-source-1"] and got[3].limitations == [ranking.SAYS["partial"]]
    assert (got[4].outcome, got[4].answer, got[4].answer_citations, got[4].candidates, got[4].limitations) == ("unsupported", answers.NOBODY, [], None, [ranking.SAYS["unsupported"]])


def test_plans_that_name_ids_twice_over(spark):
    rows = [("good", ["a", "b"], 2, ["a", "b"]), ("count", ["a"], 2, ["a"]), ("order", ["b", "a"], 2, ["a", "b"]), ("twice", ["a", "a"], 2, ["a"]), ("sides", ["a", "b"], 2, ["b", "c"]), ("none", None, 0, None)]
    df = spark.createDataFrame(rows, "id string, planned array<string>, n int, described array<string>")
    got = {}
    for r in profile_checks.list_problems(df, "id", "planned", "n", "described").collect():
        got.setdefault(r.id, set()).add(r.problem)
    assert got == {"count": {"wrong_count"}, "order": {"unordered_planned"}, "twice": {"repeated_planned"}, "sides": {"not_described", "not_planned"}}


def test_both_sides_of_a_plan(spark):
    plan = spark.createDataFrame([("k2", 2), ("k1", 1)], "candidate_id string, job int")
    told = spark.createDataFrame([("k1", "x"), ("k2", "y")], "candidate_id string, looks string")
    assert [tuple(r) for r in profile_checks.described_plan(plan, told, "candidate_id").collect()] == [("k1", 1, "x"), ("k2", 2, "y")]
    with pytest.raises(ValueError, match="k2 .1 planned, 0 described"):
        profile_checks.described_plan(plan, told.where("candidate_id = 'k1'"), "candidate_id")
    with pytest.raises(ValueError, match="k1 .1 planned, 2 described"):
        profile_checks.described_plan(plan, told.union(told), "candidate_id")
