import pytest
from pyspark.sql import functions as F

from lodestone.operators import profile_checks as C
from lodestone.operators import profiles as P
from lodestone.operators.quality import merged_months


@pytest.fixture(scope="module")
def people(spark):
    job = lambda s, e, n=None, t="Engineer": (t, "Acme", s, e, n)
    rows = [
        ("candidate_001", "Ada L", "senior", 7.7, "Builds", [job("2022-01", None, 8), job("2018-12", "2021-12")], [("SQL", 5.0), ("Python", 7.0)], [("German", "native")]),
        ("candidate_002", "ada  l", "junior", 6.0, "Cooks", [job("2018-01", None), job("2020-01", None, 0)], [("SQL", 9.0), ("sql ", 1.0)], [("English", "fluent")]),
        ("nobody", "", "mid", 3.0, "builds", [job("2020-05", "2020-01"), job("20-01", None)], [], []),
    ]
    return spark.createDataFrame(rows, C.PROFILE)


def test_profile_problems(people):
    got = {}
    for r in C.profile_problems(people).collect():
        got.setdefault(r.candidate_id, set()).add(r.problem)
    assert got == {
        "candidate_002": {"seniority_years", "current_roles", "team_size", "newest_first", "skills_repeat", "skill_years"},
        "nobody": {"candidate_id", "full_name", "end_before_start", "months"},
    }


def test_slots(spark, people):
    slots = spark.createDataFrame([("candidate_001", ["sql"], [("German", "Native")], 8), ("candidate_002", ["Java"], [("English", "native")], 4), ("candidate_009", [], [], None)], "candidate_id string, required_skills array<string>, languages array<struct<name:string,proficiency:string>>, leadership_team_size int")
    got = sorted(map(tuple, C.slot_problems(people, slots).collect()))
    assert got == [("candidate_002", "languages"), ("candidate_002", "leadership"), ("candidate_002", "required_skills"), ("candidate_009", "missing"), ("nobody", "unexpected")]


def test_experience(people):
    years = {r.candidate_id: r.years for r in merged_months(C.experience(people.where("candidate_id LIKE 'candidate%'")), "candidate_id", "start", "end").collect()}
    assert years == {"candidate_001": 7.7, "candidate_002": 8.6}


def test_collection_repeats(people):
    got = {(r.id, r.first_id, r.signature) for r in C.collection_repeats(people).collect()}
    assert got == {("candidate_002", "candidate_001", "name"), ("nobody", "candidate_001", "summary")}


def test_report(people):
    p = C.profile_problems(people)
    assert {(r.check, r.problem): r["count"] for r in C.report(("profile", p, "problem")).collect()}["profile", "months"] == 1


def test_formatting(spark):
    row = spark.range(1).select(P.date_range(F.lit("2020-01"), F.lit(None).cast("string")).alias("a"), P.initials(F.lit("ada m lovelace")).alias("b"), P.initials(F.lit(" ")).alias("c"), P.years_label(F.lit(1.0)).alias("d"), P.years_label(F.lit(2.5)).alias("e"), P.title(F.lit("team_lead")).alias("f"), P.pick(["x", "y"], F.lit(3)).alias("g")).first()
    assert tuple(row) == ("Jan 2020 - Present", "AM", "CV", "1 year", "2.5 years", "Team Lead", "y")


def test_selected(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert [r.id for r in P.selected(rows, "id", 2, "b").collect()] == ["b", "c"]
    with pytest.raises(ValueError, match="only 1 remain"):
        P.selected(rows, "id", 2, "c")
