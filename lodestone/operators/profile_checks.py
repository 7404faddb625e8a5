"""Checks of nested candidate profiles and of a dataset plan, as problem rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.quality import missing_and_unexpected, month_index, problems, repeats_earlier

#: Bounds of a profile.
SENIORITY = {"junior": (0, 4), "mid": (2, 10), "senior": (5, 50)}
YEARS, TEAM = (0, 50), (1, 100)
ID = r"^candidate_\d{3}$"
MONTH = r"^\d{4}-(0[1-9]|1[0-2])$"

PROFILE = (
    "candidate_id string, full_name string, seniority string, years_of_experience double, summary string, "
    "work_experience array<struct<job_title:string,company:string,start_date:string,end_date:string,managed_team_size:int>>, "
    "skills array<struct<name:string,years_of_experience:double>>, languages array<struct<name:string,proficiency:string>>"
)


def no_repeats(items: Column) -> Column:
    """No two items that agree but for case and white space."""
    keys = F.transform(items, T.squeeze)
    return F.size(F.array_distinct(keys)) == F.size(keys)


def newest_first(dates: Column) -> Column:
    return dates == F.reverse(F.array_sort(dates))


def profile_problems(profiles: DataFrame) -> DataFrame:
    """Field bounds, uniqueness in lists and agreement between fields."""
    years, jobs = F.col("years_of_experience"), F.col("work_experience")
    lo = F.create_map(*(F.lit(x) for k, (a, _) in SENIORITY.items() for x in (k, float(a))))
    hi = F.create_map(*(F.lit(x) for k, (_, b) in SENIORITY.items() for x in (k, float(b))))
    checks = {
        "candidate_id": F.col("candidate_id").rlike(ID),
        "full_name": F.length(F.trim("full_name")) > 0,
        "years": years.between(*YEARS),
        "seniority_years": years.between(F.try_element_at(lo, F.col("seniority")), F.try_element_at(hi, F.col("seniority"))),
        "months": F.forall(jobs, lambda j: j.start_date.rlike(MONTH) & (j.end_date.isNull() | j.end_date.rlike(MONTH))),
        "end_before_start": F.forall(jobs, lambda j: j.end_date.isNull() | (j.end_date >= j.start_date)),
        "current_roles": F.size(F.filter(jobs, lambda j: j.end_date.isNull())) <= 1,
        "team_size": F.forall(jobs, lambda j: j.managed_team_size.isNull() | j.managed_team_size.between(*TEAM)),
        "newest_first": newest_first(F.transform(jobs, lambda j: j.start_date)),
        "skills_repeat": no_repeats(F.transform("skills", lambda s: s["name"])),
        "skill_years": F.forall("skills", lambda s: s.years_of_experience.isNull() | (s.years_of_experience <= years)),
        "languages_repeat": no_repeats(F.transform("languages", lambda s: s["name"])),
    }
    return problems(profiles, "candidate_id", checks)


def slot_problems(profiles: DataFrame, slots: DataFrame) -> DataFrame:
    """What a profile lacks of its slot (candidate_id, required_skills, languages, leadership_team_size), and ids on one side only."""
    met = slots.alias("s").join(profiles.alias("p"), "candidate_id")
    skills = F.transform("p.skills", lambda s: T.squeeze(s["name"]))
    spoken = F.transform("p.languages", lambda x: F.concat(T.squeeze(x["name"]), F.lit(":"), T.squeeze(x.proficiency)))
    wanted = F.transform("s.languages", lambda x: F.concat(T.squeeze(x["name"]), F.lit(":"), T.squeeze(x.proficiency)))
    checks = {
        "required_skills": F.size(F.array_except(F.transform("s.required_skills", T.squeeze), skills)) == 0,
        "languages": F.size(F.array_except(wanted, spoken)) == 0,
        "leadership": F.col("s.leadership_team_size").isNull() | F.exists("p.work_experience", lambda j: j.managed_team_size == F.col("s.leadership_team_size")),
    }
    one_sided = missing_and_unexpected(slots, profiles, "candidate_id").select("candidate_id", "problem")
    return problems(met, "candidate_id", checks).union(one_sided)


def experience(profiles: DataFrame, cutoff: str = "2026-07") -> DataFrame:
    """Role intervals in months, current ones ending at the cut-off; for merged_months."""
    j = F.explode("work_experience")
    rows = profiles.select("candidate_id", j.alias("j"))
    end = F.least(month_index(F.coalesce("j.end_date", F.lit(cutoff))), month_index(F.lit(cutoff)))
    return rows.select("candidate_id", month_index(F.col("j.start_date")).alias("start"), end.alias("end"))


def collection_repeats(profiles: DataFrame) -> DataFrame:
    """Profiles that repeat an earlier one's name, summary or work history."""
    work = F.array_join(F.transform("work_experience", lambda j: F.concat_ws("|", T.squeeze(j.company), T.squeeze(j.job_title), j.start_date)), ";")
    return repeats_earlier(profiles, "candidate_id", {"name": T.squeeze(F.col("full_name")), "summary": T.squeeze(F.col("summary")), "work": work})


def phrase_hits(rows: DataFrame, key: str, text: Column, phrases: list[str]) -> DataFrame:
    """(key, phrase) wherever a forbidden phrase occurs."""
    n = T.word_text(text)
    found = F.filter(F.array(*(F.when(F.contains(n, F.lit(p)), F.lit(p)) for p in phrases)), lambda x: x.isNotNull())
    return rows.select(key, F.explode(found).alias("phrase"))


def scenario_gaps(scenarios: DataFrame, evidence: DataFrame) -> DataFrame:
    """(scenario_id, candidate_id, evidence) that no document of the candidate proves.

    scenarios: scenario_id, candidates (array), required (array); evidence: candidate_id, text.
    """
    need = scenarios.select("scenario_id", F.explode("candidates").alias("candidate_id"), "required").withColumn("evidence", F.explode("required")).drop("required")
    met = need.join(evidence, "candidate_id").where(F.contains(T.word_text(F.col("text")), T.word_text(F.col("evidence")))).select("scenario_id", "candidate_id", "evidence").distinct()
    return need.join(met, ["scenario_id", "candidate_id", "evidence"], "left_anti")


def report(*parts: tuple[str, DataFrame, str]) -> DataFrame:
    """Counts of problems per check: (check, frame, problem column)."""
    each = [df.groupBy(F.lit(name).alias("check"), F.col(column).alias("problem")).count() for name, df, column in parts]
    return reduce(DataFrame.union, each)


def list_problems(plans: DataFrame, key: str, planned: str, count: str, described: str) -> DataFrame:
    """(key, problem) of plans that name ids twice over, in the arrays planned and described: a wrong
    count, repeats, ids out of order, and ids on one side only; a null array is empty."""
    ids = {"planned": F.coalesce(planned, F.array().cast("array<string>")), "described": F.coalesce(described, F.array().cast("array<string>"))}
    checks = [F.when(~F.size(ids["planned"]).eqNullSafe(F.col(count)), "wrong_count")]
    for name, x in ids.items():
        checks += [F.when(F.size(F.array_distinct(x)) < F.size(x), f"repeated_{name}"), F.when(F.array_sort(x) != x, f"unordered_{name}")]
    checks += [F.when(F.size(F.array_except(ids["planned"], ids["described"])) > 0, "not_described"), F.when(F.size(F.array_except(ids["described"], ids["planned"])) > 0, "not_planned")]
    return plans.select(key, F.explode(F.filter(F.array(*checks), lambda p: p.isNotNull())).alias("problem"))


def described_plan(planned: DataFrame, described: DataFrame, key: str) -> DataFrame:
    """The planned rows with what describes each, in order of the key; an error if either side has a key
    that the other lacks, or a key twice."""
    sides = planned.select(key, F.lit("planned").alias("side")).unionByName(described.select(key, F.lit("described").alias("side")))
    counts = sides.groupBy(key).agg(F.count_if(F.col("side") == "planned").alias("p"), F.count_if(F.col("side") == "described").alias("d"))
    wrong = counts.where("p != 1 OR d != 1").orderBy(key).head(5)
    if wrong:
        raise ValueError("plan and descriptions differ: " + ", ".join(f"{r[0]} ({r['p']} planned, {r['d']} described)" for r in wrong))
    return planned.join(described, key).orderBy(key)
