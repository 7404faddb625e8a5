"""Profiles as rows: formatting, facts, metrics, dates and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.functions.text import normalized
from lodestone.operators.quality import month_index, month_text


def month_label(s: Column) -> Column:
    """YYYY-MM as Mon YYYY; null stays null."""
    return F.date_format(F.to_date(F.concat(s, F.lit("-01"))), "MMM yyyy")


def date_range(start: Column, end: Column) -> Column:
    return F.concat(month_label(start), F.lit(" - "), F.coalesce(month_label(end), F.lit("Present")))


def years_label(n: Column) -> Column:
    s = F.when(n == F.floor(n), F.floor(n).cast("string")).otherwise(n.cast("string"))
    return F.concat(s, F.when(n == 1, " year").otherwise(" years"))


def initials(name: Column) -> Column:
    """First letters of the first two words, CV without any."""
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != "")
    return F.coalesce(F.nullif(F.array_join(F.transform(F.slice(words, 1, 2), lambda w: F.upper(F.substring(w, 1, 1))), ""), F.lit("")), F.lit("CV"))


def title(label: Column) -> Column:
    return F.initcap(F.replace(label, F.lit("_"), F.lit(" ")))


def pick(options: list[str], n: Column) -> Column:
    """One of a list by position modulo its length."""
    return F.get(F.array(*map(F.lit, options)), F.pmod(n, F.lit(len(options))).cast("int"))


def facts(rows: DataFrame, key: str, columns: list[str], lists: list[str] = ()) -> DataFrame:
    """(key, label, evidence) rows: one per scalar, one per list item; nulls left out."""
    scalars = F.array(*(F.struct(F.lit(c).alias("label"), F.col(c).cast("string").alias("evidence")) for c in columns))

    def items(c: str) -> Column:
        return F.transform(F.coalesce(c, F.array()), lambda x, i: F.struct(F.concat(F.lit(f"{c}_"), (i + 1).cast("string")).alias("label"), x.cast("string").alias("evidence")))

    return rows.select(key, F.inline(F.concat(scalars, *map(items, lists)))).where("evidence IS NOT NULL AND evidence <> ''")


def metrics(rows: DataFrame, key: str, texts: list[str], lists: list[str] = ()) -> DataFrame:
    """Characters of all texts and items, and the number of items."""
    chars = sum((F.coalesce(F.length(c), F.lit(0)) for c in texts), F.lit(0))
    for c in lists:
        chars = chars + F.aggregate(F.coalesce(c, F.array()), F.lit(0), lambda a, x: a + F.length(x))
    items = sum((F.coalesce(F.size(c), F.lit(0)) for c in lists), F.lit(0))
    return rows.select(key, chars.cast("long").alias("n_chars"), items.cast("long").alias("n_items"))


def rebuilt_dates(rows: DataFrame, key: str, position: str, months: str, end: str) -> DataFrame:
    """Roles' dates from their lengths, from the newest (position 1, ending at `end`) backwards without gaps."""
    w = W.partitionBy(key).orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    last = month_index(F.lit(end))
    after = F.sum(months).over(w)
    return rows.withColumn("start_date", month_text(last - after + 1)).withColumn("end_date", month_text(last - after + F.col(months)))


def selected(rows: DataFrame, order: str, limit: int | None = None, start_from: str | None = None) -> DataFrame:
    """The first `limit` rows in order, from an id on; too few is an error that names how many remain."""
    left = rows if start_from is None else rows.where(F.col(order) >= start_from)
    if limit is None:
        return left.orderBy(order)
    have = left.limit(limit).count()
    if have < limit:
        raise ValueError(f"only {have} remain")
    return left.orderBy(order).limit(limit)


def catalogue(chunks: DataFrame, candidate: str, fields: list[str]) -> DataFrame:
    """One row per candidate with its fields, and which of them its chunks disagree on."""
    out = chunks.groupBy(candidate).agg(*(F.min(f).alias(f) for f in fields), *(F.countDistinct(f).alias(f"__{f}") for f in fields))
    clash = F.array_join(F.filter(F.array(*(F.when(F.col(f"__{f}") > 1, f) for f in fields)), lambda x: x.isNotNull()), ",")
    return out.select(candidate, *fields, clash.alias("conflicts"))


def mentioned(rows: DataFrame, name: Column, question: str) -> DataFrame:
    """Rows whose normalised name occurs in the question."""
    n = normalized(name)
    return rows.where(F.contains(normalized(F.lit(question)), n) & (n != ""))


#: A profile as one row.
PROFILE = (
    "candidate_id string, full_name string, professional_title string, profession string, seniority string, years_of_experience double, summary string, city string, country string, "
    "work_experience array<struct<job_title:string,company:string,location:string,highlights:array<string>,technologies:array<string>,managed_team_size:int>>, "
    "education array<struct<degree:string,field_of_study:string,institution:string,location:string>>, skills array<struct<name:string,category:string>>, "
    "languages array<struct<name:string,proficiency:string>>, certifications array<struct<name:string,issuer:string,year:int>>, "
    "projects array<struct<name:string,description:string,technologies:array<string>,year:int>>"
)


def searchable() -> Column:
    """All that a profile (PROFILE's columns) says, as one text, with the wordings that
    questions use for team sizes, language levels and certificates."""
    said = lambda *parts: F.array_join(F.filter(F.array(*(p.cast("string") for p in parts)), lambda x: x.isNotNull() & (x != "")), " ")
    every = lambda name, f: F.array_join(F.transform(F.coalesce(F.col(name), F.array()), f), " ")

    def role(r: Column) -> Column:
        n = r["managed_team_size"].cast("string")
        led = F.when(n.isNotNull(), F.concat(F.lit("managed team size "), n, F.lit(" team size "), n, F.lit(" managed "), n, F.lit(" engineers")))
        return said(r["job_title"], r["company"], r["location"], F.array_join(r["highlights"], " "), F.array_join(r["technologies"], " "), led)

    text = said(
        F.col("candidate_id"), F.col("full_name"), F.col("professional_title"), F.col("profession"), F.replace("profession", F.lit("_"), F.lit(" ")), F.col("seniority"),
        F.col("years_of_experience"), F.col("summary"), F.col("city"), F.col("country"), every("work_experience", role),
        every("education", lambda x: said(x["degree"], x["field_of_study"], x["institution"], x["location"])), every("skills", lambda x: said(x["name"], x["category"])),
        every("languages", lambda x: said(x["name"], x["proficiency"], x["name"], x["proficiency"])), F.when(F.size("certifications") > 0, "certification certifications"),
        every("certifications", lambda x: said(x["name"], x["issuer"], x["year"])), every("projects", lambda x: said(x["name"], x["description"], F.array_join(x["technologies"], " "), x["year"])),
    )
    return F.trim(F.regexp_replace(text, " +", " "))


def plan_problems(slots: DataFrame, scenarios: DataFrame, policies: DataFrame, n: int) -> DataFrame:
    """(subject, problem) of a plan: a wrong number of slots, ids that aren't candidate_001 and so on in
    order, repeated names and scenarios whatever their case, policies that are off, and unknown ids in scenarios.

    slots: candidate_id, place (from 1), full_name; scenarios: scenario_id, expected (ids); policies: name, enabled.
    """
    count = slots.agg(F.count("*").alias("n")).where(F.col("n") != n).select(F.col("n").cast("string").alias("subject"), F.lit("slot_count").alias("problem"))
    order = slots.where(F.col("candidate_id") != F.format_string("candidate_%03d", "place")).select("candidate_id", F.lit("out_of_order"))
    twice = lambda rows, c, what: rows.groupBy(F.lower(c).alias("subject")).count().where("count > 1").select("subject", F.lit(what))
    off = policies.where("NOT enabled").select("name", F.lit("policy_off"))
    asked = scenarios.select("scenario_id", F.explode("expected").alias("candidate_id")).join(slots.select("candidate_id"), "candidate_id", "left_anti")
    unknown = asked.select(F.concat_ws(":", "scenario_id", "candidate_id"), F.lit("unknown_candidate")).distinct()
    return count.union(order).union(twice(slots, "full_name", "repeated_name")).union(twice(scenarios, "scenario_id", "repeated_scenario")).union(off).union(unknown)
