"""Evidence scores: which of a question's requirements a text proves."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import text as T


def family(term: str) -> list[str]:
    """Terms that may stand for a query term."""
    if term == "manage":
        return ["manage"]
    for group in (["developer", "engineer"], ["employee", "member", "people", "person", "report", "staff"], ["squad", "team"]):
        if term in group:
            return group
    return [term]


def matched(terms: Column, term: str) -> Column:
    return F.arrays_overlap(terms, F.array(*map(F.lit, family(term))))


def lexical(terms: Column, normalized: Column, wanted: list[str], phrases: list[str] = ()) -> Column:
    """Share of terms found plus 0.15 times the share of phrases, at most 1."""
    if not wanted:
        cover = F.lit(0.0)
    else:
        cover = sum((F.when(matched(terms, t), 1.0).otherwise(0.0) for t in wanted), F.lit(0.0)) / len(wanted)
    if phrases:
        found = sum((F.when(F.instr(normalized, p) > 0, 1.0).otherwise(0.0) for p in phrases), F.lit(0.0))
        cover = cover + 0.15 * found / len(phrases)
    return F.least(F.lit(1.0), cover)


def lexical_of_text(searchable: Column, wanted: list[str]) -> Column:
    """Share of terms found, by searching the text once per term."""
    found = [T.has_token(searchable, [f for t in family(w) for f in T.surface_forms(t)]) for w in wanted]
    return sum((F.when(x, 1.0).otherwise(0.0) for x in found), F.lit(0.0)) / max(1, len(wanted))


def combined(semantic: Column, lexical_: Column, numeric: Column | None = None) -> Column:
    if numeric is None:
        return T.clamp(0.70 * semantic + 0.30 * lexical_)
    return T.clamp(0.40 * semantic + 0.20 * lexical_ + 0.40 * numeric)


def strength(lexical_: Column, semantic: Column, combined_: Column) -> Column:
    """How much one text supports a condition."""
    return 0.70 * lexical_ + 0.20 * semantic + 0.10 * combined_


#: What states a comparison before a number, in the order in which it is looked for.
COMPARISONS = (("gte", ("at least", "minimum", "no fewer than")), ("gt", ("more than", "over")), ("lte", ("at most", "maximum", "up to", "no more than")), ("lt", ("less than", "under")))


def operator_before(tokens: Column, at: Column) -> Column:
    """Comparison that up to four tokens before a number state (substring tests, in order)."""
    lo = F.greatest(at - 4, F.lit(0))
    s = F.array_join(F.slice(tokens, lo + 1, at - lo), " ")
    out = F
    for name, marks in COMPARISONS:
        out = out.when(reduce(or_, (F.instr(s, m) > 0 for m in marks)), name)
    return out.otherwise("eq")


def satisfies(operator: Column | str, value: Column | float, found: Column, stated: Column) -> Column:
    """The number found, with its own comparison, satisfies the wanted one."""
    wanted = operator if isinstance(operator, Column) else F.lit(operator)
    below, above = ~stated.isin("lt", "lte"), ~stated.isin("gt", "gte")
    return (
        F.when(wanted == "eq", (stated == "eq") & (found == value))
        .when(wanted == "gte", below & (found >= value))
        .when(wanted == "gt", below & (found > value))
        .when(wanted == "lte", above & (found <= value))
        .when(wanted == "lt", above & (found < value))
    )


def _any(tokens: Column, words: list[str]) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, words)))


def is_duration(tokens: Column, at: Column) -> Column:
    next_two = F.slice(tokens, at + 2, 2)
    near = T.window(tokens, at, 4)
    return _any(next_two, T.DURATION_UNITS) | (_any(near, T.DURATION_UNITS) & _any(near, ["experience", "experienced", "career", "since"]))


def is_team_size(tokens: Column, at: Column) -> Column:
    local = T.window(tokens, at, 8)
    plain = F.transform(local, T.canonical)
    counted = F.transform(T.window(tokens, at, 2), T.canonical)
    nouns = ["developer", "engineer", "employee", "member", "people", "person", "report", "staff", "squad", "team"]
    led = _any(local, T.MANAGEMENT)
    for pair in (["direct", "report"], ["team", "size"], ["team", "leadership"]):
        led = led | T.contains_sequence(plain, pair)
    return ~is_duration(tokens, at) & _any(counted, nouns) & led


def is_experience(tokens: Column, at: Column) -> Column:
    unit = F.get(tokens, at + 1)
    return F.coalesce(unit.isin(*T.DURATION_UNITS), F.lit(False)) & _any(T.window(tokens, at, 4), ["experience", "experienced", "career"])


def in_context(tokens: Column, at: Column, wanted: Column | list[str]) -> Column:
    """At least half of the wanted terms stand around. wanted: terms, or a column of their families."""
    if not isinstance(wanted, Column):
        if not wanted:
            return F.lit(True)
        wanted = F.array(*(T.array(family(w)) for w in wanted))
    near = F.transform(T.window(tokens, at, 8), T.canonical)
    return 2 * F.size(F.filter(wanted, lambda w: F.arrays_overlap(near, w))) >= F.size(wanted)


def numeric(clauses: Column, value: Column | float, operator: Column | str = "eq", relation: Column | str = "generic", context: Column | list[str] = ()) -> Column:
    """1 where a number in one clause satisfies comparison and relation; for
    generic numbers 0.1 where only the number does; else 0."""
    kind = relation if isinstance(relation, Column) else F.lit(relation)
    tests = {"team_size": is_team_size, "experience_duration": is_experience, "generic": lambda c, i: in_context(c, i, context)}
    if not isinstance(relation, Column):
        tests = {relation: tests.get(relation, tests["generic"])}

    def test(clause: Column, related: bool) -> Column:
        places = F.sequence(F.lit(0), F.size(clause) - 1)

        def at(i: Column) -> Column:
            found = T.number(F.get(clause, i))  # first, as few words are numbers
            ok = found.isNotNull() & F.coalesce(satisfies(operator, value, found, operator_before(clause, i)), F.lit(False))
            return ok & reduce(or_, ((kind == name) & f(clause, i) for name, f in tests.items())) if related else ok

        return F.exists(places, at)

    proven = F.exists(clauses, lambda c: test(c, True))
    return F.when(proven, 1.0).when((kind == "generic") & F.exists(clauses, lambda c: test(c, False)), 0.1).otherwise(0.0)


def numbers(clauses: Column) -> Column:
    """Each number in clauses with its own comparison, what it counts, and the terms around it."""

    def each(clause: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(clause) - 1), lambda i: T.number(F.get(clause, i)).isNotNull())
        return F.transform(places, lambda i: F.struct(
            T.number(F.get(clause, i)).alias("value"), operator_before(clause, i).alias("operator"), is_team_size(clause, i).alias("team_size"),
            is_experience(clause, i).alias("experience_duration"), F.transform(T.window(clause, i, 8), T.canonical).alias("near"),
        ))

    return F.flatten(F.transform(clauses, each))


NUMBERS = "array<struct<value: double, operator: string, team_size: boolean, experience_duration: boolean, near: array<string>>>"


def numbers_of_text(text: Column) -> Column:
    """`numbers` of a text's clauses. Most texts without any are told by one search; what isn't ASCII may fold to a number's name."""
    found = numbers(T.clauses(text))
    return F.when(text.rlike(rf"(?i)[0-9]|[^\x00-\x7f]|{'|'.join(T.NUMBER_WORDS)}"), found).when(text.isNotNull(), F.array().cast(NUMBERS))


def families(context: list[str]) -> Column:
    """Families of terms, as `numeric_of` takes them."""
    return F.array(*(T.array(family(w)) for w in context)).cast("array<array<string>>")


def numeric_of(found: Column, value: Column, operator: Column, relation: Column, context: Column) -> Column:
    """`numeric` of a text whose `numbers` are known; context: families of terms."""
    ok = lambda n: F.coalesce(satisfies(operator, value, n["value"], n["operator"]), F.lit(False))
    around = lambda n: 2 * F.size(F.filter(context, lambda w: F.arrays_overlap(n["near"], w))) >= F.size(context)
    related = lambda n: ((relation == "generic") & around(n)) | reduce(or_, ((relation == k) & n[k] for k in ("team_size", "experience_duration")))
    proven = F.exists(found, lambda n: ok(n) & related(n))
    return F.when(proven, 1.0).when((relation == "generic") & F.exists(found, ok), 0.1).otherwise(0.0)


def language_relation(clauses: Column, language: Column | str, proficiency: Column | str, canonical: bool = False) -> Column:
    """Both terms within three tokens of one clause; not the native of cloud-native. canonical: of the clauses' tokens."""

    def test(clause: Column) -> Column:
        plain = clause if canonical else F.transform(clause, T.canonical)
        places = F.sequence(F.lit(0), F.size(plain) - 1)

        def at(i: Column) -> Column:
            level = F.get(plain, i)
            cloud = (level == "native") & (F.coalesce(F.get(plain, i - 1), F.lit("")) == "cloud")
            return (level == proficiency) & F.array_contains(T.window(plain, i, 3), language) & ~cloud

        return F.exists(places, at)

    return F.exists(clauses, test)
