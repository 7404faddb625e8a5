"""Text scalars as Spark columns: normalisation, tokens, canonical terms, numbers."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the search vocabulary.
TOKEN = r"c\+\+|c#|\.net|[a-z0-9]+(?:[.-][a-z0-9]+)*"
HYPHENS = "[_‐‑‒–—-]+"
CLAUSE = r"[\r\n]+|[•▪◦●]+|[.!?;]+"
STOP_WORDS = "a an and any are as candidate candidates do does exactly find for from has have having in is me of on or please show studied study the their to which who whose with".split()
SCAFFOLDING = "at background between career combine compare cv cvs earned evaluate experience experienced fits focused how hold know knowledge language least less maximum minimum more mother over people person position professional related role skill skilled someone speaker speaking than tongue under up use uses using versus versu work worked working".split()
NUMBER_WORDS = {w: n for n, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split())} | {w: 10 * n for n, w in enumerate("thirty forty fifty sixty seventy eighty ninety hundred".split(), 3)}
MANAGEMENT = "lead leader leadership led manage managed management manager managing supervise supervised supervising".split()
ENGINEERING = "developer developers engineer engineers".split()
PEOPLE = "employee employees member members people person report reports staff".split()
TEAM = "squad squads team teams".split()
WORKFORCE = [*ENGINEERING, *PEOPLE, *TEAM]
DURATION_UNITS = "day days month months week weeks year years y".split()
PROFICIENCY = "native fluent professional intermediate".split()
PROFICIENCY_ADVERBS = {"natively": "native", "fluently": "fluent", "professionally": "professional", "intermediately": "intermediate"}


@cache
def accent_map() -> tuple[str, str]:
    """Lower-case letters with marks and the plain letters they decompose to."""
    marked, plain = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", c).casefold() if not unicodedata.combining(x))
        if c == c.lower() and base != c and len(base) == 1:
            marked.append(c)
            plain.append(base)
    return "".join(marked), "".join(plain)


def fold(s: Column) -> Column:
    """Lower case without accents or combining marks; ß is ss. Plain ASCII has nothing to replace."""
    marked, plain = accent_map()
    lower = F.replace(F.lower(s), F.lit("ß"), F.lit("ss"))
    whole = F.regexp_replace(F.translate(lower, marked, plain), r"[̀-ͯ]", "")
    return F.when(F.octet_length(s) == F.length(s), F.lower(s)).otherwise(whole)


def tokens(s: Column) -> Column:
    """Search tokens of a raw text, in order."""
    return F.regexp_extract_all(F.regexp_replace(fold(s), HYPHENS, " "), F.lit(TOKEN), F.lit(0))


def normalized(s: Column) -> Column:
    return F.array_join(tokens(s), " ")


def canonical(t: Column) -> Column:
    """A token without plural, with the few aliases that stand for one term."""
    return _canonical(F.trim(t, F.lit(".-")))


def _canonical(t: Column) -> Column:
    n = F.length(t)
    out = F.when(t.isin("accessible", "accessibility"), F.lit("accessibility"))
    for adverb, term in PROFICIENCY_ADVERBS.items():
        out = out.when(t == adverb, F.lit(term))
    return (
        out.when(t.isin(*MANAGEMENT), F.lit("manage"))
        .when(t.endswith("ies") & (n > 4), F.concat(t.substr(F.lit(1), n - 3), F.lit("y")))
        .when(t.endswith("s") & (n > 4) & ~t.endswith("ss"), t.substr(F.lit(1), n - 1))
        .otherwise(t)
    )


def role_token(t: Column) -> Column:
    """Canonical, with one word for developing and engineering."""
    c = canonical(t)
    return F.when(c.isin("developer", "development", "engineering"), "engineer").otherwise(c)


def canonical_terms(s: Column) -> Column:
    trimmed = F.transform(tokens(s), lambda t: F.trim(t, F.lit(".-")))  # once, as lambdas share nothing
    return F.filter(F.transform(trimmed, lambda t: _canonical(t)), lambda t: t != "")


def surface_forms(term: str) -> list[str]:
    """Tokens that are one canonical term."""
    ends = [term, *([f"{term}s"] if len(term) > 3 and not term.endswith(("s", "ie")) else []), *([f"{term[:-1]}ies"] if len(term) > 2 and term.endswith("y") else [])]
    named = {"accessibility": ["accessible", "accessibility"], "manage": MANAGEMENT, "net": [".net"]}.get(term, [])
    return list(dict.fromkeys([*ends, *named, *(a for a, b in PROFICIENCY_ADVERBS.items() if b == term)]))


def has_token(searchable: Column, forms: list[str]) -> Column:
    """Whether one of the tokens stands in a folded text without hyphens, found without cutting it into tokens."""
    end = r"(?![a-z0-9]|\.[a-z0-9])"
    ends = {"c": r"(?![a-z0-9#]|\+\+|\.[a-z0-9])", "c++": "", "c#": ""}
    words = [f"(?:{'|'.join(re.escape(f) for f in forms if f not in ends)}){end}"] if set(forms) - set(ends) else []
    words += [re.escape(f) + e for f, e in ends.items() if f in forms]
    found = searchable.rlike(rf"(?<![a-z0-9])(?<![a-z0-9]\.)(?:{'|'.join(words)})")
    # Behind the token .net the next one may follow at once.
    cut = F.arrays_overlap(F.regexp_extract_all(searchable, F.lit(TOKEN), F.lit(0)), array(forms))
    return F.when(F.contains(searchable, F.lit(".net")), cut).otherwise(found)


def searchable(s: Column) -> Column:
    return F.regexp_replace(fold(s), HYPHENS, " ")


def number(t: Column) -> Column:
    """The number a token stands for, as a double; null if none."""
    words = F.create_map(*(F.lit(x) for w, n in NUMBER_WORDS.items() for x in (w, float(n))))
    return F.coalesce(F.try_element_at(words, t), F.when(t.rlike(r"^\d+(\.\d+)?$"), t.cast("double")))


def clauses(s: Column) -> Column:
    """The token lists of a text's clauses; empty ones left out."""
    return F.filter(F.transform(F.split(s, CLAUSE), tokens), lambda c: F.size(c) > 0)


def window(tokens_: Column, at: Column, radius: int) -> Column:
    """Tokens around position `at` (from 0)."""
    lo = F.greatest(at - radius, F.lit(0))
    return F.slice(tokens_, lo + 1, at + radius + 1 - lo)


def array(x: Column | list) -> Column:
    """A literal list as a column; a column is left as it is."""
    return x if isinstance(x, Column) else F.array(*map(F.lit, x))


def contains_sequence(tokens_: Column, sequence: Column | list[str]) -> Column:
    want = array(sequence)
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens_) - F.size(want) + 1, F.lit(1)))
    return F.exists(starts, lambda i: F.slice(tokens_, i, F.size(want)) == want)


def ordered_subsequence(tokens_: Column, sequence: Column | list[str], gap: int = 2) -> Column:
    """The sequence occurs in order with at most `gap` tokens between neighbours. The first
    place of each word counts until a gap is too wide; then the search starts anew."""
    want = array(sequence)
    n = F.size(want)
    start = F.struct(F.lit(0).alias("k"), F.lit(0).alias("last"), F.lit(0).alias("i"))

    def step(a: Column, t: Column) -> Column:
        i = a["i"] + 1
        wide = (a["k"] > 0) & (i - a["last"] - 1 > gap)
        hit = (a["k"] < n) & (t == F.get(want, a["k"]))
        again = hit & wide
        k = F.when(~hit, a["k"]).when(again, F.when(t == F.get(want, F.lit(0)), 1).otherwise(0)).otherwise(a["k"] + 1)
        return F.struct(k.cast("int").alias("k"), F.when(hit, i).otherwise(a["last"]).cast("int").alias("last"), i.cast("int").alias("i"))

    return F.aggregate(tokens_, start, step, lambda a: a["k"] == n)


def squeeze(s: Column) -> Column:
    """Trimmed, lower case, white space collapsed."""
    return F.lower(F.trim(F.regexp_replace(s, r"\s+", " ")))


def word_text(s: Column) -> Column:
    """Lower case, runs of other than word characters as one space."""
    plain = F.octet_length(s) == F.length(s)
    return F.trim(F.when(plain, F.regexp_replace(F.lower(s), r"[^\w]+", " ")).otherwise(F.regexp_replace(F.lower(s), r"(?U)[^\w]+", " ")))


def slug(s: Column) -> Column:
    return F.trim(F.regexp_replace(fold(s), "[^a-z0-9]+", "-"), F.lit("-"))


def truncate(s: Column, n: int) -> Column:
    """Collapsed text of at most n characters, with an ellipsis where cut."""
    c = F.trim(F.regexp_replace(s, r"\s+", " "))
    return F.when(F.length(c) > n, F.concat(F.rtrim(c.substr(1, n - 3)), F.lit("..."))).otherwise(c)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
