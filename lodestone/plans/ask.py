"""A question over an index, end to end: one lazy plan down to a few candidates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.functions import text as T
from lodestone.functions import vectors
from lodestone.operators import evidence as E
from lodestone.operators import ranking, retrieval
from lodestone.sources.shared import written
from lodestone.plans.questions import Condition, Question, analyze, conditions, role_token

#: Sections that may prove a degree, and an alias of a term; how many tokens from a
#: section's begin may name a role; words that begin the next degree.
DEGREE_SECTIONS = ["education", "skills", "skills_and_languages"]
OWN_SECTIONS = ["identity", "professional_summary", "projects", "skills", "skills_and_languages"]
ROLE_PREFIX = {"identity": 18, "professional_summary": 20, "experience": 5}
DEGREE_MARKS = ["bachelor", "bsc", "bs", "master", "msc", "ms", "phd"]


def features(chunks: DataFrame, q: Question) -> DataFrame:
    """chunks with lexical, numeric, contextual and the token columns that conditions test."""
    df = chunks
    if q.numbers:
        # Through a generator, so that filters on scores don't search the text again.
        df = df.select("*", F.explode(F.array(E.numbers_of_text(F.col("text")))).alias("__n"))
    df = df.withColumn("__t", T.tokens(F.col("text"))).withColumn("__c", T.clauses(F.col("text"))).withColumn("__p", F.transform("__t", T.canonical))
    units = [t for t in q.terms if not any(t in r for r in q.languages)]
    n = len(units) + len(q.languages)
    got = sum((F.when(E.matched(F.col("__p"), t), 1.0).otherwise(0.0) for t in units), F.lit(0.0))
    got = sum((F.when(E.language_relation(F.col("__c"), *r), 1.0).otherwise(0.0) for r in q.languages), got)
    normal = F.array_join("__t", " ")
    phrases = sum((F.when(F.instr(normal, p) > 0, 1.0).otherwise(0.0) for p in q.phrases), F.lit(0.0)) / max(1, len(q.phrases))
    lexical = F.least(F.lit(1.0), (got / n if n else F.lit(0.0)) + 0.15 * phrases)
    scores = [E.numeric_of(F.col("__n"), F.lit(float(x.value)), F.lit(x.operator), F.lit(x.relation), E.families(x.context)) for x in q.numbers]
    numeric = sum(scores, F.lit(0.0)) / len(scores) if scores else F.lit(0.0)
    contextual = F.lit(False)
    for s in scores:
        contextual = contextual | (s == 1.0)
    return df.withColumn("lexical", lexical).withColumn("numeric", numeric).withColumn("contextual", contextual).drop("__n")


def _degree(tokens: Column, aliases: tuple[str, ...], fields: tuple[str, ...]) -> Column:
    """A degree's name and then, before the next degree, a word for every field."""
    def after(alias: str) -> Column:
        words = alias.split()
        want = F.array(*map(F.lit, words))
        places = F.sequence(F.lit(1), F.greatest(F.size(tokens) - len(words) + 1, F.lit(1)))
        begin = F.get(F.filter(places, lambda i: F.slice(tokens, i, len(words)) == want), 0) + len(words)
        rest = F.slice(tokens, begin, F.greatest(F.size(tokens) - begin + 1, F.lit(0)))
        ends = F.filter(F.transform(rest, lambda t, i: F.when(t.isin(*DEGREE_MARKS), i)), lambda i: i.isNotNull())
        segment = F.transform(F.slice(rest, 1, F.coalesce(F.get(ends, 0), F.size(rest))), T.role_token)
        every = [F.exists(segment, _begins(role_token(f))) for f in fields]
        return F.coalesce(begin.isNotNull() & reduce(lambda x, y: x & y, every), F.lit(False))

    return reduce(lambda x, y: x | y, map(after, aliases))


def _begins(field: str) -> Callable[[Column], Column]:
    return lambda t: t.startswith(field)


def _role(tokens: Column, words: tuple[str, ...]) -> Column:
    """A role in the title, else at the begin of a section that speaks of the candidate."""
    words = [role_token(w) for w in words]
    roles = lambda t: F.filter(F.transform(t, T.role_token), lambda x: x != "")
    out = T.ordered_subsequence(roles(T.tokens(F.coalesce("professional_title", F.lit("")))), words)
    for section, most in ROLE_PREFIX.items():
        if words != ["engineer"] or section == "identity":
            out = out | ((F.col("section_name") == section) & T.ordered_subsequence(F.slice(roles(tokens), 1, most), words))
    return F.coalesce(out, F.lit(False))


def condition_strength(c: Condition) -> Column:
    """A scored hit's strength for a condition; 0 where it isn't met."""
    plain, clauses, tokens = F.col("__p"), F.col("__c"), F.col("__t")
    whole = T.clamp(E.strength(F.col("lexical"), F.col("semantic"), F.col("combined")))
    if c.kind == "identity":
        return F.when(T.normalized(F.coalesce("candidate_name", F.lit(""))).isin(*c.payload), 1.0).otherwise(0.0)
    if c.kind == "numeric":
        n = c.payload
        return F.when(E.numeric(clauses, n.value, n.operator, n.relation, list(n.context)) == 1.0, T.clamp(F.col("numeric"))).otherwise(0.0)
    if c.kind == "relation":
        met = E.language_relation(clauses, *c.payload)
    elif c.kind == "education":
        met = F.col("section_name").isin(*DEGREE_SECTIONS) & _degree(tokens, *c.payload)
    elif c.kind in ("role", "phrase"):
        met = _role(tokens, c.payload)
    else:
        # The first word that counts for the term; another form of it only where candidates describe themselves.
        same = F.get(tokens, (F.array_position(plain, c.payload) - 1).cast("int")) == c.payload
        met = F.coalesce(same, F.lit(False)) | (E.matched(plain, c.payload) & F.col("section_name").isin(*OWN_SECTIONS))
    return F.when(met, whole).otherwise(0.0)


def assisted(chunks: DataFrame, q: Question, query: list[float], k: int = 50, metric: str = "cosine") -> DataFrame:
    """Semantic hits and exact supplements, deduplicated and ranked."""
    hits = retrieval.nearest(chunks, query, k, metric).withColumn("semantic", vectors.relevance(F.col("distance"), metric)).withColumnRenamed("rank", "raw_rank")
    numbers = bool(q.numbers)

    def scored(df: DataFrame) -> DataFrame:
        f = features(df, q)
        return f.withColumn("combined", E.combined(F.col("semantic"), F.col("lexical"), F.col("numeric") if numbers else None))

    extra = retrieval.supplements(scored(chunks.withColumn("semantic", F.lit(0.0))), hits, numbers)
    return retrieval.merge(scored(hits), extra, T.normalized(F.col("text")))


def ask(chunks: DataFrame, text: str, query: list[float], names: list[str] | None = None, k: int | None = None, pool: int = 15, limit: int | None = None, metric: str = "cosine") -> DataFrame:
    """Supported (or partly supported) candidates of a question, at most `limit`, best first.

    names: the candidates' names that the question may ask for; by default those
    of its hits, of which there are at most k and SUPPLEMENTS.
    """
    limits = Limits()
    k, limit = limits.raw(k), limits.final(limit)
    q = analyze(text)
    hits = written(assisted(chunks, q, query, k, metric), "hits")
    ranking.reject_conflicts(hits)
    if names is None:
        names = sorted(r[0] for r in hits.select("candidate_name").distinct().collect() if r[0])
    wanted = conditions(q, names)
    ranked = ranking.candidates(hits, matches(hits, wanted), sum(c.weight for c in wanted) or 1.0, len(wanted), pool)
    best = ranking.support(ranked, len(wanted))
    return best.withColumn("final_rank", F.row_number().over(W.orderBy("candidate_rank"))).where(F.col("final_rank") <= limit)


def matches(hits: DataFrame, wanted: list[Condition]) -> DataFrame:
    """The best hit of each candidate and condition."""
    if not wanted:
        return hits.sparkSession.createDataFrame([], "candidate_id string, condition string, weight double, chunk_id string, strength double, rank int")
    each = F.array(*(F.struct(F.lit(c.key).alias("condition"), F.lit(c.weight).alias("weight"), condition_strength(c).alias("strength")) for c in wanted))
    return ranking.best_matches(hits.select("candidate_id", "chunk_id", "combined", "semantic", "rank", F.inline(each)))


@dataclass(frozen=True)
class Limits:
    """Default and greatest number of hits, candidates, chunks per candidate and final candidates."""

    raw_default: int = 50
    raw_most: int = 200
    candidates_default: int = 10
    candidates_most: int = 30
    evidence_default: int = 4
    evidence_most: int = 8
    final_default: int = 5
    final_most: int = 10

    def __post_init__(self) -> None:
        for name in ("raw", "candidates", "evidence", "final"):
            if not 1 <= getattr(self, f"{name}_default") <= getattr(self, f"{name}_most"):
                raise ValueError(f"the default of {name} must be positive and not above its maximum")

    def _resolve(self, name: str, asked: int | None) -> int:
        n = getattr(self, f"{name}_default") if asked is None else asked
        most = getattr(self, f"{name}_most")
        if not 1 <= n <= most:
            raise ValueError(f"{name} must be between 1 and {most}")
        return n

    def raw(self, asked: int | None = None) -> int:
        return self._resolve("raw", asked)

    def candidates(self, asked: int | None = None) -> int:
        return self._resolve("candidates", asked)

    def evidence(self, asked: int | None = None) -> int:
        return self._resolve("evidence", asked)

    def final(self, asked: int | None = None) -> int:
        return self._resolve("final", asked)
