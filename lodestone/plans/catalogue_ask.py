"""Questions over profiles that are derived from the given tables, with SQL: single ones and a table of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import ranking
from lodestone.operators.evidence import family
from lodestone.plans import oracle_text as O
from lodestone.plans import question_table as QT
from lodestone.plans.ask import assisted, ask, matches
from lodestone.plans.catalogue import query
from lodestone.plans.questions import analyze, conditions
from lodestone.sources.shared import spread, written

FIRST, LAST = "Ada Alan Grace Kurt Emmy Carl Maria Paul Rosa Hugo".split(), "Lovelace Turing Hopper Goedel Noether Gauss Curie Erdos Peters Steiner Keller Meyer Weber".split()
RANKS, ROLES, VERBS = ["Junior", "Senior", "Principal"], ["Engineer", "Developer", "Designer", "Analyst"], ["Managed", "Led", "Supervised"]
TONGUES, LEVELS, DEGREES = ["German", "French", "Spanish", "Italian", "Dutch"], ["native", "professional", "intermediate"], ["MSc", "BSc"]
FIELDS, TOOLS = ["computer science", "fine arts", "mathematics", "civil engineering", "marine biology", "applied physics"], ["cloud", "accessibility audits", "kafka", "spark pipelines", "testing", "networks", "databases"]
SEGMENTS = ["automobile", "building", "furniture", "household", "machinery"]


def _pick(of: str, names: list[str]) -> str:
    return f"CASE {of} % {len(names)} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


def _text(number: str) -> str:
    return f"CAST({number} AS STRING)"


_SECTIONS = {
    "identity": "concat(name, ' ', title)",
    "experience": f"concat({_pick('key', VERBS)}, ' a team of ', {_text('n')}, ' engineers in ', segment, '. Delivered ', {_text('nation')}, ' projects in ', {_text('nation % 9 + 1')}, ' years of experience')",
    "languages": "concat(tongue, ' (', level, '), English (fluent)')",
    "education": "concat(degree, ' in ', field)",
    "skills": f"concat(segment, ', ', {_pick('key', TOOLS)})",
}
#: Both engines read this: five sections of each customer's profile, and what they state.
PROFILES = f"""(SELECT c_custkey AS key, c_nationkey AS nation, c_custkey % 17 + 1 AS n, lower(c_mktsegment) AS segment,
concat({_pick('c_custkey', FIRST)}, ' ', {_pick('c_custkey', LAST)}) AS name, concat({_pick('c_custkey', RANKS)}, ' ', lower(c_mktsegment), ' ', {_pick('c_custkey', ROLES)}) AS title,
{_pick('c_nationkey', TONGUES)} AS tongue, {_pick('c_custkey', LEVELS)} AS level, {_pick('c_custkey', DEGREES)} AS degree, {_pick('c_nationkey', FIELDS)} AS field,
{_pick('c_custkey', ROLES)} AS role FROM customer) AS p"""
SECTIONS = " UNION ALL ".join(f"SELECT concat('k', {_text('key')}, '-{s}') AS chunk, concat('k', {_text('key')}) AS candidate, name, title, '{s}' AS section, {t} AS text, (key * 7 + {13 * i}) % 97 AS hundredths, n, segment, tongue, level, degree, field, role FROM {PROFILES}" for i, (s, t) in enumerate(_SECTIONS.items()))
WHO = {
    "roles": "Which machinery candidates have accessibility experience?",
    "numbers": "Who managed at least 8 engineers?",
    "names": "Compare Ada Lovelace and Alan Curie for accessibility",
    "degree": "Who has an MSc in computer science?",
}


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of customers as an index of chunks."""
    customer = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_mktsegment"))
    rows = spark.sql(SECTIONS.replace("FROM customer", "FROM {customer}"), customer=customer)
    x = F.col("hundredths") / 100
    return rows.select(
        F.col("chunk").alias("chunk_id"), F.col("candidate").alias("candidate_id"), F.col("name").alias("candidate_name"), F.col("title").alias("professional_title"),
        F.col("section").alias("section_name"), "text", F.array(x, F.sqrt(1 - x * x)).alias("embedding"),
    )


def _list(x: list) -> str:
    return "[" + ", ".join(_list(i) if isinstance(i, list) else f"'{i}'" for i in x) + "]"


def _facts(text: str) -> tuple[str, str]:
    """What a question's score counts: families of its terms, and its phrases."""
    q = analyze(text)
    units = [family(t) for t in q.terms if not any(t in r for r in q.languages)]
    return f"CAST({_list(units)} AS VARCHAR[][])", f"CAST({_list(list(q.phrases))} AS VARCHAR[])"


_RELATION = "(section = 'languages' AND lower(tongue) = asked_tongue AND level = asked_level)"
_TEAM = "(section = 'experience' AND n >= asked_n)"
_FIELD = "(section = 'education' AND degree = asked_degree AND field = asked_field)"
_ROLE = "(segment = asked_segment AND (role = asked_role OR (role IN ('Engineer', 'Developer') AND asked_role IN ('Engineer', 'Developer'))))"


def _sql(questions: str, wanted: str) -> str:
    """questions: qid, hundredths of the question's vector, units, phrases and asked_ columns; wanted: the typed join (c.*, condition, weight, strength or null)."""
    return f"""WITH q AS ({questions}), k AS ({SECTIONS.replace('STRING', 'VARCHAR')}),
c AS (SELECT *, CAST(hundredths AS DOUBLE) / 100 AS x, {O.tokens('text')} AS tokens, {O.canonical_terms('text')} AS terms FROM k),
s AS (SELECT c.*, q.* EXCLUDE (hundredths), x * CAST(q.hundredths AS DOUBLE) / 100 + sqrt(1 - x * x) * sqrt(1 - (CAST(q.hundredths AS DOUBLE) / 100) * (CAST(q.hundredths AS DOUBLE) / 100)) AS cosine FROM c, q),
l AS (SELECT *, CASE WHEN coalesce({_TEAM}, false) THEN 1.0 ELSE 0.0 END AS numeric_, CASE WHEN len(units) + asked_relations = 0 THEN 0.0 ELSE (coalesce(list_sum([CASE WHEN list_has_any(terms, u) THEN 1.0 ELSE 0.0 END FOR u IN units]), 0.0) + CASE WHEN coalesce({_RELATION}, false) THEN 1.0 ELSE 0.0 END) / (len(units) + asked_relations) END
  + 0.15 * coalesce(list_sum([CASE WHEN contains(array_to_string(tokens, ' '), p) THEN 1.0 ELSE 0.0 END FOR p IN phrases]), 0.0) / greatest(1, len(phrases)) AS lexical_ FROM s),
m AS (SELECT * EXCLUDE (lexical_), least(1.0, lexical_) AS lexical, greatest(0.0, least(1.0, cosine)) AS near FROM l),
h AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(1 - cosine, 12), chunk) AS raw_rank FROM m QUALIFY raw_rank <= 50),
a AS (SELECT *, CASE WHEN asked_n IS NULL THEN 0.3 * lexical ELSE 0.2 * lexical + 0.4 * numeric_ END AS alone FROM m WHERE CASE WHEN asked_n IS NULL THEN lexical > 0 ELSE numeric_ > 0 END),
x AS (SELECT a.* FROM a ANTI JOIN h USING (qid, chunk) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY numeric_ DESC, lexical DESC, alone DESC, chunk DESC) <= 50),
u AS (SELECT * EXCLUDE (raw_rank, near), near AS semantic, CASE WHEN asked_n IS NULL THEN 0.7 * near + 0.3 * lexical ELSE 0.4 * near + 0.2 * lexical + 0.4 * numeric_ END AS combined, raw_rank FROM h
  UNION ALL SELECT * EXCLUDE (near, alone), 0.0 AS semantic, alone AS combined, NULL AS raw_rank FROM x),
p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY combined DESC, numeric_ DESC, lexical DESC, semantic DESC, coalesce(raw_rank, 10000), chunk DESC) AS rank, least(1.0, 0.7 * lexical + 0.2 * semantic + 0.1 * combined) AS whole FROM u),
e AS ({wanted}),
b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY qid, candidate, condition ORDER BY strength DESC, combined DESC, semantic DESC, rank) = 1),
t AS (SELECT qid, sum(weight) AS total, count(*) AS n_conditions FROM w GROUP BY qid),
g AS (SELECT qid, candidate, max(semantic) AS support, min(rank) AS best FROM p GROUP BY qid, candidate),
o AS (SELECT qid, candidate, sum(weight) AS got, sum(weight * strength) AS good, count(*) AS n_matched FROM b GROUP BY qid, candidate),
v AS (SELECT g.*, coalesce(got, 0) / total AS coverage, coalesce(good, 0) / total AS quality, coalesce(n_matched, 0) AS n_matched, n_conditions FROM g JOIN t USING (qid) LEFT JOIN o USING (qid, candidate)),
z AS (SELECT *, 0.55 * coverage + 0.30 * quality + 0.15 * support AS score FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, coverage DESC, quality DESC, support DESC, best, candidate) AS place FROM z QUALIFY place <= 15),
f AS (SELECT *, n_matched = n_conditions AND score >= 0.45 AS full_, n_matched >= 1 AND coverage >= 0.65 AND score >= 0.30 AS part_ FROM r),
y AS (SELECT *, bool_or(full_) OVER (PARTITION BY qid) AS any_ FROM f),
j AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place) AS final_rank FROM y WHERE full_ OR (part_ AND NOT any_))"""


_BEST = "SELECT candidate AS candidate_id, condition, chunk AS chunk_id, round(strength, 6) AS strength FROM b"
_ANSWER = "candidate AS candidate_id, CAST(final_rank AS INTEGER) AS final_rank, round(score, 6) AS score, round(coverage, 6) AS coverage, CASE WHEN any_ THEN 'supported' ELSE 'partial' END AS outcome FROM j WHERE final_rank <= 5"
_NOTHING = {"asked_n": "NULL", "asked_tongue": "NULL", "asked_level": "NULL", "asked_relations": "0", "asked_degree": "NULL", "asked_field": "NULL", "asked_segment": "NULL", "asked_role": "NULL"}


def _one(text: str, **asked: str) -> str:
    units, phrases = _facts(text)
    return f"SELECT 0 AS qid, 100 AS hundredths, {units} AS units, {phrases} AS phrases, " + ", ".join(f"CAST({v} AS {'BIGINT' if k in ('asked_n', 'asked_relations') else 'VARCHAR'}) AS {k}" for k, v in (_NOTHING | asked).items())


def _wanted(*each: tuple[str, float, str, str]) -> str:
    """(condition, weight, test, strength); the conditions of a question are w."""
    return " UNION ALL ".join(f"SELECT *, '{k}' AS condition, CAST({w} AS DOUBLE) AS weight, {s} AS strength FROM p WHERE {t}" for k, w, t, s in each)


def _single(text: str, each: list[tuple[str, float, str, str]], **asked: str) -> str:
    w = ", ".join(f"(0, '{k}', CAST({w} AS DOUBLE))" for k, w, _, _ in each)
    return _sql(_one(text, **asked), _wanted(*each)).replace("WITH q AS", f"WITH w AS (SELECT * FROM (VALUES {w}) w(qid, condition, weight)), q AS", 1)


_PLANS = {
    "roles": _single(WHO["roles"], [("role:machinery", 1.25, "segment = 'machinery'", "whole"), ("term:accessibility", 1.0, "list_contains(terms, 'accessibility')", "whole")]),
    "numbers": _single(WHO["numbers"], [("numeric:0:team_size:gte:8", 2.0, _TEAM, "numeric_")], asked_n="8"),
    "names": _single(WHO["names"], [("identity:explicit-candidate", 2.0, "name IN ('Ada Lovelace', 'Alan Curie')", "1.0"), ("term:accessibility", 1.0, "list_contains(terms, 'accessibility')", "whole")]),
    "degree": _single(WHO["degree"], [("education:master_science:computer+science", 1.75, _FIELD, "whole")], asked_degree="'MSc'", asked_field="'computer science'"),
}


def _register(name: str) -> None:
    def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
        best = ask(chunks(spark, sf_dir), WHO[name], [1.0, 0.0])
        return best.select("candidate_id", "final_rank", F.round("score", 6).alias("score"), F.round("coverage", 6).alias("coverage"), "outcome")

    def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = analyze(WHO[name])
        hits = written(assisted(chunks(spark, sf_dir), q, [1.0, 0.0]), "hits")
        best = matches(hits, conditions(q, [f"{a} {b}" for a in FIRST for b in LAST]))
        return best.select("candidate_id", "condition", "chunk_id", F.round("strength", 6).alias("strength"))

    candidates.__name__, evidence.__name__ = f"ask_{name}", f"ask_{name}_evidence"
    query(f"{_PLANS[name]} SELECT {_ANSWER}")(candidates)
    query(f"{_PLANS[name]} {_BEST}")(evidence)


for _name in WHO:
    _register(_name)

# --- a table of questions ---------------------------------------------------------------

#: Of each nation: what it asks, as text and as what the text means.
KINDS = {
    "relation": "Who is {level} in {tongue}?",
    "team": "Who managed at least {n} engineers?",
    "term": "Which candidates have {segment} experience?",
    "degree": "Who has a {degree} in {field}?",
    "role": "Who is a {segment} {role}?",
    "both": "Who managed at least {n} engineers and is {level} in {tongue}?",
}


def _asked(nation: int) -> dict:
    return {"level": LEVELS[nation % 3], "tongue": TONGUES[nation % 5], "n": nation % 17 + 1, "segment": SEGMENTS[nation % 5], "degree": DEGREES[nation % 2], "field": FIELDS[nation % 6], "role": ROLES[nation % 4]}


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six questions for each nation."""
    part = {"level": LEVELS, "tongue": TONGUES, "segment": SEGMENTS, "degree": DEGREES, "field": FIELDS, "role": ROLES}
    picks = {k: F.expr(_pick("n_nationkey", v)) for k, v in part.items()} | {"n": (F.col("n_nationkey") % 17 + 1).cast("string")}

    def said(form: str) -> F.Column:
        pieces = form.replace("{", "\x00{").replace("}", "\x00").split("\x00")
        return F.concat(*(picks[p[1:]] if p[:1] == "{" else F.lit(p) for p in pieces if p))

    each = F.array(*(F.struct(F.lit(i).alias("i"), said(f).alias("text")) for i, f in enumerate(KINDS.values())))
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.inline(each))
    x = (F.col("n_nationkey") * 4 % 97) / 100
    return rows.select((F.col("n_nationkey") * len(KINDS) + F.col("i")).cast("long").alias("question_id"), "text", F.array(x, F.sqrt(1 - x * x)).alias("query"))


def _table() -> str:
    rows = []
    for nation in range(25):
        a = _asked(nation)
        for i, (kind, form) in enumerate(KINDS.items()):
            units, phrases = _facts(form.format(**a))
            relation = kind in ("relation", "both")
            asked = _NOTHING | {"asked_n": a["n"] if kind in ("team", "both") else "NULL"}
            asked |= {"asked_tongue": f"'{a['tongue'].lower()}'", "asked_level": f"'{a['level']}'", "asked_relations": "1"} if relation else {}
            asked |= {"asked_degree": f"'{a['degree']}'", "asked_field": f"'{a['field']}'"} if kind == "degree" else {}
            asked |= {"asked_segment": f"'{a['segment']}'"} if kind in ("term", "role") else {}
            asked |= {"asked_role": f"'{a['role']}'"} if kind == "role" else {}
            labels = f"CAST({_list([c.key for c in conditions(analyze(form.format(**a)))])} AS VARCHAR[])"
            text = form.format(**a)
            rows.append(f"({nation}, {nation * len(KINDS) + i}, '{text}', {labels}, {units}, {phrases}, {', '.join(f'CAST({v} AS {"BIGINT" if k in ("asked_n", "asked_relations") else "VARCHAR"})' for k, v in asked.items())})")
    return f"SELECT v.qid, CAST(n_nationkey * 4 % 97 AS BIGINT) AS hundredths, question, labels, units, phrases, {', '.join(_NOTHING)} FROM nation JOIN (VALUES {', '.join(rows)}) v(nation, qid, question, labels, units, phrases, {', '.join(_NOTHING)}) ON nation = n_nationkey"


_TYPED = " UNION ALL ".join(
    f"SELECT p.*, w.condition, w.weight, {s} AS strength FROM p JOIN w USING (qid) WHERE w.condition = '{k}' AND {t}"
    for k, t, s in (("relation", _RELATION, "whole"), ("numeric", _TEAM, "numeric_"), ("education", _FIELD, "whole"), ("role", _ROLE, "whole"), ("term", "list_contains(terms, asked_segment) AND (list_contains(tokens, asked_segment) OR section IN ('identity', 'skills'))", "whole"))
)
_CONDITIONS = """SELECT qid, 'relation' AS condition, 1.5 AS weight FROM q WHERE asked_relations = 1 UNION ALL SELECT qid, 'numeric', 2.0 FROM q WHERE asked_n IS NOT NULL UNION ALL
SELECT qid, 'education', 1.75 FROM q WHERE asked_degree IS NOT NULL UNION ALL SELECT qid, 'role', 1.25 FROM q WHERE asked_role IS NOT NULL UNION ALL SELECT qid, 'term', 1.0 FROM q WHERE asked_segment IS NOT NULL AND asked_role IS NULL"""
TABLE = _sql(_table(), _TYPED).replace("), k AS (", f"), w AS ({_CONDITIONS}), k AS (", 1)


@query(f"{TABLE} SELECT CAST(qid AS BIGINT) AS question_id, {_ANSWER}")
def question_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """150 questions at once."""
    best = QT.ask_all(chunks(spark, sf_dir), questions(spark, sf_dir))
    return best.select("question_id", "candidate_id", "final_rank", F.round("score", 6).alias("score"), F.round("coverage", 6).alias("coverage"), "outcome")


@query(f"{TABLE} SELECT CAST(qid AS BIGINT) AS question_id, candidate AS candidate_id, condition AS kind, chunk AS chunk_id, round(strength, 6) AS strength FROM b")
def question_table_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hit of each question, candidate and condition."""
    best = QT.evidence(chunks(spark, sf_dir), questions(spark, sf_dir))[2]
    kind = F.when(F.col("kind") == "phrase", "role").otherwise(F.col("kind"))
    return best.select("question_id", "candidate_id", kind.alias("kind"), "chunk_id", F.round("strength", 6).alias("strength"))


@query(f"""WITH n AS (SELECT DISTINCT name FROM {PROFILES}), q AS (SELECT c_custkey AS question_id, concat('Compare ', {_pick('c_custkey', FIRST)}, ' ', {_pick('c_custkey', LAST)}, 's and ', {_pick('c_custkey * 7', FIRST)}, ' ', {_pick('c_custkey * 3', LAST)}, ' of ', lower(c_mktsegment)) AS text FROM customer)
SELECT question_id, name FROM q, n WHERE contains(array_to_string({O.tokens('text')}, ' '), lower(name))""")
def question_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each customer about two people, met with all names."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    text = F.concat(F.lit("Compare "), F.expr(_pick("c_custkey", FIRST)), F.lit(" "), F.expr(_pick("c_custkey", LAST)), F.lit("s and "), F.expr(_pick("c_custkey * 7", FIRST)), F.lit(" "), F.expr(_pick("c_custkey * 3", LAST)), F.lit(" of "), F.lower("c_mktsegment"))
    names = chunks(spark, sf_dir).select(F.col("candidate_name").alias("name"))
    return QT.named(c.select(F.col("c_custkey").alias("question_id"), text.alias("text")), names)


# --- contexts of all questions, by recursion in SQL ---------------------------------------

#: How many chunks and characters a context may have here, so that many are cut.
_BUDGET = {"most_chunks": 7, "most_chars": 1500}
_LABEL = "list_filter(labels, lambda x: starts_with(x, CASE {c} WHEN 'role' THEN 'phrase' ELSE {c} END))[1]"
_CONTEXTS = f"""WITH RECURSIVE {TABLE[len("WITH "):]},
jj AS (SELECT * FROM j WHERE final_rank <= 5),
kb AS (SELECT qid, candidate, chunk, list({_LABEL.format(c='condition')} ORDER BY condition) AS keys, list(weight ORDER BY condition) AS weights FROM b GROUP BY qid, candidate, chunk),
gk AS (SELECT p.qid, p.candidate, p.chunk, p.section, p.text, p.combined, p.semantic, p.rank, coalesce(keys, []) AS keys, coalesce(weights, []) AS weights FROM p JOIN jj USING (qid, candidate) LEFT JOIN kb USING (qid, candidate, chunk)),
gr AS (SELECT qid, candidate, 0 AS step, CAST([] AS VARCHAR[]) AS chosen, list_distinct(flatten(list(keys))) AS open_ FROM gk GROUP BY qid, candidate
  UNION ALL SELECT qid, candidate, step + 1, list_append(chosen, chunk), list_filter(open_, lambda x: NOT list_contains(keys, x)) FROM
  (SELECT r.*, k.chunk, k.keys, row_number() OVER (PARTITION BY r.qid, r.candidate ORDER BY coalesce(list_sum([CASE WHEN list_contains(open_, keys[i]) THEN weights[i] ELSE 0.0 END FOR i IN range(1, len(keys) + 1)]), 0.0) DESC, combined DESC, semantic DESC, rank) AS n
   FROM gr r JOIN gk k ON r.qid = k.qid AND r.candidate = k.candidate AND NOT list_contains(chosen, k.chunk) WHERE step < 4) WHERE n = 1 AND list_has_any(keys, open_)),
gw AS (SELECT qid, candidate, chosen, step FROM gr QUALIFY row_number() OVER (PARTITION BY qid, candidate ORDER BY step DESC) = 1),
gc AS (SELECT qid, candidate, unnest(chosen) AS chunk, generate_subscripts(chosen, 1) AS n FROM gw),
kt AS (SELECT qid, candidate FROM gk GROUP BY qid, candidate HAVING bool_or(len(list_filter(keys, lambda x: starts_with(x, 'term:'))) > 0)),
gf AS (SELECT k.qid, k.candidate, k.chunk, step + row_number() OVER (PARTITION BY k.qid, k.candidate ORDER BY combined DESC, semantic DESC, rank) AS n FROM gk k ANTI JOIN gc USING (qid, candidate, chunk) SEMI JOIN kt USING (qid, candidate) JOIN gw ON gw.qid = k.qid AND gw.candidate = k.candidate),
ge AS (SELECT qid, candidate, chunk, n FROM gc UNION ALL SELECT * FROM gf WHERE n <= 4),
rows_ AS (SELECT jj.qid, jj.final_rank, k.chunk, row_number() OVER (PARTITION BY jj.qid, jj.candidate ORDER BY len(k.keys) = 0, n) AS i, row_number() OVER (PARTITION BY jj.qid ORDER BY jj.final_rank, len(k.keys) = 0, n) AS pos,
  concat('CANDIDATE ', jj.final_rank, ': ', c0.name, ' | ', c0.title, ' | ', jj.candidate, chr(10), 'SUPPORT: ', CASE WHEN any_ THEN 'complete' ELSE 'partial' END, ' | candidate_score=0.0000 | coverage=0.0000', chr(10), 'MATCHED REQUIREMENTS: ', array_to_string(list_filter(q.labels, lambda x: list_contains(lb.labels_, x)), '; ')) AS header,
  concat('page  | ', k.section, ' | ', k.chunk, chr(10), 'SUPPORTS: ', CASE WHEN len(k.keys) = 0 THEN 'support-only' ELSE array_to_string(list_sort(k.keys), ', ') END, chr(10), 'EVIDENCE: ') AS source, k.text
  FROM ge JOIN jj USING (qid, candidate) JOIN gk k ON k.qid = jj.qid AND k.candidate = jj.candidate AND k.chunk = ge.chunk JOIN q ON q.qid = jj.qid JOIN (SELECT DISTINCT candidate, name, title FROM k) c0 ON c0.candidate = jj.candidate
  JOIN (SELECT qid, candidate, list({_LABEL.format(c='condition')}) AS labels_ FROM b GROUP BY qid, candidate) lb ON lb.qid = jj.qid AND lb.candidate = jj.candidate),
go AS (SELECT q.qid, question, coalesce(max(CASE WHEN any_ THEN 'supported' ELSE 'partial' END), 'unsupported') AS outcome, count(jj.qid) AS n_found FROM q LEFT JOIN jj ON jj.qid = q.qid GROUP BY q.qid, question),
says AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{v}')" for k, v in ranking.SAYS.items())}) y(outcome, says)),
fold AS (SELECT qid, CAST(0 AS BIGINT) AS pos, length(concat('QUESTION: ', question, chr(10), 'RETRIEVAL OUTCOME: ', outcome, chr(10), 'QUALITY BOUNDARY: ', says)) AS base, CAST(0 AS BIGINT) AS cur, 0 AS got, CAST([] AS VARCHAR[]) AS ids, 0 AS n_cand, false AS full_, false AS stop_, false AS short_ FROM go JOIN says USING (outcome)
  UNION ALL SELECT qid, pos, base_, CASE WHEN put THEN cur_ + 1 + head + least(length(text), room) ELSE cur_ END, got_ + CASE WHEN put THEN 1 ELSE 0 END, CASE WHEN put THEN list_append(ids, chunk) ELSE ids END,
    n_cand + CASE WHEN put AND got_ = 0 THEN 1 ELSE 0 END, inner_ OR tight, stopped, short_ OR stopped OR (tight AND NOT inner_)
  FROM (SELECT *, NOT stopped AND NOT inner_ AND NOT tight AS put FROM (SELECT *, NOT stopped AND NOT inner_ AND (len(ids) >= {_BUDGET['most_chunks']} OR room < 40) AS tight FROM (SELECT *, least(900, {_BUDGET['most_chars']} - base_ - 2 - cur_ - 1 - head) AS room FROM (
    SELECT f.qid, r.pos, r.chunk, r.text, f.ids, f.n_cand, f.short_, CASE WHEN r.i = 1 AND r.pos > 1 THEN f.base + 2 + f.cur ELSE f.base END AS base_, CASE WHEN r.i = 1 THEN length(r.header) ELSE f.cur END AS cur_, CASE WHEN r.i = 1 THEN 0 ELSE f.got END AS got_, CASE WHEN r.i = 1 THEN false ELSE f.full_ END AS inner_,
      length(concat('SOURCE ', CASE WHEN r.i = 1 THEN 0 ELSE f.got END + 1, ': ', r.source)) AS head,
      f.stop_ OR (r.i = 1 AND ((r.pos > 1 AND f.got = 0) OR len(f.ids) >= {_BUDGET['most_chunks']} OR {_BUDGET['most_chars']} - CASE WHEN r.pos > 1 THEN f.base + 2 + f.cur ELSE f.base END <= length(r.header) + 80)) AS stopped
    FROM fold f JOIN rows_ r ON r.qid = f.qid AND r.pos = f.pos + 1))))),
ends AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY qid ORDER BY pos DESC) = 1)
SELECT CAST(go.qid AS BIGINT) AS question_id, CASE WHEN n_cand > 0 THEN outcome ELSE 'unsupported' END AS outcome, array_to_string(ids, ',') AS chunk_ids, CAST(n_cand AS INTEGER) AS n_candidates, short_ OR n_cand < n_found AS budget_exhausted FROM ends JOIN go USING (qid)"""


@query(_CONTEXTS)
def question_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contexts of all questions, under a small budget."""
    rows = QT.answers(chunks(spark, sf_dir), questions(spark, sf_dir), **_BUDGET)
    return rows.select("question_id", "outcome", F.array_join("chunk_ids", ",").alias("chunk_ids"), "n_candidates", "budget_exhausted")


# --- identity ------------------------------------------------------------------------------


@query("""SELECT source AS candidate_id, count(DISTINCT lang) AS n_names, count(DISTINCT CASE WHEN doc_id % 5 = 0 THEN source END) AS n_titles FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1""")
def identity_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as candidates, with the language in place of the name."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = d.select(F.col("source").alias("candidate_id"), F.col("lang").alias("candidate_name"), F.when(F.col("doc_id") % 5 == 0, F.col("source")).alias("professional_title"))
    return ranking.conflicts(rows)
