"""Many questions at once against single ones, the cover and the context against plain forms."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import ingest, ranking
from lodestone.plans import question_table as QT
from lodestone.plans.ask import ask
from tests.literal_chunks import chunks as literal_chunks

QUESTIONS = [
    "Which frontend candidates have accessibility experience?", "Who managed at least 8 engineers and is native in German?", "Compare Ada Lovelace and Alan Turing for a cloud data engineering role",
    "Who has an MSc in computer science?", "Who has a bachelor of science in mathematics?", "Which candidates know cloud and data?", "more than 3 projects", "Who led exactly eleven developers?",
    "Emmy Noether", "Who is fluent in English?", "data engineers", "who is the", "Someone who delivered 8 projects in the cloud", "Who supervised over 10 people?", "frontend developers with accessible flows",
]


@pytest.fixture(scope="module")
def index(spark):
    return literal_chunks(spark)


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(i, t, [1.0 - i / 40, (1 - (1.0 - i / 40) ** 2) ** 0.5]) for i, t in enumerate(QUESTIONS)]
    return spark.createDataFrame(rows, "question_id long, text string, query array<double>")


def test_equals_single_questions(index, asked):
    for k in (3, 50):
        got = {}
        for r in QT.ask_all(index, asked, k=k).collect():
            got.setdefault(r.question_id, []).append((r.final_rank, r.candidate_id, round(r.score, 9), round(r.coverage, 9), r.outcome))
        for q in asked.collect():
            want = [(r.final_rank, r.candidate_id, round(r.score, 9), round(r.coverage, 9), r.outcome) for r in ask(index, q.text, q["query"], k=k).collect()]
            assert sorted(got.get(q.question_id, [])) == sorted(want), (k, q.text)


def test_degree_fields_count_as_roles_do(spark):
    row = ("c1", "k1", "Ada Lovelace", None, "education", "Bachelor of science in software development", [1.0, 0.0])
    one = spark.createDataFrame([row], literal_chunks(spark).schema)
    text = "Who has a bachelor of science in software development?"
    asked = spark.createDataFrame([(1, text, [1.0, 0.0])], "question_id long, text string, query array<double>")
    kinds = {(r.kind, r.strength > 0) for r in QT.evidence(one, asked)[2].collect()}
    assert ("education", True) in kinds
    assert ask(one, text, [1.0, 0.0]).first().n_matched == 2


def test_headings_are_no_names(spark):
    lines = F.array(*map(F.lit, ["Professional Summary", "Ada Lovelace", "Work Experience", "Engineer"]))
    assert tuple(spark.range(1).select(ingest.detected(lines).alias("d")).first().d) == ("Ada Lovelace", "Engineer")


def plain_cover(rows, limit):
    """Greedy cover, one hit after the other."""
    rest, chosen = [dict(r) for r in rows], []
    strongest = lambda r: (r["combined"], r["semantic"], -r["rank"])
    kinds = {c[2] for r in rest for c in r["conditions"] or ()}
    left = {c[0] for r in rest for c in r["conditions"] or ()}
    while left and rest and len(chosen) < limit:
        best = max(rest, key=lambda r: (sum(c[1] for c in r["conditions"] or () if c[0] in left), *strongest(r)))
        if not left & {c[0] for c in best["conditions"] or ()}:
            break
        left -= {c[0] for c in best["conditions"]}
        chosen.append(best)
        rest.remove(best)
    if not kinds or "term" in kinds:
        chosen += sorted(rest, key=strongest, reverse=True)[: limit - len(chosen)]
    return [(r["chunk_id"], i, ",".join(sorted(c[0] for c in r["conditions"] or ()))) for i, r in enumerate(chosen, 1)]


def test_cover_equals_its_plain_form(spark):
    rng = random.Random(4)
    rows = []
    for q in range(2):
        for k in range(25):
            kinds = rng.choice([["term", "role"], ["role", "numeric"], []])
            for i in range(rng.randrange(1, 9)):
                own = [(c, w, kinds[n % len(kinds)]) for n, (c, w) in enumerate(zip("abcdef", (1.0, 1.5, 2.0, 1.25, 1.0, 1.75), strict=True)) if kinds and rng.random() < 0.3]
                rows.append({"question_id": q, "candidate_id": f"k{k}", "chunk_id": f"c{k}-{i}", "combined": rng.randrange(4) / 4, "semantic": rng.randrange(3) / 3, "rank": i + 1, "conditions": own or None})
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "question_id long, candidate_id string, chunk_id string, combined double, semantic double, rank int, conditions array<struct<key: string, weight: double, kind: string>>")
    for limit in (1, 3, 4):
        got = {}
        for r in ranking.select_evidence(df.repartition(5), limit, ["question_id"]).collect():
            got.setdefault((r.question_id, r.candidate_id), []).append((r.chunk_id, r.evidence_order, r.condition_keys))
        for key in {(r["question_id"], r["candidate_id"]) for r in rows}:
            own = [r for r in rows if (r["question_id"], r["candidate_id"]) == key]
            assert sorted(got.get(key, []), key=lambda x: x[1]) == plain_cover(own, limit)


def plain_context(question, outcome, found, blocks, most_chunks, most_chars, most_text, each):
    """The context, grown as a list of parts."""
    parts = [f"QUESTION: {question}\nRETRIEVAL OUTCOME: {outcome}\nQUALITY BOUNDARY: {ranking.SAYS[outcome]}"]
    ids, n, short = [], 0, False
    for rank, k, name, title, score, coverage, labels in found:
        if len(ids) >= most_chunks:
            short = True
            break
        head = f"CANDIDATE {rank}: {name or 'Unknown candidate'} | {title or 'Unknown title'} | {k}\nSUPPORT: {'complete' if outcome == 'supported' else 'partial'} | candidate_score={score:.4f} | coverage={coverage:.4f}\nMATCHED REQUIREMENTS: {'; '.join(labels) or 'none'}"
        if most_chars - len("\n\n".join(parts)) <= len(head) + 80:
            short = True
            break
        own = []
        for order, chunk, text, keys, section in sorted(blocks.get(k, []), key=lambda b: (not b[3], b[0]))[:each]:
            if len(ids) + len(own) >= most_chunks:
                short = True
                break
            meta = f"SOURCE {len(own) + 1}: f.pdf | page 1 | {section} | {chunk}\nSUPPORTS: {', '.join(keys) or 'support-only'}"
            room = min(most_text, most_chars - len("\n\n".join(parts)) - 2 - len(head) - sum(len(b) + 1 for _, b in own) - 1 - len(meta) - len("\nEVIDENCE: "))
            if room < 40:
                short = True
                break
            text = " ".join(text.split())
            text = text if len(text) <= room else text[: room - 3].rstrip() + "..."
            own.append((chunk, f"{meta}\nEVIDENCE: {text}"))
        if not own:
            short = True
            break
        n += 1
        ids += [c for c, _ in own]
        parts.append("\n".join([head, *(b for _, b in own)]))
    return "\n\n".join(parts), ids, n, short or n < len(found)


def test_contexts_equal_their_plain_form(spark):
    rng = random.Random(8)
    questions, found, evidence, given = [], [], [], {}
    for q in range(12):
        outcome, own, blocks = rng.choice(["supported", "partial"]), [], {}
        for rank in range(1, rng.randrange(2, 7)):
            k = f"k{rank}"
            own.append((rank, k, rng.choice(["Ada L", None]), rng.choice(["Engineer", None]), rng.random(), rng.random(), [f"label {i}" for i in range(rng.randrange(3))]))
            found.append((q, rank, k, *own[-1][2:6], outcome, own[-1][6]))
            for order in range(1, rng.randrange(1, 7)):
                keys = [f"key{i}" for i in range(rng.randrange(3))]
                b = (order, f"c{q}-{k}-{order}", "word  and\nmore " * rng.randrange(1, 40), keys, "skills")
                blocks.setdefault(k, []).append(b)
                evidence.append((q, k, order, ",".join(keys), b[1], b[2], "skills", "f.pdf", "1"))
        questions.append((q, f"Question {q}?"))
        given[q] = (f"Question {q}?", outcome, own, blocks)
    questions.append((99, "Nothing?"))
    frames = (
        spark.createDataFrame(questions, "question_id long, text string"),
        spark.createDataFrame(found, "question_id long, final_rank int, candidate_id string, candidate_name string, professional_title string, score double, coverage double, outcome string, labels array<string>"),
        spark.createDataFrame(evidence, "question_id long, candidate_id string, evidence_order long, condition_keys string, chunk_id string, text string, section_name string, source_filename string, page_label string"),
    )
    for budget in ((12, 7000, 900, 4), (5, 1500, 300, 2), (12, 700, 900, 4), (3, 100, 50, 1)):
        got = {r.question_id: r for r in ranking.contexts(*frames, *budget).collect()}
        for q, x in given.items():
            text, ids, n, short = plain_context(*x, *budget)
            r = got[q]
            if n:
                assert (r.context_text, r.chunk_ids, r.n_candidates, r.budget_exhausted, r.outcome) == (text, ids, n, short, x[1]), (q, budget)
                assert len(r.context_text) <= budget[1]
            else:
                assert (r.outcome, r.n_candidates, r.budget_exhausted) == ("unsupported", 0, True) and ranking.SAYS["exhausted"][:20] in r.context_text or budget[1] == 100
        assert got[99].outcome == "unsupported" and not got[99].budget_exhausted


def test_answers_of_a_table(index, asked):
    rows = QT.answers(index, asked).collect()
    assert {r.question_id for r in rows} == set(range(len(QUESTIONS)))
    best = {r.question_id: r for r in rows}
    assert best[1].outcome == "supported" and "CANDIDATE 1: Emmy Noether" in best[1].context_text and best[1].chunk_ids[0] == "c10"
    assert best[11].outcome == "unsupported" and best[11].context_text.endswith("CANDIDATES: none")


def test_names_are_found_as_by_plain_search(spark):
    from lodestone.plans.questions import normalize

    names = ["Ada Lovelace", "Ada", "Émile Zola", "da Lo", "Jean-Paul van der Berg", "x", "", "Zola", "Lovelace and"]
    texts = ["Compare Ada Lovelaces and Émile  ZOLA", "jean-paul VAN DER bergs", "nothing", "", None, "Is adaloveland near?", "Adam and Ada, and Zolas"]
    questions = spark.createDataFrame(list(enumerate(texts)), "question_id long, text string")
    got = {tuple(r) for r in QT.named(questions, spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == {(i, n) for i, t in enumerate(texts) for n in names if normalize(n) and normalize(n) in normalize(t or "")}
    assert QT.named(questions, spark.createDataFrame([("",)], "name string")).count() == 0
