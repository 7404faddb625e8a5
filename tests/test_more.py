"""Conditions, limits, sources, evaluation, ingestion and the stream into the index."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import answers, evaluation, ingest, quality, ranking
from lodestone.plans import questions as Q
from lodestone.plans.ask import Limits, ask, condition_strength, features
from lodestone.sources import files
from lodestone.sources.store import ChunkIndex
from lodestone.streaming import ingest as stream
from tests.literal_chunks import chunks as literal_chunks


def keys(text, names=()):
    return [(c.kind, c.key.split(":", 1)[1]) for c in Q.conditions(Q.analyze(text), names)]


@pytest.mark.parametrize(
    ("text", "names", "want"),
    [
        ("Find a native German backend engineer.", ["Jonas Keller"], [("relation", "language_proficiency:german+native"), ("phrase", "backend engineer")]),
        ("Which frontend candidates have accessibility experience?", [], [("role", "frontend"), ("term", "accessibility")]),
        ("Compare Aino Korhonen and Lukas Gruber for a cloud data engineering role.", ["Aino Korhonen", "Lukas Gruber", "Javier Molina"], [("identity", "explicit-candidate"), ("phrase", "data engineering"), ("term", "cloud")]),
        ("frontend candidates who are engineers", [], [("role", "frontend"), ("role", "engineer")]),
        ("Someone with a QA automation background", [], [("role", "qa"), ("term", "automation")]),
        ("People with a data background", [], [("role", "data")]),
        ("Who led at least 12 people?", [], [("numeric", "0:team_size:gte:12")]),
        ("more than 5 years of Python experience", [], [("numeric", "0:experience_duration:gt:5"), ("term", "python")]),
        ("Who is fluent in French and a native German speaker?", [], [("relation", "language_proficiency:french+fluent"), ("relation", "language_proficiency:german+native")]),
        ("mother tongue is Greek", [], [("relation", "language_proficiency:greek+native")]),
        ('"cloud platform" experience', [], [("term", "cloud"), ("term", "platform")]),
    ],
)
def test_conditions(text, names, want):
    assert keys(text, names) == want


def test_identity_takes_any_of_the_names(spark):
    c = Q.conditions(Q.analyze("Compare Ada Lovelace and Alan Turing"), ["Ada Lovelace", "Alan Turing"])
    assert len(c) == 1 and c[0].payload == ("ada lovelace", "alan turing") and c[0].weight == 2.0
    got = ask(literal_chunks(spark), "Compare Ada Lovelace and Alan Turing", [1.0, 0.0]).collect()
    assert {r.candidate_id for r in got if r.outcome == "supported"} == {"k1", "k2"}


@pytest.mark.parametrize(
    ("question", "section", "title", "text", "met"),
    [
        ("backend engineer", "experience", None, "Backend developer of services", True),
        ("backend engineer", "experience", None, "Designer who worked along with the backend developers", False),
        ("backend engineer", "languages", None, "backend engineer", False),
        ("backend engineer", "languages", "Senior Backend Developer", "German", True),
        ("Who is an engineer?", "experience", None, "Engineer of services", False),
        ("Who is an engineer?", "identity", None, "Kurt, engineer", True),
        ("data engineer", "professional_summary", None, "Data platform engineer", True),
        ("Python", "experience", None, "uses python daily", True),
        ("manager", "experience", None, "led the team", False),
        ("manager", "skills", None, "led the team", True),
        ("MSc in computer science", "education", None, "MSc in computer science", True),
        ("MSc in computer science", "experience", None, "MSc in computer science", False),
        ("MSc in computer science", "education", None, "MSc in arts, BSc in computer science", False),
        ("MSc in computer engineering", "skills", None, "master of science, computer development", True),
    ],
)
def test_condition_evidence(spark, question, section, title, text, met):
    q = Q.analyze(question)
    row = spark.createDataFrame([(section, title, text, "x")], "section_name string, professional_title string, text string, candidate_name string")
    scored = features(row, q).withColumn("semantic", F.lit(0.5)).withColumn("combined", F.lit(0.5))
    (c,) = Q.conditions(q)
    got = scored.select(condition_strength(c).alias("s"), "lexical").first()
    assert got.s == pytest.approx(min(1.0, 0.7 * got.lexical + 0.15) if met else 0.0)


def test_ordered_words_count_from_their_first_place(spark):
    from lodestone.functions import text as T

    for words, want in (("a x x b", True), ("a x x x b", False), ("a x a x x b", False), ("a x x x b a b", True)):
        assert spark.range(1).select(T.ordered_subsequence(F.split(F.lit(words), " "), ["a", "b"])).first()[0] is want, words


def test_limits_and_conflicts(spark):
    limits = Limits()
    assert (limits.raw(), limits.candidates(30), limits.evidence(), limits.final(10)) == (50, 30, 4, 10)
    for f, n in ((limits.raw, 201), (limits.candidates, 0), (limits.final, 11)):
        with pytest.raises(ValueError, match="between"):
            f(n)
    with pytest.raises(ValueError, match="default"):
        Limits(raw_default=300)
    rows = spark.createDataFrame([("a", "A", None), ("a", "A", "t"), ("b", "B", "t"), ("b", "C", "t")], "candidate_id string, candidate_name string, professional_title string")
    with pytest.raises(ValueError, match="candidate b"):
        ranking.reject_conflicts(rows)
    ranking.reject_conflicts(rows.where("candidate_id = 'a'"))


def test_diagnosis():
    d = Q.diagnose(Q.analyze("Which backend engineers know a good Python background?"))
    assert d["unconditioned"] == () and "which" in d["discarded"] and "background" in d["discarded"]


def test_headers_and_overrides(spark):
    lines = F.array(*map(F.lit, ["Curriculum 2024", "Ada Lovelace", "candidate_001", "ada@x.org", "Data engineer", "London"]))
    row = spark.range(1).select(ingest.detected(lines).alias("d"), ingest.preferred(F.lit("  "), F.lit(" Ada  L ")).alias("p"), ingest.preferred(F.lit("B"), F.lit("A")).alias("q")).first()
    assert (row.d.candidate_name, row.d.professional_title, row.p, row.q) == ("Ada Lovelace", "Data engineer", "Ada L", "B")
    pages = spark.createDataFrame([([1, 2],), ([7],)], "page_numbers array<int>")
    assert sorted(r[0] for r in ingest.unflattened(ingest.flattened(pages)).collect()) == [[1, 2], [7]]


def test_sequence_of_ids(spark):
    rows = spark.createDataFrame([("c_001",), ("c_003",), ("c_003",), ("x",)], "id string")
    assert {tuple(r) for r in quality.sequence_problems(rows, "id", "c").collect()} == {("x", "form"), ("c_003", "repeated"), ("c_002", "gap")}


def test_traceable_results(spark):
    cols = "question_id int, returned_id string, candidate_id string, document_id string, document_hash string, source_filename string, section_name string, page_numbers array<int>, chunk_id string"
    good = ("a", "a", "d", "h", "f.pdf", "skills", [1], "chunk_1")
    rows = [(1, *good), (2, "b", *good[1:]), (3, *good[:6], [], "chunk_1"), (4, *good), (5, *good)]
    context = spark.createDataFrame([(k, "f.pdf chunk_1") for k in (1, 2, 3)] + [(4, "f.pdf")], "question_id int, context string")
    got = {r.question_id: r.source_traceable for r in evaluation.traceable(spark.createDataFrame(rows, cols), context).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_totals_gaps_and_references(spark):
    done = spark.createDataFrame([(1, "supported", [], True, True), (2, "error", ["a"], False, False)], "scenario_id int, outcome string, missing array<string>, budget_compliant boolean, passed boolean")
    assert tuple(evaluation.totals(done).first()) == (2, 1, 1, 1, 1, 1)
    c = spark.createDataFrame([(1, "a", ["x"]), (1, "b", ["x", "y"])], "question_id int, candidate_id string, labels array<string>")
    gaps = evaluation.label_gaps(c, spark.createDataFrame([(1, ["x", "y"])], "question_id int, labels array<string>"), spark.createDataFrame([(1, "b")], "question_id int, candidate_id string"))
    assert {(r.candidate_id, tuple(r.missing), r.selected) for r in gaps.collect()} == {("a", ("y",), False), ("b", (), True)}
    a = spark.createDataFrame([(1, ["s1", "s2"], ["s2"]), (2, None, ["s3"])], "question_id int, one array<string>, two array<string>")
    assert sorted(map(tuple, answers.referenced(a, "one", "two").collect())) == [(1, "s1"), (1, "s2"), (2, "s3")]


def test_file_selection(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.PDF").write_text("one")
    (tmp_path / "b.txt").write_text("no")
    assert [r.name for r in files.documents(spark, select_all=str(tmp_path)).collect()] == ["a.PDF"]
    for wrong, match in ((dict(files=[str(tmp_path / "b.txt")]), "not a"), (dict(directory=str(tmp_path)), "no .pdf"), (dict(files=[]), "no file"), (dict(directory="x", select_all="y"), "both")):
        with pytest.raises(ValueError, match=match):
            files.documents(spark, **wrong)
    assert [files.safe_name(n) for n in ("a.pdf", "../a", "a/b", "", "..", "a\\b")] == [True, False, False, False, False, False]


def test_proving_documents(spark):
    docs = spark.createDataFrame([(1, ["the", "pineapples", "grow"]), (2, ["apple", "trees"]), (3, ["the"]), (4, [])], "d int, words array<string>")
    facts = spark.createDataFrame([("a", ["apple"]), ("b", ["the", "apple"]), ("c", ["he"]), ("d", ["zzz"])], "f string, words array<string>")
    assert {tuple(r) for r in quality.proving_documents(docs, facts, "d", "f").collect()} == {("a", 2), ("b", 1)}


def test_stream_fills_the_index(spark, tmp_path):
    rows = [(i, f"Ada {i}\n\nSKILLS\nPython and Spark {i}\n\nEDUCATION\nMSc in maths {i}", f"k{i}") for i in range(3)]
    spark.createDataFrame([*rows, (9, rows[0][1], "k9")], "doc_id long, text string, who string").write.parquet(f"{tmp_path}/docs")
    index = ChunkIndex(spark, f"file://{tmp_path}/index", {"index_version": "1", "embedding_model": "m", "dimension": 2, "chunking_version": "section-v1", "metric": "cosine"})
    embed = lambda c: c.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>"))
    for _ in range(2):  # the second run finds nothing new
        s = stream.start(stream.files(spark, f"file://{tmp_path}/docs"), "doc_id", "text", f"file://{tmp_path}/ledger", f"file://{tmp_path}/checkpoint", stream.into_index(index, embed, "text", "who"))
        s.awaitTermination()
        got = index.chunks().groupBy("section_name").count().collect()
        assert {(r[0], r[1]) for r in got} == {("identity", 3), ("skills", 3), ("education", 3)}
    assert index.healthy()
    assert tuple(index.info().select("n_records", "n_documents", "metric").first()) == (9, 3, "cosine")
    index.reset()
    assert index.chunks().count() == 0


def test_searchable_profile(spark):
    from lodestone.operators import profiles

    full = ("candidate_001", "Ada L", "Engineer", "data_engineer", "senior", 7.5, "Builds.", "London", "UK", [("Lead", "ACME", None, ["led work"], ["Spark"], 8), ("Dev", "B", "Paris", [], [], None)], [("MSc", "maths", "UCL", "London")], [("SQL", "data")], [("German", "native")], [("AWS", "Amazon", 2020)], [("P", "does x", ["Java"], None)])
    bare = ("candidate_002", *[None] * 14)
    got = {r.candidate_id: r.s for r in spark.createDataFrame([full, bare], profiles.PROFILE).select("candidate_id", profiles.searchable().alias("s")).collect()}
    assert got["candidate_001"] == (
        "candidate_001 Ada L Engineer data_engineer data engineer senior 7.5 Builds. London UK Lead ACME led work Spark managed team size 8 team size 8 managed 8 engineers Dev B Paris "
        "MSc maths UCL London SQL data German native German native certification certifications AWS Amazon 2020 P does x Java"
    )
    assert got["candidate_002"] == "candidate_002"
