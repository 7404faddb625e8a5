"""What a reviewer's larger tables showed, on small rows."""

from pyspark.sql import functions as F

from lodestone.operators import ingest
from lodestone.plans import catalogue
from tests.oracle import compare


def documents(spark, tmp_path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    next((tmp_path / "d").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    return str(tmp_path)


def test_lines_keep_digits_at_their_ends(spark, tmp_path):
    at = documents(spark, tmp_path, ["0 begins and ends in 0\n1 and 1\n 2 ", "", "4490", None])
    assert compare(spark, at, catalogue.queries()["chunk_pack_greedy"], catalogue.oracle_sql()["chunk_pack_greedy"]) == 3
    lines = spark.read.parquet(f"{at}/documents.parquet").where("doc_id = 0").select(ingest.header_lines("text").alias("l")).first().l
    assert lines == ["0 begins and ends in 0", "1 and 1", "2"]


def test_terms_are_found_at_the_ends_of_tokens(spark, tmp_path):
    at = documents(spark, tmp_path, ["que### a", "the+ b", "the++", ".netthe", ".net.der", "x.network", "c#the", "c++tion", "the.que", "der#tion", "etc.the", "the-que", ""])
    for name in ("lexical_score", "phrase_match"):
        assert compare(spark, at, catalogue.queries()[name], catalogue.oracle_sql()[name]) == 13


def test_token_search_equals_the_token_list(spark):
    from lodestone.functions import text as T

    rows = ["c", "c#", "c++", "c+", "abc#", "c.d", ".c", "c++x", "x.c#", ".net c#", ".netc", "cookies", "cookie", "net", ".net", "x.net", "C-sharp", "c#c"]
    df = spark.createDataFrame([(r,) for r in rows], "text string")
    for term in ("c", "c#", "c++", "net", "cookie"):
        got = df.select("text", T.has_token(T.searchable("text"), T.surface_forms(term)).alias("a"), T.canonical_terms("text").alias("t")).collect()
        assert [(r.text, r.a) for r in got] == [(r.text, term in r.t) for r in got], term


def test_equal_matches_have_equal_scores(spark):
    from lodestone.operators import ranking

    strengths = {"a": (0.1, 0.2, 0.3), "b": (0.3, 0.2, 0.1)}
    hits = spark.createDataFrame([("a", 0.5, 0.5, 2), ("b", 0.5, 0.5, 1)], "candidate_id string, semantic double, combined double, rank int")
    matches = spark.createDataFrame([(c, f"{c}{i}", 1.0, s) for c, each in strengths.items() for i, s in enumerate(each)], "candidate_id string, condition string, weight double, strength double")
    rows = ranking.candidates(hits, matches.coalesce(1), 3.0, 3).orderBy("candidate_rank").collect()
    assert rows[0].score == rows[1].score and [r.candidate_id for r in rows] == ["b", "a"]


def test_each_different_text_is_scored_once(spark, monkeypatch):
    from lodestone.plans import question_table as QT

    seen = []
    monkeypatch.setattr(QT, "_texts", lambda c, f=QT._texts: seen.append(f(c)) or seen[0])
    rows = [(f"c{i:03d}", f"k{i}", f"N {i}", None, "skills", "kafka" if i % 2 else "Managed a team of 9 engineers. 3 projects", [1.0, 0.0]) for i in range(400)]
    chunks = spark.createDataFrame(rows, "chunk_id string, candidate_id string, candidate_name string, professional_title string, section_name string, text string, embedding array<double>")
    asked = spark.createDataFrame([(1, "Who knows kafka?", [1.0, 0.0]), (2, "Who managed at least 8 engineers?", [1.0, 0.0]), (3, "3 projects", [1.0, 0.0])], "question_id long, text string, query array<double>")
    facts = QT.parsed(asked)
    got = QT.assisted(chunks, facts, k=10).where("is_supplemental").collect()
    assert seen[0].count() == 2
    odd, even = ({f"c{i:03d}" for i in list(range(s, 400, 2))[-50:]} for s in (1, 0))
    assert [{r.chunk_id for r in got if r.question_id == q} for q in (1, 2, 3)] == [odd, even, even]


def test_numbers_of_a_text_prove_what_its_clauses_do(spark):
    from lodestone.functions import text as T
    from lodestone.operators import evidence as E

    texts = ["Managed a team of 8 engineers.", "at least ten years of experience; 3 cloud projects", "no number", "", "Led over 12 people and 4 teams! 5 years of career", "1.5 projects in the cloud, up to 20 reports supervised"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("c", T.clauses("text")).withColumn("n", E.numbers("c"))
    context = spark.range(1).selectExpr("array(array('cloud'), array('project')) AS w").first().w
    for relation in ("team_size", "experience_duration", "generic"):
        for operator in ("eq", "gte", "gt", "lte", "lt"):
            for value in (3.0, 8.0, 12.0):
                args = [F.lit(value), F.lit(operator), F.lit(relation), F.array(*(F.array(*map(F.lit, w)) for w in context))]
                assert df.where(E.numeric(F.col("c"), *args) != E.numeric_of(F.col("n"), *args)).count() == 0


def test_name_search_broadcasts_no_exploded_questions(spark):
    from lodestone.plans import question_table as QT

    questions = spark.createDataFrame([(i, f"Compare Ada Lovelaces and {'word ' * 20} number {i}") for i in range(50)], "question_id long, text string")
    names = spark.createDataFrame([("Ada Lovelace",), ("Alan de Turing",)], "name string")
    plan = QT.named(questions, names)
    assert plan.count() == 50
    assert "Generate" not in plan._jdf.queryExecution().toString()
