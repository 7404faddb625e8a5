"""Queries whose time grew beyond their limit, on small rows."""

from pyspark.sql import functions as F

from lodestone.plans import catalogue, catalogue_ask, catalogue_more  # noqa: F401
from tests.oracle import compare
from tests.test_findings import documents


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_terms_are_counted_within_their_documents(spark, tmp_path):
    at = documents(spark, tmp_path, ["Teams team, the TEAM. Études etude", None, "", "-. .-", "team natively native\nskills skill", "the the"])
    assert compare(spark, at, catalogue.queries()["canonical_terms"], catalogue.oracle_sql()["canonical_terms"]) == 5
    assert "doc_id" not in plan(catalogue.queries()["canonical_terms"](spark, at)).split("Relation")[0]


def test_small_files_are_dealt_to_all_cores(spark, tmp_path):
    from lodestone.sources.shared import spread

    one = spark.read.parquet(documents(spark, tmp_path, ["a"] * 50) + "/documents.parquet")
    assert one.rdd.getNumPartitions() == 1 and spread(one).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    many = spark.range(0, 100, 1, 40).select(F.col("id"))
    assert spread(many) is many


def test_facts_are_compared_with_the_words_of_each_row(spark):
    from lodestone.operators import quality

    docs = spark.createDataFrame([(1, ["abcd", "x"]), (2, ["zabcdz", "x", "y"]), (3, None), (4, [""]), (5, ["x"])], "d long, words array<string>")
    facts = spark.createDataFrame([("a", ["abcd", "x"]), ("b", ["y", "x"]), ("c", ["none", "x"]), ("d", [""]), ("e", None)], "f string, words array<string>")
    rows = quality.proving_documents(docs, facts, "d", "f")
    assert {tuple(r) for r in rows.collect()} == {("a", 2), ("b", 1)}
    twice = docs.union(docs.where("d = 1"))
    assert {tuple(r) for r in quality.proving_documents(twice, facts, "d", "f").collect()} == {("a", 3), ("b", 1)}


def test_plain_and_other_texts_have_the_same_words(spark, tmp_path):
    at = documents(spark, tmp_path, ["Ab_c, 12-x\t(É) ", "Ab_c, 12-x\t() ", "ÀB…c", "", " ab ", "áb c"])
    spark.createDataFrame([(1, "ab"), (2, "ab_c 12"), (3, "àb"), (4, "x")], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "b"))
    next((tmp_path / "b").glob("*.parquet")).rename(tmp_path / "benchmark.parquet")
    compare(spark, at, catalogue.queries()["fact_token_coverage"], catalogue.oracle_sql()["fact_token_coverage"])


def test_numbers_are_found_once_for_all_wanted_ones(spark, sf):
    df = catalogue.queries()["numeric_operators"](spark, sf)
    assert compare(spark, sf, catalogue.queries()["numeric_operators"], catalogue.oracle_sql()["numeric_operators"]) == df.count()
    assert plan(df).count("split(") == 1
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_texts_without_numbers_are_told_at_once(spark):
    from lodestone.functions import text as T
    from lodestone.operators import evidence as E

    texts = ["Led SEVEN engineers", "led síx people", "no count", "K ﬁve", "", None, "Managed 9 engineers. 2 years of experience", "ｎine ８"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", E.numbers(T.clauses("text")).alias("a"), E.numbers_of_text(F.col("text")).alias("b"))
    assert df.where(~F.col("a").eqNullSafe(F.col("b"))).count() == 0


def test_a_questions_numbers_are_found_once(spark, sf):
    from lodestone.plans.ask import features
    from lodestone.plans.questions import analyze

    chunks = catalogue_ask.chunks(spark, sf)
    assert chunks.rdd.getNumPartitions() > 5 * spark.sparkContext.defaultParallelism
    scored = features(chunks, analyze(catalogue_ask.WHO["numbers"])).where("numeric > 0").select("chunk_id", "numeric", "contextual")
    assert plan(scored).count("Filter exists(") <= 1 and scored.count() > 0
    for name in ("ask_numbers", "ask_numbers_evidence"):
        assert compare(spark, sf, catalogue.queries()[name], catalogue.oracle_sql()[name]) > 0


def test_documents_of_a_small_file_are_dealt_out_before_they_are_cut(spark, sf):
    assert "Repartition" in plan(catalogue.queries()["chunk_documents"](spark, sf))
