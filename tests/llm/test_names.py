"""Callers' columns of any name come back unchanged."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm.html_text import extract
from lodestone.llm.quality_rules import quality_rules
from lodestone.llm.sharding import shard
from lodestone.llm.substring_dedup import substring_dedup

ODD = ["__firsts", "__k", "__o", "__w", "__i", "__h", "__html", "__id", "__label", "k", "o", "i", "x", "n", "c", "row", "page", "label", "id", "firsts", "a.b", "sp ace", "ti`ck"]


def odd(df):
    return df.withColumns({c: F.lit(i) for i, c in enumerate(ODD)})


def check(got, df, n=None):
    assert set(ODD) <= set(got.columns)
    same = got.select(*(F.col("`" + c.replace("`", "``") + "`").alias(f"v{i}") for i, c in enumerate(ODD)))
    rows = same.collect()
    assert len(rows) == (df.count() if n is None else n)
    assert all(list(r) == list(range(len(ODD))) for r in rows)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_substring_dedup(docs):
    plain = substring_dedup(docs).select("doc_id", "n_removed", "kept_text")
    got = substring_dedup(odd(docs).withColumn("n_words", F.lit("theirs")))
    check(got, docs)
    assert sorted(map(tuple, got.select("doc_id", "n_removed", "kept_text").collect())) == sorted(map(tuple, plain.collect()))


def test_quality_rules_and_shard(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    check(quality_rules(odd(docs), labels), docs)
    check(shard(odd(docs)), docs)


def test_labels_beyond_the_bound_are_a_part_by_hash(spark, sf, docs):
    from lodestone.llm.quality_rules import learn

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert learn(docs, labels, most_labelled=60) == learn(docs.repartition(5), labels.repartition(3), most_labelled=60)


def test_extract(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    check(extract(odd(pages)), pages)


@pytest.mark.parametrize("at", range(4))
def test_stages(spark, sf, docs, at):
    stage = corpus_pipeline.STAGES[at][1]
    given = odd(docs).withColumns({"n_removed": F.lit("mine"), "kept": F.lit("mine"), "n_words": F.lit("mine")})
    got = stage(spark, given, sf)
    assert got.columns == given.columns
    assert sorted(map(repr, got.select(*docs.columns).collect())) == sorted(map(repr, stage(spark, docs, sf).collect()))
    check(got, docs, got.count())
    assert {tuple(r) for r in got.select("n_removed", "kept", "n_words").distinct().collect()} <= {("mine", "mine", "mine")}
