"""The queries of this subpackage, one opN_<name> per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.collocations import collocations
from lodestone.llm.common import fresh, table, written
from lodestone.llm.decontamination import decontaminate
from lodestone.llm.fill_in_middle import fill_in_middle, restored
from lodestone.llm.html_text import extract
from lodestone.llm.language_model import score
from lodestone.llm.neighbours import nearest
from lodestone.llm.ngram_join import ngram_join
from lodestone.llm.packing import pack
from lodestone.llm.quality_rules import quality_rules
from lodestone.llm.sharding import shard
from lodestone.llm.substring_dedup import substring_dedup
from lodestone.llm.token_files import read_ids, write_ids
from lodestone.llm.token_rollup import TokenRollup, changes, token_counts


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, table(spark, sf_dir, "labels")).drop("text")


def op3_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents inserted (twice, the second time without effect), those of
    low quality revised to their text without repeated lines, the toxic deleted."""
    lines = F.split("text", "\n")
    shorter = F.when(F.size(F.array_distinct(lines)) < F.size(lines), F.array_join(F.array_distinct(lines), "\n"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text"), shorter.alias("new"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    counts = written(token_counts(docs, ("text", "new")), "token-counts")
    labelled = written(counts.join(labels, "doc_id").withColumns({c: F.coalesce(c, c.replace("new", "text")) for c in ("new_words", "new_bpe")}), "labelled-counts")
    was, now = ("text_words", "text_bpe"), ("new_words", "new_bpe")
    last = labelled.where("toxic = 1").withColumns({n: F.when(F.col("quality") == 0, F.col(n)).otherwise(F.col(w)) for w, n in zip(was, now, strict=True)})
    rollup = TokenRollup(spark, fresh(spark, "token-rollup"))
    for name, batch in (
        ("load", changes(counts, "insert")),
        ("load", changes(counts, "insert")),
        ("revise", changes(labelled.where("quality = 0"), "revise", was, now)),
        ("toxic", changes(last, "delete", now, None)),
    ):
        rollup.commit(name, batch)
    return rollup.totals()


def op6_context_mixing_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = fresh(spark, "token-files")
    write_ids(table(spark, sf_dir, "documents"), at)
    return read_ids(spark, at, with_ids=False)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op8_hashed_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


def op9_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return docs.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from lodestone.llm.oracles import SQL

    return SQL
