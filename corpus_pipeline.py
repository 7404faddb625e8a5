"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet and read again as the next one's docs. All but the last keep the
columns of documents. Texts that lose a repeated passage stay with what is
left; documents that are rejected, copies or contaminated go.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import col, id_key, packed, table, written
from lodestone.llm.decontamination import decontaminate
from lodestone.llm.ngram_join import ngram_join
from lodestone.llm.packing import pack
from lodestone.llm.quality_rules import quality_rules
from lodestone.llm.substring_dedup import ADDED, substring_dedup

#: Keys that are broadcast at most, 8 bytes each; more are joined by a shuffle of the texts.
FEW = 1 << 21


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned ones reject.

    A null or empty text fails the base rules and goes; a null id keeps its row
    judged by its text; repeated rows are each judged; of several labels of an id
    the lowest counts; other columns, whatever their names, come back unchanged.
    """
    others = packed(c for c in docs.columns if c != "text").alias("row")
    return _back(quality_rules(docs.select("doc_id", "text", others), table(spark, sf_dir, "labels")).where("kept"), docs)


def _keyed(docs: DataFrame) -> DataFrame:
    """The texts with a key of each different row, `k`, from id and text (ids may repeat or be null), its id and its other columns."""
    key = F.xxhash64(id_key("doc_id"), F.col("text").isNull(), F.coalesce("text", F.lit("")))
    return docs.select(packed(c for c in docs.columns if c != "text").alias("row"), "text", key.alias("k"), id_key("doc_id").alias("i"))


def _back(keyed: DataFrame, docs: DataFrame) -> DataFrame:
    return keyed.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the row with the least id and key; of rows that repeat it whole, one.

    A null id counts as the least; rows that share an id are documents of their
    own; a null or empty text links with nothing, so its row stays (equal rows
    once); ties of id go to the least hash of the text.
    """
    keyed = _keyed(docs)
    ids = keyed.groupBy("k").agg(F.min("i").alias("i"), F.count("*").alias("n"))
    linked = ngram_join(keyed.select("k", "text"), "k").groupBy("k").agg(F.min("component_id").alias("c"))
    stay = linked.join(ids, "k").groupBy("c").agg(F.min(F.struct("i", "k")).alias("x")).select("x.k", F.lit(True).alias("stays"))
    # The keys of rows that go or repeat; where there are few, texts stay where they are.
    fate = written(ids.join(stay, "k", "left").where("stays IS NULL OR n > 1").select("k", "stays"), "fate")
    sent = F.broadcast if fate.count() <= FEW else lambda x: x
    once = keyed.join(sent(fate.select("k")), "k", "left_anti")
    more = keyed.join(sent(fate.where("stays").select("k")), "k", "left_semi").dropDuplicates(["k"])
    return _back(once.unionByName(more), docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that an earlier one has.

    No row goes: a document all of whose words repeat keeps an empty text; texts
    that lose nothing, null ones too, stay byte for byte; of rows that share an id
    the one with the lesser hash of its text is earlier, equal rows lose alike.
    """
    lost = [c for c in docs.columns if c in ADDED]  # names that the operator takes for its own columns
    cut = substring_dedup(docs.withColumnsRenamed({c: f"{c} of the row" for c in lost}))
    cut = cut.select(*(F.col(f"`{c} of the row`").alias(c) if c in lost else col(c) for c in docs.columns), *(F.col(c).alias(f"{c} found") for c in ADDED))
    changed = F.col("n_removed found") > 0
    text = F.when(changed, F.col("kept_text found")).otherwise(F.col("text"))
    chars = F.when(changed, F.length("kept_text found")).otherwise(F.col("n_chars"))
    return cut.select(*(text.alias(c) if c == "text" else chars.alias(c) if c == "n_chars" else col(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.

    Rows are judged by their texts, so a null or shared id protects none; a null
    or empty text stays; every copy of a contaminated row goes; an empty
    benchmark, or one without words, removes nothing.
    """
    keyed = _keyed(docs)
    leaks = decontaminate(keyed.select("k", "text"), table(spark, sf_dir, "benchmark"), "k").select("k").distinct()
    return _back(keyed.join(leaks, "k", "left_anti"), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens.

    A null or empty text is one piece with its end id; a null id comes back as
    null; each of repeated rows is packed; the other columns end here.
    """
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: Learned rules and tokenizer ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-").lower())
    return docs
