"""Ingestion states: identity by content, duplicates, revisions and headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.sources.shared import written


#: Headings that a document's head may have.
HEADER_HEADINGS = ["professional profile", "professional summary", "profile", "summary", "professional experience", "work experience", "employment history", "skills", "languages", "education", "certifications", "projects", "selected projects"]


def fingerprint(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def document_id(document_hash: Column) -> Column:
    return F.concat(F.lit("document_"), F.substring(document_hash, 1, 16))


def candidate_id(filename: Column, first_page: Column, document_hash: Column) -> Column:
    """From the name, else the first page, else the hash."""
    pattern = r"(candidate_\d{3})"
    return F.coalesce(F.nullif(F.regexp_extract(F.lower(filename), pattern, 1), F.lit("")), F.nullif(F.regexp_extract(F.lower(first_page), pattern, 1), F.lit("")), F.concat(F.lit("candidate_"), F.substring(document_hash, 1, 16)))


def classify(incoming: DataFrame, index: DataFrame, order: list[str]) -> DataFrame:
    """Status of each incoming document (document_hash, candidate_id, ...).

    duplicate_input after the first of a hash; skipped if stored, complete and
    unchanged; metadata_refreshed if stored under other names; else pending.
    index: document_hash, stored_name, complete.
    """
    n = F.row_number().over(W.partitionBy("document_hash").orderBy(*order))
    df = incoming.withColumn("__n", n).join(index, "document_hash", "left")
    status = (
        F.when(F.col("__n") > 1, "duplicate_input")
        .when(~F.coalesce("complete", F.lit(False)), "pending")
        .when(~F.col("stored_name").eqNullSafe(F.col("name")), "metadata_refreshed")
        .otherwise("skipped")
    )
    return df.withColumn("status", status).drop("__n", "stored_name", "complete")


def duplicates(df: DataFrame, *keys: Column) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).count().where("count > 1")


def replaced(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Stored rows of older revisions: another hash with the same path or candidate."""
    older = F.col("s.document_hash") != F.col("c.document_hash")
    by_path = stored.alias("s").join(current.alias("c"), (F.col("s.source_path") == F.col("c.source_path")) & older, "left_semi")
    by_candidate = stored.alias("s").join(current.alias("c"), (F.col("s.candidate_id") == F.col("c.candidate_id")) & older, "left_semi")
    return by_path.union(by_candidate).distinct()


def header_lines(text: Column, n: int = 20) -> Column:
    return F.slice(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, n)


def is_name(line: Column, headings: list[str] = ()) -> Column:
    """Two to six words, each with a letter, no digit or @, not a heading."""
    words = F.split(line, r"\s+")
    ok = F.size(words).between(2, 6) & ~line.rlike(r"[0-9@]") & F.forall(words, lambda w: w.rlike(r"\p{L}"))
    return ok & ~F.lower(line).isin(*headings) if headings else ok


def coverage(chunks: DataFrame) -> DataFrame:
    """One row: records, documents, candidates, complete and incomplete documents."""
    docs = summaries(chunks)
    return docs.agg(F.sum("stored_count").alias("n_records"), F.count("*").alias("n_documents"), F.countDistinct("candidate_id").alias("n_candidates"), F.count_if("complete").alias("n_complete"), F.count_if(~F.col("complete")).alias("n_incomplete"))


def summaries(chunks: DataFrame) -> DataFrame:
    """Per document: stored and expected chunks, candidate and whether it is complete."""
    df = chunks.groupBy("document_hash").agg(F.count("*").alias("stored_count"), F.countDistinct("document_chunk_count").alias("n_expected"), F.min("document_chunk_count").alias("expected"), F.min_by("candidate_id", "chunk_index").alias("candidate_id"))
    complete = (F.col("n_expected") == 1) & (F.col("expected") > 0) & (F.col("expected") == F.col("stored_count"))
    return df.withColumn("complete", F.coalesce(complete, F.lit(False)))


def repeated_candidates(docs: DataFrame) -> DataFrame:
    """(candidate_key, n): candidate ids, whatever their case, that more than one document of a batch claims."""
    return docs.where(F.col("candidate_id").isNotNull()).groupBy(F.lower("candidate_id").alias("candidate_key")).agg(F.count("*").alias("n")).where("n > 1")


def detected(lines: Column, headings: list[str] = HEADER_HEADINGS) -> Column:
    """Name and title (struct) of a document's first lines: the first that reads as a name, and the
    first behind it without digits, @, an id or a middle dot; headings are neither."""
    name = F.get(F.filter(lines, lambda x: is_name(x, headings)), 0)
    behind = F.slice(lines, F.array_position(lines, name).cast("int") + 1, F.size(lines))
    title = F.get(F.filter(behind, lambda x: ~x.rlike(r"[0-9@·]") & ~F.contains(F.lower(x), F.lit("candidate_")) & ~F.lower(x).isin(*headings)), 0)
    return F.struct(name.alias("candidate_name"), title.alias("professional_title"))


def preferred(given: Column, found: Column) -> Column:
    """What the caller says, trimmed, else what was found; blank counts as nothing."""
    clean = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    return F.coalesce(clean(given), clean(found))


def flattened(chunks: DataFrame) -> DataFrame:
    """Chunks as an index stores them: pages as one text."""
    return chunks.withColumn("page_numbers", F.array_join("page_numbers", ","))


def unflattened(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("page_numbers", F.split("page_numbers", ",").cast("array<int>"))


def in_order(rows: DataFrame, name: str, *then: str) -> DataFrame:
    """rows with `place`, from 1: by the name whatever its case, then by the other columns, as summaries
    (name, hash) and results of an ingestion (name, path, status) are listed. Places follow from counts
    per range of names, so no task orders all rows."""
    keys = [F.lower(F.col(name)), *map(F.col, then)]
    ranged = rows.repartitionByRange(*keys).withColumn("range", F.spark_partition_id())
    laid = written(ranged, "in-order")
    before = laid.groupBy("range").count().withColumn("before", F.coalesce(F.sum("count").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    place = F.row_number().over(W.partitionBy("range").orderBy(*keys)) + F.col("before")
    return laid.join(F.broadcast(before), "range").withColumn("place", place.cast("long")).drop("range", "before")
