"""File sources and sinks: document bytes, JSON, atomic reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.ingest import document_id, fingerprint


def documents(spark: SparkSession, files: list[str] | None = None, directory: str | None = None, recursive: bool = False, suffix: str = ".pdf", select_all: str | None = None) -> DataFrame:
    """Bytes of the selected files with path, name, hash and document id, ordered by name and path.

    Exactly one of files, directory and select_all (a directory with all below it)
    selects; names end in suffix (any case): a named file that doesn't is an error,
    and so is a selection without files.
    """
    if sum(x is not None for x in (files, directory, select_all)) != 1:
        raise ValueError("select by files or by directory, not both or neither")
    if files is not None:
        if len(set(files)) != len(files):
            raise ValueError("a file is selected twice")
        if wrong := [f for f in files if not f.lower().endswith(suffix)]:
            raise ValueError(f"not a {suffix} file: {wrong[0]}")
        if not files:
            raise ValueError("no file is selected")
    below = recursive or select_all is not None
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(below).lower()).load(files if files is not None else directory or select_all)
    name = F.element_at(F.split("path", "/"), -1)
    rows = rows.where(F.lower("path").endswith(suffix)).withColumn("name", name)
    if rows.select("path").isEmpty():
        raise ValueError(f"no {suffix} file is selected")
    rows = rows.withColumn("document_hash", fingerprint(F.col("content")))
    return rows.withColumn("document_id", document_id(F.col("document_hash"))).orderBy(F.lower("name"), F.lower("path"))


def safe_name(name: str) -> bool:
    """Whether a name is one plain file name, so that it can't lead out of its folder."""
    return bool(name) and name not in (".", "..") and not any(c in name for c in "/\\\0")


def json_rows(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Whole-file JSON under an explicit schema; malformed input fails."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def write_json(df: DataFrame, path: str, order: list[str]) -> None:
    """Rows as JSON in order; the commit protocol shows all files or none."""
    df.orderBy(*order).write.mode("overwrite").json(path)


def report(df: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("report"))


def rename_plan(rows: DataFrame, stem, suffix: str = ".pdf") -> DataFrame:
    """New names from slugs; the second and later of a name get -2, -3 and so on."""
    from pyspark.sql.window import Window as W

    n = F.row_number().over(W.partitionBy("stem").orderBy("document_hash"))
    out = rows.withColumn("stem", stem).withColumn("n", n)
    return out.withColumn("new_name", F.concat("stem", F.when(F.col("n") > 1, F.concat(F.lit("-"), F.col("n").cast("string"))).otherwise(F.lit("")), F.lit(suffix))).drop("n")
