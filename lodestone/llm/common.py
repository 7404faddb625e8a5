"""Shared plumbing: written tables in the shared folder, loading, word pattern."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.shared import shared_dir

#: Fixed value: a word is a maximal run of characters other than these six.
SPACE = r"[\x20\x09-\x0D]+"
LEAST_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; Spark removes it when the session ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a written table: lineage ends here and survives lost executors."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes a written table that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    for f in df.inputFiles()[:1]:
        p = jvm.org.apache.hadoop.fs.Path(f).getParent()
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def id_key(column: str | Column) -> Column:
    """An id as a long; a null id counts as the least of all."""
    c = col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("long"), F.lit(LEAST_ID))


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def packed(columns: Iterable[str]) -> Column:
    """A caller's columns as one struct, so that no name of theirs meets one of ours."""
    names = list(columns)
    return F.struct(*(F.col(_quoted(c)).alias(c) for c in names)) if names else F.struct(F.lit(0).alias("none"))


def unpacked(columns: Iterable[str], row: str = "row") -> list[Column]:
    """The columns of a packed struct, under their names."""
    return [F.col(row).getField(c).alias(c) for c in columns]


def col(name: str) -> Column:
    """A column by its whole name, even one with dots."""
    return F.col(_quoted(name))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
