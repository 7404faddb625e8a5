"""The folder that driver and executors share, and small files that are written once."""

from __future__ import annotations

import os
import tempfile
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. A machine-local one
    stands in only where all of Spark runs on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "lodestone-work")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; Spark removes it when the session ends."""
    at = f"{shared_dir(spark)}/{name}-{uuid4().hex[:12]}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: they are computed once, however often they are
    read, and survive lost executors. Spark removes it when the session ends."""
    at = scratch(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a file too small to be split, dealt to all cores before much is done to each of them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(4 * cores)


class Notes:
    """Small text files in a folder, each whole as soon as it can be seen and never changed."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.at("").getFileSystem(self._conf)

    def at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def names(self) -> list[str]:
        if not self.fs.exists(self.at("")):
            return []
        found = (x.getPath().getName() for x in self.fs.listStatus(self.at("")) if x.isFile())
        return sorted(n for n in found if not n.startswith((".", "_")))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> bool:
        """False if the name is taken. The text is written aside and gets its name in one
        step that fails if another writer was first, so one writer alone is told True."""
        if self.exists(name):
            return False
        aside = self.at(f".{uuid4().hex}")
        stream = self.fs.create(aside, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        done = self._named(aside, self.at(name))
        self.fs.delete(aside, False)
        return done and self.read(name) == text

    def _named(self, aside, at) -> bool:
        """A local rename would replace the other's file, so there the name is a link; elsewhere
        a rename fails on a name that is taken."""
        if self.fs.getScheme() != "file":
            return not self.fs.exists(at) and self.fs.rename(aside, at)
        nio = self._jvm.java.nio.file
        local = lambda p: nio.Paths.get(self.fs.makeQualified(p).toUri())
        try:
            nio.Files.createLink(local(at), local(aside))
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    def number(self) -> int:
        """The highest number among the names; 0 if there is none."""
        return max((int(n) for n in self.names() if n.isdigit()), default=0)

    def latest(self) -> str | None:
        """The text under the highest number."""
        n = self.number()
        return self.read(f"{n:012d}") if n else None

    def follow(self, number: int, text: str) -> bool:
        """Writes the text under exactly the next number; False if that is taken."""
        return self.write(f"{number + 1:012d}", text)
