"""Delta-maintained token counts by source, language and tokenizer version.

A batch of changes becomes signed sums per (source, language, tokenizer): an
insert adds a document and its count, a delete takes them back, a revision
takes back the old count and adds the new. A batch is committed once: its sums
are written to a folder of their own, and a note under the batch's name says
which folder counts. A name has one note, so however many drivers commit a
batch, at once or again after a failure, one folder counts and the others
don't. Totals are the sums over all committed batches, as they are additive;
`compact` writes them as one table, so that old batches needn't be read again.

Edge cases: null source or language is a group of its own; a null or empty
text counts 0 tokens; an empty batch commits and adds nothing; groups whose
documents are all taken back disappear; changes with other signs or unknown
kinds raise ValueError.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import kernels as K
from lodestone.llm.tokens import default_path, encoder
from lodestone.sources.shared import Notes

KEYS = ("source", "lang", "tokenizer")
SUMS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
#: The signs of a change's old and new count.
KINDS = {"insert": (0, 1), "delete": (-1, 0), "revise": (-1, 1)}
WORDS, BPE = "words-1", "word_bpe_49k"


class TokenRollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._batches, self._compact = Notes(spark, f"{self.path}/batches"), Notes(spark, f"{self.path}/compact")

    def committed(self, batch: str) -> bool:
        return self._batches.exists(self._named(batch))

    def _named(self, batch: str) -> str:
        if not re.fullmatch(r"\w[\w.-]*", batch) or batch.startswith("_"):
            raise ValueError(f"a batch's name has letters, digits, '.', '_' and '-' only and begins with a letter or digit: {batch!r}")
        return batch

    def stage(self, changes: DataFrame) -> str:
        """Writes the sums of (source, lang, tokenizer, kind, old_tokens, new_tokens); the folder doesn't count yet."""
        kind = F.col("kind")
        minus = sum((F.when(kind == k, -a).otherwise(0) for k, (a, _) in KINDS.items()), F.lit(0))
        plus = sum((F.when(kind == k, b).otherwise(0) for k, (_, b) in KINDS.items()), F.lit(0))
        known = F.when(kind.isin(*KINDS), F.lit(0)).otherwise(F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce(kind, F.lit("null")))).cast("int"))
        sums = changes.groupBy(*(F.col(k).cast("string").alias(k) for k in KEYS)).agg(
            F.sum((plus - minus + known).cast("long")).alias("n_docs"),
            F.sum(plus * F.coalesce("new_tokens", F.lit(0)) - minus * F.coalesce("old_tokens", F.lit(0))).cast("long").alias("n_tokens"),
        )
        folder = uuid4().hex
        sums.write.parquet(f"{self.path}/sums/{folder}")
        return folder

    def publish(self, batch: str, folder: str) -> bool:
        """Lets a staged folder count as the batch; False if another one does."""
        return self._batches.write(self._named(batch), folder)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Commits a batch of changes; False if it was committed before."""
        return not self.committed(batch) and self.publish(batch, self.stage(changes))

    def _state(self) -> tuple[list[str], list[str]]:
        """The folders that count, and the names of the batches in them."""
        done = json.loads(self._compact.latest() or '{"folder": null, "batches": []}')
        late = sorted(set(self._batches.names()) - set(done["batches"]))
        folders = [done["folder"]] * bool(done["folder"]) + [self._batches.read(n) for n in late]
        return folders, sorted({*done["batches"], *late})

    def _sums(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SUMS)
        rows = self.spark.read.schema(SUMS).parquet(*(f"{self.path}/sums/{f}" for f in folders))
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over all committed batches."""
        return self._sums(self._state()[0]).where("n_docs != 0 OR n_tokens != 0")

    def compact(self) -> None:
        """Writes the totals as one table that stands for all batches committed so far. A batch that is
        committed meanwhile still counts by its own note; of two compactions at once one stays."""
        number = self._compact.number()
        folders, names = self._state()
        if len(folders) > 1:
            folder = uuid4().hex
            self._sums(folders).write.parquet(f"{self.path}/sums/{folder}")
            self._compact.follow(number, json.dumps({"folder": folder, "batches": names}))


def token_counts(docs: DataFrame, text_cols: tuple[str, ...] = ("text",), path: str | None = None) -> DataFrame:
    """docs' columns without the texts, with the counts of both tokenizers for each
    text column, x_words and x_bpe; null where the text is null. One pass, no shuffle."""
    path = path or default_path()
    added = [f"{c}_{k}" for c in text_cols for k in ("words", "bpe")]
    keep = [f for f in docs.schema.fields if f.name not in (*text_cols, *added)]
    names = [f.name for f in keep]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for b in K.slices(batch, len(names), 4 << 20):
                out = b.columns[: len(names)]
                for text in b.columns[len(names) :]:
                    data, offsets = K.buffers(text)
                    null = np.asarray(text.is_null())
                    counts = (K.Words(data, offsets).counts.astype(np.int64), np.diff(enc.encode(data, offsets)[1]))
                    out += [pa.array(n, mask=null) for n in counts]
                yield pa.RecordBatch.from_arrays(out, [*names, *added])

    schema = T.StructType([*keep, *(T.StructField(c, T.LongType()) for c in added)])
    return docs.select(*names, *(F.col(c).cast("string").alias(f"__{c}") for c in text_cols)).mapInArrow(task, schema)


def changes(counts: DataFrame, kind: str, old: tuple[str, str] | None = None, new: tuple[str, str] | None = ("text_words", "text_bpe")) -> DataFrame:
    """One change per document and tokenizer; old, new: the columns of the two counts."""
    none = F.lit(None).cast("long")
    each = [F.struct(F.lit(t).alias("tokenizer"), (F.col(old[i]) if old else none).alias("old_tokens"), (F.col(new[i]) if new else none).alias("new_tokens")) for i, t in enumerate((WORDS, BPE))]
    return counts.select("source", "lang", F.lit(kind).alias("kind"), F.inline(F.array(*each)))
