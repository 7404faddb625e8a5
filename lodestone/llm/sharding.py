"""Sharding by sampled splitters: contiguous key ranges of near-equal weight.

Rows are ordered by (md5 of the text, id), so equal texts are neighbours. A
weighted sample of keys (-ln(u) / weight below a bound that the whole weight
gives, u from a hash of the row) gives quantile boundaries; rows are partitioned into those ranges; ranges
that hold more than twice their share are sampled again and subdivided. A few
hundred range totals reach the driver; running sums within a range and these
totals give each row its exact place in the whole order, from which the shard
follows. The splitters only spread the work: they don't change the result.

Laws: `bytes` (weight: UTF-8 bytes of the text plus 16; a shard's size differs
from the mean by less than one row's) or `rows` (counts at most one apart).

Edge cases: a null text counts as empty, a null id as the least id; rows that
agree in id and text are neighbours in any order; an empty table gives an
empty result; an only row larger than a shard makes the shards beside it
empty; added columns replace columns of their names.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.llm.common import col, id_key, packed, unpacked, written

ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
BLOCK = 32


def _range(splitters: list[tuple[str, int]]) -> Column:
    """How many splitters are at or below the row, in two short steps."""
    blocks = [splitters[i : i + BLOCK] for i in range(0, len(splitters), BLOCK)]
    if not blocks:
        return F.lit(0)
    kind = "struct<k:string,i:bigint>"
    heads = F.from_json(F.lit(json.dumps([{"k": b[0][0], "i": b[0][1]} for b in blocks])), f"array<{kind}>")
    parts = F.from_json(F.lit(json.dumps([[{"k": k, "i": i} for k, i in b] for b in blocks])), f"array<array<{kind}>>")
    row = F.struct(F.col("__k").alias("k"), F.col("__i").alias("i"))
    at = F.size(F.filter(heads, lambda s: s <= row)) - 1
    return F.greatest(at, F.lit(0)) * BLOCK + F.coalesce(F.size(F.filter(F.get(parts, at), lambda s: s <= row)), F.lit(0))


def _numbers(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _sample(rows: DataFrame, n: int, whole: int) -> list[tuple[str, int]]:
    """About n different keys of rows of the whole weight, in order; each task passes on only its own."""
    u = (F.pmod(F.xxhash64("__k", "__i"), F.lit(1 << 40)) + 1) / F.lit(float(1 << 40))
    drawn = rows.where(-F.ln(u) / F.col("__v") <= n / max(1, whole)).select("__k", "__i").distinct()
    return sorted((r[0], r[1]) for r in drawn.collect())


def _every(drawn: list[tuple[str, int]], parts: int) -> list[tuple[str, int]]:
    """Quantiles that cut the sample into about so many parts."""
    step = max(1, len(drawn) // max(1, parts))
    return drawn[step // 2 :: step]


def shard(docs: DataFrame, shards: int = 40, law: str = "bytes", id_col: str = "doc_id", text_col: str = "text", ranges: int = 320, oversample: int = 8, rounds: int = 6) -> DataFrame:
    """docs without the text, with size, text_crc32, law, shard, slot and grown_shard."""
    if law not in ("bytes", "rows"):
        raise ValueError(f"law is bytes or rows, not {law}")
    keep = [c for c in docs.columns if c not in (*ADDED, text_col)]
    t = F.coalesce(col(text_col).cast("string"), F.lit(""))
    size = F.octet_length(t).cast("long") + 16
    rows = written(docs.select(packed(keep).alias("row"), F.md5(t.cast("binary")).alias("__k"), id_key(id_col).alias("__i"), size.alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), (size if law == "bytes" else F.lit(1).cast("long")).alias("__v")), "shard-keys")

    def totals(splitters: list[tuple[str, int]]) -> dict[int, tuple[int, int]]:
        return {r[0]: (r[1], r[2]) for r in rows.groupBy(_range(splitters).alias("r")).agg(F.sum("__v"), F.count("*")).collect()}

    whole = rows.agg(F.sum("__v")).first()[0] or 0
    splitters = _every(_sample(rows, ranges * oversample, whole), ranges)
    have = totals(splitters)
    for _ in range(rounds):
        over = {r for r, (v, n) in have.items() if n > 1 and v > 2 * whole / ranges}
        if not over:
            break
        inner = rows.where(_range(splitters).isin(sorted(over)))
        more = sum(-(-have[r][0] * ranges // whole) for r in over)
        drawn = _sample(inner, more * oversample, sum(have[r][0] for r in over))
        longer = sorted({*splitters, *_every(drawn, more)})
        if len(longer) == len(splitters):
            break
        splitters, have = longer, totals(longer)
    before_v, before_n, v, n = [], [], 0, 0
    for r in range(len(splitters) + 1):
        before_v.append(v)
        before_n.append(n)
        v, n = v + have.get(r, (0, 0))[0], n + have.get(r, (0, 0))[1]
    by = W.partitionBy("__r").orderBy("__k", "__i")
    place = F.get(_numbers(before_v), F.col("__r")) + F.sum("__v").over(by.rowsBetween(W.unboundedPreceding, 0)) - F.col("__v")
    index = F.get(_numbers(before_n), F.col("__r")) + F.row_number().over(by) - 1
    placed = rows.withColumn("__r", _range(splitters)).select("*", place.alias("__p"), index.alias("__x"))
    placed = written(placed.withColumn("shard", F.expr(f"__p * {shards} div {max(1, v)}").cast("int")), "shard-places")
    first = {r[0]: r[1] for r in placed.groupBy("shard").agg(F.min("__x")).collect()}
    slot = F.col("__x") - F.get(_numbers([first.get(s, 0) for s in range(shards)]), F.col("shard"))
    return placed.select(*unpacked(keep), "size", "text_crc32", F.lit(law).alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

