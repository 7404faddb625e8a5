"""Phrase collocations: word sequences that occur far more often than their parts suggest.

Texts are cut into pieces at punctuation and line ends, pieces into words. A
phrase of 2 to `longest` words that occurs at least `least` times within pieces
of its language is a candidate. Cut after its first k words it has the score
floor(1000 a n / (l r)), with a, l and r the occurrences of phrase, first part
and rest and n those of all words; its lowest-scoring cut counts. A candidate
whose every occurrence is part of one longer candidate is dropped.

How: the texts become runs of numbers, one per word that is frequent enough,
with a gap wherever a phrase must end. Level by level a phrase is a pair of
neighbouring numbers (its first words and its last words), and only pairs of
two frequent parts are candidates, of these only pairs in a bucket (by hash)
whose pairs together occur often enough, so none that is frequent can be missed.
The candidates get a minimal perfect hash, which is broadcast in groups of
bounded size; mappers look all pairs up (a pair whose stored key differs is no
candidate), count slots with bincount and send blocks of counts, which are
summed in two steps. Frequent pairs are the next level's numbers. Counts of
first and last parts come along by number, so each cut is read from them.

Edge cases: a null text is empty; a null language is `und`, an empty one
stays; ties of a score are broken by count and by the phrase's bytes; repeated
rows count as often as they are; without any candidate the result is empty;
other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import kernels as K
from lodestone.llm import perfect_hash as P
from lodestone.llm.common import col, discard, written

#: The characters that end pieces; with blanks and tabs they end words.
ENDS = b".,;:!?\n\x0b\x0c\r"
IS_END = np.zeros(256, bool)
IS_END[list(ENDS)] = True
IS_GAP = IS_END.copy()
IS_GAP[[9, 32]] = True
#: Slots of one block of counts, and blocks' parts in the first summing step.
BLOCK, FAN = 1 << 13, 16
BLOCKS = "block int, fan int, counts binary"
#: Buckets of the prefilter, by powers of two: so many that pairs by chance fill a quarter, at least and at most.
LEAST_BITS, MOST_BITS = 16, 26
#: Parts of the keys in which candidates are sent, by powers of two.
PART_BITS = 8
#: Bytes of text at once, and numbers of a row of runs, about: Parquet takes a hundred rows
#: into a page before it looks at their size, and its readers and writers hold whole pages.
SLICE, PIECE = 250_000, 1 << 13


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, K.Words, np.ndarray, np.ndarray]]:
    """Slices of (text, language's hash, ..) with their words, the words' hashes by language, and where a piece ends."""
    for batch in batches:
        for b in K.slices(batch, 0, SLICE):
            w = K.Words(*K.buffers(b.column(0)), lower=True, blank=IS_GAP)
            if not len(w.start):
                continue
            h = K.mix(w.hashes() ^ np.asarray(b.column(1)).view(K.U64)[w.doc])
            seen = np.concatenate([np.zeros(1, np.int32), np.cumsum(IS_END[w.data], dtype=np.int32)])
            ends = np.ones(len(h), bool)
            ends[:-1] = seen[w.start[1:]] > seen[w.end[:-1]]
            ends[w.first[1:][w.counts > 0] - 1] = True
            yield b, w, h, ends


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each word, its count in a slice and the least hash of a text that has it; without
    a word's hash, the count of all words of a language."""
    for b, w, h, _ in _runs(batches):
        order = np.argsort(h, kind="stable")
        h, text = h[order], np.asarray(b.column(3))[w.doc[order]]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        n = np.diff(np.append(first, len(h)))
        yield pa.RecordBatch.from_pydict({"lang": pa.nulls(len(n), pa.string()), "h": h[first].view(np.int64), "f": n, "owner": np.minimum.reduceat(text, first)})
        some = np.flatnonzero(w.counts)
        none = pa.nulls(len(some), pa.int64())
        yield pa.RecordBatch.from_pydict({"lang": b.column(2).cast(pa.string()).take(pa.array(some)), "h": none, "f": w.counts[some].astype(np.int64), "owner": none})


def _word_names(slots, owners) -> Callable:
    """What gives each frequent word with its language and number, once a task, from the text that owns it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.empty(0, np.int64)
        for b, w, h, _ in _runs(batches):
            at = slots.value.of(h)
            own = np.flatnonzero(at >= 0)
            own = own[owners.value[at[own] - slots.value.base] == np.asarray(b.column(3))[w.doc[own]]]
            at, first = np.unique(at[own], return_index=True)
            new = ~np.isin(at, seen)
            at, first = at[new], own[first[new]]
            if len(at):
                seen = np.concatenate([seen, at])
                words = [w.data[i:j].tobytes() for i, j in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"slot": at, "lang": b.column(2).cast(pa.string()).take(pa.array(w.doc[first])), "word": pa.array(words, pa.binary()).cast(pa.string())})

    return task


def _word_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The words' hashes of each slice, with a zero after every piece."""
    for _, _, h, ends in _runs(batches):
        keys = np.zeros(len(h) + int(ends.sum()), K.U64)
        keys[np.arange(len(h)) + np.cumsum(ends) - ends] = h
        yield keys


def _pair_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Of runs of numbers, the pairs of neighbours as keys; zero where either is missing."""
    for b in batches:
        for run in b.column(0):
            x = np.frombuffer(run.as_buffer(), "<i4").astype(np.int64) + 1
            yield ((x[:-1] << 32 | x[1:]) * ((x[:-1] > 0) & (x[1:] > 0))).view(K.U64)


def _run(numbers: np.ndarray) -> bytes:
    """Numbers as bytes, each gap one -1."""
    gap = numbers < 0
    return numbers[~gap | np.concatenate([[True], ~gap[:-1]])[: len(gap)]].astype("<i4").tobytes()


def _pieces(keys: np.ndarray) -> Iterator[slice]:
    """Parts of about PIECE keys that end with a zero, so that no pair lies across a cut; what has no zeros stays whole."""
    ends, at = np.flatnonzero(keys == 0) + 1, 0
    while len(keys) - at > PIECE:
        i = int(np.searchsorted(ends, at + PIECE))
        if i == len(ends) or ends[i] == len(keys):
            break
        yield slice(at, int(ends[i]))
        at = int(ends[i])
    yield slice(at, len(keys))


def _numbered(rows: DataFrame, keys: Callable, found: P.Index) -> DataFrame:
    """The runs of slots of the keys that `keys` gives, group by group of the index."""
    spark = rows.sparkSession
    groups = range(len(found.groups))
    for g in groups:
        slots = spark.sparkContext.broadcast(found.slots(g))

        def task(batches: Iterator[pa.RecordBatch], g: int = g, slots=slots) -> Iterator[pa.RecordBatch]:
            for have, part in _resolved(batches, keys, g):
                new = np.where(have >= 0, have, slots.value.of(part))
                for x in _pieces(part):
                    if g < groups[-1]:
                        yield pa.RecordBatch.from_pydict({"keys": pa.array([part[x].tobytes()], pa.binary()), "run": pa.array([new[x].tobytes()], pa.binary())})
                    elif (new[x] >= 0).any():
                        yield pa.RecordBatch.from_pydict({"run": pa.array([_run(new[x])], pa.binary())})

        rows = written(rows.mapInArrow(task, "keys binary, run binary" if g < groups[-1] else "run binary"), "phrase-runs")
    return rows


def _resolved(batches: Iterator[pa.RecordBatch], keys: Callable, g: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers found so far, with their keys."""
    if g == 0:
        for k in keys(batches):
            yield np.full(len(k), -1, np.int64), k
    else:
        for b in batches:
            for k, run in zip(b.column(0), b.column(1), strict=True):
                yield np.frombuffer(run.as_buffer(), "<i8"), np.frombuffer(k.as_buffer(), "<u8")


def _bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    return (K.mix(keys) >> K.U64(64 - bits)).astype(np.int64)


def _hot(runs: DataFrame, least: int, bits: int) -> np.ndarray:
    """Of 2**bits buckets of pairs, packed, whether their pairs occur `least` times together; counters stop there."""
    kind = "<u1" if least < 256 else "<u4"

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, kind)

        def fold(held: list[np.ndarray]) -> None:
            at, n = np.unique(np.concatenate(held), return_counts=True)
            counts[at] = np.minimum(counts[at].astype(np.int64) + n, least)

        held, size = [], 0
        for k in _pair_keys(batches):
            held.append(_bucket(k[k > 0], bits))
            size += len(held[-1])
            if size > 1 << 19:
                fold(held)
                held, size = [], 0
        if held:
            fold(held)
        yield from _blocks(counts, TaskContext.get().partitionId() % FAN)

    def bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _summed(batches, kind, least):
            x = np.frombuffer(b.column(2)[0].as_buffer(), kind)
            yield pa.RecordBatch.from_pydict({"block": b.column(0), "bits": pa.array([np.packbits(x >= least).tobytes()], pa.binary())})

    once = runs.mapInArrow(mapper, BLOCKS).repartition("block", "fan").mapInArrow(lambda b: _summed(b, kind, least), BLOCKS)
    whole = np.zeros((1 << bits) // 8, np.uint8)
    for r in once.select("block", F.lit(0).alias("fan"), "counts").repartition("block").mapInArrow(bits_of, "block int, bits binary").collect():
        part = np.frombuffer(r.bits, np.uint8)
        whole[r.block * BLOCK // 8 :][: len(part)] = part
    return whole


def _blocks(counts: np.ndarray, fan: int) -> Iterator[pa.RecordBatch]:
    """The blocks that hold any count."""
    for block, x in enumerate(counts.reshape(-1, BLOCK)):
        if x.any():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "fan": pa.array([fan], pa.int32()), "counts": pa.array([x.tobytes()], pa.binary())})


def _candidates(runs: DataFrame, least: int, bits: int) -> DataFrame:
    """The different pairs of neighbouring numbers whose bucket is full enough; tasks send them in
    arrays by part of the keys, and a part is freed of repeats as a whole."""
    full = runs.sparkSession.sparkContext.broadcast(_hot(runs, least, bits))

    def sent(keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = P.top(keys) >> (P.SHARD_BITS - PART_BITS)
        order = np.argsort(part, kind="stable")
        keys, part = keys[order], part[order]
        cut = np.flatnonzero(np.diff(part)) + 1
        for x, n in zip(np.split(keys, cut), part[np.append(0, cut)] if len(part) else (), strict=True):
            yield pa.RecordBatch.from_pydict({"part": pa.array([n], pa.int32()), "keys": pa.array([x.tobytes()], pa.binary())})

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Distinct()
        for k in _pair_keys(batches):
            k = np.unique(k[k > 0])
            at = _bucket(k, bits)
            seen.add(k[(full.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)])
            if seen.size > 1 << 22:
                yield from sent(seen.take())
        if seen.size:
            yield from sent(seen.take())

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, at = _Distinct(), None
        for b in batches:
            for part, keys in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if part != at:
                    yield from out(seen.take())
                    at = part
                seen.add(np.frombuffer(keys.as_buffer(), "<u8"))
        yield from out(seen.take())

    def out(k: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(k), 1 << 18):
            yield pa.RecordBatch.from_pydict({"key": k[i : i + (1 << 18)].view(np.int64), "top": P.top(k[i : i + (1 << 18)])})

    return runs.mapInArrow(mapper, "part int, keys binary").repartition("part").sortWithinPartitions("part").mapInArrow(distinct, "key long, top int")


class _Distinct:
    """Different keys of several arrays, put together now and then."""

    def __init__(self):
        self.held: list[np.ndarray] = []
        self.size, self.fold = 0, 1 << 20

    def add(self, keys: np.ndarray) -> None:
        self.held.append(keys)
        self.size += len(keys)
        if self.size > self.fold:
            keys = self.take()
            self.held, self.size, self.fold = [keys], len(keys), max(1 << 20, 2 * len(keys))

    def take(self) -> np.ndarray:
        out = np.unique(np.concatenate(self.held)) if self.held else np.empty(0, K.U64)
        self.held, self.size = [], 0
        return out


def _summed(batches: Iterator[pa.RecordBatch], kind: str = "<i8", most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Blocks of counts added up, to `most` at most."""
    total: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        for block, fan, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            x = np.frombuffer(counts.as_buffer(), kind)
            have = total.get((block, fan))
            if have is None:
                total[block, fan] = x.copy()
            elif most is None:
                have += x
            else:
                have[:] = np.minimum(have.astype(np.int64) + x, most)
    for (block, fan), x in total.items():
        yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "fan": pa.array([fan], pa.int32()), "counts": pa.array([x.tobytes()], pa.binary())})


def _counted(runs: DataFrame, found: P.Index, least: int) -> DataFrame:
    """key and f of the candidates that occur `least` times."""
    spark, out = runs.sparkSession, []
    for g in range(len(found.groups)):
        slots = spark.sparkContext.broadcast(found.slots(g))

        def mapper(batches: Iterator[pa.RecordBatch], slots=slots) -> Iterator[pa.RecordBatch]:
            s = slots.value
            counts, held, size = np.zeros(-(-len(s) // BLOCK) * BLOCK, np.int64), [], 0
            for k in _pair_keys(batches):
                at = s.of(k[k > 0])
                held.append(at[at >= 0] - s.base)
                size += len(held[-1])
                if size > max(1 << 20, len(counts)):
                    counts += np.bincount(np.concatenate(held), minlength=len(counts))
                    held, size = [], 0
            if held:
                counts += np.bincount(np.concatenate(held), minlength=len(counts))
            yield from _blocks(counts, TaskContext.get().partitionId() % FAN)

        def frequent(batches: Iterator[pa.RecordBatch], slots=slots) -> Iterator[pa.RecordBatch]:
            stored = slots.value.stored
            for b in _summed(batches):
                block, x = b.column(0)[0].as_py(), np.frombuffer(b.column(2)[0].as_buffer(), "<i8")
                at = np.flatnonzero(x >= least)
                keys = stored[block * BLOCK + at]
                yield pa.RecordBatch.from_pydict({"key": keys.view(np.int64), "top": P.top(keys), "f": x[at]})

        once = runs.mapInArrow(mapper, BLOCKS).repartition("block", "fan").mapInArrow(_summed, BLOCKS)
        whole = once.select("block", F.lit(0).alias("fan"), "counts").repartition("block").mapInArrow(frequent, "key long, top int, f long")
        out.append(written(whole, "phrase-counts"))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def _lowest(size: Column) -> Column:
    """(score, words before the cut, l, r) of the lowest-scoring cut."""
    whole = lambda c: c.cast("decimal(20,0)")

    def cut(k: Column) -> Column:
        first, rest = F.element_at("firsts", k), F.element_at("lasts", size - k)
        top = (whole(F.col("a")) * whole(F.col("n"))).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)")
        return F.struct(F.call_function("div", top.cast("decimal(38,0)"), (whole(first) * whole(rest)).cast("decimal(38,0)")).alias("score"), k.alias("k"), first.alias("l"), rest.alias("r"))

    return F.array_min(F.transform(F.sequence(F.lit(1), size - 1), cut))


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 5, least: int = 100, most: int = P.MOST) -> DataFrame:
    """lang, phrase, n_words, a, l, r, n, score and dropped of all candidates."""
    lang = F.coalesce(col(lang_col).cast("string"), F.lit("und"))
    rows = docs.select(F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"), F.xxhash64(lang).alias("h"), lang.alias("lang")).withColumn("own", F.xxhash64("text"))
    counts = rows.mapInArrow(_word_counts, "lang string, h long, f long, owner long").groupBy("lang", "h").agg(F.sum("f").alias("f"), F.min("owner").alias("owner"))
    counts = written(counts.where(F.col("h").isNull() | (F.col("f") >= least)), "words")
    keyed = counts.where("h is not null").select(F.col("h").alias("key"), "f", "owner")
    found = P.index(_topped(keyed.select("key")), most)
    if not len(found):
        empty = "lang string, phrase string, n_words int, a long, l long, r long, n long, score long, dropped boolean"
        return docs.sparkSession.createDataFrame([], empty)
    runs = _numbered(rows.select("text", "h"), _word_keys, found)
    keyed, names = keyed.join(found.numbered(), "key"), None
    for g, (shards, base) in enumerate(found.groups):
        size = sum(found.sizes[x] for x in shards)
        owned = keyed.where(F.col("slot").between(base, base + size - 1)).select("slot", "owner").toArrow()
        owner = np.empty(size, np.int64)
        owner[owned["slot"].to_numpy() - base] = owned["owner"].to_numpy()
        sent = [docs.sparkSession.sparkContext.broadcast(x) for x in (found.slots(g), owner)]
        some = rows.mapInArrow(_word_names(*sent), "slot long, lang string, word string")
        names = some if names is None else names.unionByName(some)
    names = names.dropDuplicates(["slot"])
    level = keyed.join(names, "slot").select("slot", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.array("f").alias("firsts"), F.array("f").alias("lasts"))
    level = written(level, "phrases-1")
    n = counts.where("h is null").select("lang", F.col("f").alias("n"))
    whole = n.agg(F.sum("n")).first()[0]
    bits = min(MOST_BITS, max(LEAST_BITS, (4 * whole // least).bit_length()))
    levels = []
    for size in range(2, longest + 1):
        candidates = written(_candidates(runs, least, bits), "phrase-candidates")
        found = P.index(candidates, most)
        if not len(found):
            break
        pairs = _counted(runs, found, least)
        found = P.index(pairs.select("key", "top"), most)
        if not len(found):
            break
        after = _numbered(runs, _pair_keys, found) if size < longest else runs
        a, b = (F.shiftright("key", 32) - 1).alias("first"), (F.col("key").bitwiseAND(0xFFFFFFFF) - 1).alias("second")
        pairs = pairs.join(found.numbered(), "key").select("slot", a, b, "f")
        first = level.select(F.col("slot").alias("first"), "lang", "phrase", "firsts", F.col("f").alias("first_f"))
        second = level.select(F.col("slot").alias("second"), "last", "lasts", F.col("f").alias("second_f"))
        more = lambda c: F.concat(c, F.array("f")).alias(c)
        made = pairs.join(first, "first").join(second, "second").select("slot", "first", "second", "first_f", "second_f", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f", more("firsts"), more("lasts"))
        made = written(made, f"phrases-{size}")
        if levels:
            within = made.where("first_f = f").select(F.col("first").alias("slot")).union(made.where("second_f = f").select("second")).distinct()
            levels[-1] = levels[-1].join(within.withColumn("dropped", F.lit(True)), "slot", "left")
        levels.append(made.withColumn("n_words", F.lit(size)))
        for old in (candidates, *([runs] if after is not runs else [])):
            discard(old)
        level, runs = made, after
    if levels:
        levels[-1] = levels[-1].withColumn("dropped", F.lit(None).cast("boolean"))
    kept = [x.select("lang", "phrase", "n_words", F.col("f").alias("a"), "firsts", "lasts", F.coalesce("dropped", F.lit(False)).alias("dropped")) for x in levels]
    if not kept:
        return phrases(docs.limit(0), text_col, lang_col)
    whole = kept[0]
    for x in kept[1:]:
        whole = whole.unionByName(x)
    cut = whole.join(F.broadcast(n) if _few(n) else n, "lang").withColumn("cut", _lowest(F.col("n_words")))
    return cut.select("lang", "phrase", "n_words", "a", "cut.l", "cut.r", "n", "cut.score", "dropped")


def _few(rows: DataFrame, most: int = 10_000) -> bool:
    return rows.limit(most + 1).count() <= most


def _topped(keys: DataFrame) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(P.top(np.asarray(b.column(0)).view(K.U64)))], ["key", "top"])

    return keys.mapInArrow(task, "key long, top int").distinct()


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 5, least: int = 100, top: int = 2000, most: int = P.MOST) -> DataFrame:
    """Each language's first `top` phrases: lang, rank, phrase, a, l, r, n, score."""
    kept = phrases(docs, text_col, lang_col, longest, least, most).where(~F.col("dropped")).drop("dropped", "n_words")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(64)).alias("part")
    firsts = kept.select("*", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = firsts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
