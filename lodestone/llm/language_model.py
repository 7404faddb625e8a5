"""A hashed maximum-entropy language model with class-factored softmax.

Tokens are words (A-Z lower-cased) and one end per text. The most frequent
training tokens are symbols of their own, all others share the symbol
"rare". Symbols are dealt into classes, and
    P(w | context) = P(class of w | context) P(w | class, context)
with softmaxes over classes and over a class's symbols, whose scores sum hashed
feature rows: a bias, the word before, the word before that (a skip) and both.
A rare token's share within "rare" is (c + 1) / (Nr + Vr + 1), c its training
count, Nr and Vr the rare tokens and types, so one slot is left for unknown
words and the probabilities of all words sum to one, as in the base model.

Training is distributed, in `rounds` over equal parts of the training texts, dealt
by a hash: each task takes gradient steps (row-wise Adagrad) over its texts in
minibatches, starting from the round's weights (at first, from the counts); the
tasks' weights are then averaged row by row, weighted by the steps that touched
each, and the next round starts from the average. A round has at least LEAST
tasks and as many as keep what they shuffle below an eighth of their texts.
`losses` has each round's mean log10 probability of tokens before they were
learnt. Symbols, weights and the broadcast dictionary of the most frequent words, which
tells contexts apart, grow as the square root of the training tokens (`sizes`);
the counts of rarer words are joined.

Edge cases: a null or empty text is its end alone; a null id trains (its text
form is empty); rows that share an id are scored each by itself; without any
training text every token is unknown and has probability 1 / (N + V + 1) in
the base; an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import kernels as K
from lodestone.llm.common import written

#: Sizes of a corpus of up to `BASE` training tokens; they grow with larger ones.
SIDE, CLASS_ROWS, WORD_ROWS, DICTIONARY = 32, 1 << 14, 1 << 15, 1 << 17
BASE = 1 << 24
#: Bytes of text of a training task at least (and eight times its weights), and tasks of a round at least.
SHARE, LEAST = 48 << 20, 4
#: Training tokens beyond which the model stays as large as it is; its weights then take about 0.2 GB in half precision.
MOST_TOKENS = 1 << 32
BATCH = 8192
END = K.U64(0x5851F42D4C957F2D)
BEGIN = K.U64(0x14057B7EF767814F)
RARE = K.U64(0x2545F4914F6CDD1D)
LOG10E = float(np.log10(np.e))


class Lookup:
    """Place of each hash in a sorted array, -1 if it isn't there."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, K.U64(0))
        self.at = np.searchsorted(keys >> K.U64(48), np.arange((1 << 16) + 1).astype(K.U64))

    def __call__(self, h: np.ndarray) -> np.ndarray:
        top = (h >> K.U64(48)).astype(np.int64)
        lo, hi = self.at[top], self.at[top + 1]
        out = np.where((lo < hi) & (self.keys[lo] == h), lo, -1)
        left = np.flatnonzero((out < 0) & (lo + 1 < hi))
        step = 1
        while len(left):
            at = lo[left] + step
            hit = self.keys[at] == h[left]
            out[left[hit]] = at[hit]
            left = left[~hit & (at + 1 < hi[left])]
            step += 1
        return out


def sizes(tokens: int) -> tuple[int, int, int, int]:
    """Classes (and symbols of each), rows of both tables and words of the dictionary: symbols, rows
    and words grow as the square root of the training tokens, about as fast as a corpus's types, up to
    MOST_TOKENS; so what is broadcast has a bound, and beyond it tasks grow in number with the texts."""
    grown = max(1.0, min(tokens, MOST_TOKENS) / BASE) ** 0.5
    return round(SIDE * grown**0.5), round(CLASS_ROWS * grown), round(WORD_ROWS * grown), round(DICTIONARY * grown)


def _row(h: np.ndarray, rows: int) -> np.ndarray:
    """The row of a hash; 16 bits, where they are enough, sort faster."""
    at = ((h >> K.U64(32)) * K.U64(rows)) >> K.U64(32)
    return at.astype(np.uint16 if rows <= 1 << 16 else np.uint32)


def _rows(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.take(table, at, axis=0, mode="clip")


def _exp(s: np.ndarray, bias: np.ndarray, more: list[np.ndarray]) -> np.ndarray:
    """exp of summed scores, in place; scores are held within 60, far beyond what training reaches."""
    s += bias
    for x in more:
        s += x
    np.clip(s, -60, 60, out=s)
    return np.exp(s, out=s)


def _totals(g: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of g[order] from each place in first to the next; most have one row or a few."""
    many = np.diff(np.append(first, len(order)))
    total = _rows(g, order[first])
    for k in (1, 2, 3):
        more = np.flatnonzero(many > k)
        total[more] += _rows(g, order[first[more] + k])
    for i in np.flatnonzero(many > 4).tolist():
        total[i] = _rows(g, order[first[i] : first[i] + many[i]]).sum(0)
    return total


@dataclass
class Model:
    keys: np.ndarray  # sorted hashes of the dictionary
    counts: np.ndarray  # their training counts
    symbols: np.ndarray  # their symbols; 0 is rare
    end_symbol: int
    end_count: int
    n: int  # training tokens, ends included
    v: int  # different ones
    n_rare: int
    v_rare: int
    size: int  # symbols
    class_bias: np.ndarray
    class_rows: np.ndarray
    word_rows: np.ndarray
    word_bias: np.ndarray
    losses: tuple[float, ...] = ()

    def rows(self, one: np.ndarray, two: np.ndarray, classes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        both = K.mix(one * K.U64(0x9E3779B97F4A7C15) + two)
        skip = K.mix(two ^ K.U64(0xA5A5A5A5A5A5A5A5))
        c = [_row(x, len(self.class_rows)) for x in (K.mix(one + K.U64(1)), skip, both)]
        salt = (classes.astype(K.U64) + K.U64(1)) * K.U64(0xD6E8FEB86659FD93)
        w = [_row(K.mix(x ^ salt), len(self.word_rows)) for x in (one, skip, both)]
        return c, w

    def forward(self, one: np.ndarray, two: np.ndarray, symbol: np.ndarray) -> tuple:
        """Log-probabilities (natural) of the symbols, and what a step needs: the
        last two, divided by the two before, are all probabilities."""
        cls, member = symbol % len(self.class_bias), symbol // len(self.class_bias)
        c, w = self.rows(one, two, cls)
        i = np.arange(len(symbol))
        p = _exp(_rows(self.class_rows, c[0]), self.class_bias, [_rows(self.class_rows, r) for r in c[1:]])
        q = _exp(_rows(self.word_rows, w[0]), _rows(self.word_bias, cls), [_rows(self.word_rows, r) for r in w[1:]])
        zp, zq = p @ np.ones(p.shape[1], np.float32), q @ np.ones(q.shape[1], np.float32)
        log = np.log(p[i, cls]) - np.log(zp) + np.log(q[i, member]) - np.log(zq)
        return log, cls, member, c, w, zp, zq, p, q

    def step(self, one: np.ndarray, two: np.ndarray, symbol: np.ndarray, sums: list[np.ndarray], touched: list[np.ndarray], rate: float) -> float:
        """One gradient step; the sum of the tokens' log-probabilities before it."""
        log, cls, member, c, w, zp, zq, p, q = self.forward(one, two, symbol)
        i = np.arange(len(symbol))
        p /= zp[:, None]
        q /= zq[:, None]
        p[i, cls] -= 1
        q[i, member] -= 1
        everywhere = np.zeros(len(symbol), np.uint16)
        for k, (weights, rows, g) in enumerate(((self.class_rows, c, p), (self.word_rows, w, q), (self.word_bias, [cls.astype(np.uint16)], q), (self.class_bias[None], [everywhere], p))):
            for r in rows:
                order = np.argsort(r, kind="stable")  # a radix sort, as rows have 16 bits
                r = r[order]
                first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
                total = _totals(g, order, first)
                r = r[first]
                sums[k][r] += np.einsum("ij,ij->i", total, total) / total.shape[1]
                touched[k][r] += 1
                total *= (rate / np.sqrt(sums[k][r] + 1e-3))[:, None]
                weights[r] = _rows(weights, r) - total
        return float(log.sum(dtype=np.float64))

    def tables(self) -> tuple[np.ndarray, ...]:
        return self.class_rows, self.word_rows, self.word_bias, self.class_bias[None]

    def sent(self) -> Model:
        """As it is broadcast: rows in half precision, as tasks send them."""
        return replace(self, class_rows=self.class_rows.astype(np.float16), word_rows=self.word_rows.astype(np.float16))

    def worker(self) -> Model:
        """A task's own copy, to work on."""
        return replace(self, **{k: getattr(self, k).astype(np.float32) for k in ("class_rows", "word_rows", "word_bias", "class_bias")})


def _tokens(batch: pa.RecordBatch, text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices with the hashes of their tokens, an end after each text, and where texts begin."""
    for b in K.slices(batch, text):
        w = K.Words(*K.buffers(b.column(text)), lower=True)
        yield b, np.insert(w.hashes(), w.first[1:], END), w.first + np.arange(len(w.first))


def _contexts(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one, two = np.concatenate([[BEGIN], h[:-1]]), np.concatenate([[BEGIN, BEGIN], h[:-2]])[: len(h)]
    start = first[:-1]
    one[start] = BEGIN
    two[start] = BEGIN
    later = start + 1
    two[later[later < first[1:]]] = BEGIN
    return one, two


def _counted(train: DataFrame) -> DataFrame:
    """(h, c): how often each word occurs in the training texts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(h), 1 << 16):
                yield pa.RecordBatch.from_pydict({"h": h[i : i + (1 << 16)].view(np.int64), "c": c[i : i + (1 << 16)]})

        for batch in batches:
            for b in K.slices(batch, 0):
                held.append(K.Words(*K.buffers(b.column(0)), lower=True).hashes())
                size += len(held[-1])
                if size > 4 << 20:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return written(train.select("text").mapInArrow(task, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "word-counts")


def _most_frequent(counts: DataFrame, n: int) -> DataFrame:
    """The (h, c) of at most n, and nearly n, most frequent words. A histogram of counts says from
    which count on; of the words with the next lower one a share by hash fills up. No task sorts them all."""
    level = F.when(F.col("c") <= 1024, F.col("c")).otherwise(F.lit(384) + F.floor(F.log2("c") * 64)).cast("long")
    bins = sorted(((r[0], r[1]) for r in counts.groupBy(level.alias("l")).count().collect()), reverse=True)
    least, have, share = 1 << 60, 0, 0.0
    for at, many in bins:
        if have + many > n:
            share = max(0.0, (n - have - 3 * (n - have) ** 0.5) / many)
            break
        least, have = at, have + many
    under = max((at for at, _ in bins if at < least), default=0)
    u = F.pmod(F.xxhash64("h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return counts.where((level >= least) | ((level == under) & (u < share)))


def _fresh(counts: DataFrame, ends: int) -> Model:
    """The model before training: biases from the counts, no rows yet."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    side, _, _, dictionary = sizes(int(total[0]) + ends)
    top = _most_frequent(counts, dictionary).toArrow()
    top = top.sort_by([("c", "descending"), ("h", "ascending")])
    h = top.column("h").to_numpy().astype(np.int64).view(K.U64)
    c = top.column("c").to_numpy().astype(np.int64)
    n_symbols = min(side * side - 2, len(h))
    symbol = np.zeros(len(h), np.int64)
    symbol[:n_symbols] = np.arange(n_symbols) + 2
    n_rare, v_rare = int(total[0] - c[:n_symbols].sum()), int(total[1] - n_symbols)
    mass = np.concatenate([[n_rare + 1, ends + 1], c[:n_symbols] + 1]).astype(np.float64)
    grid = np.full((side, side), 1e-30)
    grid.reshape(-1)[: len(mass)] = mass
    by_class = grid.sum(0)
    class_bias = np.log(by_class / by_class.sum()).astype(np.float32)
    order = np.argsort(h)
    return Model(h[order], c[order], symbol[order], 1, ends, int(total[0]) + ends, int(total[1]) + (ends > 0), n_rare, v_rare, len(mass), class_bias, np.zeros((0, side), np.float32), np.zeros((0, side), np.float32), np.log(grid / by_class).T.astype(np.float32))


def _view(model: Model, find: Lookup, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place in the dictionary (-1: not there), symbol, and the hash as a feature sees it."""
    at = find(h)
    end = h == END
    symbol = np.where(at >= 0, model.symbols[at] if len(model.symbols) else 0, 0)
    symbol[end] = model.end_symbol
    return at, symbol, np.where((at >= 0) | end, h, RARE)


def train(docs: DataFrame, counts: DataFrame, size: int, rate: float = 0.15, rounds: int = 2) -> Model:
    """docs: (text, held_out), of `size` bytes. All texts that aren't held out train."""
    texts = docs.where("NOT held_out").select("text")
    model = _fresh(counts, texts.count())
    side, class_rows, word_rows, _ = sizes(model.n)
    model = replace(model, class_rows=np.zeros((class_rows, side), np.float32), word_rows=np.zeros((word_rows, side), np.float32))
    shares = max(LEAST, -(-size // rounds // max(SHARE, 8 * 4 * side * (class_rows + word_rows))))
    for i in range(rounds):
        model = _round(texts.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == i), model, shares, rate)
    return model


PARTS = "part long, touched binary, means binary"
LOSS = -1


def _part(k: int, i: int, touched: np.ndarray, means: np.ndarray) -> pa.RecordBatch:
    """Rows of table k from i on; wide tables in half precision."""
    return pa.RecordBatch.from_pydict({"part": pa.array([k << 40 | i], pa.int64()), "touched": pa.array([touched.astype(np.float32).tobytes()], pa.binary()), "means": pa.array([means.astype(np.float16 if k < 2 else np.float32).tobytes()], pa.binary())})


def _unpart(part: int, touched: bytes, means: bytes) -> tuple[np.ndarray, np.ndarray]:
    t = np.frombuffer(touched, np.float32).astype(np.float64)
    return t, np.frombuffer(means, np.float16 if part >> 40 < 2 else np.float32).astype(np.float64).reshape(len(t), -1)


def _round(texts: DataFrame, model: Model, shares: int, rate: float) -> Model:
    """The model after all of `texts`, learnt in `shares` tasks and averaged."""
    sent = texts.sparkSession.sparkContext.broadcast(model.sent())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value.worker()
        find = Lookup(m.keys)
        tables = m.tables()
        sums = [np.zeros(len(x), np.float32) for x in tables]
        touched = [np.zeros(len(x), np.float32) for x in tables]
        loss, n = 0.0, 0
        for batch in batches:
            for _, h, first in _tokens(batch, 0):
                _, symbol, seen = _view(m, find, h)
                one, two = _contexts(seen, first)
                n += len(h)
                for i in range(0, len(h), BATCH):
                    j = slice(i, i + BATCH)
                    loss += m.step(one[j], two[j], symbol[j], sums, touched, rate)
        if n:
            for k, x in enumerate(tables):
                for i in range(0, len(x), 2048):
                    t = touched[k][i : i + 2048]
                    if t.any():
                        yield _part(k, i, t, x[i : i + 2048])
            yield pa.RecordBatch.from_pydict({"part": pa.array([LOSS], pa.int64()), "touched": pa.array([np.array([n], np.float64).tobytes()], pa.binary()), "means": pa.array([np.array([loss], np.float64).tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for part, touched, means in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part == LOSS:
                    t, s = np.frombuffer(touched, np.float64), np.frombuffer(means, np.float64)
                else:
                    t, s = _unpart(part, touched, means)
                    s = s * t[:, None]
                x = have.setdefault(part, [np.float64(0), np.float64(0)])
                x[0], x[1] = x[0] + t, x[1] + s
        for part, (t, s) in have.items():
            if part == LOSS:
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "touched": pa.array([t.tobytes()], pa.binary()), "means": pa.array([s.tobytes()], pa.binary())})
            else:
                yield _part(part >> 40, part & ((1 << 40) - 1), t, s / np.maximum(t, 1)[:, None])

    reducers = max(8, min(2000, sum(-(-len(x) // 2048) for x in model.tables()) // 4))
    rows = texts.coalesce(shares).mapInArrow(task, PARTS).repartition(reducers, "part").mapInArrow(add, PARTS)
    new = replace(model, **{k: getattr(model, k).copy() for k in ("class_rows", "word_rows", "word_bias", "class_bias")})
    for r in written(rows, "weights").toLocalIterator():
        if r["part"] == LOSS:
            n, loss = (np.frombuffer(r[c], np.float64)[0] for c in ("touched", "means"))
            new.losses = (*new.losses, float(loss / n) * LOG10E)
            continue
        i, (t, s) = r["part"] & ((1 << 40) - 1), _unpart(r["part"], r["touched"], r["means"])
        live = t > 0
        new.tables()[r["part"] >> 40][i : i + len(t)][live] = s[live]
    sent.unpersist()
    return new


SCORED = "doc_id long, held_out boolean, row long, n_tokens long, local_known long, local_log double, rare_log double, n_rare long, log_p double, others array<struct<h:bigint,m:int>>"


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    fold = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold == held_fold).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counts = _counted(keyed.where("NOT held_out"))
    return _scores(keyed, counts, train(keyed.select("text", "held_out"), counts, size))


def _scores(keyed: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """keyed: (doc_id, held_out, text)."""
    sent = keyed.sparkSession.sparkContext.broadcast(model.sent())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value.worker()
        find = Lookup(m.keys)
        row = TaskContext.get().partitionId() << 36
        logs = np.log10(np.append(m.counts, 0) + 1.0)
        for batch in batches:
            for b, h, first in _tokens(batch, 2):
                at, symbol, seen = _view(m, find, h)
                one, two = _contexts(seen, first)
                p = np.empty(len(h))
                for i in range(0, len(h), BATCH):
                    j = slice(i, i + BATCH)
                    p[j] = m.forward(one[j], two[j], symbol[j])[0]
                end = h == END
                local = np.where(end, np.log10(m.end_count + 1.0), logs[at])
                rare = symbol == 0
                other = np.flatnonzero((at < 0) & ~end)
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))

                def total(x: np.ndarray, begin: np.ndarray = first[:-1]) -> np.ndarray:
                    return np.add.reduceat(x.astype(np.float64), begin) if len(begin) else np.empty(0)

                od, oh = doc[other], h[other]
                order = np.lexsort((oh, od))
                od, oh = od[order], oh[order]
                new = np.flatnonzero(np.concatenate([[True], (od[1:] != od[:-1]) | (oh[1:] != oh[:-1])])) if len(od) else np.empty(0, np.int64)
                times = np.diff(np.append(new, len(od)))
                offsets = np.searchsorted(od[new], np.arange(len(first)))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": b.column(0), "held_out": b.column(1), "row": row + np.arange(len(first) - 1), "n_tokens": np.diff(first),
                    "local_known": total((at >= 0) | (end & (m.end_count > 0))).astype(np.int64), "local_log": total(local), "rare_log": total(np.where(rare, local, 0.0)), "n_rare": total(rare).astype(np.int64), "log_p": total(p) * LOG10E,
                    "others": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.StructArray.from_arrays([pa.array(oh[new].view(np.int64)), pa.array(times.astype(np.int32))], ["h", "m"])),
                })
                row += len(first) - 1

    scored = written(keyed.mapInArrow(task, SCORED), "scored")
    rest = scored.select("row", F.inline("others")).join(counts, "h").groupBy("row").agg(F.sum(F.col("m") * F.log10(F.col("c") + 1.0)).alias("far_log"), F.sum("m").alias("far_known"))
    far = F.coalesce("far_log", F.lit(0.0))
    base = F.col("local_log") + far - F.col("n_tokens") * float(np.log10(model.n + model.v + 1.0))
    total = F.col("log_p") + F.col("rare_log") + far - F.col("n_rare") * float(np.log10(model.n_rare + model.v_rare + 1.0))
    return scored.drop("others").join(rest, "row", "left").select("doc_id", "held_out", "n_tokens", (F.col("local_known") + F.coalesce("far_known", F.lit(0))).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), base.alias("base_score"), total.alias("score"))
