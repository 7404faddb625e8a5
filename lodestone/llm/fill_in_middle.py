"""Fill-in-the-middle: each text is cut at two drawn places and its parts are put in another order.

A text's units are words, each with the white space before it, and the white
space left at the end. Two draws give the units after which the prefix and the
middle end; further draws choose the form: the plain text, or prefix, suffix
and middle behind markers, in the order psm or spm.

How: a text is a run of a small automaton over bytes. A chunk of bytes that is
read without knowing in which state it is entered gives a function: for every
entry state the exit state, the units that begin in the chunk and the markers
that end in it. Functions compose associatively, so the entry state of each
chunk, and the units before it, come from a prefix scan over functions, and any
chunk can then be asked for its part of a cut. Texts of one chunk need no more
than their own function. The chunks of longer texts are dealt out over tasks,
their functions (a few numbers each) are composed, the two chunks that hold the
cuts are chosen by their unit counts, and only these are read again.

Edge cases: a null text counts as empty; an empty text is plain and has no
units; a null id is drawn as an empty one; rows that share an id draw the same
numbers; repeated rows get equal results; texts of any length are cut in
chunks of `chunk` bytes; all columns are kept and the added ones replace any of
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import kernels as K
from lodestone.llm.common import col, packed, unpacked, written

ADDED = ("n", "form", "prefix", "middle", "suffix", "output")
#: The markers of prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
#: The automaton: before any byte, in white space, in a word, in a word after `<`, and after `<` and one of the letters.
START, BLANK, WORD, OPEN, LETTER = range(5)
STATES = 5
#: What is kept of a function: exit state, units begun and markers ended for each entry state.
FUNCTION = "exits binary, units binary, marks binary"


def _table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each state and byte: the next state, whether a unit begins, whether a marker ends."""
    to = np.full((STATES, 256), WORD, np.int8)
    to[:, K.IS_SPACE] = BLANK
    to[:, ord("<")] = OPEN
    for m in MARKERS:
        to[OPEN, ord(m[1])] = LETTER
    unit = np.zeros((STATES, 256), np.int64)
    unit[START] = 1
    unit[WORD:, K.IS_SPACE] = 1
    mark = np.zeros((STATES, 256), np.int64)
    mark[LETTER, ord(">")] = 1
    return to, unit, mark


NEXT, UNIT, MARK = _table()


def states(data: np.ndarray, first: np.ndarray, entry: int | np.ndarray) -> np.ndarray:
    """The state before each byte. first: where each chunk begins; entry: the state there.

    A state depends on two bytes back at most, so that all bytes are read at once.
    """
    s = np.empty(len(data), np.int8)
    if not len(data):
        return s
    begins = np.zeros(len(data) + 1, bool)
    begins[first] = True
    begins = begins[:-1]
    entered = np.zeros(len(data) + 1, np.int8)
    entered[first] = entry
    s[0] = entered[0]
    s[1:] = NEXT[WORD, data[:-1]]
    s[begins] = entered[:-1][begins]
    opened = np.flatnonzero((s[:-1] == OPEN) & ~begins[1:]) + 1
    s[opened] = NEXT[OPEN, data[opened - 1]]
    return s


def begun(data: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The bytes at which a unit begins."""
    return np.flatnonzero(UNIT[s, data])


def functions(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each chunk's function: exit state, units and markers, by entry state."""
    n = len(offsets) - 1
    out = [np.zeros((n, STATES), np.int64) for _ in range(3)]
    some = np.flatnonzero(np.diff(offsets))
    first, last = offsets[some], offsets[some + 1] - 1
    for e in range(STATES):
        out[0][:, e] = e
        if len(some):
            s = states(data, first, e)
            out[0][some, e] = NEXT[s[last], data[last]]
            for total, table in zip(out[1:], (UNIT, MARK), strict=True):
                total[some, e] = np.add.reduceat(table[s, data], first)
    return out[0], out[1], out[2]


def compose(f: tuple[np.ndarray, ...], g: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """First f, then g, for many pairs at once."""
    rows = np.arange(len(f[0]))[:, None]
    return g[0][rows, f[0]], f[1] + g[1][rows, f[0]], f[2] + g[2][rows, f[0]]


def scanned(f: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """What precedes and includes each chunk of one text, by doubling steps."""
    f, step = tuple(x.copy() for x in f), 1
    while step < len(f[0]):
        later = compose(tuple(x[:-step] for x in f), tuple(x[step:] for x in f))
        for x, y in zip(f, later, strict=True):
            x[step:] = y
        step *= 2
    return f


def _cut(data: np.ndarray, offsets: np.ndarray, units: np.ndarray, n: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Of each text, the byte before which `wanted` units lie. units: places of all; n: their number in each text."""
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    at = np.concatenate([units, [0]])[np.minimum(first + wanted, len(units))]
    return np.where(wanted >= n, offsets[1:], at) - offsets[:-1]


def _whole(batches: Iterator[pa.RecordBatch], text: int, draws: int) -> Iterator[pa.RecordBatch]:
    """Texts of one chunk: n, markers, and the bytes before both cuts."""
    for batch in batches:
        for b in K.slices(batch, text):
            data, offsets = K.buffers(b.column(text))
            s = states(data, offsets[:-1][np.diff(offsets) > 0], START)
            units = begun(data, s)
            n = np.diff(np.searchsorted(units, offsets))
            marks = np.diff(np.concatenate([[0], np.cumsum(MARK[s, data])])[offsets])
            h = [np.asarray(b.column(draws + i)) % (n + 1) for i in (0, 1)]
            cuts = [_cut(data, offsets, units, n, f(*h)) for f in (np.minimum, np.maximum)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x.astype(np.int64)) for x in (n, marks, *cuts))], [*b.schema.names, "n", "marks", "a", "b"])


def _chunk_functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in K.slices(batch, 2):
            f = functions(*K.buffers(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([r.tobytes() for r in x], pa.binary()) for x in f)], ["k", "i", "exits", "units", "marks"])


def _composed(t: pa.Table) -> pa.Table:
    """Of one text, from its chunks' functions: n, markers, and of each cut its chunk, the state in which that is entered and the units before it."""
    t = t.sort_by("i")
    f = tuple(np.frombuffer(b"".join(t[c].to_pylist()), np.int64).reshape(-1, STATES) for c in ("exits", "units", "marks"))
    exits, units, marks = (x[:, START] for x in scanned(f))
    n = int(units[-1])
    draws = [t[c][0].as_py() % (n + 1) for c in ("h1", "h2")]
    entry, before = np.concatenate([[START], exits[:-1]]), np.concatenate([[0], units[:-1]])
    rows = []
    for name, wanted in zip("ab", (min(draws), max(draws)), strict=True):
        i = int(np.searchsorted(units, wanted, "right")) if wanted < n else -1
        rows.append({"k": t["k"][0].as_py(), "n": n, "marks": int(marks[-1]), "cut": name, "i": t["i"][i].as_py() if i >= 0 else -1, "entry": int(entry[i]), "left": int(wanted - before[i])})
    return pa.Table.from_pylist(rows, pa.schema([("k", pa.string()), ("n", pa.int64()), ("marks", pa.int64()), ("cut", pa.string()), ("i", pa.int64()), ("entry", pa.int64()), ("left", pa.int64())]))


def _found(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """The byte of a cut within its text, from the chunk that holds it."""
    for b in batches:
        at = []
        for text, i, entry, left in zip(*(b.column(c).to_pylist() for c in ("part", "i", "entry", "left")), strict=True):
            data = np.frombuffer(text, np.uint8)
            at.append(i * chunk + int(begun(data, states(data, np.zeros(1, np.int64), entry))[left]))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.int64())], ["k", "cut", "at"])


def _giant(rows: DataFrame, chunk: int) -> DataFrame:
    """rows of several chunks with n, marks, a and b."""
    size = F.octet_length("r.text")
    part = lambda i: F.substring(F.col("r.text").cast("binary"), (i * chunk + 1).cast("int"), F.lit(chunk))
    parts = F.transform(F.sequence(F.lit(0), F.ceil(size / chunk).cast("int") - 1), lambda i: F.struct(i.cast("long").alias("i"), part(i).alias("part")))
    keyed = rows.withColumn("k", F.sha2(F.concat(F.length("r.draw").cast("string"), F.lit(":"), "r.draw", "r.text"), 256))
    chunks = keyed.select("k", "h1", "h2", F.explode(parts).alias("x")).select("k", "h1", "h2", "x.i", "x.part")
    chunks = written(chunks.repartition("k", "i").dropDuplicates(["k", "i"]), "fim-chunks")
    found = chunks.select("k", "i", "part").mapInArrow(_chunk_functions, f"k string, i long, {FUNCTION}")
    drawn = chunks.where("i = 0").select("k", "h1", "h2")
    cuts = found.join(drawn, "k").groupBy("k").applyInArrow(_composed, "k string, n long, marks long, cut string, i long, entry long, left long")
    cuts = written(cuts, "fim-cuts")
    inner = cuts.where("i >= 0").join(chunks.select("k", "i", "part"), ["k", "i"]).select("k", "cut", "i", "entry", "left", "part").mapInArrow(lambda b: _found(b, chunk), "k string, cut string, at long")
    ends = cuts.join(inner, ["k", "cut"], "left").groupBy("k").agg(F.max("n").alias("n"), F.max("marks").alias("marks"), *(F.max(F.when(F.col("cut") == c, F.coalesce("at", F.lit(-1)))).alias(c) for c in "ab"))
    at = lambda c: F.when(F.col(c) < 0, size.cast("long")).otherwise(F.col(c)).alias(c)
    return keyed.join(ends, "k").select("r", "h1", "h2", "h3", "h4", "n", "marks", at("a"), at("b"))


def restored(output: Column, form: Column) -> Column:
    """The text rebuilt from an output and its form."""
    p = F.split(output, "<[PSM]>", -1)
    psm, spm = F.concat(p[1], p[3], p[2]), F.concat(p[2], p[3], p[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80, chunk: int = 1 << 15) -> DataFrame:
    """docs with n, form, prefix, middle, suffix (null if plain) and output.

    rate: per cent of texts that are changed; spm: per cent of these in the order spm.
    """
    names = [c for c in docs.columns if c not in ADDED]
    plain = lambda c: F.coalesce(col(c).cast("string"), F.lit(""))
    own = F.struct(packed(names).alias("row"), plain(text_col).alias("text"), plain(id_col).alias("draw"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), "r.draw"), 256)
    rows = docs.select(own.alias("r")).select("r", *(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)))
    short = rows.where(F.octet_length("r.text") <= chunk)
    flat = short.select("r.row", "r.text", "r.draw", "h1", "h2", "h3", "h4")
    schema = T.StructType([*flat.schema.fields, *(T.StructField(c, T.LongType()) for c in ("n", "marks", "a", "b"))])
    short = flat.mapInArrow(lambda b: _whole(b, 1, 3), schema)
    giant = _giant(rows.where(F.octet_length("r.text") > chunk), chunk).select("r.row", "r.text", "r.draw", "h1", "h2", "h3", "h4", "n", "marks", "a", "b")
    data = F.col("text").cast("binary")
    cut = short.unionByName(giant).select(
        "row", "text", "n",
        F.when((F.col("n") == 0) | (F.col("marks") > 0) | (F.col("h3") % 100 >= rate), "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm").alias("form"),
        F.substring(data, F.lit(1), F.col("a").cast("int")).cast("string").alias("p"),
        F.substring(data, F.col("a").cast("int") + 1, (F.col("b") - F.col("a")).cast("int")).cast("string").alias("m"),
        F.substring(data, F.col("b").cast("int") + 1, F.octet_length("text")).cast("string").alias("s"),
    )
    p, s, m = (F.lit(x) for x in MARKERS)
    output = F.when(F.col("form") == "psm", F.concat(p, "p", s, "s", m, "m")).when(F.col("form") == "spm", F.concat(s, "s", p, "p", m, "m")).otherwise(F.col("text"))
    part = lambda c, name: F.when(F.col("form") != "plain", F.col(c)).alias(name)
    return cut.select(*unpacked(names), "n", "form", part("p", "prefix"), part("m", "middle"), part("s", "suffix"), output.alias("output"))
