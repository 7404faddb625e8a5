"""Benchmark decontamination by template canonicalisation.

Numbers, units and names of a text become typed placeholders that remember
what stood there; windows of `width` template words are hash-joined with those
of the benchmark items; matched windows of one document and item that lie on
one diagonal (same distance between both places) are one alignment. Its slots
must be consistent: one item value always meets the same document value and no
two item values share one, so a question with other numbers and names is
caught and a text that only has its shape isn't. A document is contaminated by
an item if an alignment matches `least` of its windows, or all if it has fewer.

Only SQL functions: each text is read once, its windows' first words are tested
against a bitmap of the benchmark's (bounded, a literal), and only windows that
pass are hashed whole, exploded and joined. The benchmark may be of any size; the plan broadcasts it
only where Spark finds it small.

Names are capitalised words inside a sentence; neighbours make one name. An
item's first word is plain at a sentence's start and may be a name inside
running text, so an item has both forms. Windows with fewer than `plain`
ordinary words match too easily and don't count. Items shorter than a window,
and those that keep fewer windows than must match, are compared as a whole;
if they have fewer than `plain` ordinary words, with equal values.

Edge cases: null and empty texts have no windows; a null id is no document or
item and gives no row; repeated rows of either table count once; other columns
don't matter; texts are read whole; rows that share an id are one document with
several texts, each matched by itself, of which the fullest match is told.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words and signs that are units after (or before) a number.
UNITS = "km|m|cm|mm|kg|g|mg|lbs?|oz|miles?|met(?:er|re)s?|feet|foot|ft|inch(?:es)?|yards?|acres?|hours?|hrs?|minutes?|mins?|seconds?|secs?|days?|weeks?|months?|years?|dollars?|euros?|pounds?|cents?|percent|lit(?:er|re)s?|ml|l|mph|kmh|kwh|watts?|volts?|degrees?"
MARK = "\x01"
MOST_BITS = 22
BEGIN = 3


#: Item and document value of each slot. Capitalised words around a quoted passage run into
#: the name that it begins or ends with: a name that holds the item's is the item's.
_PAIRS = f"transform(arrays_zip(b, d), x -> struct(x.b AS b, IF(startswith(x.b, '{MARK}a') AND contains(concat('_', substring(x.d, 3), '_'), concat('_', substring(x.b, 3), '_')), x.b, x.d) AS d))"


def _templates(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, v: words in lower case, placeholders as mark, kind (n, u, a) and
    value; t: template words).

    In steps whose results are used more than once, so that none is evaluated
    twice; texts without marks or digits skip what only concerns these.
    """
    t = F.replace(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit("\n"), F.lit(". "))
    df = rows.where(F.col(key).isNotNull()).select(F.col(key), F.regexp_replace(t, r"\s(?<=[\p{L}\p{N},]\s)(?=\p{Lu}\p{Ll})", f" {MARK}a").alias("x"))
    joined = F.regexp_replace("x", rf" {MARK}a(?<={MARK}a\p{{L}}{{1,40}} {MARK}a)", "_")
    df = df.select(key, F.when(F.contains("x", F.lit(MARK)), joined).otherwise(F.col("x")).alias("x"))
    n = F.regexp_replace("x", r"[.,:/](?<=[0-9].)(?=[0-9])", "_")
    n = F.regexp_replace(n, rf"(?i)(?<=[0-9])\s?({UNITS})\b", f" {MARK}u$1")
    n = F.regexp_replace(n, r"(?<=[0-9])\s?%", f" {MARK}upercent ")
    n = F.regexp_replace(n, r"[$€£¥](?=\s?[0-9])", f" {MARK}ucurrency ")
    n = F.regexp_replace(n, r"(?<![\p{L}_0-9])[0-9][0-9_]*", f"{MARK}n$0")
    df = df.select(key, F.when(F.col("x").rlike("[0-9]"), n).otherwise(F.col("x")).alias("x"))
    words = F.filter(F.split(F.lower("x"), rf"[^\p{{L}}\p{{M}}\p{{N}}{MARK}_]+"), lambda x: x != "")
    df = df.select(key, words.alias("v"), F.contains("x", F.lit(MARK)).alias("m"))
    template = F.transform("v", lambda x: F.when(F.startswith(x, F.lit(MARK)), F.substring(x, 1, 2)).otherwise(x))
    return df.select(key, "v", F.when(F.col("m"), template).otherwise(F.col("v")).alias("t"))


def _forms(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Templates (item, v, t) of the items as they read at a sentence's start and
    inside running text, where a capitalised first word is, or begins, a name."""
    rows = rows.select(F.col(key).cast("long").alias("item"), F.col(text).cast("string").alias("text")).distinct()
    inside = _templates(rows.withColumn("text", F.concat(F.lit("x "), F.regexp_replace("text", r"^\s+", ""))), "item", "text")
    inside = inside.select("item", *(F.expr(f"slice({c}, 2, greatest(size({c}) - 1, 0))").alias(c) for c in "vt"))
    return _templates(rows, "item", "text").union(inside).where("size(t) > 0").dropDuplicates(["item", "v"])


def _begin(at: str, begin: int) -> str:
    return f"xxhash64({', '.join(f't[{at} + {i}]' for i in range(begin))})"


def _hash(at: str, width: str, equal: str) -> str:
    """Of template words; of the words themselves if values must be equal, but for
    names at either end, which may have run into names around the passage."""
    ends = f"transform(slice(v, {at} + 1, {width}), (x, n) -> IF((n = 0 OR n = {width} - 1) AND startswith(x, '{MARK}a'), '{MARK}a', x))"
    return f"xxhash64({equal}, IF({equal}, {ends}, slice(t, {at} + 1, {width})))"


def _places(width: int) -> str:
    return f"IF(size(t) < {width}, cast(array() as array<int>), sequence(0, size(t) - {width}))"


def _slots(at: str, width: int | str) -> str:
    return f"filter(slice(v, {at} + 1, {width}), x -> startswith(x, '{MARK}'))"


def _windows(forms: DataFrame, width: int, plain: int, least: int) -> DataFrame:
    """(item, of: the form, item_windows: those that count, w: their width, equal:
    whether values must be, i: place, h, s: hash of the first words, b: slots)."""
    df = forms.select("item", "v", "t", F.expr(f"filter({_places(width)}, i -> {width} - size({_slots('i', width)}) >= {min(plain, width)})").alias("p"))
    df = df.select("*", F.expr(f"size(t) < {width} OR size(p) < least({least}, size(t) - {width} + 1)").alias("whole"))
    few = f"whole AND size(t) - size(filter(v, x -> startswith(x, '{MARK}'))) < {plain}"
    df = df.select("item", F.xxhash64("v").alias("of"), "v", "t", F.expr(f"IF(whole, size(t), {width})").alias("w"), F.expr(few).alias("equal"), F.expr("IF(whole, array(0), p)").alias("p"))
    df = df.select("*", F.size("p").cast("long").alias("item_windows"), F.least("w", F.lit(BEGIN)).alias("begin"), F.explode("p").alias("i"))
    s = "CASE begin " + " ".join(f"WHEN {n} THEN {_begin('i', n)}" for n in range(1, BEGIN + 1)) + " END"
    return df.select("item", "of", "item_windows", "w", "equal", "begin", "i", F.expr(_hash("i", "w", "equal")).alias("h"), F.expr(s).alias("s"), F.expr(_slots("i", "w")).alias("b"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 8, plain: int = 4, least: int = 5) -> DataFrame:
    """(id, item, n_windows, item_windows, n_slots, exact) of every contaminated document and item."""
    windows = _windows(_forms(benchmark, item_col, item_text_col), width, plain, least)
    kinds: dict[int, list] = {}
    for r in windows.select("begin", "w", "equal").distinct().collect():
        kinds.setdefault(r["begin"], []).append((r["w"], r["equal"]))
    found = _templates(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc"), "v", "t")
    hashed = []
    for begin in sorted(kinds):  # of one scan
        each = windows.where(F.col("begin") == begin)
        bits = int(min(MOST_BITS, max(12, (64 * max(1, each.count())).bit_length())))
        cell = F.expr(f"s & {(1 << bits) - 1}L")
        words = {r[0]: r[1] for r in each.groupBy(F.shiftright(cell, 6).alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63L as int))")).alias("b")).collect()}
        bitmap = F.split(F.lit(",".join(str(words.get(i, 0)) for i in range(1 << (bits - 6)))), ",").cast("array<bigint>")
        found = found.select("*", F.expr(f"transform({_places(begin)}, i -> {_begin('i', begin)})").alias("s"))
        found = found.select("*", _passing(bitmap, bits).alias(f"p{begin}")).drop("s")
        every = "array(" + ", ".join(f"struct({w} AS w, {str(e).lower()} AS e)" for w, e in sorted(kinds[begin])) + ")"
        hashed.append(f"flatten(transform({every}, k -> transform(filter(p{begin}, j -> j + k.w <= size(t)), j -> struct({_hash('j', 'k.w', 'k.e')} AS h, j AS j, {_slots('j', 'k.w')} AS d))))")
    if hashed:
        met = found.select("doc", F.explode(F.expr(f"concat({', '.join(hashed)})")).alias("x")).select("doc", "x.*").join(windows.drop("s", "begin"), "h").where("size(b) = size(d)")
        met = met.select("doc", "item", "of", "item_windows", "equal", "i", (F.col("j") - F.col("i")).alias("diagonal"), F.expr(_PAIRS).alias("slots"))
        line = met.groupBy("doc", "item", "of", "item_windows", "equal", "diagonal").agg(F.countDistinct("i").alias("n_windows"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("s"))
        line = line.where("size(array_distinct(s.b)) = size(s) AND size(array_distinct(s.d)) = size(s)").where(F.col("n_windows") >= F.least(F.lit(least), F.col("item_windows")))
        out = line.select("doc", "item", "item_windows", "n_windows", "equal", F.size("s").cast("long").alias("n_slots"), F.forall("s", lambda x: x.b == x.d).alias("exact")).where("exact OR NOT equal")
    else:
        out = docs.sparkSession.createDataFrame([], "doc long, item long, item_windows long, n_windows long, equal boolean, n_slots long, exact boolean")
    # An item may be found in both its forms.
    out = out.groupBy("doc", "item").agg(F.max("n_windows").alias("n_windows"), F.max("item_windows").alias("item_windows"), F.max("n_slots").alias("n_slots"), F.max("exact").alias("exact"))
    return out.withColumnsRenamed({"doc": id_col, "item": item_col})


def _passing(bitmap: Column, bits: int) -> Column:
    """Places of the windows whose first words' bit is set; the bitmap is constant, so each costs a look-up."""
    places = F.expr("IF(size(s) = 0, cast(array() as array<int>), sequence(0, size(s) - 1))")

    def set_(i: Column) -> Column:
        cell = F.get("s", i).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        return F.getbit(F.get(bitmap, F.shiftright(cell, 6).cast("int")), cell.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1

    return F.filter(places, set_)
