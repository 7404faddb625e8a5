"""Quality rules: a decision list learned from labelled statistics.

`statistics` adds plain counts of a text's words, symbols, lines and repeats as
built-in SQL expressions. `learn` fits an ordered list of threshold
conjunctions to labelled rows by sequential covering: a rule is grown on one
part of the rows, condition by condition, by information gain; pruned on the
other part while that does not lower its worth there; kept if it is precise
enough there; then the rows it covers are set aside and the next one is grown.
Where good documents can be told apart among those that a rule rejects, a rule
that keeps them is put before it, so the order of the list matters.
`verdict` writes the list as one CASE expression, so that judging a document is
a projection.

Edge cases: a null text has no words and fails the base rules; without usable
labels there are no learned rules; a null label is no label; of several
labels of one id the lowest counts; texts of any length are read whole; added
columns replace columns of their names, all others are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import col, packed

#: The white space between words and the symbols that count.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_upper", "n_marks", "n_lines", "n_chars_all")
#: Rates that rules may test, each from the counts above.
RATES = {
    "mean_word": "word_chars / n_words",
    "symbol_rate": "n_symbols / n_words",
    "dup_line_rate": "n_dup_lines / n_lines",
    "repeat_rate": "n_repeat_words / n_words",
    "upper_rate": "n_upper / word_chars",
    "mark_rate": "n_marks / n_words",
    "line_words": "n_words / n_lines",
    "words": "cast(n_words as double)",
}
MOST_LABELLED = 20_000


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the BASE and EXTRA counts (long); nulls count as no text."""
    keep = [c for c in docs.columns if c not in (*BASE, *EXTRA)]
    t = F.coalesce(col(text_col).cast("string"), F.lit(""))

    def without(chars: str) -> Column:
        return F.length(F.translate(t, chars, ""))

    n = F.length(t)
    trimmed = F.nullif(F.trim(t, F.lit(BLANKS)), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(x, F.lit(BLANKS))) > 0)
    df = docs.select(*keep, F.coalesce(F.split(trimmed, r"[\x20\x09-\x0D]+"), F.array().cast("array<string>")).alias("__w"), lines.alias("__l"), n.alias("__n"), without(BLANKS).alias("__c"), without(SYMBOLS).alias("__s"), without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("__u"), without("!?").alias("__m"))
    df = df.select("*", F.expr("IF(size(__w) < 3, array(), transform(sequence(0, size(__w) - 3), i -> xxhash64(__w[i], __w[i + 1], __w[i + 2])))").cast("array<bigint>").alias("__h"), F.expr("length(bin(size(__w)))").alias("__b"))
    # Hash and place in one number: sorting brings equal windows together.
    df = df.select("*", F.expr("sort_array(transform(__h, (h, i) -> shiftleft(h, __b) | cast(i as bigint)))").alias("__p"))
    same = "(shiftright(x, __b) = shiftright(__p[{0}], __b) AND __h[cast(x & (shiftleft(1L, __b) - 1L) as int)] = __h[cast(__p[{0}] & (shiftleft(1L, __b) - 1L) as int)])"
    df = df.select("*", F.expr(f"sort_array(transform(filter(__p, (x, k) -> (k > 0 AND {same.format('k - 1')}) OR (k + 1 < size(__p) AND {same.format('k + 1')})), x -> cast(x & (shiftleft(1L, __b) - 1L) as int)))").alias("__r"))
    covered = F.expr("aggregate(transform(__r, (p, k) -> IF(k + 1 < size(__r), least(3, __r[k + 1] - p), 3)), 0L, (a, x) -> a + x)")
    # Through a generator, so that a filter on the counts isn't pushed below them
    # and evaluated inside their own loops.
    return df.select(*keep, F.inline(F.array(F.struct(
        F.size("__w").cast("long").alias("n_words"),
        F.col("__c").cast("long").alias("word_chars"),
        (F.col("__n") - F.col("__s")).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        (F.col("__n") - F.col("__u")).cast("long").alias("n_upper"),
        (F.col("__n") - F.col("__m")).cast("long").alias("n_marks"),
        F.size("__l").cast("long").alias("n_lines"),
        F.col("__n").cast("long").alias("n_chars_all"),
    ))))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rate(name: str) -> Column:
    """A rate as a double; 0 where it has no denominator."""
    top, _, below = RATES[name].partition(" / ")
    if not below:
        return F.expr(top)
    return F.when(F.expr(below) > 0, F.expr(f"cast({top} as double) / {below}")).otherwise(0.0)


@dataclass(frozen=True)
class Test:
    name: str
    above: bool
    at: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] > self.at if self.above else x[self.name] <= self.at

    def column(self) -> Column:
        return rate(self.name) > self.at if self.above else rate(self.name) <= self.at


@dataclass(frozen=True)
class Rule:
    """All tests hold: the document is rejected, or kept."""

    tests: tuple[Test, ...]
    precision: float
    covered: int
    keeps: bool = False


def _all(tests: tuple[Test, ...], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for t in tests:
        out &= t.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, cuts: int, longest: int) -> tuple[Test, ...]:
    tests: tuple[Test, ...] = ()
    live = np.ones(len(bad), bool)
    while len(tests) < longest and (live & ~bad).any():
        p0, n0 = (live & bad).sum(), live.sum()
        best, worth = None, 1e-9
        for name, v in x.items():
            for at in np.unique(np.quantile(v[live], np.linspace(0.02, 0.98, cuts))):
                for above in (True, False):
                    hit = live & (v > at if above else v <= at)
                    p, n = (hit & bad).sum(), hit.sum()
                    if p:
                        gain = p * (np.log2(p / n) - np.log2(p0 / n0))
                        if gain > worth:
                            best, worth = Test(name, above, float(at)), gain
        if best is None:
            break
        v, hit = x[best.name], live & best.holds(x)
        rest = live & ~hit
        if rest.any():  # halfway between what is covered and what isn't
            lo, hi = (v[rest].max(), v[hit].min()) if best.above else (v[hit].max(), v[rest].min())
            best = Test(best.name, best.above, float((lo + hi) / 2))
        tests += (best,)
        live = hit
    return tests


def fit(x: dict[str, np.ndarray], bad: np.ndarray, part: np.ndarray, least_precision: float = 0.9, least_rows: int = 5, most_rules: int = 12, cuts: int = 24, longest: int = 4) -> list[Rule]:
    """Sequential covering; part: True for the rows that rules are grown on."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < most_rules:
        g, p = left & part, left & ~part
        if (bad & g).sum() < least_rows or (bad & p).sum() < 1:
            break
        tests = _grow({k: v[g] for k, v in x.items()}, bad[g], cuts, longest)
        if not tests:
            break
        xp, bp = {k: v[p] for k, v in x.items()}, bad[p]

        def worth(t: tuple[Test, ...], xp=xp, bp=bp) -> float:
            hit = _all(t, xp, len(bp))
            return ((hit & bp).sum() - 4 * (hit & ~bp).sum()) / max(1, bp.sum())

        while len(tests) > 1:
            shorter = max((tests[:i] + tests[i + 1 :] for i in range(len(tests))), key=worth)
            if worth(shorter) < worth(tests):
                break
            tests = shorter
        hit = _all(tests, x, len(bad)) & left
        judged = hit & ~part
        right, n = (judged & bad).sum(), judged.sum()
        if hit.sum() < least_rows or n == 0 or right / n < least_precision:
            break
        rules += _exceptions(x, bad, part, hit, tests, least_precision, least_rows, cuts, longest)
        rules.append(Rule(tests, float(right / n), int(hit.sum())))
        left &= ~hit
    return rules


def _exceptions(x: dict[str, np.ndarray], bad: np.ndarray, part: np.ndarray, hit: np.ndarray, tests: tuple[Test, ...], least_precision: float, least_rows: int, cuts: int, longest: int) -> list[Rule]:
    """A rule for good documents among those that `tests` reject, if there are some that can be told apart."""
    grown = hit & part
    if (~bad & grown).sum() < least_rows:
        return []
    more = _grow({k: v[grown] for k, v in x.items()}, ~bad[grown], cuts, longest)
    kept = _all(more, x, len(bad)) & hit
    judged = kept & ~part
    if not more or judged.sum() == 0 or (judged & ~bad).sum() < least_precision * judged.sum() or (kept & ~bad).sum() < least_rows:
        return []
    return [Rule(tests + more, float((judged & ~bad).sum() / judged.sum()), int(kept.sum()), True)]


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_labelled: int = MOST_LABELLED) -> list[Rule]:
    """Rules for label 0, from about `most_labelled` labelled rows at most, chosen by a threshold on a hash of the id."""
    want = labels.where(col(id_col).isNotNull() & col(label_col).isNotNull()).groupBy(col(id_col).alias("id")).agg(F.min(col(label_col)).alias("label"))
    n = want.count()
    if n > most_labelled:
        want = want.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int(most_labelled / n * (1 << 40)))
    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    known = statistics(rows.join(F.broadcast(want), "id").select("id", "label", "text"))
    rows = known.where(~base_failed()).select(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)).alias("part"), (F.col("label") == 0).alias("bad"), *(rate(k).alias(k) for k in RATES)).collect()
    if not rows:
        return []
    values = np.array([tuple(map(float, r)) for r in rows])
    values = values[np.lexsort(values.T)]
    return fit({k: values[:, 2 + i] for i, k in enumerate(RATES)}, values[:, 1] > 0, values[:, 0] > 0)


def verdict(rules: list[Rule]) -> Column:
    """What the first rule that holds says, else true."""
    out = None
    for r in rules:
        hit = r.tests[0].column()
        for t in r.tests[1:]:
            hit = hit & t.column()
        out = (F if out is None else out).when(hit, F.lit(r.keeps))
    return F.lit(True) if out is None else out.otherwise(True)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """docs with the BASE counts, base_failed and kept."""
    if rules is None:
        rules = learn(docs, labels, id_col, text_col)
    keep = [c for c in docs.columns if c not in (*BASE, *EXTRA, "base_failed", "kept")]
    # The text goes once, beside the caller's other columns.
    counted = statistics(docs.select(packed(c for c in keep if c != text_col).alias("row"), col(text_col).alias("text")))
    return counted.select(*(F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in keep), *BASE, base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))
