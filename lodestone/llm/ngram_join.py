"""N-gram Jaccard join with vertical partitioning, and its components.

A document's set is its distinct shingles of `n` words (A-Z lower-cased); two
documents link when their sets' Jaccard similarity is at least `percent` / 100.

1. Equal sets become one class with its least id as representative.
2. A repeat sketch over all shingles: whoever shares too few of its shingles
   with anyone has no partner and stays out, exactly (the sketch never misses a
   repeat). For the rest, exact document frequencies give the global order of
   shingles, rare ones first.
3. The global order is cut into `fragments` ranges at quantiles and every
   document's ordered set with it. Overlaps are counted in each fragment
   separately and summed per pair.
4. Pairs to count share a shingle in their prefixes, at places that leave room
   for the overlap they need (the first shingle that a linked pair has in common
   is such a one). First each document meets one other of each prefix shingle;
   then, where a prefix shingle leaves components apart, one or two others of
   another component; at last all pairs that prefix shingles leave in different components, sought in
   blocks of bounded size. A pair inside a component can't change it, so groups
   of copies are never expanded into all their pairs, and no link between
   components is lost.

Edge cases: a text without words (or null) has an empty set and links with
nothing; with fewer than n words the whole sequence is the one shingle; a null
id counts as the least id and comes back as null; rows that share an id are
documents of their own; other columns than the id are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import kernels as K
from lodestone.llm import sketch
from lodestone.llm.common import LEAST_ID, discard, id_key, written
from lodestone.llm.components import components


def _sets(batch: pa.RecordBatch, text: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each slice: the set sizes of its texts and all sets one after another, each sorted."""
    for b in K.slices(batch, text):
        w = K.Words(*K.buffers(b.column(text)), lower=True)
        h = w.hashes()
        starts = K.inside(w.counts, n)
        shingle = K.windows(h, n)[starts] if len(starts) else np.empty(0, K.U64)
        doc = w.doc[starts]
        few = np.flatnonzero((w.counts > 0) & (w.counts < n))
        short = np.array([K.windows(h[w.first[d] : w.first[d + 1]], int(w.counts[d]), 1)[0] + K.U64(w.counts[d]) for d in few], K.U64)
        doc, shingle = np.concatenate([doc, few]), np.concatenate([shingle, short])
        order = np.lexsort((shingle, doc))
        doc, shingle = doc[order], shingle[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])
        yield np.bincount(doc[new], minlength=len(w.counts)), shingle[new]


def _signed(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, k, n, s, s2, tokens) of every row; tokens only where enough of them may repeat."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            for _, shingle in _sets(b, 0, n):
                yield shingle

    seen = sketch.repeats(docs.select("text"), hashes, sketch.bits_for(size / 12), 1)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = TaskContext.get().partitionId() << 36
        for b in batches:
            at = 0
            for counts, shingle in _sets(b, 1, n):
                ids = b.column(0).slice(at, len(counts))
                at += len(counts)
                ends = np.cumsum(counts)
                begins = ends - counts
                doc = np.repeat(np.arange(len(counts)), counts)
                total = [np.concatenate([[K.U64(0)], np.cumsum(K.mix(shingle + K.U64(i)))]) for i in (0, 1)]
                sums = [t[ends] - t[begins] for t in total]
                again = seen.maybe(shingle)
                have = np.bincount(doc[again], minlength=len(counts))
                live = (100 * have >= percent * counts) & (counts > 1)
                kept = again & live[doc]
                offsets = np.concatenate([[0], np.cumsum(np.where(live, have, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "node": node + np.arange(len(counts)), "k": ids, "n": counts.astype(np.int64), "s": sums[0].view(np.int64), "s2": sums[1].view(np.int64),
                    "tokens": pa.ListArray.from_arrays(pa.array(offsets), pa.array(shingle[kept].view(np.int64)), mask=pa.array(~live)),
                })
                node += len(counts)

    return written(docs.select("k", "text").mapInArrow(task, "node long, k long, n long, s long, s2 long, tokens array<long>"), "shingle-sets")


def _ordered(reps: DataFrame, percent: int) -> DataFrame:
    """(node, n, need, counts, tokens) of possible partners, tokens by their numbers of documents.

    Numbers and tokens are two lists of one aggregate, so their rows match; as
    lists of structs they would take three times the room on their way.
    """
    post = reps.select("node", F.explode("tokens").alias("token"))
    df = post.groupBy("token").agg(F.count("*").cast("int").alias("count")).where("count > 1")
    lists = post.join(df, "token").groupBy("node").agg(F.collect_list("count").alias("counts"), F.collect_list("token").alias("tokens"))
    need = F.expr(f"({percent} * n + 99) div 100").alias("need")
    return written(lists.join(reps.select("node", "n"), "node").select("node", "n", need, "counts", "tokens").where(F.size("tokens") >= F.col("need")), "ordered-sets")


def _placed(ordered: DataFrame) -> DataFrame:
    """(node, n, need, tokens), tokens in the global order as (place, token)."""
    place = "transform(arrays_zip(counts, tokens), t -> named_struct('place', t.counts + (t.tokens / double('18446744073709551616') + 0.5D), 'token', t.tokens))"
    return ordered.select("node", "n", "need", F.sort_array(F.expr(place)).alias("tokens"))


def _overlaps(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, xn, y, yn) that link, as (a, b): overlaps counted per fragment, summed per pair."""
    x, y = segments.toDF("x", "f", "xt"), segments.toDF("y", "f", "yt")
    part = pairs.join(x, "x").join(y, ["y", "f"]).select("x", "xn", "y", "yn", F.size(F.array_intersect("xt", "yt")).cast("long").alias("o"))
    both = part.groupBy("x", "xn", "y", "yn").agg(F.sum("o").alias("o"))
    return both.where(f"100 * o >= {percent} * (xn + yn - o)").select(F.col("x").alias("a"), F.col("y").alias("b"))


PAIR = ["x", "xn", "y", "yn"]


def _pairs(met: DataFrame, percent: int) -> DataFrame:
    """Pairs of l and r, the lesser node first, that leave room for enough overlap.

    left: how many shingles a document has from the one in common on. If that is
    the pair's first, their overlap is at most the lesser of the two.
    """
    fits = f"l.node != r.node AND {100 + percent} * least(l.left, r.left) >= {percent} * (l.n + r.n)"
    first = "l.node < r.node"
    return met.where(fits).select(*(F.expr(f"IF({first}, {a}.{c}, {b}.{c})").alias(v) for v, a, b, c in (("x", "l", "r", "node"), ("xn", "l", "r", "n"), ("y", "r", "l", "node"), ("yn", "r", "l", "n")))).distinct()


def _blocks(rest: DataFrame, percent: int, chunk: int) -> DataFrame:
    """All fitting pairs of different components that share a prefix shingle.

    A shingle's documents are cut into chunks, large components into chunks of
    their own, and chunks meet chunks; two of one large component needn't.
    """
    own = rest.groupBy("token", "c").count()
    own = own.withColumn("g", F.when(F.col("count") * 10 >= chunk, F.col("c")).otherwise(F.lit(-1).cast("long")))
    parts = own.groupBy("token", "g").agg(F.expr(f"(sum(count) + {chunk - 1}) div {chunk}").alias("parts"))
    dealt = rest.join(own.join(parts, ["token", "g"]).select("token", "c", "g", "parts"), ["token", "c"])
    rows = F.collect_list(F.struct("node", "n", "left", "c")).alias("m")
    chunks = dealt.groupBy("token", "g", F.expr("pmod(xxhash64(node), parts)").alias("part")).agg(rows)
    cols = ("node", "n", "left", "c")
    a = chunks.select("token", F.col("g").alias("ag"), F.col("part").alias("ap"), *(F.col(f"m.{x}").alias(f"a_{x}") for x in cols))
    b = chunks.select("token", F.col("g").alias("bg"), F.col("part").alias("bp"), *(F.col(f"m.{x}").alias(f"b_{x}") for x in cols))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                an, a_n, al, ac, bn, b_n, bl, bc = (np.asarray(batch.column(c)[i].values) for c in range(8))
                fit = (100 + percent) * np.minimum(al[:, None], bl[None]) >= percent * (a_n[:, None] + b_n[None])
                p, q = np.nonzero(fit & (ac[:, None] != bc[None]))
                x, y = an[p], bn[q]
                swap = x > y
                if len(x):
                    yield pa.RecordBatch.from_pydict({"x": np.where(swap, y, x), "xn": np.where(swap, b_n[q], a_n[p]), "y": np.where(swap, x, y), "yn": np.where(swap, a_n[p], b_n[q])})

    met = a.join(b, "token").where("(ag < bg) OR (ag = bg AND ag = -1 AND ap <= bp)").select(*(f"{s}_{x}" for s in "ab" for x in cols))
    return met.mapInArrow(task, "x long, xn long, y long, yn long").distinct()


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75, fragments: int = 8, chunk: int = 1000) -> DataFrame:
    """id_col, n_shingles and component_id (the least id reachable by links) of every row."""
    keyed = docs.select(id_key(id_col).alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sets = _signed(keyed, n, percent)
    classes = written(sets.where("n > 0").groupBy("s", "s2", "n").agg(F.min("k").alias("rep"), F.min("node").alias("node")), "classes")
    reps = sets.where(F.col("tokens").isNotNull()).select("node", "n", "tokens").join(classes.select("node"), "node", "left_semi")
    stored = _ordered(reps, percent)
    ordered = _placed(stored)
    named = written(sets.select("k", "n", "s", "s2"), "names")
    discard(sets)

    cuts = ordered.select(F.explode("tokens.place").alias("p")).agg(F.percentile_approx("p", [i / fragments for i in range(1, fragments)], 1000)).first()[0] or []
    bounds = [float("-inf"), *sorted(set(cuts)), float("inf")]
    cut = F.array(*(F.struct(F.lit(i).alias("f"), F.expr(f"transform(filter(tokens, t -> t.place > {_d(a)} AND t.place <= {_d(b)}), t -> t.token)").alias("t")) for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))))
    segments = written(ordered.select("node", F.explode(cut).alias("c")).select("node", "c.f", "c.t").where(F.size("t") > 0), "segments")
    places = F.posexplode(F.expr("slice(tokens, 1, size(tokens) - need + 1).token")).alias("i", "token")
    prefix = written(ordered.select("node", "n", F.size("tokens").cast("long").alias("r"), places).select("node", "n", (F.col("r") - F.col("i")).alias("left"), "token"), "prefixes")
    discard(stored)

    # One other document of each prefix shingle: the one with most room.
    room = F.expr(f"{100 + percent} * left - {percent} * n").alias("o")
    pivot = prefix.groupBy("token").agg(F.max(F.struct(room, "node", "n", "left")).alias("p")).select("token", "p.*")
    tried = written(_pairs(prefix.alias("l").join(pivot.alias("r"), "token"), percent), "pairs")
    stars = components(_overlaps(tried, segments, percent))

    def apart() -> DataFrame:
        """Prefixes of the shingles that more than one component has."""
        p = prefix.join(stars, "node", "left").withColumn("c", F.coalesce("label", "node")).drop("label")
        open_ = p.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi")
        return written(p.join(open_.select("token"), "token"), "apart")

    def joined(pairs: DataFrame) -> DataFrame:
        """The components with the links of more pairs."""
        found = written(_overlaps(pairs, segments, percent), "links")
        return stars if found.isEmpty() else components(found.union(stars.where("node != label")))

    # Again, where a prefix shingle leaves components apart: with the one with most
    # room in each of two halves of its components, dealt anew each round.
    for salt in (1, 2):
        rest = apart()
        half = F.pmod(F.xxhash64("c", "token", F.lit(salt)), F.lit(2)).alias("half")
        pivot = rest.groupBy("token", half).agg(F.max(F.struct(room, "node", "n", "left", "c")).alias("p")).select("token", "p.*")
        more = _pairs(rest.alias("l").join(pivot.alias("r"), "token").where("l.c != r.c"), percent)
        more = written(more.join(tried, PAIR, "left_anti"), "pairs")
        stars = joined(more)
        tried = tried.union(more)

    # All pairs that are still apart.
    stars = joined(written(_blocks(apart(), percent, chunk).join(tried, PAIR, "left_anti"), "pairs"))

    label = classes.join(stars, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = written(label.groupBy("label").agg(F.min("rep").alias("component")), "least")
    found = label.join(least, "label").select("s", "s2", "n", "component")
    out = named.join(found, ["s", "s2", "n"], "left")
    return out.select(F.nullif("k", F.lit(LEAST_ID)).alias(id_col), F.col("n").alias("n_shingles"), F.nullif(F.coalesce("component", "k"), F.lit(LEAST_ID)).alias("component_id"))


def _d(x: float) -> str:
    return f"double('{x!r}')" if abs(x) != float("inf") else f"double('{'-' if x < 0 else ''}Infinity')"
