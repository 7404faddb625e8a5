"""From page text to chunks: lines, sections, units, packing and identities."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

VERSION = "section-v1"
MOST, LEAST, OVERLAP = 1200, 80, 120
#: Headings of the sections, headings of two sections at once, titles of a whole
#: document, and what begins a new unit of text.
HEADINGS = {
    "professional_summary": ("professional profile", "professional summary", "career profile", "personal profile", "profile", "summary"),
    "experience": ("professional experience", "work experience", "employment history", "career history", "experience"),
    "skills": ("technical skills", "core skills", "key skills", "competencies", "skills"),
    "languages": ("language skills", "spoken languages", "languages"),
    "education": ("academic background", "academic history", "education and training", "education"),
    "certifications": ("professional certifications", "certificates and certifications", "certifications", "certificates"),
    "projects": ("selected projects", "personal projects", "portfolio projects", "projects", "portfolio"),
}
SKILLS_AND_LANGUAGES = ("skills languages", "languages skills", "technical skills languages")
DOCUMENT_TITLES = ("cv", "curriculumvitae", "resume", "résumé")
UNIT_BEGINS = r"^(?:[•▪◦‣*-]\s+|(?i:technologies|technology|team leadership|tools|stack)\s*:)"


def page_text(s: Column) -> Column:
    """Clean page text: line ends, blanks, page footers, lone bullets and runs of empty lines."""
    s = F.regexp_replace(F.regexp_replace(s, "\r\n?", "\n"), " ", " ")
    lines = F.transform(F.split(s, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    lines = F.filter(lines, lambda x: ~x.rlike(r"(?i)^page \d+ of \d+$") & ~x.rlike("^[•▪◦●]$"))
    return F.trim(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), F.lit(" \n"))


def solid_length(s: Column) -> Column:
    """Characters that aren't white space."""
    return F.length(F.regexp_replace(s, r"\s", ""))


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per line, numbered from 0."""
    return docs.select(*[c for c in docs.columns if c != text], F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def sections(rows: DataFrame, doc: str, order: list[str], heading: Column) -> DataFrame:
    """Each line's section: the last heading before it, across pages; `identity`
    before the first, `document` where a document has none."""
    whole = W.partitionBy(doc)
    upto = whole.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    marked = rows.withColumn("__h", heading)
    any_ = F.max(F.col("__h").isNotNull()).over(whole)
    return marked.withColumn("section", F.when(~any_, F.lit("document")).otherwise(F.coalesce(F.last("__h", ignorenulls=True).over(upto), F.lit("identity")))).drop("__h")


def runs(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Number of the run of equal neighbouring values that each row is in, from 1."""
    w = W.partitionBy(key).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return rows.withColumn("__n", new).withColumn("run", F.sum("__n").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__n")


def units(line_array: Column) -> Column:
    """Text units of a section's lines: an empty line, a bullet or a label starts a new one; others join by a space."""
    start = r"^(?:[•▪◦●*-]\s|[^:]{1,40}:\s)"
    marked = F.transform(line_array, lambda x: F.when(F.trim(x) == "", F.lit("\x1e")).when(x.rlike(start), F.concat(F.lit("\x1e"), F.trim(x))).otherwise(F.trim(x)))
    joined = F.regexp_replace(F.array_join(marked, " "), " ?\x1e ?", "\x1e")
    return F.filter(F.split(joined, "\x1e"), lambda u: u != "")


def pack(unit_array: Column, most: int = MOST, overlap: int = 0) -> Column:
    """Units joined by newlines into chunks of at most `most` characters, in order.

    With overlap a chunk begins with the last words of the one before, as many
    as fit in `overlap` characters and in the room the unit leaves.
    """
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), F.lit(None).cast("string").alias("cur"))

    def tail(cur: Column, unit: Column) -> Column:
        room = F.least(F.lit(overlap), F.lit(most) - F.length(unit) - 1)
        cut = F.right(cur, F.greatest(room, F.lit(0)))
        whole = F.length(cur) <= room
        words = F.when(whole | F.substring(F.left(F.right(cur, room + 1), F.lit(1)), 1, 1).rlike(r"\s"), cut).otherwise(F.regexp_replace(cut, r"^\S*\s*", ""))
        return F.trim(F.when(room > 0, words).otherwise(F.lit("")))

    def add(acc: Column, unit: Column) -> Column:
        grown = F.concat_ws("\n", acc["cur"], unit)
        fits = acc["cur"].isNull() | (F.length(grown) <= most)
        fresh = unit
        if overlap:
            t = tail(acc["cur"], unit)
            fresh = F.when(t == "", unit).otherwise(F.concat_ws("\n", t, unit))
        return F.struct(F.when(fits, acc["done"]).otherwise(F.array_append(acc["done"], acc["cur"])).alias("done"), F.when(fits, grown).otherwise(fresh).alias("cur"))

    return F.aggregate(unit_array, start, add, lambda acc: F.when(acc["cur"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["cur"])))


def merge_last(chunks: Column, least: int = LEAST, most: int = MOST) -> Column:
    """A tiny last chunk joins the one before, if both fit."""
    n = F.size(chunks)
    both = F.concat(F.get(chunks, n - 2), F.lit("\n"), F.get(chunks, n - 1))
    return F.when((n >= 2) & (F.length(F.get(chunks, n - 1)) < least) & (F.length(both) <= most), F.array_append(F.slice(chunks, 1, F.greatest(n - 2, F.lit(0))), both)).otherwise(chunks)


def text_windows(s: str, most: int = MOST, overlap: int = OVERLAP) -> list[str]:
    """A text as word-safe windows, each beginning with the last words of the one before."""
    words = [w[i : i + most] for w in s.split() for i in range(0, len(w), most)]
    out, at = [], 0
    while at < len(words):
        end, size = at + 1, len(words[at])
        while end < len(words) and size + 1 + len(words[end]) <= most:
            size += 1 + len(words[end])
            end += 1
        out.append(" ".join(words[at:end]))
        if end == len(words):
            break
        back, kept = end, 0
        while back > at and kept + len(words[back - 1]) + (kept > 0) <= overlap:
            back -= 1
            kept += len(words[back]) + (kept > 0)
        at = end if back == at else back  # a window that would only be repeated isn't
    return out


def word_windows(docs: DataFrame, id_col: str, text: str, most: int, overlap: int) -> DataFrame:
    """Long texts as windows of words (Arrow batches)."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, k, w) for i, s in zip(pdf[id_col], pdf[text], strict=True) for k, w in enumerate(text_windows(s or "", most, overlap))]
            yield pd.DataFrame(rows, columns=[id_col, "window_no", "window"])

    return docs.select(id_col, text).mapInPandas(task, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, window_no long, window string")


PART = "struct<heading:string,value:string>"


def heading_parts(line: Column) -> Column:
    """A line as text and headings (array of struct heading, value; a heading is its section's name).

    A heading is a whole line, or stands in capitals behind text with a small letter
    or a digit, as where two columns were read as one line.
    """
    sections_ = {alias: name for name, aliases in HEADINGS.items() for alias in aliases} | dict.fromkeys(SKILLS_AND_LANGUAGES, "skills_and_languages")
    known = F.create_map(*(F.lit(x) for pair in sections_.items() for x in pair))
    single = sorted((a for a in sections_ if a not in SKILLS_AND_LANGUAGES), key=len, reverse=True)
    s = F.trim(line)
    whole = F.try_element_at(known, F.lower(F.regexp_replace(s, r"\s+", " ")))
    pieces = F.split(F.regexp_replace(s, rf"(?iU)(?<!\w)({'|'.join(single)})(?!\w)", "\x02$1\x03"), "\x02")

    def text(v: Column) -> Column:
        return F.when(F.trim(v) == "", F.array().cast(f"array<{PART}>")).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("heading"), F.trim(v).alias("value"))))

    def add(acc: Column, piece: Column) -> Column:
        name, rest = F.substring_index(piece, "\x03", 1), F.substring_index(piece, "\x03", -1)
        taken = (name == F.upper(name)) & acc["seen"].rlike(r"[\p{Ll}\p{Nd}]")
        found = F.array(F.struct(F.element_at(known, F.lower(name)).alias("heading"), F.lit("").alias("value")))
        return F.struct(
            F.when(taken, F.concat(acc["done"], text(acc["cur"]), found)).otherwise(acc["done"]).alias("done"),
            F.when(taken, rest).otherwise(F.concat(acc["cur"], name, rest)).alias("cur"),
            F.concat(acc["seen"], name, rest).alias("seen"),
        )

    first = F.get(pieces, 0)
    start = F.struct(F.array().cast(f"array<{PART}>").alias("done"), first.alias("cur"), first.alias("seen"))
    inside = F.aggregate(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), start, add, lambda acc: F.concat(acc["done"], text(acc["cur"])))
    plain = F.array(F.struct(F.lit(None).cast("string").alias("heading"), s.alias("value")))
    return F.when(whole.isNotNull(), F.array(F.struct(whole.alias("heading"), F.lit("").alias("value")))).when((s == "") | (F.size(pieces) == 1), plain).otherwise(inside)


def section_lines(pages: DataFrame, doc: str = "document_hash") -> DataFrame:
    """Lines of pages (doc, page_number, text) with their sections, headings told apart and titles of the document left out."""
    rows = pages.select(doc, "page_number", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = rows.where(~F.lower(F.regexp_replace("line", r"(?U)[^\wÀ-ÿ]+", "")).isin(*DOCUMENT_TITLES))
    rows = rows.select(doc, "page_number", "line_no", F.posexplode(heading_parts(F.col("line"))).alias("part_no", "part")).select(doc, "page_number", "line_no", "part_no", "part.*")
    return sections(rows, doc, ["page_number", "line_no", "part_no"], F.col("heading"))


def section_units(pages: DataFrame, doc: str = "document_hash") -> DataFrame:
    """Units of text by doc, run (of one section), section, page_number and unit_no."""
    w = W.partitionBy(doc).orderBy("page_number", "line_no", "part_no")
    before = lambda c: F.lag(c).over(w)
    new = before("page_number").isNull() | (before("page_number") != F.col("page_number")) | before("heading").isNotNull() | (before("value") == "") | F.col("value").rlike(UNIT_BEGINS)
    rows = section_lines(pages, doc).withColumn("unit_no", F.sum(F.when(new, 1).otherwise(0)).over(w)).where("heading IS NULL AND value != ''")
    rows = runs(rows, doc, ["page_number", "line_no", "part_no"], "section")
    lines_ = F.sort_array(F.collect_list(F.struct("page_number", "line_no", "part_no", "value")))
    return rows.groupBy(doc, "run", "section", "page_number", "unit_no").agg(F.array_join(F.transform(lines_, lambda x: x["value"]), " ").alias("text"))


def _carried(texts: list[str], pages: list[set[int]], room: int) -> tuple[list[str], list[set[int]]]:
    """The last words that fit in `room`, as one text with the pages of the units that it reaches back to."""
    words = "\n".join(texts).split()
    n = bisect_right(list(accumulate(len(w) + 1 for w in reversed(words))), room + 1)
    if not n:
        return [], []
    said = " ".join(words[-n:])
    starts = [0, *accumulate(map(len, texts))]
    back = bisect_right(starts, starts[-1] - len(said)) - 1
    return [said], [set().union(*pages[max(0, back) :])]


def _packed(units_: list, most: int, least: int, overlap: int) -> list[dict]:
    """Chunks of one section's units (text, page, lead): as many as fit, the next with the last words of the one before."""
    done: list[tuple[set[int], str]] = []
    texts, pages, size = [], [], -1
    for u in units_:
        text = u["text"]
        if texts and size + 1 + len(text) > most:
            done.append((set().union(*pages), "\n".join(texts)))
            texts, pages = _carried(texts, pages, 0 if u["lead"] else min(overlap, most - len(text) - 1))
            size = len(texts[0]) if texts else -1
        texts.append(text)
        pages.append({u["page_number"]})
        size += 1 + len(text)
    if texts:
        done.append((set().union(*pages), "\n".join(texts)))
    if len(done) > 1 and len(done[-1][1]) < least and len(both := f"{done[-2][1]}\n{done[-1][1]}") <= most:
        done[-2:] = [(done[-2][0] | done[-1][0], both)]
    return [{"page_numbers": sorted(p), "text": t} for p, t in done]


def chunk_documents(pages: DataFrame, most: int = MOST, least: int = LEAST, overlap: int = OVERLAP, doc: str = "document_hash", version: str = VERSION) -> DataFrame:
    """Pages (doc, page_number, text) to chunks: doc, chunk_index, section_name, page_numbers, page_label, text, chunk_id.

    A section's units are packed by a small function per section; everything before
    and behind it are joins-free windows and groups by document. A document
    without text has no chunks.
    """
    if not (200 <= most and 1 <= least <= most and 0 <= overlap < most):
        raise ValueError("chunks have 200 characters at least, a smallest size and an overlap below the largest")

    @F.pandas_udf("array<string>")
    def windows(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else text_windows(t, most, overlap))

    @F.pandas_udf("array<struct<page_numbers:array<int>,text:string>>")
    def packed(sections_: pd.Series) -> pd.Series:
        return sections_.map(lambda u: _packed(u, most, least, overlap))

    long = F.length("text") > most
    parts = F.when(long, windows(F.when(long, F.col("text")))).otherwise(F.array("text"))
    units_ = section_units(pages, doc).select(doc, "run", "section", F.col("page_number").cast("int").alias("page_number"), "unit_no", F.posexplode(parts).alias("k", "text"))
    row = F.struct("unit_no", "k", "text", "page_number", (F.col("k") > 0).alias("lead"))
    by_section = units_.groupBy(doc, "run", "section").agg(F.sort_array(F.collect_list(row)).alias("u")).withColumn("c", packed("u"))
    chunks = by_section.select(doc, "run", F.col("section").alias("section_name"), F.posexplode("c").alias("k", "c")).select(doc, "run", "k", "section_name", "c.*")
    index = (F.row_number().over(W.partitionBy(doc).orderBy("run", "k")) - 1).alias("chunk_index")
    out = chunks.select(doc, index, "section_name", "page_numbers", page_label(F.col("page_numbers")).alias("page_label"), "text")
    return out.withColumn("chunk_id", chunk_id(F.col(doc), F.col("chunk_index"), F.col("section_name"), F.array_join("page_numbers", ","), F.col("text"), version))


def page_label(pages: Column) -> Column:
    """`3`, or `3-5` from the first to the last."""
    first, last = F.array_min(pages), F.array_max(pages)
    return F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))


def section_histogram(chunks: DataFrame, least: int = LEAST) -> DataFrame:
    """(section_name, n_chunks, n_small): chunks by section, and those below the least size."""
    return chunks.groupBy("section_name").agg(F.count("*").alias("n_chunks"), F.count_if(F.length("text") < least).alias("n_small"))


def chunk_id(document_hash: Column, index: Column, section: Column, pages: Column, text: Column, version: str = VERSION) -> Column:
    """Identity from content and place, never from names or paths."""
    payload = F.concat_ws("\x1f", document_hash, F.lit(version), index.cast("string"), section, pages, F.sha2(text.cast("binary"), 256))
    return F.concat(F.lit("chunk_"), F.substring(F.sha2(payload.cast("binary"), 256), 1, 24))


def contract_problems(chunks: DataFrame, most: int = MOST) -> DataFrame:
    """Documents whose chunks break the contract: gaps in the index, long texts or repeated ids."""
    by = chunks.groupBy("document_id").agg(
        F.count("*").alias("n"),
        (F.max("chunk_index") + 1).alias("top"),
        F.countDistinct("chunk_index").alias("indexes"),
        F.countDistinct("chunk_id").alias("ids"),
        F.max(F.length("text")).alias("longest"),
    )
    return by.select("document_id", ((F.col("n") != F.col("top")) | (F.col("n") != F.col("indexes"))).alias("index_gap"), (F.col("longest") > most).alias("too_long"), (F.col("ids") != F.col("n")).alias("repeated_id")).where("index_gap OR too_long OR repeated_id")
