import pytest
from pyspark.sql import functions as F

from lodestone.operators import answers, chunking, evaluation, ingest, quality, ranking
from lodestone.plans.ask import ask
from lodestone.sources import files
from lodestone.sources.store import ChunkIndex


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_page_text(spark):
    raw = "Name\r\n\r\n\r\n\r\nPage 1 of 2\n•\na \t b\n"
    assert one(spark, chunking.page_text(F.lit(raw))) == "Name\n\na b"


def test_units_and_packing(spark):
    lines = F.array(*map(F.lit, ["Built things", "for people", "", "- one", "Skills: SQL"]))
    assert one(spark, chunking.units(lines)) == ["Built things for people", "- one", "Skills: SQL"]
    units = F.array(*map(F.lit, ["aaaa", "bbbb", "cc", "dddd dddd"]))
    assert one(spark, chunking.pack(units, 9)) == ["aaaa\nbbbb", "cc", "dddd dddd"]
    assert one(spark, chunking.merge_last(F.array(F.lit("aaaa"), F.lit("b")), 3, 9)) == ["aaaa\nb"]
    assert one(spark, chunking.pack(F.array(F.lit("one two three"), F.lit("four")), 13, 5)) == ["one two three", "three\nfour"]
    assert one(spark, chunking.pack(F.array().cast("array<string>"), 9)) == []


def test_word_windows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = chunking.word_windows(spark.createDataFrame([(1, text), (2, None), (3, "x" * 50)], "id long, text string"), "id", "text", 40, 10).orderBy("id", "window_no").collect()
    mine = [r.window for r in rows if r.id == 1]
    assert all(len(w) <= 40 for w in mine)
    assert list(dict.fromkeys(" ".join(mine).split())) == text.split()
    assert [len(r.window) for r in rows if r.id == 3] == [40, 10]
    assert not [r for r in rows if r.id == 2]


def test_sections(spark):
    rows = spark.createDataFrame([(1, 0, "Ada"), (1, 1, "SKILLS"), (1, 2, "SQL"), (2, 0, "text")], "doc long, n long, line string")
    h = F.when(F.col("line") == "SKILLS", "skills")
    got = {(r.doc, r.n): r.section for r in chunking.sections(rows, "doc", ["n"], h).collect()}
    assert got == {(1, 0): "identity", (1, 1): "skills", (1, 2): "skills", (2, 0): "document"}


def test_months_and_texts(spark):
    rows = spark.createDataFrame([(1, 10, 12), (1, 13, 14), (1, 12, 12), (1, 20, 20), (2, 5, 5)], "k long, s long, e long")
    assert {r.k: (r.months, r.years) for r in quality.merged_months(rows, "k", "s", "e").collect()} == {1: (6, 0.5), 2: (1, 0.1)}
    assert one(spark, quality.month_text(quality.month_index(F.lit("2026-07")))) == "2026-07"


def test_classify(spark):
    new = spark.createDataFrame([("h1", "a"), ("h1", "b"), ("h2", "c"), ("h3", "d"), ("h4", "e")], "document_hash string, name string")
    index = spark.createDataFrame([("h2", "c", True), ("h3", "x", True), ("h4", "e", False)], "document_hash string, stored_name string, complete boolean")
    assert {r.name: r.status for r in ingest.classify(new, index, ["name"]).collect()} == {"a": "pending", "b": "duplicate_input", "c": "skipped", "d": "metadata_refreshed", "e": "pending"}
    assert one(spark, ingest.candidate_id(F.lit("CV_Candidate_007.pdf"), F.lit(""), F.lit("ab"))) == "candidate_007"
    assert one(spark, ingest.candidate_id(F.lit("x.pdf"), F.lit("none"), F.lit("abc"))) == "candidate_abc"


def test_support_prefers_complete(spark):
    cols = "candidate_id string, n_matched long, score double, coverage double"
    rows = spark.createDataFrame([("a", 2, 0.8, 1.0), ("b", 1, 0.5, 0.7), ("c", 0, 0.2, 0.0)], cols)
    assert [(r.candidate_id, r.outcome) for r in ranking.support(rows, 2).collect()] == [("a", "supported")]
    assert [(r.candidate_id, r.outcome) for r in ranking.support(rows.where("candidate_id <> 'a'"), 2).collect()] == [("b", "partial")]
    assert ranking.support(rows.withColumn("n_matched", F.lit(0)), 0).count() == 0  # without conditions nothing is supported


def test_evidence_cover(spark):
    c = "array<struct<key:string,weight:double,kind:string>>"
    rows = spark.createDataFrame([("a", "x", 0.9, 0.5, 1, []), ("a", "y", 0.2, 0.5, 2, [("k1", 2.0, "term")]), ("a", "z", 0.3, 0.5, 3, [("k2", 1.0, "term")])], f"candidate_id string, chunk_id string, combined double, semantic double, rank int, conditions {c}")
    got = ranking.select_evidence(rows, 3).orderBy("evidence_order").collect()
    assert [r.chunk_id for r in got] == ["y", "z", "x"]
    assert [r.chunk_id for r in ranking.select_evidence(rows, 1).collect()] == ["y"]


def test_budget_cuts_the_last(spark):
    rows = spark.createDataFrame([(1, "a" * 60), (2, "b" * 60), (3, "c" * 60)], "n int, text string")
    assert [r.used_chars for r in ranking.within_budget(rows, [F.col("n")], 12, 170, 900).orderBy("n").collect()] == [60, 60, 50]
    assert [r.used_chars for r in ranking.within_budget(rows, [F.col("n")], 12, 150, 900).orderBy("n").collect()] == [60, 60]


def test_policies(spark):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    for policy, want, got, ok in [("exact", ["a"], ["a"], True), ("exact", ["a"], ["a", "b"], False), ("contains_all", ["a"], ["a", "b"], True), ("subset", ["a", "b"], ["a"], True), ("any_of", ["a"], ["b"], False), ("none", [], [], True)]:
        assert one(spark, evaluation.meets(F.lit(policy), a(*want), a(*got), F.lit(0))) is ok


def test_default_citations(spark):
    rows = spark.createDataFrame([("a", 1, "a-source-1", False), ("a", 2, "a-source-2", True), ("b", 1, "b-source-1", False)], "candidate_id string, place int, source_id string, direct boolean")
    assert {r.candidate_id: r.cited for r in answers.default_citations(rows).collect()} == {"a": "a-source-2", "b": "b-source-1"}


def _chunks(spark, rows):
    cols = "chunk_id string, text string, document_id string, document_hash string, candidate_id string, candidate_name string, professional_title string, source_filename string, source_path string, section_name string, page_numbers string, chunk_index int, embedding array<float>"
    return spark.createDataFrame([(c, t, "d" + h, h, k, "Ada L", "Data engineer", h + ".pdf", "/" + h, s, "1", i, v) for c, t, h, k, s, i, v in rows], cols)


STAMP = {"index_version": "1", "embedding_model": "m", "dimension": 2, "chunking_version": "v", "metric": "cosine"}


def test_index(spark, tmp_path):
    index = ChunkIndex(spark, f"file://{tmp_path}/i", STAMP)
    assert index.chunks().count() == 0
    index.upsert(_chunks(spark, [("c1", "x", "h1", "k1", "skills", 0, [1.0, 0.0]), ("c2", "y", "h1", "k1", "skills", 1, [0.0, 1.0]), ("c3", "z", "h2", "k2", "skills", 0, [0.6, 0.8])]))
    index.upsert(_chunks(spark, [("c3", "new", "h2", "k2", "skills", 0, [0.6, 0.8])]))
    assert index.chunks().count() == 3
    assert index.healthy()
    assert [r.chunk_id for r in index.nearest([1.0, 0.0], 2).orderBy("rank").collect()] == ["c1", "c3"]
    index.refresh(spark.createDataFrame([("h1", "n.pdf", "/n")], "document_hash string, source_filename string, source_path string"))
    assert {r.source_filename for r in index.chunks().collect()} == {"n.pdf", "h2.pdf"}
    index.delete_replaced(spark.createDataFrame([("h9", "/other", "k2")], "document_hash string, source_path string, candidate_id string"))
    assert index.delete("h1") == 2
    assert index.chunks().count() == 0
    with pytest.raises(ValueError, match="stamped"):
        ChunkIndex(spark, f"file://{tmp_path}/i", STAMP | {"dimension": 3})
    with pytest.raises(ValueError, match="norm"):
        index.upsert(_chunks(spark, [("c1", "x", "h1", "k1", "skills", 0, [3.0, 0.0])]))
    with pytest.raises(ValueError, match="twice"):
        index.upsert(_chunks(spark, [("c1", "x", "h1", "k1", "skills", 0, [1.0, 0.0])] * 2))


def test_files(spark, tmp_path):
    for name, text in (("b.PDF", "two"), ("a.pdf", "one"), ("c.txt", "no")):
        (tmp_path / name).write_text(text)
    assert [r.name for r in files.documents(spark, directory=str(tmp_path)).collect()] == ["a.pdf", "b.PDF"]
    with pytest.raises(ValueError, match="both or neither"):
        files.documents(spark)


def test_ask(spark):
    chunks = _chunks(spark, [("c1", "Managed a team of 9 engineers using Python", "h1", "k1", "experience", 0, [1.0, 0.0]), ("c2", "German (native)", "h1", "k1", "languages", 1, [0.0, 1.0]), ("c3", "Managed 3 projects", "h2", "k2", "experience", 0, [0.6, 0.8]), ("c4", "Cooks", "h3", "k3", "skills", 0, [0.0, -1.0])])
    got = ask(chunks, "Who managed at least 8 engineers and is native in German?", [1.0, 0.0], k=4).collect()
    assert [(r.candidate_id, r.outcome, r.final_rank) for r in got] == [("k1", "supported", 1)]
    assert ask(chunks, "who is the", [1.0, 0.0]).count() == 0


def test_drafts_and_presentation(spark):
    ranked = spark.createDataFrame([("a", 1), ("b", 2)], "candidate_id string, final_rank int")
    draft = spark.createDataFrame([("a", 2, "x"), ("c", 1, "")], "candidate_id string, place int, text string")
    assert {tuple(r) for r in answers.draft_problems(draft, ranked).collect()} == {("a", "out_of_order"), ("b", "missing_candidate"), ("c", "unknown_candidate"), ("c", "empty")}
    cited = spark.createDataFrame([("a", "a-source-1")], "candidate_id string, source_id string")
    sources = spark.createDataFrame([("a-source-1", 1, "3-4")], "source_id string, place int, page_label string")
    assert {r.candidate_id: r.first_page for r in answers.presented(ranked, cited, sources).collect()} == {"a": "3", "b": None}
