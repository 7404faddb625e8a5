"""The chunker against a plain one, page by page and line by line."""

import hashlib
import re

import numpy as np
import pytest

from lodestone.operators import chunking as C

CV = [
    "CV\nAda Lovelace\nData engineer in London\n\nPROFESSIONAL SUMMARY\nBuilds pipelines.\nLikes  order.\n\nSkills\n- Python\n- SQL\nTechnologies: Spark, Kafka",
    "Apache Airflow 5y EDUCATION\nMSc in computer science\nPROGRAMMING LANGUAGES\nPython\nSkills Languages\nGerman (native)\nSUMMARY of work Projects EXPERIENCE here",
]


def plain_parts(line):
    names = {a: s for s, aliases in C.HEADINGS.items() for a in aliases}
    s = line.strip()
    folded = " ".join(s.lower().split())
    if folded in C.SKILLS_AND_LANGUAGES:
        return [("h", "skills_and_languages")]
    if folded in names:
        return [("h", names[folded])]
    out, at = [], 0
    for m in re.finditer(r"(?<!\w)(?:" + "|".join(sorted(names, key=len, reverse=True)) + r")(?!\w)", s, re.I):
        before = s[: m.start()].strip()
        if m[0].isupper() and any(c.islower() or c.isdigit() for c in before):
            if s[at : m.start()].strip():
                out.append(("t", s[at : m.start()].strip()))
            out.append(("h", names[m[0].lower()]))
            at = m.end()
    if not out:
        return [("t", s)]
    return out + ([("t", s[at:].strip())] if s[at:].strip() else [])


def plain_chunks(pages, most=1200, least=80, overlap=120):
    """(section, pages, text) of one document's pages."""
    lines, section, any_ = [], "identity", False
    for n, text in pages:
        lines.append(None)
        for line in text.split("\n"):
            if re.sub(r"[^\wÀ-ÿ]+", "", line).lower() in C.DOCUMENT_TITLES:
                continue
            for kind, value in plain_parts(line):
                if kind == "h":
                    section, any_ = value, True
                    lines.append(None)
                else:
                    lines.append((section, n, value))
    units, fresh = [], True
    for x in lines:
        if x is None or not x[2]:
            fresh = True
            continue
        if fresh or re.match(C.UNIT_BEGINS, x[2]):
            units.append([x[0] if any_ else "document", x[1], x[2]])
        else:
            units[-1][2] += " " + x[2]
        fresh = False
    out, i = [], 0
    while i < len(units):
        j = i
        while j < len(units) and units[j][0] == units[i][0]:
            j += 1
        rows = [{"text": t, "page_number": p, "lead": k > 0} for _, p, u in units[i:j] for k, t in enumerate(C.text_windows(u, most, overlap) if len(u) > most else [u])]
        out += [(units[i][0], c["page_numbers"], c["text"]) for c in C._packed(rows, most, least, overlap)]
        i = j
    return out


def _documents():
    rng = np.random.default_rng(8)
    word = lambda: "w" * int(rng.integers(1, 12)) if rng.random() < 0.995 else "long" * 400
    docs = {"cv": list(enumerate(CV, 1)), "none": [(1, "just a line\n\nand one more")], "empty": [(1, ""), (2, " \n ")]}
    for d in range(25):
        pages = []
        for n in range(1, int(rng.integers(2, 5))):
            lines = []
            for _ in range(int(rng.integers(1, 40))):
                r = rng.random()
                text = " ".join(word() for _ in range(int(rng.integers(1, 40))))
                lines.append("" if r < 0.15 else str(rng.choice(["EXPERIENCE", "Skills", "education", "languages skills", "Resume"])) if r < 0.3 else f"- {text}" if r < 0.5 else f"{text} 5y PROJECTS" if r < 0.55 else f"Stack: {text}" if r < 0.6 else text * (12 if r > 0.97 else 1))
            pages.append((n, "\n".join(lines)))
        docs[f"d{d}"] = pages
    return docs


@pytest.mark.parametrize(("most", "least", "overlap"), [(1200, 80, 120), (200, 50, 0), (300, 80, 60)])
def test_chunks_equal_plain_ones(spark, most, least, overlap):
    docs = _documents()
    pages = spark.createDataFrame([(d, n, t) for d, p in docs.items() for n, t in p], "document_hash string, page_number int, text string").repartition(3)
    rows = C.chunk_documents(pages, most, least, overlap).collect()
    got = {d: [] for d in docs}
    for r in sorted(rows, key=lambda r: (r.document_hash, r.chunk_index)):
        assert r.chunk_index == len(got[r.document_hash])
        assert 0 < len(r.text) <= most
        payload = "\x1f".join((r.document_hash, C.VERSION, str(r.chunk_index), r.section_name, ",".join(map(str, r.page_numbers)), hashlib.sha256(r.text.encode()).hexdigest()))
        assert r.chunk_id == "chunk_" + hashlib.sha256(payload.encode()).hexdigest()[:24]
        assert r.page_label == (str(r.page_numbers[0]) if len(r.page_numbers) == 1 else f"{r.page_numbers[0]}-{r.page_numbers[-1]}")
        got[r.document_hash].append((r.section_name, r.page_numbers, r.text))
    for d, p in docs.items():
        assert got[d] == plain_chunks(p, most, least, overlap), d
    assert [s for s, _, _ in got["cv"]][:3] == ["identity", "professional_summary", "skills"]
    assert got["none"][0][0] == "document" and not got["empty"]


def test_windows_repeat_last_words():
    assert C.text_windows("aa bb cc dd ee", 8, 3) == ["aa bb cc", "cc dd ee"]
    assert C.text_windows("aa bb", 8, 3) == ["aa bb"]
    assert C.text_windows("x" * 10, 4, 2) == ["xxxx", "xxxx", "xx"]
    assert C.text_windows("", 8, 3) == []
