from quillmill.operators import documents as D
from quillmill.sources import files as S

MD = "---\ntitle: T\ntags: [a, b]\n---\nintro\n\n# One\ntext\n```\n# no heading\n```\n## Two\n\nbody  \n\n### Three\n## Four\n"


def brute(text):
    """Sections of a Markdown text with a stack."""
    lines, heads, fence = text.splitlines(), [], False
    import re

    for i, x in enumerate(lines):
        if re.match(r"\s*(?:```|~~~)", x):
            fence = not fence
        elif not fence and (m := re.match(r"(#{1,6})\s+(.+?)\s*#*\s*$", x)):
            heads.append((i, len(m.group(1)), m.group(2).strip()))
    out, stack, count = [], [], {(): 0}
    if heads and any(x.strip() for x in lines[: heads[0][0]]):
        count[()] = 1
        out.append(("1", "", 1, heads[0][0]))
    for k, (i, lv, title) in enumerate(heads):
        while stack and stack[-1][0] >= lv:
            stack.pop()
        parent = stack[-1][1] if stack else ()
        count[parent] = count.get(parent, 0) + 1
        path = (*parent, count[parent])
        stack.append((lv, path))
        out.append((".".join(map(str, path)), title, i + 1, heads[k + 1][0] if k + 1 < len(heads) else len(lines)))
    return out


def test_sections_match_stack(spark):
    import random

    r = random.Random(1)
    texts = ["".join(r.choice(["# a\n", "## b\n", "### c #\n", "#### d\n", "x\n", "\n", "```\n", "#no\n"]) for _ in range(r.randint(0, 14))) for _ in range(60)]
    docs = spark.createDataFrame([(i, "markdown", "t", t) for i, t in enumerate(texts)], "id long, fmt string, title string, text string")
    got = {}
    for s in D.build_sections(docs, "id", "fmt", "title", "text").collect():
        if s.kind != "document":
            got.setdefault(s.id, []).append((s.path, s.title, s.line_start, s.line_end))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == sorted(brute(t)), t


def test_sections_by_format(spark):
    docs = spark.createDataFrame([(1, "txt", "a", "x\ny"), (2, "pdf", "b", None), (3, "pdf", "c", "z"), (4, None, "d", "")], "id long, fmt string, title string, text string")
    pages = spark.createDataFrame([(2, 3, "p3"), (2, 1, "p1")], "id long, page_number int, text string")
    s = D.with_section_ids(D.build_sections(docs, "id", "fmt", "title", "text", pages), "id")
    assert {(r.section_id, r.kind, r.title, r.line_end) for r in s.collect()} == {("1#1", "document", "a", 2), ("2#1", "page", "Page 1", None), ("2#2", "page", "Page 3", None), ("3#1", "document", "c", 1), ("4#1", "document", "d", 1)}


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text(MD, encoding="utf-8")
    (tmp_path / "b.txt").write_bytes("\n 标题行 \n知识库的文档模型和解析器都在这里，每个章节都有编号。".encode("gb18030"))
    (tmp_path / "c.bin").write_bytes(b"\x00")
    (tmp_path / "d.lw").write_text("graph TD\nA --> B")
    (tmp_path / "e.pdf").write_bytes(b"%PDF-1.4 nothing")
    rows = {r.path.rsplit("/", 1)[1]: r for r in S.load_documents(spark, str(tmp_path)).collect()}
    assert rows["a.md"].title == "T" and rows["a.md"].text.startswith("intro") and '"tags"' in rows["a.md"].front_matter
    assert rows["b.txt"].title == "标题行" and rows["b.txt"].line_count == 3
    assert "unsupported file type '.bin'" in rows["c.bin"].error and rows["e.pdf"].error
    assert rows["d.lw"].title == "d" and rows["d.lw"].doc_format == "lw"
    docs = spark.createDataFrame([("k", rows["a.md"].text, "T", "s", "markdown")], "id string, text string, title string, source string, fmt string")
    sec = D.with_section_ids(D.markdown_sections(docs, "id", "title", "text"), "id")
    assert [(r.section_id, r.title, r.content) for r in sec.orderBy("sort_path").collect()] == [("k#1", "", "intro"), ("k#2", "One", "text\n```\n# no heading\n```"), ("k#2.1", "Two", "body  "), ("k#2.1.1", "Three", ""), ("k#2.2", "Four", "")]
    p = D.user_prompts(docs, sec, "id", "title", "source", "fmt").first().prompt
    assert p.startswith("Document\nid: k\ntitle: T") and "[section k#2.1]\nTwo\nbody" in p


def test_missing_source(spark):
    import pytest

    with pytest.raises(S.SourceNotFoundError):
        S.load_documents(spark, "/no/such/place")
    with pytest.raises(S.UnsupportedFormatError):
        S.create_default_registry().get_parser(".doc")


def test_front_matter_edges(spark):
    from pyspark.sql import functions as F

    rows = ["---\na: 1\n---\n\n\nx", "---\nopen", "text", "---\n---\ny", "--- \na\n...\nz"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = {r.i: (r.s.front, r.s.body) for r in df.select("i", D.split_front_matter(F.col("t")).alias("s")).collect()}
    assert got[0] == ("a: 1\n", "x") and got[1] == (None, "---\nopen") and got[2] == (None, "text") and got[3][1] == "y" and got[4] == ("a\n", "z")
