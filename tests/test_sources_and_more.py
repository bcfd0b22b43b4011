import json

import pytest

from quillmill.operators import extraction as X
from quillmill.operators import search as S
from quillmill.sources import diagram as M
from quillmill.sources import store as ST
from quillmill.streaming import ingest as I


def test_diagram():
    rows = M.parse_diagram('graph td\n%% note\nA["One"] -->|uses| B[Two]; B -- makes --> C <--> A\nA[Other]')
    edges = [(r.a, r.b, r.label, r.both) for r in rows if r.kind == "edge"]
    assert edges == [("A", "B", "uses", False), ("B", "C", "makes", False), ("C", "A", "", True), ("A", "C", "", True)]
    assert {(r.a, r.label) for r in rows if r.kind == "node"} == {("A", "One"), ("B", "Two"), ("C", "")}
    assert [(r.a, r.b, r.label) for r in rows if r.kind == "conflict"] == [("A", "One", "Other")]


@pytest.mark.parametrize(
    ("text", "part", "line"),
    [("", "missing graph declaration", 1), ("pie", "diagram type 'pie'", 1), ("graph", "needs a direction", 1), ("graph XX", "unsupported direction", 1), ("graph TD\nA ==> B", "'==>'", 2), ("graph TD\nA[x", "missing ']'", 2),
     ("graph TD\nA -->|x B", "missing '|'", 2), ("graph TD\nA(x)", "shape", 2), ("graph TD\nsubgraph x", "subgraph", 2), ("graph TD\nA -->", "expected a node id", 2), ("graph TD\nA B", "expected a link operator", 2), ("%%{init}%%", "directives", 1)],
)
def test_diagram_errors(text, part, line):
    (r,) = M.parse_diagram(text)
    assert r.kind == "error" and part in r.label and r.line == line


def test_diagram_tables(spark):
    df = spark.createDataFrame([(1, "graph LR\nA[x]-->B\nA-->B"), (2, None)], "file long, t string")
    rows = M.parse_diagrams(df, "file", "t")
    assert [(r.source, r.target, r.n) for r in M.diagram_edges(rows, "file").collect()] == [("A", "B", 2)]
    assert {(r.id, r.title) for r in M.diagram_nodes(rows, "file").filter("line = 2").collect()} and M.diagram_errors(rows, "file").count() == 1


def test_extraction(spark):
    good = {"entities": [{"name": " A ", "aliases": ["x", "x", " "], "sources": [{"section_id": "s1", "page_number": 9, "quote": "q"}, {"section_id": "no", "page_number": "7"}]}, {"name": "a"}], "concepts": [], "facts": [{"statement": "s"}], "relations": [{"source": "A", "target": "Z", "type": "t"}]}
    rows = [("ok", "```json\n" + json.dumps(good) + "\n```"), ("text", "Sure: " + json.dumps({k: [] for k in X.LISTS}) + " done"), ("bad", "nothing"), ("list", "[1]"), ("missing", "{}"), ("wrong", json.dumps(dict.fromkeys(X.LISTS, 1))), ("noname", json.dumps({**{k: [] for k in X.LISTS}, "entities": [{"name": " "}]})), ("empty", None)]
    c = X.check_contract(X.read_answers(spark.createDataFrame(rows, "id string, raw string"), "id"), "id")
    err = {r.id: r.error for r in c.collect()}
    assert err["ok"] is None and err["text"] is None and "valid JSON" in err["bad"] and "object" in err["list"] and "missing" in err["missing"] and "list" in err["wrong"] and err["empty"]
    it = X.payload_items(c, "id")
    bad = X.item_errors(it, "id")
    assert [r.id for r in bad.collect()] == ["noname"]
    ok = X.with_ids(X.accepted(it, bad, "id"))
    assert {r.aliases[0] for r in ok.filter("name = 'A'").collect()} == {"x"} and ok.filter("kind = 'entity'").select("id").distinct().count() <= 2
    sec = spark.createDataFrame([("ok", "s1", 4), ("ok", "s2", 5)], "id string, section_id string, page_number int")
    r = {x.pos: x for x in X.repair_sources(it.filter("id = 'ok'"), "id", sec).collect()}
    assert (r[0].section_id, r[0].page_number) == ("s1", 4) and r[1].section_id is None and r[1].page_number is None and "unknown" in r[1].note
    v = X.verdict_rows(spark.createDataFrame([(1, '{"same": true, "reason": "r"}'), (2, '{"same": "FALSE"}'), (3, '{"same": 1}'), (4, "x")], "id long, raw string"), "id")
    assert {x.id: x.same for x in v.collect()} == {1: True, 2: False, 3: None, 4: None}


def test_ask_model(spark):
    class Echo:
        def complete(self, *, system_prompt, user_prompt):
            if user_prompt == "boom":
                raise RuntimeError("no")
            return system_prompt + user_prompt

    df = spark.createDataFrame([(1, "a"), (2, "boom")], "id long, prompt string")
    assert {(r.id, r.raw, r.error) for r in X.ask_model(df, "id", "s:", Echo).collect()} == {(1, "s:a", None), (2, None, "RuntimeError: no")}


def test_snippets_and_terms():
    assert S.search_terms("  Ａ b ") == ["a", "b"]
    with pytest.raises(ValueError):
        S.search_terms("   ")
    text = "x" * 200 + " Straße  here " + "y" * 200
    s = S.make_snippet(text, ["strasse"], 5)
    assert s == "…xxxx Straße her…"
    assert S.make_snippet("", ["a"]) == "" and S.make_snippet("abc", ["zz"], 1) == "ab…"


def test_front_matter_page(spark):
    p = spark.createDataFrame([("d/a.md", '---\nid: "1"\nkind: "entity"\naliases:\n  - "X \\"y\\""\n---\n# Title\nbody **b** `c` [l](z.md)'), ("index.md", "---\nopen"), ("q.md", "no heading")], "path string, text string")
    r = {x.path: x for x in S.search_pages(p).collect()}
    assert (r["d/a.md"].title, r["d/a.md"].kind, r["d/a.md"].object_id, r["d/a.md"].aliases) == ("Title", "entity", "1", ['X "y"'])
    assert r["d/a.md"].display_text == "Title\nbody b c l" and r["index.md"].kind == "index" and r["index.md"].warning and r["q.md"].title == "q"


def test_store(spark, tmp_path):
    st = ST.TableStore(spark, str(tmp_path))
    df = spark.range(3)
    st.save_graph(df, df, "k")
    assert st.load_graph("k")[0].count() == 3
    with pytest.raises(ST.StoreError):
        st.load_graph("none")
    with pytest.raises(ValueError):
        st.path("kb", "../x")
    f = tmp_path / "kb.json"
    f.write_text(json.dumps({"entities": [{"name": "A", "sources": []}], "facts": []}))
    assert ST.read_knowledge_json(spark, str(f))["entities"].first().name == "A"
    f.write_text("{}")
    for call in (ST.read_knowledge_json, ST.read_graph_json):
        with pytest.raises(ST.StoreError):
            call(spark, str(f))
    n = ST.write_pages(spark.createDataFrame([("x/a.md", "t\n"), ("b.md", "u")], "path string, text string"), str(tmp_path / "w"))
    assert n == 2 and (tmp_path / "w/x/a.md").read_text() == "t\n"


def test_layout(tmp_path):
    ls = ST.LayoutStore(str(tmp_path), "g", {"a"})
    assert ls.save({"positions": {"a": {"x": 1, "y": 2.346}, "b": {"x": 1, "y": 1}}, "view": {"zoom": 1e6}, "search": "q"})["view"]["zoom"] == ST.MAX_ZOOM
    assert ls.load()["positions"] == {"a": {"x": 1.0, "y": 2.35}}
    (tmp_path / "g.json").write_text("broken")
    assert ls.load()["positions"] == {} and (tmp_path / "g.json.broken").exists()


def test_streaming(spark, tmp_path):
    import datetime as dt

    src = tmp_path / "in"
    df = spark.createDataFrame([(1, "a\nb", "x", dt.datetime(2024, 1, 1)), (2, None, "x", dt.datetime(2024, 1, 2))], "doc_id long, text string, kind string, loaded_at timestamp_ntz")
    df.write.parquet(str(src))
    q = I.ingest_documents(I.stream_table(spark, str(src), df), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert {(r.doc_id, r.line_count) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, 2), (2, 0)}
    q = I.run_to_table(I.arrivals_per_window(I.stream_table(spark, str(src), df)), "arrivals", str(tmp_path / "cp2"))
    q.awaitTermination(60)
    assert sum(r.n for r in spark.sql("select * from arrivals").collect()) == 2


def test_entry_without_llm(spark):
    import __spark_entry__ as e

    q = e.queries()
    assert "p3_found" in q and set(e.oracle_sql()) <= set(q)


def test_pages_in_parts_and_json(spark, tmp_path):
    rows = [("a.md", 0, None, "one\n"), ("b.md", 1, "Facts", "\n## Facts\n\n- x"), ("b.md", 0, "", "# b"), ("b.md", 2, "Facts", "- y")]
    pages = spark.createDataFrame(rows, "path string, part int, section string, text string")
    assert ST.write_pages(pages, str(tmp_path / "w")) == 2
    assert (tmp_path / "w/b.md").read_text() == "# b\n\n## Facts\n\n- x\n- y\n" and (tmp_path / "w/a.md").read_text() == "one\n"
    with pytest.raises(Exception, match="FileExistsError"):
        ST.write_pages(pages, str(tmp_path / "w"), overwrite=False)
    assert ST.write_pages(pages.limit(0), str(tmp_path / "w")) == 0
    nested = spark.createDataFrame([(1, ["x", None], [("d", None)], None), (2, None, [], "é\n")], "id long, aliases array<string>, sources array<struct<document_id:string,section_id:string>>, text string")
    ST.write_json(nested, str(tmp_path / "j"))
    back = ST.read_json(spark, str(tmp_path / "j"), nested)
    assert sorted(back.collect()) == sorted(nested.collect())


def test_policies_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([(1, True, None), (2, None, "bad")], "id long, same boolean, error string")
    assert [r.id for r in X.enforce(rows).collect()] == [1]
    with pytest.raises(Exception, match="bad"):
        X.enforce(rows, "raise").collect()
    assert X.enforce(rows.filter("id = 1"), "raise").count() == 1
    with pytest.raises(ValueError, match="policy"):
        X.enforce(rows, "ignore")
    from quillmill.functions.encoding import decode
    from quillmill.sources import files as FS

    assert decode("é".encode("latin-1"), "utf-8").had_errors and decode("é".encode(), "utf-8") == ("é", "utf-8", False)
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "b.bin").write_bytes(b"x")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4 broken")
    files = FS.read_files(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r.status for r in FS.scan_report(FS.create_default_registry().parse_all(files)).collect()}
    assert got == {"a.txt": "read", "b.bin": "skipped", "c.pdf": "failed"}
    (i,) = FS.pdf_info(files.filter("path LIKE '%.pdf'")).collect()
    assert i.page_count is None and i.error
    from quillmill.operators import linker as N

    pages = spark.createDataFrame([("a.md", "[x](b.md) [y](c.md)"), ("b.md", "")], "path string, text string")
    assert [tuple(r) for r in N.broken_links(pages, pages).collect()] == [("a.md", "c.md")]
