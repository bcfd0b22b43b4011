import datetime as dt

from quillmill.operators import candidates as C
from quillmill.operators import search as S
from quillmill.operators import closure, graph as G, knowledge as K, linker as N, lint as L, wiki as W

REF = "array<struct<document_id:string,section_id:string,page_number:int,quote:string>>"
T = dt.datetime(2024, 1, 1)


def items(spark, rows):
    s = f"item_id long, kind string, name string, item_type string, description string, aliases array<string>, sources {REF}, loaded_at timestamp_ntz"
    return K.items_view(spark.createDataFrame([(*r, T) for r in rows], s))


def verdicts(spark, rows):
    return spark.createDataFrame(rows, "left_id long, right_id long, same boolean")


def src(d):
    return [(d, None, None, None)]


BASE = [
    (1, "entity", "Parser", "system", "Reads.", ["The Reader"], src("d1")),
    (2, "entity", " parser ", "other", "Reads.", [], src("d2")),
    (3, "entity", "Reader X", "system", "Other", None, src("d1")),
    (4, "concept", "Parser", None, None, None, None),
    (5, "entity", "Alone", None, "", [], []),
]


def test_merge(spark):
    v = items(spark, BASE)
    g = K.merge_groups(v, verdicts(spark, [(3, 2, True), (1, 4, True), (None, 1, True), (5, 1, False), (5, 5, True)]))
    assert dict(map(tuple, g.collect())) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    m = {r.group_id: r for r in K.merged_items(v, g).collect()}
    assert (m[1].canonical_name, m[1].type, m[1].n_items) == ("Parser", "system", 3) and m[4].type is None and m[5].type == "other"
    names = K.canonical_names(v, g)
    assert [(r.alias) for r in K.merged_aliases(v, g, names).filter("group_id = 1").orderBy("ord").collect()] == ["The Reader", "Reader X"]
    assert [r.description for r in K.merged_descriptions(v, g).filter("group_id = 1").orderBy("ord").collect()] == ["Reads.", "Other"]
    assert {(r.document_id, r.first_item) for r in K.merged_sources(v, g).filter("group_id = 1").collect()} == {("d1", 1), ("d2", 2)}
    nm = dict(map(tuple, K.name_map(v, g, K.merged_items(v, g)).collect()))
    assert nm["reader x"] == "Parser" and nm["the reader"] == "Parser"
    assert {(r.group_id, r.method) for r in K.merge_report(v, g, K.merged_items(v, g)).collect()} == {(1, "judge")}


def test_closure_matches_union_find(spark):
    import random

    r = random.Random(2)
    links = [(r.randint(1, 60), r.randint(1, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(7, None), (8, 8)]
    p = {}

    def find(x):
        while p.setdefault(x, x) != x:
            x = p[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            p[max(x, y)] = min(x, y)
    got = dict(map(tuple, closure.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {x: find(x) for x in p}


def test_candidates(spark):
    rows = [
        (1, "entity", "Document Model", None, None, ["DM"], None), (2, "entity", "Document Model v2", None, None, None, None), (3, "entity", "Model Document", None, None, ["dm"], None),
        (4, "entity", "parseer", None, None, None, None), (5, "entity", "parser", None, None, None, None), (6, "entity", "docu ment model", None, None, None, None), (7, "entity", "", None, None, None, None),
    ]
    got = {(r.l, r.r): r.reason for r in C.candidate_pairs(items(spark, rows)).collect()}
    assert got[("document model", "model document")] == "shared name or alias"
    assert got[("docu ment model", "document model")] == "same name without whitespace"
    assert got[("document model", "document model v2")] == "one name contains the other"
    assert got[("parseer", "parser")] == "similar spelling"


def test_all_pairs_of_a_shared_key(spark, monkeypatch):
    v = items(spark, [(i, "entity", n, None, None, ["Same"], None) for i, n in enumerate("abcdefghijk", 1)] + [(20, "entity", "x y z", None, None, None, None), (21, "entity", "xy z", None, None, None, None), (22, "entity", "x yz", None, None, None, None), (23, "concept", "a", None, None, ["Same"], None)])
    alias = sorted(("entity", x, y) for x in "abcdefghijk" for y in "abcdefghijk" if x < y)
    for block in (500, 3):
        monkeypatch.setattr(C, "BLOCK", block)
        assert sorted((r.kind, r.l, r.r) for r in C.shared_alias(v).collect()) == alias
        assert sorted((r.l, r.r) for r in C.same_compact(C.distinct_names(v)).collect()) == [("x y z", "x yz"), ("x y z", "xy z"), ("x yz", "xy z")]
    got = {(r.l, r.r): r.rule for r in C.candidate_pairs(v).filter("reason = 'shared name or alias'").collect()}
    assert len(got) == len(alias) and set(got.values()) == {1}


def kb(spark):
    v = items(spark, [*BASE, (6, "entity", "Parser Two", None, "Long text.", ["parser"], src("d9"))])
    f = spark.createDataFrame([(1, "Parser helps Alone.", "Parser", "helps", "Alone", src("d1"), ""), (2, "x", "", "", "", None, ""), (3, "y", "Parser", "is", "Nobody", src("d3"), "")], f"fact_id long, statement string, subject string, predicate string, object string, sources {REF}, key string")
    r = spark.createDataFrame([(1, "Reader X", "Alone", "uses", "relation", "d", src("d1"), ""), (2, "reader x", "ALONE", "Uses", "relation", "", src("d2"), ""), (3, "Alone", "alone", "is", "relation", "", None, "")], f"edge_id long, source string, target string, type string, kind string, description string, sources {REF}, id string")
    return v, f, r


def test_graph_and_lint(spark):
    v, f, r = kb(spark)
    keys, nodes = G.node_keys(v), G.nodes(v)
    res = G.resolve(G.links_of(r, f), G.name_index(keys))
    edges = G.edges(res)
    e = {(x.source_key, x.type_key, x.target_key): x for x in edges.collect()}
    assert e[("reader x", "uses", "alone")].n_relations == 2 and e[("parser", "helps", "alone")].ambiguous_source and e[("alone", "is", "alone")].self_loop
    assert e[("parser", "helps", "alone")].source_id is None
    assert {(x.kind, x.ref_id) for x in G.unlinked(res).collect()} == {("fact", 3)}
    assert {x.name for x in G.ambiguous_names(res).collect()} == {"parser"}
    deg = {x.id: (x.n_out, x.n_in) for x in G.degrees(nodes, edges, keys).collect()}
    title = {x.title: x.id for x in nodes.collect() if x.kind == "entity"}
    assert deg[title["Alone"]] == (1, 3) and deg[title["Reader X"]] == (1, 0) and deg[title["Parser Two"]] == (1, 0)
    near = {(x.id, x.neighbor_id) for x in G.neighbors(edges, keys).collect()}
    assert (title["Alone"], title["Parser Two"]) in near and (title["Alone"], title["Alone"]) in near
    issues = L.all_issues(L.self_loops(edges), L.dangling_edges(edges, nodes, keys), L.isolated_nodes(nodes, G.degrees(nodes, edges, keys)), L.unlinked_facts(G.incomplete_facts(f), G.unlinked(res), f))
    counts = dict(map(tuple, L.count_issues(issues).collect()))
    assert counts["self_loop"] == 1 and counts["dangling_edge"] == 0 and counts["unlinked_fact"] == 2 and counts["graph_problems"] == counts["isolated_node"]
    assert not L.is_clean(issues) and L.sort_issues(issues).first().severity == "warning"
    lost = L.dangling_edges(edges, nodes.filter("title <> 'Alone'"), keys.filter("key <> 'alone'"))
    assert lost.count() == 3


def test_wiki_links_and_search(spark):
    from quillmill.operators import search as S

    v, f, r = kb(spark)
    nodes = G.nodes(v)
    pages = W.render_pages(v, nodes, f, r)
    every = pages.collect()
    rows = {x.title: x for x in every}
    alone = rows["Alone"].text
    assert alone.startswith('---\nid: "') and "- Parser helps Alone. [1]" in alone and "- ← Reader X —uses→ Alone [1]" in alone and "1. **d1**" in alone
    assert len({x.path.lower() for x in every}) == len(every)
    assert {x.path for x in every if x.title.strip().lower() == "parser"} == {"Parser-entity.md", "Parser-concept.md"}
    named = v.select("id", "name", "aliases").withColumnRenamed("id", "object_id")
    idx = N.link_index(W.page_paths(W.page_targets(v)).join(named, "object_id").selectExpr("path", "kind", "name as title", "aliases"))
    linked = {x.path: x for x in N.link_pages(pages, idx).collect()}
    assert "[Reader X](Reader%20X.md)" in linked["Alone.md"].text and linked["Alone.md"].skipped_self > 0 and linked["Alone.md"].skipped_ambiguous > 0
    joined = {x.path: x.text for x in N.link_pages(pages, idx, limit=0).collect()}
    assert joined == {k: x.text for k, x in linked.items()}
    lp = spark.createDataFrame([(x.path, x.text, "entity") for x in linked.values()], "path string, text string, kind string")
    assert L.dead_links(lp).count() == 0 and "Alone.md" not in {x.path for x in L.orphan_pages(lp).collect()}
    hits = S.search(S.search_pages(pages), "reader x", limit=3).collect()
    assert hits[0].score == 100 and hits[0].path == "Reader X.md" and "Reader X" in hits[0].snippet


def test_safe_stem(spark):
    df = spark.createDataFrame([("a/b:c", "id"), ("con", "id"), ("  ..x. ", "id"), ("", "id"), ("n" * 90, "0123456789"), ("编程", "id"), ("-.-", "x")], "n string, i string")
    from pyspark.sql import functions as F

    got = [r.s for r in df.select(W.safe_stem(F.col("n"), F.col("i")).alias("s")).collect()]
    assert got == ["a-b-c", "_con", "x", "page", "n" * 71 + "-01234567", "编程", "page"]


def test_paths_and_links():
    assert N.relative_target("a/b.md", "c d.md") == "../c d.md" and N.format_link("x[y]", "a (b).md") == "[x\\[y\\]](a%20%28b%29.md)"
    names = N.Names(["parser", "parser stage", "解析器", "c++"])
    t, n, s, a = N.link_text("The parser stage and parsers; 使用解析器 c++ `parser` parser.md\n# parser\n[^1]: x\n## Sources\nparser", names, {"parser": "p.md", "parser stage": "ps.md", "解析器": "j.md", "c++": "c.md"}, "q.md")
    assert t.startswith("The [parser stage](ps.md) and parsers; 使用[解析器](j.md) [c++](c.md) `parser` parser.md\n# parser") and (n, s, a) == (3, 0, 0)


def test_lint_pages(spark):
    p = spark.createDataFrame([("index.md", "[a](a.md)", "index"), ("a.md", "[b](s/b.md) [x](x.md) [w](http://x)", "entity"), ("s/b.md", "[up](../a.md) [self](b.md) [a](#x)", "entity"), ("c.md", None, "")], "path string, text string, kind string")
    assert [(r.path, r.rule) for r in L.dead_links(p).collect()] == [("a.md", "dead_link")]
    assert {r.path for r in L.orphan_pages(p).collect()} == {"c.md"}
    assert {r.path for r in L.unindexed_pages(p, p.filter("path <> 'c.md'")).collect()} == {"c.md"}


def test_judge_prompts(spark):
    from quillmill.operators import extraction as X

    v = items(spark, [(1, "entity", "Parser", "system", "", ["Reader"], [("d", None, None, " seen ")] * 5), (2, "entity", "Parseer", None, "", None, None)])
    pairs = C.limited_pairs(C.candidate_pairs(v), 1)
    (p,) = X.judge_prompts(pairs, C.distinct_names(v), v).collect()
    assert p.prompt.startswith("kind: entity") and p.prompt.count("quote: seen") == 3 and "aliases: Reader" in p.prompt and "name: Parseer" in p.prompt


def test_links_by_join_equal_links_by_broadcast(spark):
    names = [("parser.md", "entity", "Parser", ["the parser", "c++"]), ("stage.md", "concept", "Parser Stage", None), ("zh.md", "entity", "解析器", ["Größe"]), ("two.md", "entity", "the parser", []), ("long.md", "concept", "a name of many words", [])]
    index = N.link_index(spark.createDataFrame(names, "path string, kind string, title string, aliases array<string>"))
    texts = [("a.md", "Our Parser  Stage and c++ of the parser use 解析器.\n```\nparser\n```\n## Sources\nparser"), ("parser.md", "parser, A name of\nmany words; grösse Größe parser.md"), ("b.md", None), ("c.md", "")]
    pages = spark.createDataFrame(texts, "path string, text string")
    told, joined = (sorted(map(tuple, N.link_pages(pages, index, prefer_entity=True, limit=n).collect())) for n in (100, 0))
    assert told == joined
    assert {r[0]: r[2] for r in told}["a.md"].startswith("Our [Parser  Stage](stage.md) and [c++](parser.md) of [the parser](parser.md) use [解析器](zh.md).")


def test_overlapping_markup_is_kept():
    names = N.Names(["parser"])
    text = "<a `b> parser` [x [[parser]] y](z) ---\n---\nparser\n---"
    assert N.link_text(text, names, {"parser": "p.md"})[0].count("](p.md)") == 1
    assert N.link_text("---\nparser\n---\nparser", names, {"parser": "p.md"})[0] == "---\nparser\n---\n[parser](p.md)"


def test_search_aliases_are_folded_whole(spark):
    page = '---\nid: "1"\nkind: "entity"\naliases:\n  - "Ｆｕｌｌ  Width"\n  - "STRASSE"\n---\n# Title\nbody'
    pages = S.search_pages(spark.createDataFrame([("t.md", page)], "path string, text string"))
    assert pages.first().normalized_aliases == ["full width", "strasse"]
    assert S.search(pages, "straße").first().score == S.ALIAS_EXACT
    assert S.search(pages, "full  WIDTH").first().score == S.ALIAS_EXACT


def test_long_pages_come_in_parts(spark):
    ref = "array<struct<document_id:string,section_id:string,page_number:int,quote:string>>"
    v = spark.createDataFrame([(1, "entity", "Hot", "hot", "h" * 16, "other", "About.", ["H"], []), (2, "concept", "Cold", "cold", "c" * 16, "other", "", [], [])], f"item_id long, kind string, name string, key string, id string, type string, description string, aliases array<string>, sources {ref}")
    f = spark.createDataFrame([(n, f"S{n:03}", "Hot", "p", "Cold" if n == 5 else "", [("d", f"d#{n % 3}", None, None)], f"s{n:03}") for n in range(25)], f"fact_id long, statement string, subject string, predicate string, object string, sources {ref}, key string")
    r = spark.createDataFrame([(1, "Cold", "Hot", "uses", "relation", "", [], "i")], f"edge_id long, source string, target string, type string, kind string, description string, sources {ref}, id string")
    whole = {x.path: x.text for x in W.render_pages(v, G.nodes(v), f, r).collect()}
    parts = W.render_pages(v, G.nodes(v), f, r, most=7)
    got = parts.collect()
    hot = sorted((x.part, x.section, x.text) for x in got if x.path == "Hot.md")
    assert len(hot) > 4 and {s for _, s, _ in hot} == {"", "Facts", "Relations", "Sources"} and all(t.count("\n- ") <= 8 for _, _, t in hot)
    assert {x.path: x.text for x in W.whole_pages(parts).collect()} == whole
    assert [x.section for x in got if x.path == "Cold.md"] == [None]
    index = N.link_index(spark.createDataFrame([("Cold.md", "concept", "Cold", []), ("Hot.md", "entity", "Hot", [])], "path string, kind string, title string, aliases array<string>"))
    linked = N.link_pages(parts, index).collect()
    assert len(linked) == len(got) and sum(x.links for x in linked if x.path == "Hot.md") == sum(x.links for x in N.link_pages(W.render_pages(v, G.nodes(v), f, r), index).collect() if x.path == "Hot.md")
    assert {x.title for x in S.search_pages(parts).collect() if x.path == "Hot.md"} == {"Hot"}


def test_given_node_ids_go_before_names(spark):
    links = spark.createDataFrame([("a", "b", "t", "n2", None), ("a", "b", "t", "gone", "n1"), ("zz", "b", "t", "n1", None)], "source string, target string, type string, source_ref string, target_ref string")
    index = G.name_index(spark.createDataFrame([("n1", "a"), ("n2", "a"), ("n3", "b")], "id string, key string"))
    ids = spark.createDataFrame([("n1",), ("n2",), ("n3",)], "id string")
    got = sorted((r.source, r.source_id or "", r.source_nodes, r.target_id) for r in G.resolve(links, index, ids).collect())
    assert got == [("a", "", 2, "n1"), ("a", "n2", 1, "n3"), ("zz", "n1", 1, "n3")]


def test_lint_runs(spark):
    import pytest

    p = spark.createDataFrame([("a.md", "[x](b.md)", "page")], "path string, text string, kind string")
    issues, runs = L.run_rules({"dead_link": L.dead_links(p), "self_loop": None})
    assert issues.count() == 1 and {r.rule for r in runs.filter("status = 'run'").collect()} == {"dead_link"} and runs.count() == len(L.SEVERITY)
    with pytest.raises(L.NothingToCheckError):
        L.run_rules({"dead_link": None})
    with pytest.raises(ValueError, match="unknown rule"):
        L.run_rules({"nothing": None})


def test_pages_are_made_without_checkpoints_or_joins_by_quote(spark):
    ref = "array<struct<document_id string, section_id string, page_number int, quote string>>"
    v = spark.createDataFrame([(1, "entity", "Hot", "hot", "h" * 16, "other", "", [], [])], f"item_id long, kind string, name string, key string, id string, type string, description string, aliases array<string>, sources {ref}")
    f = spark.createDataFrame([(1, "S", "Hot", "p", "", [("d", "s", 1, "q")], "s")], f"fact_id long, statement string, subject string, predicate string, object string, sources {ref}, key string")
    r = spark.createDataFrame([(1, "Hot", "X", "uses", "relation", "", [("d", "s", 1, "q"), ("e", None, None, None)], "i")], f"edge_id long, source string, target string, type string, kind string, description string, sources {ref}, id string")
    pages = W.render_pages(v, G.nodes(v), f, r)
    assert "- S [1]\n" in pages.collect()[0].text and "Hot —uses→ X [1][2]\n" in pages.collect()[0].text
    # no result of a step is written to the checkpoint folder and no source is joined by its quote
    plan = pages._jdf.queryExecution().optimizedPlan().toString()
    assert "Scan ExistingRDD[object_id" not in plan and "LogicalRDD [object_id" not in plan
    assert not [x for x in plan.splitlines() if "Join" in x and "quote" in x]
