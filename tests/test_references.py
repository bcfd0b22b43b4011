import datetime as dt

from quillmill.operators import references as R

T = lambda d: dt.datetime(2024, 1, d)
REF = "array<struct<document_id:string,section_id:string,page_number:int,quote:string>>"
ITEMS = f"item_id long, name string, aliases array<string>, sources {REF}, loaded_at timestamp_ntz, deleted_at timestamp_ntz, extra string"
FACTS = f"fact_id long, sources {REF}, loaded_at timestamp_ntz"
EDGES = f"edge_id long, source string, target string, sources {REF}, loaded_at timestamp_ntz"
LIFE = "{} string, loaded_at timestamp_ntz, deleted_at timestamp_ntz"


def run(spark, docs=(), secs=(), items=(), facts=(), edges=()):
    i = spark.createDataFrame(list(items), ITEMS)
    refs = R.references(i, spark.createDataFrame(list(facts), FACTS), spark.createDataFrame(list(edges), EDGES))
    lives = R.existence(spark.createDataFrame(list(docs), LIFE.format("document_id")), spark.createDataFrame(list(secs), LIFE.format("section_id")), i)
    return refs, lives


def src(d=None, s=None):
    return (d, s, None, None)


def test_orphans_in_time(spark):
    docs = [("d1", T(1), T(10)), ("D2 ", T(5), None), ("d1", T(12), None), ("d3", T(4), T(3))]
    facts = [(1, [src("D1"), src("d2", "d2#1")], T(3)), (2, [src("d1")], T(10)), (3, [src(" d1 ")], T(11)), (4, [src("d1"), src("")], T(13)), (5, [src("d3")], T(4)), (5, [src("d3")], T(2)), (6, None, T(1))]
    refs, lives = run(spark, docs, [("d2#1", T(3), None)], facts=facts)
    got = sorted(map(tuple, R.orphan_references(refs, lives).collect()))
    assert got == [
        ("facts", 1, "document_id", 2, "2024-01"),
        ("facts", 2, "document_id", 1, "2024-01"),
        ("facts", 3, "document_id", 1, "2024-01"),
        ("facts", 5, "document_id", 1, "2024-01"),
    ]


def test_names_and_current(spark):
    items = [(1, "Alpha  Beta", ["AB", None], [], T(2), None, "x"), (2, "Gone", None, None, T(1), T(2), "x")]
    edges = [(1, " alpha beta", "ab", [], T(2)), (2, "alpha beta", "gone", [], T(1)), (3, None, "  ", [], T(1)), (4, "gone", "nowhere", [], T(5))]
    refs, lives = run(spark, items=items, edges=edges)
    got = sorted((r.row_id, r.field_name) for r in R.orphan_references(refs, lives).collect())
    assert got == [(2, "source"), (4, "source"), (4, "target")]
    assert sorted((r.key, r.n_refs) for r in R.current_orphans(refs, lives).collect()) == [("gone", 2), ("nowhere", 1)]
    assert {(r.ref_table, r.field_name, r.orphans) for r in R.orphan_report(R.orphan_references(refs, lives)).collect()} == {("edges", "source", 2), ("edges", "target", 1)}


def test_empty_and_null_time(spark):
    refs, lives = run(spark)
    assert R.orphan_references(refs, lives).count() == 0
    refs, lives = run(spark, docs=[("d", T(1), None), ("e", None, None)], facts=[(1, [src("d"), src("e")], None)])
    assert [(r.ref_pos, r.period) for r in R.orphan_references(refs, lives).collect()] == [(2, None)]


def test_hot_key_matches_brute_force(spark):
    import random

    r = random.Random(3)
    docs = [("hot" if r.random() < 0.5 else f"d{r.randint(1, 9)}", T(r.randint(1, 28)), T(r.randint(1, 28)) if r.random() < 0.5 else None) for _ in range(60)]
    facts = [(i, [src("hot" if r.random() < 0.4 else f"d{r.randint(1, 12)}")], T(r.randint(1, 28))) for i in range(200)]
    want = {i for i, s, t in facts if not any(k == s[0][0] and a <= t and (b is None or b > t) for k, a, b in docs)}
    refs, lives = run(spark, docs, facts=facts)
    assert {x.row_id for x in R.orphan_references(refs, lives).collect()} == want


def test_many_gaps_come_in_chunks(spark):
    t = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)
    docs = [("hot", t(4 * i), t(4 * i + 2)) for i in range(200)] + [("same", t(5), t(9)), ("same", t(9), None)]
    facts = [(i, [src("hot"), src("same")], t(i - 2)) for i in range(810)]
    refs, lives = run(spark, docs, facts=facts)
    g = R.gaps(lives)
    assert g.filter("key = 'hot'").count() == 4 and max(len(r.gaps) for r in g.collect()) == R.CHUNK
    got = {(x.row_id, x.ref_pos) for x in R.orphan_references(refs, lives).collect()}
    hot = {(i, 1) for i in range(810) if not any(4 * k <= i - 2 < 4 * k + 2 for k in range(200))}
    assert got == hot | {(i, 2) for i in range(810) if i - 2 < 5}


def test_two_batches_give_the_counts_of_one(spark, tmp_path):
    from quillmill.streaming import ingest

    docs = [("a", T(1), T(3)), ("b", T(1), None), ("c", T(2), T(4)), ("c", T(5), None), ("A ", T(6), None)]
    facts = [(1, [src("a"), src("x")], T(1)), (2, [src("a"), src("c")], T(2)), (3, [src("x")], T(2))]
    refs, lives = run(spark, docs, facts=facts)
    want = {tuple(r) for r in R.current_orphans(refs, lives).collect()}
    assert want == {("d", "x", 2)}
    first, second = run(spark, docs[:2], facts=facts[:1]), run(spark, docs[2:], facts=facts[1:])
    counts = R.add_counts(R.signed_counts(*first), R.signed_counts(*second))
    assert {tuple(r) for r in R.orphans_of(counts).collect()} == want
    assert {tuple(r) for r in R.orphans_of(R.signed_counts(*first)).collect()} == {("d", "a", 1), ("d", "x", 1)}
    # the same as streams of files: rows first, references later
    src_dir, state, schema = str(tmp_path / "in"), str(tmp_path / "state"), LIFE.format("document_id")
    lives_of = lambda b: R.existence(b, b.select(b.document_id.alias("section_id"), "loaded_at", "deleted_at").limit(0), run(spark)[1].sparkSession.createDataFrame([], ITEMS))
    for i, part in enumerate((docs[:2], docs[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src_dir)
        ingest.maintain_counts(ingest.stream_table(spark, src_dir, spark.createDataFrame([], schema)), state, str(tmp_path / "ck"), lives_of=lives_of).awaitTermination()
        assert ingest.counts_at(spark, state) is not None, i
    got = {(r.key, r.n_rows) for r in ingest.counts_at(spark, state).collect()}
    assert got == {("a", 1), ("b", 1), ("c", 1)}
