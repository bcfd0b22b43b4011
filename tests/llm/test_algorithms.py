import itertools
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmill.llm import components as CC
from quillmill.llm import names as NM
from quillmill.llm import neardup as ND
from quillmill.llm import packing as PK
from quillmill.llm import splitting as SP

# --- 1 splitting ----------------------------------------------------------------------------------------------------

PIECES = ["a", "b. ", "\n", "\n\n", "# h\n", "- x\n", "中。", "```\n", "word ", "== H ==\n", "T\n====\n", "\\section{x}\n", "1. y\n"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=120), st.integers(2, 60), st.data())
def test_pieces_tile_the_text(parts, size, data):
    text, overlap = "".join(parts), data.draw(st.integers(0, size - 1))
    p = SP.split_text(text, size, overlap)
    if len(text) <= size:
        assert p == []
        return
    assert len(p) > 1 and "".join(text[n:e] for _, n, e in p) == text
    assert all(e - s <= size for s, _, e in p)
    assert all(b[1] - b[0] == overlap and a[2] == b[1] for a, b in itertools.pairwise(p))


def test_cuts_at_headings_and_sentences():
    text = "# A\n\n" + "Short one. " * 20 + "\n\n# B\n\n" + "Other text. " * 20
    p = SP.split_text(text, 300, 20)
    assert any(text[n:].startswith("# B") for _, n, _ in p)
    assert all(text[e - 1] in " \n" for _, _, e in p[:-1])


def test_long_inputs_are_linear():
    for t in ("x" * 60000, "\n" * 20000, "# a\n" * 5000):
        assert "".join(t[n:e] for _, n, e in SP.split_text(t, 4000, 400)) == t


def test_split_rows(spark):
    df = spark.createDataFrame([("k", "x" * 30, 1), ("k", "x" * 30, 2), ("n", None, 3), (None, "y" * 30, 4), ("s", "", 5), ("e", "z" * 10, 6)], "section_id string, content string, item_key int")
    r = SP.split_oversized(df, "sections", "section_id", "content", 10, 2).collect()
    assert {x.item_key for x in r} == {"k"} and [x.piece_no for x in sorted(r)] == list(range(1, len(r) + 1)) and max(len(x.piece) for x in r) <= 10
    assert SP.split_oversized(df.limit(0), "sections", "section_id", "content", 10, 2).count() == 0
    with pytest.raises(ValueError):
        SP.split_text("abc", 2, 2)


# --- 6 near duplicates ----------------------------------------------------------------------------------------------


def _brute(rows, share=0.8, least=8):
    import re

    w = [(i, Counter(re.findall(r"[^\W_]+", t.lower()))) for i, t in dict(rows).items() if t]
    w = [(i, c, sum(c.values())) for i, c in w if sum(c.values()) >= least]
    return {(min(a, b), max(a, b)) for (a, x, n), (b, y, m) in itertools.combinations(w, 2) if sum((x & y).values()) >= share * max(n, m) - 1e-9}


def _texts(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    base = [[r.choice(words) for _ in range(r.randint(7, 24))] for _ in range(12)]
    out = []
    for i in range(n):
        t = list(r.choice(base))
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(t))
            t[k : k + 1] = r.choice([[], [r.choice(words)], [t[k], r.choice(words)]])
        r.shuffle(t) if r.random() < 0.2 else None
        out.append((i, r.choice([" ", ", "]).join(t)))
    return out


@pytest.mark.parametrize(("hot", "often"), [(4000, 64), (3, 2), (4000, 0), (5, 20)])
def test_near_duplicates_lose_nothing(spark, hot, often):
    rows = [*_texts(1, 150), (900, None), (901, ""), (902, "too short")]
    df = spark.createDataFrame([*rows, rows[0]], "fact_id long, statement string")
    nd = ND.NearDuplicates([ND.records(df, "facts", "fact_id", "statement")], hot=hot, often=often)
    assert {(x.low_id, x.high_id) for x in nd.pairs().collect()} == _brute(rows)
    if hot == 3:
        want = _brute(rows)
        g = {x.record_id: x.group_id for x in nd.groups().collect()}
        assert set(g) == {i for p in want for i in p} and all(g[a] == g[b] for a, b in want)


@pytest.mark.parametrize(("hot", "often", "first"), [(4000, 64, 32), (3, 2, 8), (2, 0, 16)])
def test_near_duplicates_of_all_lengths(spark, monkeypatch, hot, often, first):
    monkeypatch.setattr(ND, "FIRST", first)
    r = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    base = [[r.choice(words) for _ in range(n)] for n in (8, 9, 12, 25, 31, 32, 33, 40, 41, 100, 128, 129, 160, 161)]
    rows = []
    for i in range(120):
        t = list(r.choice(base))
        for _ in range(r.randint(0, max(1, len(t) // 5))):
            t[r.randrange(len(t)) : r.randrange(len(t)) + 1] = [r.choice(words)] * r.randint(0, 1) or [t[0]]
            t = t or ["w0"]
        rows.append((i, " ".join(t[:200])))
    df = spark.createDataFrame(rows, "fact_id long, statement string")
    nd = ND.NearDuplicates([ND.records(df, "facts", "fact_id", "statement")], hot=hot, often=often)
    assert {(x.low_id, x.high_id) for x in nd.pairs().collect()} == _brute(rows)


def test_shard_rows_do_not_grow_with_the_data():
    import numpy as np

    words = " ".join(f"w{i}" for i in range(19))
    for times in (10**3, 10**6, 10**9):
        count = np.full(ND.COUNTERS, 100 * times, np.int64)
        t = ND._Text(words, count, 0.8).ordered()
        assert sum(b for _, b in ND.shard_keys(t, 0, count, 4000, 64)) <= 20
    # a hot pair of a long text is cut in blocks
    t = ND._Text(" ".join(f"w{i}" for i in range(50)), count, 0.8).ordered()
    assert all(b > 1 for _, b in ND.shard_keys(t, 1, count, 4000, 64))
    assert list(ND.classes(25, 0.8)) == [0] and list(ND.classes(26, 0.8)) == [0, 1] and list(ND.classes(33, 0.8)) == [1] and list(ND.classes(500, 0.8)) == [2, 3]


def test_near_duplicates_empty(spark):
    df = spark.createDataFrame([], "fact_id long, statement string, words string, rep long")
    nd = ND.NearDuplicates([ND.records(df, "facts", "fact_id", "statement")])
    assert nd.pairs().count() == 0


def test_bk_tree():
    r = random.Random(0)
    codes = [r.getrandbits(64) for _ in range(300)]
    codes += [c ^ (1 << r.randrange(64)) for c in codes[:50]]
    t = ND.BKTree()
    for i, c in enumerate(codes):
        t.add(c, i)
    for c in codes[:40]:
        assert {v for _, v in t.within(c, 20)} == {i for i, x in enumerate(codes) if (x ^ c).bit_count() <= 20}


# --- 7 components ---------------------------------------------------------------------------------------------------


def test_components_match_union_find(spark):
    r = random.Random(5)
    links = [(r.randint(1, 200), r.randint(1, 200)) for _ in range(150)] + [(i + 1, i) for i in range(300, 420)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (None, 3), (1, 2), (2, 1)]
    p = {}

    def find(x):
        while p.setdefault(x, x) != x:
            x = p[x]
        return x

    for a, b in links:
        if a and b and a != b:
            x, y = find(a), find(b)
            p[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(a, b, True, "x") for a, b in links] + [(7, 9999, False, "x"), (7, 9998, None, "x")], "left_id long, right_id long, same boolean, u string")
    from pyspark.sql import functions as F

    got = dict(map(tuple, CC.components(CC.linked_pairs(df, "left_id", "right_id", F.col("same"))).collect()))
    assert got == {x: find(x) for x in p}
    assert CC.components(CC.linked_pairs(df.limit(0), "left_id", "right_id")).count() == 0


# --- 9 packing ------------------------------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=20), st.integers(40, 64))
def test_fill_uses_every_item_once(counts, capacity):
    used = Counter()
    for take, times in PK.fill(counts, capacity):
        assert sum(s * k for s, k in take.items()) <= capacity and times > 0
        for s, k in take.items():
            used[s] += k * times
    assert used == Counter(counts)


def test_fill_is_tight_and_scales():
    r = random.Random(1)
    counts = Counter(min(1024, int(r.lognormvariate(5, 1)) + 1) for _ in range(20000))
    plan = PK.fill(counts, 1024)
    bins = sum(t for _, t in plan)
    total = sum(s * n for s, n in counts.items())
    assert bins <= total / 1024 * 1.02 + 1
    big = PK.fill({s: n * 1000 for s, n in counts.items()}, 1024)
    assert sum(t for _, t in big) <= 1000 * bins and len(big) <= 1024 * 8


def test_assign(spark):
    sizes = [(i, n) for i, n in enumerate([0, None, 5, 5, 5, 10, 23, 30, 1, 9, 10, 20])]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens int")
    rows = PK.assign_containers(df, "doc_id", "n_tokens", 10).collect()
    per = Counter()
    for r in rows:
        per[r.container_id] += r.n_tokens
    assert max(per.values()) <= 10 and Counter({i: n or 0 for i, n in sizes}) == Counter({i: sum(r.n_tokens for r in rows if r.doc_id == i) for i, _ in sizes})
    assert Counter(r.doc_id for r in rows if r.doc_id not in (6, 7, 11)) == Counter({i: 1 for i, _ in sizes if i not in (6, 7, 11)})
    assert sorted(r.n_tokens for r in rows if r.doc_id == 6) == [3, 10, 10] and len({(r.doc_id, r.piece_no) for r in rows}) == len(rows)
    assert PK.assign_containers(df.limit(0), "doc_id", "n_tokens", 10).count() == 0
    assert sorted(map(tuple, rows)) == sorted(map(tuple, PK.assign_containers(df.repartition(3), "doc_id", "n_tokens", 10).collect()))


# --- 4 names --------------------------------------------------------------------------------------------------------

REGISTRY = [
    (1, "Samuel Haskidge"), (2, "Susanna Haskidge"), (3, "Frederick Mardolm"), (4, "Zevidge Splitter 7"), (5, "Zevidge Splitter"), (6, "Institute for Text Partners Tessmere"), (7, "Jellholt Meridian Technologies GmbH"),
    (8, "澄海图谱技术协会"), (9, "晴川信息检索研究院"), (10, "lexical citation closure"), (11, "federated candidate compression"), (12, "Renée Östolm"), (13, "Krelidge Saffron Partners S.A."), (14, "William Halkolm"),
]
CASES = {
    "Dr. Samuel Haskidge": 1, "Haskidge, Susanna": 2, "S. Haskidge": None, "Fred Mardolm": 3, "MARDOLM Frederick, Ms": 3, "frederick.mardolm": 3, "Zevidge Splitter v7": 4, "Splitter Zevidge 7": 4, "zevidge_splitter": 5, "ZevidgeSplitter": 5,
    "Zevidge Splitter 8": None, "ITP Tessmere": 6, "IFTPT (Tessmere)": 6, "Institute for Text Partnesr Tessmere": 6, "JMTG (Jellholt)": 7, "Jellholt Meridian Tech. GmbH": 7, "Jellholt Meridian Technologies AG": None, "澄海圖譜技術協會": 8,
    "《澄海 图谱技术协会》": 8, "晴川信息院": 9, "lexical closure of citations": 10, "citation closure, lexical": 10, "federated candidate compression (FCC)": 11, "federatedCandidateCompression": 11, "Renee Oestolm": 12, "Krelidge Saffron Partners": 13,
    "William Haskolm": None, "Totally Different": None, "": None, "   ": None,
}


def test_spellings(spark):
    reg = spark.createDataFrame([*REGISTRY, (99, None)], "registry_id long, name string")
    # tokens of other entries that make Haskolm a name of its own
    reg = reg.union(spark.createDataFrame([(50 + i, n) for i, n in enumerate(["Anna Haskwicke", "Anna Haskmere", "Otto Haskidge", "Otto Tessolm", "Otto Varnolm", "Otto Jellolm", "Otto Fenolm"])], "registry_id long, name string"))
    sp = spark.createDataFrame([(s,) for s in CASES], "spelling string")
    best = {}
    for r in NM.match_spellings(sp, reg, "registry_id", "name").collect():
        best.setdefault(r.spelling, []).append((r.score, r.registry_id))
    wrong = {}
    for s, want in CASES.items():
        c = sorted(best.get(s, []), reverse=True)
        got = c[0][1] if c and (len(c) == 1 or c[0][0] - c[1][0] > NM.MARGIN) else None
        if got != want:
            wrong[s] = (want, c[:3])
    assert not wrong


def test_link_items(spark):
    reg = spark.createDataFrame(REGISTRY, "registry_id long, name string")
    rows = [(1, "S. Haskidge", ["Sam Haskidge"], "x"), (2, "Zofimaka", ["ITP Tessmere"], "x"), (2, "Zofimaka", ["ITP Tessmere"], "x"), (3, None, None, "x"), (4, " ", [None, ""], "x"), (5, "samuel  haskidge", [], "x"), (6, "S. Haskidge", None, "x")]
    items = spark.createDataFrame(rows, "item_id long, name string, aliases array<string>, score string")
    assert {(r.item_id, r.registry_id) for r in NM.link_items(items, reg).collect()} == {(1, 1), (2, 6), (5, 1)}
    assert NM.link_items(items.limit(0), reg).count() == 0 and NM.link_items(items, reg.limit(0)).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.text("abcdr", min_size=1, max_size=12), st.text("abcdr", min_size=1, max_size=12), st.integers(0, 7))
def test_words_that_share_grams_share_a_key(a, b, seed):
    df = lambda g: hash((seed, g)) % 5
    left, right = {k for k, u in NM.word_keys(a, df, False) if u == a}, {k for k, _ in NM.word_keys(b, df, True)}
    met = left & right
    assert not NM.share_grams(a, b) or any(k.startswith("g:") for k in met)
    assert not (b.startswith(a) and len(a) >= 3 or a.startswith(b) and len(b) >= 3) or any(k[0] in "pq" for k in met)


def test_naming_words_are_the_rarest():
    weight = {"fenighi": 6.0, "lumen": 2.0, "research": 1.0, "sky": 2.0}.get
    assert NM.naming_words(NM.parse("Fenighi Lumen Research"), weight, lambda c: 1) == ["fenighi"]
    assert NM.naming_words(NM.parse("Lumen Sky"), weight, lambda c: 1) == ["lumen", "sky"]
    assert NM.naming_words(NM.parse("云砚文档协会"), weight, lambda c: 9 if c in "协会" else 1)[-1] not in ("h:协", "h:会")
    assert NM.naming_words(NM.parse("&"), weight, lambda c: 1) == [] == NM.spelling_words(NM.parse("A"))
