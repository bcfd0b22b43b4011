from difflib import SequenceMatcher
from itertools import combinations
from random import Random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quillmill.operators import candidates as C


def names(spark, keys):
    return spark.createDataFrame([("entity", k, i) for i, k in enumerate(keys)], "kind string, key string, item_id long")


def brute(keys):
    out = {}
    for (i, x), (j, y) in combinations(enumerate(keys), 2):
        a, b = "".join(x.split()), "".join(y.split())
        s, n = sorted((a, b), key=len)
        if not (a[0] == b[0] or a[-1] == b[-1] or {t for t in x.split() if len(t) > 1} & {t for t in y.split() if len(t) > 1}):
            continue
        pair = (min(x, y), max(x, y))
        if s != n and s in n and len(s) >= 0.6 * len(n):
            out[pair] = "one name contains the other"
        elif SequenceMatcher(None, a, b).ratio() >= 0.85:
            out[pair] = "similar spelling"
    return out


def found(spark, keys):
    rows = C.near_spelling(names(spark, keys)).collect()
    out = {(r.l, r.r): r.reason for r in rows}
    assert len(out) == len(rows)
    return out


def test_near_spelling_of_all_lengths(spark):
    long = "the very long name of an institute for the study of long names and of their spellings"
    keys = [
        "a", "ab", "abc", "graph", "graphs", "graph engine", "graph engines", "graphengine", "grahp engine", "engine graph", "knowledge graph", "knowledg graph",
        long, long + " abroad", long.replace("spellings", "speling"), "x" + long[:-1], long[5:], long[:60], "a" * 60, "a" * 70, "ab" * 30, "ab" * 33, "ba" * 31, "云砚文档协会", "云砚文档处理协会",
        "0123456789" * 5, "0123456789" * 5 + "a", "0123456789" * 4 + "012345678",
    ]
    assert found(spark, keys) == brute(keys)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abc ", min_size=1, max_size=14).map(str.strip).filter(bool), min_size=2, max_size=60, unique=True))
def test_near_spelling_equals_brute_force(spark, keys):
    assert found(spark, keys) == brute(keys)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(20, 90), st.lists(st.tuples(st.integers(0, 89), st.sampled_from("xyz")), max_size=12)), min_size=2, max_size=25))
def test_near_spelling_of_edited_long_names(spark, edits):
    base = "karl albert ruiz de la vega institute for applied knowledge graphs and document systems in"
    keys = set()
    for n, changes in edits:
        s = list(base[:n])
        for at, c in changes:
            if at < len(s):
                s[at] = c
        keys.add(" ".join("".join(s).split()))
    keys = sorted(keys)
    assert found(spark, keys) == brute(keys)


def test_common_subsequence():
    assert C._common("abcbdab", "bdcaba") == 4
    assert C._common("", "abc") == 0


@pytest.mark.parametrize("keys", [[], ["one"]])
def test_no_pairs(spark, keys):
    assert found(spark, keys) == {}


def test_truncation(spark):
    pairs = spark.createDataFrame([("entity", str(i), str(i + 1), 1) for i in range(5)] + [("concept", "a", "b", 1)], "kind string, l string, r string, rule int")
    got = {r.kind: (r.n_pairs, r.n_kept, r.warning) for r in C.truncation(pairs, 3).collect()}
    assert got["concept"] == (1, 1, None)
    assert got["entity"][:2] == (5, 3) and "truncated to 3 (of 5)" in got["entity"][2]
    plan = C.limited_pairs(pairs, 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def written(spark):
    """Bytes that all stages so far have shuffled."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_names_of_one_word_are_not_moved_as_pairs(spark):
    letters = "bcdfghklmnprstvz"
    keys = ["".join(letters[i // 16**k % 16] + "aeiou"[(i * (k + 7) // 3) % 5] for k in range(4)) + " glacier" for i in range(0, 65536, 41)]
    df = spark.createDataFrame([(i, "entity", k, k, []) for i, k in enumerate(keys)], "item_id long, kind string, key string, name string, aliases array<string>")
    before = written(spark)
    C.candidate_pairs(df).count()
    assert written(spark) - before < 2_500_000


def overlaps(keys):
    out = {}
    for x, y in combinations(keys, 2):
        s, t = ({w for w in k.split() if len(w) > 1} for k in (x, y))
        if s and t and len(s & t) / len(s | t) >= 0.5:
            out[min(x, y), max(x, y)] = pytest.approx(len(s & t) / len(s | t), abs=6e-5)
    return out


def test_token_overlap_equals_brute_force(spark):
    r = Random(7)
    words = [f"w{i}" for i in range(30)] + ["aa", "bb", "cc"]
    keys = [" ".join(r.sample(words, min(28, 1 + int(r.expovariate(0.2))))) for _ in range(150)]
    for k in keys[:100]:
        w = k.split()
        keys += [" ".join(w[r.randrange(len(w)) // 2 :] + ["zz"]), " ".join(r.sample(w, len(w)))]
    keys = sorted(set(keys))
    assert {(x.l, x.r): x.score for x in C.token_overlap(names(spark, keys)).collect()} == overlaps(keys)


def test_near_spelling_in_small_blocks(spark):
    keys = [f"{a}{b} {c}" for a in ("abc", "abd", "xbc", "bc") for b in ("def", "dfe", "de") for c in ("glacier", "glacer", "queue")]
    rows = C.near_spelling(names(spark, keys), block=4).collect()
    assert {(r.l, r.r): r.reason for r in rows} == brute(keys) and len(rows) == len(brute(keys))
