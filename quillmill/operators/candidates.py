"""Which names might be the same: the candidate rules as joins between distinct names.

Items with the same key are one name already, so pairs are pairs of names (representatives); membership is the key
itself. The relation is not transitive, so each pair of names of a shared key is a candidate of its own. No rule
compares all names: shared keys are equi-joins, word overlap goes through pairs of the rarest words, contained names and near
spellings meet in blocks of names with one letter or word in common.

Defined results: null and blank names take no part; a pair is listed once, with the first rule that names it; names of
any length are compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.names import alias_keys_col, name_tokens
from quillmill.session import cut

#: Thresholds of the rules.
CONTAINS, OVERLAP, SIMILAR = 0.6, 0.5, 0.85
#: Names of one shared key that meet in one block; names of one letter or word whose spellings are compared in one.
BLOCK, NEAR_BLOCK = 500, 8000
#: Names of up to so many words meet by pairs of words.
MANY = 12
CONTAINED, NEAR = "one name contains the other", "similar spelling"


def distinct_names(view: DataFrame) -> DataFrame:
    """(kind, key, item_id, name): the first item of each key stands for the name."""
    return view.filter("key <> ''").groupBy("kind", "key").agg(F.min(F.struct("item_id", "name")).alias("_f")).select("kind", "key", "_f.item_id", "_f.name")


def _blocks(df: DataFrame, by: str, block: int = BLOCK) -> DataFrame:
    """Names of shared values, cut into blocks: a name comes once for each pair of blocks (_x, _y) that it takes part in; _b is its own."""
    size = df.groupBy("kind", by).agg(F.count("*").alias("_n")).filter("_n > 1").select("kind", by, F.ceil(F.col("_n") / block).alias("_m"))
    rows = df.join(size, ["kind", by]).withColumn("_b", F.pmod(F.xxhash64("key"), F.col("_m"))).withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)))
    return rows.withColumns({"_x": F.least("_b", "_o"), "_y": F.greatest("_b", "_o")}).drop("_m", "_o")


def _pairs(df: DataFrame, by: str) -> DataFrame:
    """All pairs of names that share a value, once for each value; values of many names are cut into blocks that meet in pairs."""
    on = ["kind", by, "_x", "_y"]
    met = _blocks(df.select("kind", by, "key"), by).select(*on, "key", "_b")
    both = met.toDF(*on, "l", "_bl").join(met.toDF(*on, "r", "_br"), on).filter("l < r AND (_x = _y OR _bl <> _br)")
    return both.select("kind", "l", "r")


def shared_alias(view: DataFrame) -> DataFrame:
    """Rule 1: names that share a name or alias key."""
    keys = view.filter("key <> ''").select("kind", "key", F.explode(alias_keys_col("name", "aliases")).alias("_a")).distinct()
    return _pairs(keys, "_a").distinct().withColumn("reason", F.lit("shared name or alias"))


def same_compact(names: DataFrame) -> DataFrame:
    """Rule 2: names that are equal without spaces."""
    c = names.select("kind", "key", F.regexp_replace("key", r"(?U)\s+", "").alias("_c"))
    return _pairs(c, "_c").distinct().withColumn("reason", F.lit("same name without whitespace"))


def _token_keys(t: DataFrame) -> DataFrame:
    """(kind, key, _t, _k): what two names share if their words overlap enough.

    Names of n and m words with a Jaccard overlap of at least ``OVERLAP`` share ``need`` words. If that is one, each word is a key; if it
    is more, two of the rarest n - need + 2 words of one are also two of the rarest of the other, and such a pair of words is a key.
    The number of words of both is part of it. Names that may meet one of more than ``MANY`` words have keys of one of their rarest words.
    """
    n = F.col("_n")
    each = t.select("kind", "key", F.explode("_t").alias("_u"))
    freq = each.groupBy("kind", "_u").agg(F.count("*").alias("_df"))
    rare = each.join(freq, ["kind", "_u"]).groupBy("kind", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_df", "_u"))), lambda x: x["_u"]).alias("_s"))
    rare = rare.join(t, ["kind", "key"]).withColumn("_n", F.size("_s"))
    need = lambda m: F.ceil(F.lit(OVERLAP / (1 + OVERLAP)) * (n + m) - 1e-9).cast("int")
    label = lambda m, *u: F.concat_ws(" ", F.least(n, m).cast("string"), F.greatest(n, m).cast("string"), *u)
    one = lambda m: F.transform(F.col("_s"), lambda u: label(m, u))
    first = lambda m: F.slice("_s", 1, n - need(m) + 2)
    # the words of a pair in their own order, which is the same in both names
    two = lambda m: F.flatten(F.transform(first(m), lambda u: F.transform(F.filter(first(m), lambda w: w > u), lambda w: label(m, u, w))))
    sizes = F.sequence(F.ceil(n * F.lit(OVERLAP) - 1e-9).cast("int"), F.least(F.floor(n / F.lit(OVERLAP) + 1e-9).cast("int"), F.lit(MANY)))
    few = F.when(n <= MANY, F.flatten(F.transform(sizes, lambda m: F.when(need(m) == 1, one(m)).otherwise(two(m))))).otherwise(F.array().cast("array<string>"))
    many = F.when(n > F.floor(F.lit(OVERLAP * MANY)), F.slice("_s", 1, (n - F.ceil(F.lit(OVERLAP) * n) + 1).cast("int"))).otherwise(F.array().cast("array<string>"))
    return rare.select("kind", "key", "_t", F.explode(F.concat(few, many)).alias("_k"))


def token_overlap(names: DataFrame) -> DataFrame:
    """Rule 3b: word sets with a Jaccard overlap of at least ``OVERLAP``; pairs are judged where they meet."""
    t = names.select("kind", "key", name_tokens(F.col("key")).alias("_t")).filter(F.size("_t") > 0)
    k = cut(_token_keys(t))
    met = k.toDF("kind", "l", "tl", "_k").join(k.toDF("kind", "r", "tr", "_k"), ["kind", "_k"]).filter("l < r")
    share = F.size(F.array_intersect("tl", "tr")) / F.size(F.array_union("tl", "tr"))
    full = met.withColumn("score", share).filter(F.col("score") >= OVERLAP).select("kind", "l", "r", "score").distinct()
    return full.select("kind", "l", "r", F.lit("token overlap").alias("reason"), F.round("score", 4).alias("score"))


#: Bits of the hashed letters and letter pairs of a name; letters are compared by a product of matrices.
_LETTERS, _PAIRS = 128, 256
_CHUNK = 1024


def _bits(codes: np.ndarray, owner: np.ndarray, n: int, width: int) -> np.ndarray:
    """Rows of hashed bits of numbered codes: the second occurrence in a name is another sign than the first."""
    order = np.lexsort((codes, owner))
    c, o = codes[order], owner[order]
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]) | (o[1:] != o[:-1])
    at = np.arange(len(c))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    h = (c * np.uint64(0x9E3779B97F4A7C15) + nth.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)
    out = np.zeros((n, width), bool)
    out[o, (h % np.uint64(width)).astype(np.int64)] = True
    return out


def _close_pairs(names: list[str], sides: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (shorter, longer) of the pairs of sorted names, none empty, that may hold each other or be near; of two sides, if given.

    Letters that two names do not share are unmatched in every alignment, and an unmatched letter costs its own name two
    letter pairs and the other name one. Bits that fall together only make names look nearer, so no pair is lost.
    """
    n = np.array([len(x) for x in names])
    codes = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(names)), n)
    letters = _bits(codes, owner, len(names), _LETTERS).astype(np.float32)
    two = owner[1:] == owner[:-1]
    pairs = np.packbits(_bits(((codes[:-1] << np.uint64(21)) | codes[1:])[two], owner[1:][two], len(names), _PAIRS), axis=1).view(np.uint64)
    have = letters.sum(axis=1)
    part = ((have - (1 - SIMILAR) * n) / 2 - 1e-3).astype(np.float32)
    for start in range(0, len(names), _CHUNK):
        end = min(start + _CHUNK, len(names))
        last = int(np.searchsorted(n, n[end - 1] / min(CONTAINS, SIMILAR / (2 - SIMILAR)) + 1e-6, side="right"))
        for low in range(start, last, _CHUNK):
            high = min(low + _CHUNK, last)
            both = letters[start:end] @ letters[low:high].T
            i, j = np.nonzero(both >= np.minimum(part[start:end, None] + part[None, low:high], have[start:end, None]))
            i, j = i + start, j + low
            ok = i < j if sides is None else (i < j) & (sides[i] != sides[j])
            i, j = i[ok], j[ok]
            a, b = pairs[i], pairs[j]
            near = np.bitwise_count(a ^ b).sum(axis=1) <= 3 * (1 - SIMILAR) * (n[i] + n[j]) + 1e-6
            held = (np.bitwise_count(a & ~b).sum(axis=1) == 0) & (n[i] < n[j]) & (100 * n[i] >= round(100 * CONTAINS) * n[j])
            ok = near | held
            yield i[ok], j[ok]


def _judge(key: tuple, rows: pa.Table) -> pa.Table:
    """The near pairs of one block, or of two blocks that meet."""
    kind, by, x, y = (k.as_py() for k in key)
    told = [("".join(k.split()), k, i, b) for k, i, b in zip(*(rows.column(c).to_pylist() for c in ("key", "item_id", "_b")), strict=True)]
    told.sort(key=lambda r: (len(r[0]), r[1]))
    names = [r[0] for r in told]
    out: list[tuple[str, str, str, float]] = []
    for i, j in _close_pairs(names, None if x == y else np.array([r[3] for r in told])):
        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            a, d = names[p], names[q]
            # pairs of one first letter are listed there, others of one last letter there
            if by[0] != "f" and a[0] == d[0] or by[0] == "t" and a[-1] == d[-1]:
                continue
            if len(a) < len(d) and 100 * len(a) >= round(100 * CONTAINS) * len(d) and a in d:
                out.append((told[p][1], told[q][1], CONTAINED, len(a) / len(d)))
            elif 2 * _common(a, d) >= SIMILAR * (len(a) + len(d)) - 1e-9:
                one, other = (a, d) if told[p][2] < told[q][2] else (d, a)
                if (r := SequenceMatcher(None, one, other).ratio()) >= SIMILAR:
                    out.append((told[p][1], told[q][1], NEAR, round(r, 4)))
    cols = [pa.array([r[c] for r in out], t) for c, t in enumerate((pa.string(), pa.string(), pa.string(), pa.float64()))]
    return pa.table([pa.array([kind] * len(out), pa.string()), *cols], names=["kind", "key", "key2", "reason", "score"])


def near_spelling(names: DataFrame, block: int = NEAR_BLOCK) -> DataFrame:
    """Rules 3a and 3c: one compact name contains the other, or their sequence ratio is high; (kind, l, r, reason, score).

    Both rules ask for names with the same first or last letter or a common word, so names meet there, in blocks. Only
    names are moved: inside a block the letters and letter pairs that names share leave few pairs for the rules themselves.
    """
    c = names.select("kind", "key", "item_id", F.regexp_replace("key", r"(?U)\s+", "").alias("c")).filter("c <> ''")
    values = F.concat(F.array(F.concat(F.lit("f"), F.left("c", F.lit(1))), F.concat(F.lit("l"), F.right("c", F.lit(1)))), F.transform(name_tokens(F.col("key")), lambda t: F.concat(F.lit("t"), t)))
    met = _blocks(c.select("kind", "key", "item_id", F.explode(values).alias("_v")), "_v", block)
    found = met.select("kind", "_v", "_x", "_y", "key", "item_id", "_b").groupBy("kind", "_v", "_x", "_y").applyInArrow(_judge, "kind string, key string, key2 string, reason string, score double").distinct()
    return found.select("kind", F.least("key", "key2").alias("l"), F.greatest("key", "key2").alias("r"), "reason", F.round("score", 4).alias("score"))


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, in one integer: a bit a letter."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & at.get(x, 0)
        row = (row + hit) | (row - hit)
    return (~row & full).bit_count()


def candidate_pairs(view: DataFrame) -> DataFrame:
    """(kind, l, r, reason): the first rule that names a pair gives its reason."""
    view = cut(view.select("item_id", "kind", "key", "name", "aliases"))
    names = cut(distinct_names(view))
    near = cut(near_spelling(names))
    rules = [shared_alias(view), same_compact(names), near.filter(F.col("reason") == CONTAINED), token_overlap(names), near.filter(F.col("reason") == NEAR)]
    out = None
    for rank, r in enumerate(rules):
        part = r.select("kind", "l", "r", "reason", F.lit(rank).alias("rank"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("kind", "l", "r").agg(F.min(F.struct("rank", "reason")).alias("_b")).select("kind", "l", "r", F.col("_b.reason").alias("reason"), (F.col("_b.rank") + 1).alias("rule"))


def limited_pairs(pairs: DataFrame, limit: int = 200) -> DataFrame:
    """The strongest pairs of each kind, at most ``limit``: the cap on judgements is a feature of the merger.

    The ranks are limited in every partition before the shuffle (a group limit), so one task gets ``limit`` rows of each.
    """
    w = Window.partitionBy("kind").orderBy("rule", "l", "r")
    return pairs.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n")


def truncation(pairs: DataFrame, limit: int = 200) -> DataFrame:
    """(kind, n_pairs, n_kept, warning): what the cap on judgements leaves out; no warning where nothing is left out."""
    n = pairs.groupBy("kind").agg(F.count("*").alias("n_pairs"))
    kept = F.least(F.col("n_pairs"), F.lit(limit).cast("long"))
    text = F.concat(F.lit(f"candidate pairs truncated to {limit} (of "), F.col("n_pairs").cast("string"), F.lit("); raise max_judgements to judge more"))
    return n.select("kind", "n_pairs", kept.alias("n_kept"), F.when(F.col("n_pairs") > limit, text).alias("warning"))
