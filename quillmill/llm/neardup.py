"""Records that repeat each other with small edits.

Two texts are alike if the words they share (as multisets) are at least ``share`` of the words of the longer one.

1. Exact copies (same multiset of words) are folded into one representative; all later work is on representatives.
2. Words are ordered by a hashed corpus count (2**20 counters over all records, a bounded table; any total order keeps
   the filter exact). Of n words, the n - ceil(share * n) + 1 rarest occurrences form the prefix: two alike texts share
   one word of it, two of the prefix that is one longer, and three of the one that is two longer. A prefix word whose
   counter is at most ``often`` names a shard (a counter of 1 is left out: the word occurs nowhere else); of the more
   frequent words each pair does, because alike texts without a common rarer word share two frequent ones; and a pair
   that more than ``hot`` records have (counted over all records, among words above ``hot``) is replaced by its triples
   while texts are short. So shards keep their size when the data grow and the words do not.
3. Inside a shard a BK-tree is grown over parity codes (each word occurrence flips one bit), children keyed by the
   Hamming distance to their parent. Texts that differ by d word occurrences differ in at most d bits, so following only
   edges within the largest possible difference 2 * floor((1 - share) * n) loses nothing. Codes have at least twice as many
   bits as texts have words, so that the radius stays small against the distance of unrelated texts: texts are searched
   in classes of length with codes of 64, 256, 1024... bits; those near a border are in both classes, so that two alike texts
   meet in one. Members arrive in order of length; each one searches the tree and then joins it.
4. A hot pair of longer texts, and a word or triple that stays hot, is cut into blocks: every record joins the tree of
   one block and searches the trees of all blocks, so a hot shard is never one task and no pair is lost.
5. Candidates are made distinct and verified on their words.

Trees are sent to their queries by one shuffle on the shard key and not by a broadcast, because they grow with the
data. Defined results: null and empty texts and texts below ``least`` words take no part; repeated rows of one id count
once; ids are compared within one table only; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.components import components
from quillmill.session import cut

COUNTERS = 1 << 20
EPS = 1e-9


def records(df: DataFrame, table: str, id_col: str, text_col: str, least: int = 8) -> DataFrame:
    """(record_table, record_id, words): the words of each text, sorted and joined by one space."""
    words = F.array_sort(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    d = df.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("record_id"), words.alias("_w"))
    return d.filter(F.size("_w") >= least).select(F.lit(table).alias("record_table"), "record_id", F.array_join("_w", " ").alias("words"))


class BKTree:
    """Integer codes of any width under the Hamming metric; a node is [code, values, {distance: node}]."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, code: int, value: object) -> None:
        node = self.root
        if node is None:
            self.root = [code, [value], None]
            return
        while True:
            d = (code ^ node[0]).bit_count()
            if not d:
                node[1].append(value)
                return
            kids = node[2]
            if kids is None:
                node[2] = {d: [code, [value], None]}
                return
            kid = kids.get(d)
            if kid is None:
                kids[d] = [code, [value], None]
                return
            node = kid

    def within(self, code: int, radius: int) -> Iterator[tuple[int, object]]:
        if self.root is None:
            return
        todo = [self.root]
        while todo:
            node = todo.pop()
            d = (code ^ node[0]).bit_count()
            if d <= radius:
                for v in node[1]:
                    yield d, v
            if node[2]:
                for at, kid in node[2].items():
                    if d - radius <= at <= d + radius:
                        todo.append(kid)


def _word_slot(h: int) -> int:
    return h >> 6 & COUNTERS - 1


def word_counters(reps: DataFrame) -> np.ndarray:
    """Number of representatives by hashed word: a table of fixed size, counted over all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        slots: dict[str, int] = {}
        for b in batches:
            found: list[int] = []
            for text in b.column(0).to_pylist():
                for w in set(text.split(" ")):
                    s = slots.get(w)
                    if s is None:
                        if len(slots) > 500_000:
                            slots.clear()
                        s = slots[w] = _word_slot(xxhash.xxh64_intdigest(w))
                    found.append(s)
            total += np.bincount(np.array(found, np.int64), minlength=COUNTERS) if found else 0
        at = np.nonzero(total)[0]
        for i in range(0, len(at), 100_000):
            part = at[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(total[part], pa.int64())], names=["slot", "n"])

    return _summed(reps.select("words").mapInArrow(count, "slot long, n long"))


def _summed(parts: DataFrame) -> np.ndarray:
    """The counters of all tasks as one table of fixed size."""
    got = parts.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return out


_ALL = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: Longest text of the first class of length; codes of a class have twice as many bits, each class is four times as long.
FIRST = 32


def classes(n: int, share: float) -> Iterator[int]:
    """The classes of length that a text of n words is searched in: its own, and the next one near the border."""
    k, most = 0, FIRST
    while n > most:
        k, most = k + 1, most * 4
    yield k
    if n > share * most:
        yield k + 1


class _Text:
    """The hashed words of a text and, when asked for, their order in the filter."""

    __slots__ = ("counts", "cut", "hashes", "n", "order")

    def __init__(self, words: str, count: np.ndarray, share: float):
        self.hashes = [xxhash.xxh64_intdigest(w) for w in words.split(" ")]
        self.n = len(self.hashes)
        self.counts = count[[h >> 6 & COUNTERS - 1 for h in self.hashes]]
        self.cut = self.n - ceil(share * self.n - EPS) + 1

    def ordered(self) -> _Text:
        """With ``order``: (count, hash) of the rarest occurrences; further ones of a word are words of their own."""
        self.order, last, nth = [], 0, 0
        for c, h in sorted(zip(self.counts.tolist(), self.hashes, strict=True))[: self.cut + 2]:
            nth = nth + 1 if h == last else 0
            last = h
            self.order.append((c, (h + nth) * 0xBF58476D1CE4E5B9 & _ALL if nth else h))
        return self

    def has_pairs(self, above: int) -> bool:
        """Whether two of the first ``cut`` + 1 words are more frequent."""
        return int((self.counts <= above).sum()) < self.cut

    def code(self, bits: int) -> bytes:
        """One bit for each word occurrence, flipped."""
        code = 0
        for h in self.hashes:
            code ^= 1 << ((h ^ h >> 29) & bits - 1)
        return code.to_bytes(bits >> 3, "big")

    def pairs(self, above: int, upto: int) -> Iterator[tuple[int, int, int, int]]:
        """(i, j, smaller count, key) of the pairs of words more frequent than ``above`` among the first ``upto``."""
        some = [(i, c, h) for i, (c, h) in enumerate(self.order[:upto]) if c > above]
        for x, (i, c, h) in enumerate(some):
            for j, _, g in some[x + 1 :]:
                yield i, j, c, _joined(h, g)


def _joined(h: int, g: int) -> int:
    return (h * 0x9E3779B97F4A7C15 ^ (g >> 7) * 0x94D049BB133111EB) & _ALL


def pair_counters(reps: DataFrame, counters, share: float, hot: int) -> np.ndarray:
    """Records by hashed pair of words above ``hot``: only such pairs can be hot."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for b in batches:
            for words in b.column(0).to_pylist():
                t = _Text(words, counters.value, share)
                if t.has_pairs(hot):
                    total.update(_word_slot(key) for _, _, _, key in t.ordered().pairs(hot, t.cut + 1))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["slot", "n"])

    return _summed(reps.select("words").mapInArrow(count, "slot long, n long"))


def shard_keys(t: _Text, k: int, pair_count: np.ndarray | None, hot: int, often: int) -> Iterator[tuple[int, int]]:
    """(key, blocks) of a text in class k."""
    for c, h in dict.fromkeys(t.order[: t.cut]):
        if 1 < c <= often:
            yield h, 1 + c // hot
    for i, j, c, key in t.pairs(often, t.cut + 1):
        n = c if pair_count is None or c <= hot else int(pair_count[_word_slot(key)])
        if n <= hot:
            yield key, 1
        elif k:
            yield key, 1 + n // hot
        else:
            for _, h in t.order[j + 1 : t.cut + 2]:
                yield _joined(key, h), 1


def _shards(reps: DataFrame, counters, pair_count, share: float, hot: int, often: int, tables: list[str]) -> DataFrame:
    """(shard, block, adds, n, code, rep, tab): one row per prefix word, pair or triple, several for hot shards."""
    place = {t: i for i, t in enumerate(tables)}

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, pairs = counters.value, None if pair_count is None else pair_count.value
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [], [])
            shard, at, adds, size, codes, ids, tabs = cols
            for table, rep, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                t = _Text(words, count, share).ordered()
                for k in classes(t.n, share):
                    code = t.code(64 * 4**k)
                    tab = place[table] * 64 + k
                    salt = tab * 0xD6E8FEB86659FD93
                    for key, blocks in shard_keys(t, k, pairs, hot, often):
                        mine = (rep * 0x9E3779B97F4A7C15 >> 20) % blocks
                        for block in range(blocks):
                            shard.append(_signed(key + salt & _ALL))
                            at.append(block)
                            adds.append(block == mine)
                            size.append(t.n)
                            codes.append(code)
                            ids.append(rep)
                            tabs.append(tab)
            kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], names=["shard", "block", "adds", "n", "code", "rep", "tab"])

    return reps.select("record_table", "rep", "words").mapInArrow(emit, "shard long, block int, adds boolean, n int, code binary, rep long, tab int")


def _search(share: float, tables: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree = None, BKTree()
        for b in batches:
            if not b.num_rows:
                continue
            shards, blocks = b.column(0).to_numpy(), b.column(1).to_numpy()
            # a row whose neighbours belong to other shards is alone there, unless it touches the border of the batch
            same = (shards[1:] == shards[:-1]) & (blocks[1:] == blocks[:-1])
            busy = np.zeros(b.num_rows, bool)
            busy[1:] |= same
            busy[:-1] |= same
            busy[0] = busy[-1] = True
            part = b.filter(pa.array(busy))
            out: tuple[list, list, list] = ([], [], [])
            for shard, block, adds, n, code, rep, tab in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if (shard, block, tab) != now:
                    now, tree = (shard, block, tab), BKTree()
                code = int.from_bytes(code, "big")
                need = ceil(share * n - EPS)
                if tree.root is not None:
                    for d, (m, other) in tree.within(code, 2 * (n - need)):
                        if m >= need and d <= n + m - 2 * need and other != rep:
                            out[0].append(tables[tab >> 6])
                            out[1].append(min(rep, other))
                            out[2].append(max(rep, other))
                if adds:
                    tree.add(code, (n, rep))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["record_table", "a", "b"])

    return run


def _verify(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                x, y = x.split(" "), y.split(" ")
                both = sum((Counter(x) & Counter(y)).values())
                keep.append(both >= share * max(len(x), len(y)) - EPS)
            yield b.select([0, 1, 2]).filter(pa.array(keep, pa.bool_()))

    return run


class NearDuplicates:
    """Representatives, links between them, and membership."""

    def __init__(self, parts: list[DataFrame], share: float = 0.8, hot: int = 4000, often: int = 64):
        spark = parts[0].sparkSession
        self.members = reduce(DataFrame.unionByName, parts)
        self.reps = cut(
            self.members.groupBy("record_table", "words").agg(F.min("record_id").alias("rep"), (F.max("record_id") > F.min("record_id")).alias("many"))
        )
        counters = spark.sparkContext.broadcast(word_counters(self.reps))
        tables = sorted(r[0] for r in self.reps.select("record_table").distinct().collect())
        frequent = bool((counters.value > hot).any())
        pairs = spark.sparkContext.broadcast(pair_counters(self.reps, counters, share, hot)) if frequent else None
        shards = _shards(self.reps, counters, pairs, share, hot, often, tables)
        # one row order inside a shard: shorter texts first, members of the block's tree before pure queries of that length
        lined = shards.repartition("shard", "block").sortWithinPartitions("shard", "block", "tab", "n", F.col("adds").desc(), "rep")
        cand = lined.mapInArrow(_search(share, tables), "record_table string, a long, b long").distinct()
        words = self.reps.select("record_table", F.col("rep"), "words")
        joined = cand.join(words.toDF("record_table", "a", "wa"), ["record_table", "a"]).join(words.toDF("record_table", "b", "wb"), ["record_table", "b"])
        links = joined.select("record_table", "a", "b", "wa", "wb").mapInArrow(_verify(share), "record_table string, a long, b long")
        self.links = cut(links)

    def copies(self) -> DataFrame:
        """(record_table, rep, record_id) of the representatives that stand for more than one id."""
        many = self.reps.filter("many").select("record_table", "words", "rep")
        return self.members.join(many, ["record_table", "words"]).select("record_table", "rep", "record_id").distinct()

    def pairs(self) -> DataFrame:
        """All alike pairs (record_table, low_id, high_id), copies included."""
        copies = cut(self.copies())
        side = lambda c: copies.select("record_table", F.col("rep").alias(c), F.col("record_id").alias(f"{c}_id"))
        wide = self.links.join(side("a"), ["record_table", "a"], "left").join(side("b"), ["record_table", "b"], "left")
        between = wide.select("record_table", F.coalesce("a_id", "a").alias("x"), F.coalesce("b_id", "b").alias("y"))
        inside = side("a").join(side("b").withColumnRenamed("b", "a"), ["record_table", "a"]).filter("a_id < b_id").select("record_table", F.col("a_id").alias("x"), F.col("b_id").alias("y"))
        both = between.unionByName(inside).filter("x <> y")
        return both.select("record_table", F.least("x", "y").alias("low_id"), F.greatest("x", "y").alias("high_id")).distinct()

    def groups(self) -> DataFrame:
        """(record_table, record_id, group_id, n_links): records alike directly or through others; copies keep their class."""
        tables = sorted(r[0] for r in self.reps.select("record_table").distinct().collect())
        out = None
        for t in tables:
            links = self.links.filter(F.col("record_table") == t)
            degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
            comp = components(links.select("a", "b")).withColumnRenamed("id", "rep")
            copies = self.copies().filter(F.col("record_table") == t).select("rep", "record_id")
            seen = comp.select("rep").unionByName(copies.select("rep")).distinct().join(comp, "rep", "left").join(degree, "rep", "left").join(copies, "rep", "left")
            rows = seen.select(F.lit(t).alias("record_table"), F.coalesce("record_id", "rep").alias("record_id"), F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
            out = rows if out is None else out.unionByName(rows)
        return out
