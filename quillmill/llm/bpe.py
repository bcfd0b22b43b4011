"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

The merges are compiled into a transducer over bytes that is determinised lazily. BPE has a local test: a sequence of
tokens is the encoding of its text if every neighbouring pair is, i.e. if merging the pair's own bytes gives the pair
back. So the last token of the encoding of each prefix is unique, and reading one byte needs to know only, for each
open start position, (a) the node reached in the trie of token bytes and (b) the token that ends at that start. That
set of (node, token) items is the state; starts whose bytes are no prefix of a token drop out, so lookahead is bounded
by the longest token. States and transitions are built when first met and shared by all words; each transition carries
the token that ends at the byte read. Tokens become final as soon as every open start descends from their end; at the
end of a word the chain of last tokens is followed back.

Words are the matches of the vocabulary's split pattern. Finished words are kept in a bounded table per worker, states
in a bounded table as well (both are emptied when full, which changes nothing but time).

Defined results: null and empty texts give an empty list of ids; texts without a valid encoding do not exist (all 256
bytes are tokens); a lone surrogate is encoded as U+FFFD; very long words take time in proportion to their length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Fixed value: the split pattern of the vocabulary.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def vocabulary_path(spark=None) -> str:
    """Place of the vocabulary file: setting quillmill.tokenizer.path, else the public default."""
    return (spark.conf.get("quillmill.tokenizer.path", DEFAULT_VOCABULARY) if spark is not None else None) or DEFAULT_VOCABULARY


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class _State(dict):
    """Transitions by byte: (next state, id of the token ending here); ``items`` is the open (node, token, age) set."""

    __slots__ = ("items_",)


class MergeTransducer:
    """Lazily determinised transducer for one vocabulary of ranks."""

    MAX_STATES = 400_000
    MAX_WORDS = 600_000

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.size = {i: len(b) for b, i in ranks.items()}
        self._trie(ranks)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words = _Words(self)
        self._reset()

    def _trie(self, ranks: dict[bytes, int]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for b, i in ranks.items():
            n = 0
            for x in b:
                m = self.next[n].get(x)
                if m is None:
                    m = len(self.next)
                    self.next.append({})
                    self.token.append(-1)
                    self.next[n][x] = m
                n = m
            self.token[n] = i

    def _reset(self) -> None:
        self.states: dict[tuple, _State] = {}
        self.start = self._state(((0, -1),))

    def _state(self, items: tuple) -> _State:
        s = self.states.get(items)
        if s is None:
            s = self.states[items] = _State()
            s.items_ = items
        return s

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE of a short byte string: merge the pair of lowest rank, leftmost first, until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether the pair is the encoding of its own bytes."""
        if left < 0:
            known = self.pairs.get((left, right))
            if known is None:
                known = self.pairs[(left, right)] = self.merge(self.bytes_of[right]) == [right]
            return known
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            known = self.pairs[(left, right)] = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def _step(self, state: _State, byte: int) -> tuple[_State, int]:
        open_items, last = [], -1
        for node, before in state.items_:
            n = self.next[node].get(byte)
            if n is None:
                continue
            if self.next[n]:
                open_items.append((n, before))
            t = self.token[n]
            if t >= 0 and last < 0 and self.fits(before, t):
                last = t
        assert last >= 0, "every prefix has an encoding"
        open_items.append((0, last))
        to = (self._state(tuple(open_items)), last)
        state[byte] = to
        return to

    def encode_word(self, data: bytes) -> tuple[int, ...]:
        if len(self.states) > self.MAX_STATES:
            self._reset()
        state, ends = self.start, []
        for x in data:
            to = state.get(x) or self._step(state, x)
            state = to[0]
            ends.append(to[1])
        out, at, size = [], len(data), self.size
        while at > 0:
            t = ends[at - 1]
            out.append(t)
            at -= size[t]
        out.reverse()
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return list(chain.from_iterable(map(self.words.__getitem__, _FIND(text))))

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.words.__getitem__, _FIND(text)))) if text else 0


class _Words(dict):
    """Finished words; a missing word goes through the transducer."""

    def __init__(self, machine: MergeTransducer):
        super().__init__()
        self.machine = machine

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > self.machine.MAX_WORDS:
            self.clear()
        ids = self.machine.encode_word(word.encode("utf-8", "replace") if word.isascii() else _utf8(word))
        if len(word) <= 64:
            self[word] = ids
        return ids


_FIND = regex.compile(SPLIT).findall
_MACHINES: dict[str, MergeTransducer] = {}


def _utf8(word: str) -> bytes:
    try:
        return word.encode("utf-8")
    except UnicodeEncodeError:
        return "".join("�" if "\ud800" <= c <= "\udfff" else c for c in word).encode("utf-8")


def machine(path: str = DEFAULT_VOCABULARY) -> MergeTransducer:
    """The transducer of this worker, made once per vocabulary file."""
    if path not in _MACHINES:
        _MACHINES[path] = MergeTransducer(read_ranks(path))
    return _MACHINES[path]


def encode_column(df: DataFrame, text: str, key: str, path: str, out: str = "ids") -> DataFrame:
    """(key, ids) of every row."""
    schema = StructType([df.schema[key], StructField(out, ArrayType(IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(path)
        for b in batches:
            keys, texts = b.column(0), b.column(1)
            for at in range(0, len(texts), 2000):
                part = texts.slice(at, 2000).to_pylist()
                ids = [m.encode(t) for t in part]
                yield pa.RecordBatch.from_arrays([keys.slice(at, 2000), pa.array(ids, pa.list_(pa.int32()))], names=[key, out])

    return df.select(key, text).mapInArrow(run, schema)


def count_tokens(df: DataFrame, text: str, key: str, path: str, out: str = "n_tokens") -> DataFrame:
    """(key, number of tokens) of every row."""
    schema = StructType([df.schema[key], StructField(out, IntegerType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.count(t) for t in b.column(1).to_pylist()], pa.int32())], names=[key, out])

    return df.select(key, text).mapInArrow(run, schema)


class Utf8Decoder:
    """Incremental UTF-8 state machine for streamed tokens: bytes in, finished characters out.

    Invalid bytes give U+FFFD each time a sequence breaks; an unfinished sequence waits for more bytes until ``end``.
    """

    def __init__(self) -> None:
        self.need, self.value, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out, i = [], 0
        while i < len(data):
            b = data[i]
            if self.need:
                if self.low <= b <= self.high:
                    self.value, self.need, self.low, self.high = self.value << 6 | b & 0x3F, self.need - 1, 0x80, 0xBF
                    if not self.need:
                        out.append(chr(self.value))
                    i += 1
                else:
                    out.append("�")
                    self.need, self.low, self.high = 0, 0x80, 0xBF
                continue
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.need, self.value = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.need, self.value, self.low, self.high = 2, b & 0x0F, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
            elif 0xF0 <= b <= 0xF4:
                self.need, self.value, self.low, self.high = 3, b & 0x07, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
            else:
                out.append("�")
            i += 1
        return "".join(out)

    def end(self) -> str:
        left, self.need = self.need, 0
        return "�" if left else ""


def decode(ids: list[int] | None, path: str = DEFAULT_VOCABULARY) -> str:
    """Text of token ids, decoded token by token."""
    m, d = machine(path), Utf8Decoder()
    return "".join([d.feed(m.bytes_of[i]) for i in ids or []] + [d.end()])


def decode_column(df: DataFrame, ids: str, key: str, path: str, out: str = "text") -> DataFrame:
    """(key, text) of rows of token ids; null ids give an empty text."""
    schema = StructType([df.schema[key], StructField(out, StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode(x, path) for x in b.column(1).to_pylist()], pa.string())], names=[key, out])

    return df.select(key, ids).mapInArrow(run, schema)


__all__ = ["MergeTransducer", "Utf8Decoder", "count_tokens", "decode", "decode_column", "encode_column", "machine", "read_ranks", "vocabulary_path"]
