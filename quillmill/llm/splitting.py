"""Splitting oversized texts at natural boundaries (structure-tree packing).

A text is parsed into a tree: headings by level, then blocks (paragraphs, lists, tables, code fences, HTML blocks), then
list items or lines, sentences, clauses and words. Nodes are kept as spans of the text, nothing is copied or lost.
Packing goes bottom-up: a node that fits is one unit; an oversized node is replaced by the units of its children, and
neighbouring siblings are merged as long as they fit, a heading always with what follows it. Only oversized nodes are
descended into; words above the limit are cut by characters as the last resort.

Each piece but the first begins exactly ``overlap`` characters before the end of its predecessor, and every piece,
overlap included, has at most ``max_size`` characters. Without the overlaps the pieces give back the text exactly.

Defined results: null and empty texts and texts within the limit give no pieces; repeated deliveries of one key count
once (the smallest text of the key); rows without key are left out; ``overlap`` must be smaller than ``max_size``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Span = tuple[int, int]
_FENCE = re.compile(r"[ \t]{0,3}(```+|~~~+)")
_ATX = re.compile(r"[ \t]{0,3}(#{1,6})[ \t]+\S")
_WIKI = re.compile(r"(={2,6})[^=\n].*?\1[ \t]*$")
_TEX = re.compile(r"\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\{")
_HTML = re.compile(r"<h([1-6])\b", re.I)
_ITEM = re.compile(r"[ \t]*(?:[-*+•]|\d+[.)]|\\item\b|<li\b)[ \t]*", re.I)
_TEX_LEVEL = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
#: Boundaries inside a block, from coarse to fine; each match ends a unit.
_CUTS = (
    re.compile(r"\n"),
    re.compile(r"[.!?…]+[\"'”’)\]]*\s+|[。！？；]+[”’」』）]*"),
    re.compile(r"[,;:，、：]+\s*|\s[–—-]\s"),
    re.compile(r"\s+"),
)


def _lines(text: str) -> list[Span]:
    out, at = [], 0
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end + 1
        out.append((at, end))
        at = end
    return out


def _heading(text: str, lines: list[Span], i: int) -> int:
    """Level of the heading that starts on line i, 0 if none."""
    line = text[lines[i][0] : lines[i][1]].rstrip()
    if not line:
        return 0
    if m := _ATX.match(line):
        return len(m.group(1))
    if m := _WIKI.match(line):
        return len(m.group(1))
    if m := _TEX.match(line.lstrip()):
        return _TEX_LEVEL[m.group(1)]
    if m := _HTML.match(line.lstrip()):
        return int(m.group(1))
    if i + 1 < len(lines):
        under = text[lines[i + 1][0] : lines[i + 1][1]].strip()
        if len(under) >= 3 and set(under) in ({"="}, {"-"}) and not (i and text[lines[i - 1][0] : lines[i - 1][1]].strip()):
            return 1 if under[0] == "=" else 2
    return 0


class Node:
    """A span with children that tile it; ``head`` is the end of a heading that stays with what follows."""

    __slots__ = ("end", "head", "kids", "start")

    def __init__(self, start: int, end: int, head: int = 0):
        self.start, self.end, self.head, self.kids = start, end, head or start, []


def _blocks(text: str, lines: list[Span]) -> list[tuple[int, int, int, int]]:
    """(start, end, heading level, kind): blank lines belong to the block before; kind 1 is a list."""
    out: list[list[int]] = []
    fence, open_new = "", True
    for i, (a, b) in enumerate(lines):
        line = text[a:b]
        blank = not line.strip()
        if fence:
            out[-1][1] = b
            if line.strip().startswith(fence):
                fence, open_new = "", True
            continue
        m = _FENCE.match(line)
        if m:
            out.append([a, b, 0, 0])
            fence = m.group(1)
            continue
        if blank and out:
            out[-1][1] = b
            open_new = True
            continue
        level = 0 if blank else _heading(text, lines, i)
        item = not blank and _ITEM.match(line) is not None
        if level or open_new or not out or out[-1][2] and not _underline(line):
            if item and out and out[-1][3] and not level and open_new:
                out[-1][1] = b
            else:
                out.append([a, b, level, int(item)])
            open_new = False
        else:
            out[-1][1] = b
    return [tuple(x) for x in out]


def _underline(line: str) -> bool:
    s = line.strip()
    return len(s) >= 3 and set(s) in ({"="}, {"-"})


def parse(text: str) -> Node:
    """Tree of headings over blocks; blocks are opened further only when packing needs it."""
    root = Node(0, len(text))
    stack = [(0, root)]
    for a, b, level, kind in _blocks(text, _lines(text)):
        if level:
            while stack[-1][0] >= level:
                stack.pop()
            node = Node(a, b, b)
            stack[-1][1].kids.append(node)
            stack.append((level, node))
        else:
            leaf = Node(a, b)
            leaf.head = -1 - kind
            stack[-1][1].kids.append(leaf)
        for _, open_node in stack[1:]:
            open_node.end = b
    return root


def _finer(text: str, a: int, b: int, step: int) -> list[Span]:
    """Units of a block at one kind of boundary."""
    cuts = [m.end() for m in _CUTS[step].finditer(text, a, b)]
    out, at = [], a
    for c in cuts:
        if at < c < b:
            out.append((at, c))
            at = c
    out.append((at, b))
    return out


def _items(text: str, a: int, b: int) -> list[Span]:
    """A list is opened item by item, continuation lines included."""
    out: list[Span] = []
    for x, y in _lines(text[a:b]):
        x, y = a + x, a + y
        if not out or _ITEM.match(text, x, y):
            out.append((x, y))
        else:
            out[-1] = (out[-1][0], y)
    return out


def _merge(units: list[Span], limit: int) -> list[Span]:
    """Merge neighbours while they fit."""
    out: list[Span] = []
    for u in units:
        if out and u[1] - out[-1][0] <= limit:
            out[-1] = (out[-1][0], u[1])
        else:
            out.append(u)
    return out


def _leaf(text: str, a: int, b: int, limit: int, step: int, listed: bool) -> list[Span]:
    if b - a <= limit:
        return [(a, b)]
    if listed and len(kids := _items(text, a, b)) > 1:
        return _merge([x for p in kids for x in _leaf(text, *p, limit, 0, False)], limit)
    while step < len(_CUTS):
        kids = _finer(text, a, b, step)
        step += 1
        if len(kids) > 1:
            return _merge([x for p in kids for x in _leaf(text, *p, limit, step, False)], limit)
    return [(i, min(i + limit, b)) for i in range(a, b, limit)]


def pack(text: str, node: Node, limit: int) -> list[Span]:
    """Units of at most ``limit`` characters that tile the node."""
    if node.end - node.start <= limit:
        return [(node.start, node.end)]
    if node.head < 0:
        return _leaf(text, node.start, node.end, limit, 0, node.head == -2)
    units: list[Span] = []
    if node.head > node.start:
        units += _leaf(text, node.start, node.head, limit, 0, False)
    first_kid = True
    for kid in node.kids:
        part = pack(text, kid, limit)
        if first_kid and units and part[0][1] - units[-1][0] > limit and part[0][1] - part[0][0] > 1:
            # a heading does not stand alone: the first unit below it is opened once more
            room = limit - (units[-1][1] - units[-1][0])
            if room > 0:
                a, b = part[0]
                fine = _leaf(text, a, b, max(1, min(room, b - a - 1)), 1, False)
                part = [*fine, *part[1:]]
        units += part
        first_kid = False
    return _merge(units, limit)


def split_text(text: str | None, max_size: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, new_start, end) of each piece; [] for texts within the limit. new_start is where new text begins."""
    if not 0 <= overlap < max_size:
        raise ValueError("overlap must be at least 0 and below max_size")
    if not text or len(text) <= max_size:
        return []
    spans = pack(text, parse(text), max_size - overlap)
    while len(spans) > 1 and spans[0][1] < overlap:
        # a first unit shorter than the overlap joins the next: together they are below max_size
        spans[:2] = [(0, spans[1][1])]
    return [(max(0, a - overlap), a, b) for a, b in spans]


def split_oversized(df: DataFrame, table: str, key: str, text: str, max_size: int, overlap: int) -> DataFrame:
    """(item_table, item_key, piece_no, start, new_start, stop, piece) of all texts above the limit.

    Only oversized rows leave the scan; the length is tested in the JVM.
    """
    big = (
        df.filter(F.col(key).isNotNull() & (F.char_length(text) > max_size))
        .select(F.col(key).cast("string").alias("item_key"), F.col(text).alias("_text"))
        .groupBy("item_key")
        .agg(F.min("_text").alias("_text"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                cols: tuple[list, ...] = ([], [], [], [], [], [])
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for i, (s, n, e) in enumerate(split_text(t, max_size, overlap)):
                        for c, v in zip(cols, (k, i + 1, s, n, e, t[s:e]), strict=True):
                            c.append(v)
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["item_key", "piece_no", "start", "new_start", "stop", "piece"])

    out = big.mapInArrow(run, "item_key string, piece_no int, start int, new_start int, stop int, piece string")
    return out.select(F.lit(table).alias("item_table"), "*")
