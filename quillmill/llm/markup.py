"""Markup residue: find HTML, Markdown, wiki and LaTeX in texts and convert them to clean text with structure.

A text is parsed once. Block tags and environments become lines, lines become blocks (headings, lists, tables, code,
formulas, notes, paragraphs), and what stands inside a line is converted; every construct that is consumed, or kept as a
formula or command, notes its family, so the families of a text come from the same pass as its clean text. Lines made from
tags carry a mark and do not count as Markdown. Constructs shown inside code count as well. Two passes label the blocks:

1. each block is judged alone by its length, its density of stop words (or of letters, for scripts without spaces) and
   its link density, with links of all four families: *text* (many stop words, or some in a long block), *residue* (mostly
   links) or *undecided*;
2. undecided blocks take the label of the nearest decided neighbour; between two different neighbours the nearer one
   counts, and text on a tie; headings follow the block below them. Where nothing is decided, all is text.

Clean text keeps headings as ``# title``, lists as ``- item`` and ``1. item``, code blocks between fences, tables as
rows of ``a | b`` and formulas between dollars; emphasis, tags, templates and link targets go, link texts stay,
character entities become characters. Residue blocks are left out of the clean text.

Defined results: null and empty texts have no families and null or empty clean text; diagram sources keep their text;
rows without key are left out; repeated deliveries of a key count once (the smallest text of the key).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAMILIES = ("html", "markdown", "wiki", "latex")
#: Element names of HTML.
_TAGS = (
    "a abbr address area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup "
    "data dd del details dfn dialog div dl dt em embed fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "i iframe img input ins kbd label legend li link main map mark meta meter nav noscript object ol optgroup option output p param "
    "picture pre progress q rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table "
    "tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr"
)
_TAG = r"</?(?:" + "|".join(sorted(_TAGS.split(), key=len, reverse=True)) + r")(?:\s[^<>]*)?/?>"
#: Frequent function words of the languages in view.
STOP_WORDS = frozenset(
    "the a an of and or to in on for with as by at from is are was were be been it its this that these those which who not no but if while "
    "each every any all her his our my their has have had into than then so such "
    "der die das den dem des ein eine einen und oder zu in im auf für mit als von aus bei nach ist sind nicht aber wenn jede alle ohne über "
    "le la les un une des du de et ou à au aux en dans pour avec par sur est sont ne pas que qui chaque sans ses "
    "o os as um uma e do da dos das no na nos nas para com por em é são não que cada sem "
    "и в на с по не что как для из от за к у о без или это каждую все".split()
)

# --- inside a line --------------------------------------------------------------------------------------------------

_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|([A-Za-z][A-Za-z0-9]{1,30}));")
_ANY_TAG = re.compile(_TAG, re.I)
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_SCRIPT = re.compile(r"<(script|style)\b[^<>]*>.*?</\1\s*>", re.S | re.I)
_CODE = re.compile(r"(?<!`)`([^`\n]+)`(?!`)")
_FORMULA = re.compile(
    r"\$\$[^$]+\$\$|(?<![\\$\w])\$(?![\s\d]*[\d.,]*\s)(?=[^$\n]*[\\^_={}+<>])[^\s$][^$\n]*?(?<!\s)\$(?![\d$])|(?<![\\$\w])\$[A-Za-z]\$|\\\([^\n]+?\\\)|\\\[[^\n]+?\\\]"
)
#: Commands and symbols that stand for LaTeX wherever they stand; the known ones are converted below.
_COMMAND = re.compile(
    r"(?<![\w:\\])\\[A-Za-z]{2,}\*?(?:\[[^\]\n]*\])?\{|(?<![\w:\\])\\(?:item|maketitle|noindent|newpage|tableofcontents|label|ldots|dots|par)\b"
    r"|\\(?:frac|sum|prod|int|alpha|beta|gamma|delta|epsilon|lambda|mu|sigma|theta|pi|omega|leq?|geq?|neq?|cdot|times|cap|cup|in|infty|sqrt|log|exp|max|min|to|approx|ldots|quad)(?![A-Za-z])"
    r"|[ \t]\\\\[ \t]*$|\\[%&](?=\s|$)|~\\(?:ref|cite|eqref)\b",
    re.M,
)
_LINKS = (
    ("html", "<", re.compile(r"<a\b[^<>]*>([^<>]*)</a\s*>", re.I)),
    ("wiki", "[[", re.compile(r"\[\[(?![Cc]ategory:|[Ff]ile:|[Ii]mage:)(?=[^\[\]\n]*[^\W\d])(?:[^\[\]|\n]*\|)*([^\[\]|\n]*)\]\]")),
    ("wiki", "[http", re.compile(r"\[https?://[^\s\]]+[ ]([^\]\n]+)\]")),
    ("markdown", "](", re.compile(r"!?\[([^\[\]\n]*)\]\([^()\s]+(?:[ \t]+\"[^\"\n]*\")?\)")),
    ("latex", "\\href", re.compile(r"\\href\{[^{}]*\}\{([^{}]*)\}")),
    ("latex", "\\url", re.compile(r"\\url\{([^{}]*)\}")),
)
#: What stands inside a line: family (none: escapes), a sign to look for first, pattern, what stays.
_INLINE = (
    ("html", "<!--", _COMMENT, ""),
    ("html", "<", _SCRIPT, ""),
    ("wiki", "{{", re.compile(r"\{\{[^{}]*[^\W\d][^{}]*\}\}"), ""),
    ("wiki", "[[", re.compile(r"\[\[(?:[Cc]ategory|[Ff]ile|[Ii]mage):[^\[\]]*\]\]"), ""),
    ("wiki", "__", re.compile(r"__[A-Z]{3,}__"), ""),
    ("markdown", "[^", re.compile(r"\[\^[\w-]+\]"), ""),
    ("wiki", "''", re.compile(r"(?<!')'{2,5}(?=[^\s'])([^'\n]+?)(?<=[^\s'])'{2,5}(?!')"), r"\1"),
    ("markdown", "**", re.compile(r"\*\*(?=\S)([^*\n]+?)(?<=\S)\*\*"), r"\1"),
    ("markdown", "*", re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]*?)(?<=[^\s*])\*(?![\w*])"), r"\1"),
    ("markdown", "__", re.compile(r"(?<![\w\\])__(?=[^\s_])([^\n]+?)(?<=[^\s_])__(?!\w)"), r"\1"),
    ("markdown", "_", re.compile(r"(?<![\w\\$])_(?=[^\s_])([^_\n]*?)(?<=[^\s_])_(?![\w$])"), r"\1"),
    ("markdown", "~~", re.compile(r"~~(?=\S)([^~\n]+?)(?<=\S)~~"), r"\1"),
    ("latex", "\\", re.compile(r"~?\\(?:ref|cite|eqref|label)\{[^{}]*\}"), ""),
    ("latex", "\\footnote", re.compile(r"\\footnote\{([^{}]*)\}"), r" (\1)"),
    ("latex", "\\", re.compile(r"\\(?:textbf|textit|emph|texttt|underline|textsc|mbox|text)\{([^{}]*)\}"), r"\1"),
    ("latex", "\\\\", re.compile(r"[ \t]+\\\\[ \t]*$", re.M), ""),
    (None, "\\", re.compile(r"\\([%&_#{}$])"), r"\1"),
)
_SPECIAL = re.compile(r"[\[<&*_~`{\\$]|''")

# --- lines ----------------------------------------------------------------------------------------------------------

#: Stand at the start of a line made from a tag or command, and between its cells.
_MADE, _SPLIT = "\x01", "\x02"
_BREAK = re.compile(r"<br\s*/?>|</?(?:p|div|tr|ul|ol|table)\b[^<>]*>|</(?:h[1-6]|li)\s*>", re.I)
_OPEN = re.compile(r"<h([1-6])\b[^<>]*>", re.I)
_ITEM = re.compile(r"<li\b[^<>]*>", re.I)
_CELL = re.compile(r"</t[dh]\s*>\s*<t[dh]\b[^<>]*>", re.I)
_PRE = re.compile(r"<pre\b[^<>]*>(.*?)</pre\s*>", re.S | re.I)
_MATH_BLOCK = re.compile(r"\\begin\{(equation\*?|align\*?|displaymath|math)\}(.*?)\\end\{\1\}", re.S)
_LIST_ENV = re.compile(r"^[ \t]*\\(?:begin|end)\{(?:itemize|enumerate|description|document|center|quote)\}[ \t]*$", re.M)
_SECTION = re.compile(r"[ \t]*\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\{([^{}]*)\}[ \t]*$")
_DEPTH = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
_FENCE = re.compile(r"[ ]{0,3}(```+|~~~+)")
_HEAD = re.compile(r"[ ]{0,3}(#{1,6})[ \t]+(\S.*?)[ \t]*#*[ \t]*$")
_WIKI_HEAD = re.compile(r"(={2,6})[ \t]*([^=\s][^=]*?)[ \t]*\1[ \t]*$")
_UNDER = re.compile(r"[ ]{0,3}(={3,}|-{3,})[ \t]*$")
_OTHER_RULE = re.compile(r"[ ]{0,3}(?:_{3,}|(?:\*[ ]?){3,})[ \t]*$")
_TABLE_RULE = re.compile(r"[ ]{0,3}\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*\|?[ \t]*$")
_BULLET = re.compile(r"([ \t]*)(?:([-*+•])|(\d+)[.)]|\\item(?![A-Za-z]))[ \t]+(?:\[[ xX]\][ \t]+)?(\S.*)?$")
_NOTE = re.compile(r"[ ]{0,3}\[\^?[^\]\n]+\]:[ \t]+(.*)")
_QUOTE = re.compile(r"[ ]{0,3}>[ \t]?(.*)")
#: Lists of these marks show themselves by two items in a row, one may be a figure or a sign.
_PAIRED = {"+": re.compile(r"[ ]{0,3}\+[ ]+\S"), ".": re.compile(r"[ ]{0,3}\d{1,3}\.[ ]+\S")}

#: Thresholds of the first pass: characters, share of links, shares of stop words.
SHORT, LONG, LINKY, STOP_LOW, STOP_HIGH = 60, 200, 0.6, 0.04, 0.12
_WORD = re.compile(r"[^\W\d_]+")
_WIDE = re.compile("[぀-鿿]")


class Block:
    """One block: kind, clean text, length of its links, label."""

    __slots__ = ("kind", "label", "links", "text")

    def __init__(self, kind: str, text: str, links: int = 0):
        self.kind, self.text, self.links, self.label = kind, text, links, ""


class Parse:
    """One pass over a text: its blocks, and the families of the constructs met on the way."""

    def __init__(self, text: str):
        self.families: set[str] = set()
        self.blocks: list[Block] = []
        self.linked = 0
        self.para: list[str] = []
        if "\x00" in text or _MADE in text or _SPLIT in text:
            text = re.sub("[\x00-\x02]", " ", text)
        lines = self._unfold(text).split("\n")
        self._read(lines)

    # inside a line

    def _sub(self, family: str | None, pattern: re.Pattern, to: str | Callable, s: str) -> str:
        s, n = pattern.subn(to, s)
        if n and family:
            self.families.add(family)
        return s

    def _linked(self, m: re.Match) -> str:
        """The text of a link; one as long as a sentence is prose and does not count for the link density."""
        shown = m.group(1)
        if len(shown) < (SHORT // 2 if _WIDE.search(shown) else SHORT):
            self.linked += len(shown)
        return shown

    def _entity(self, m: re.Match) -> str:
        if m.group(1) is not None and m.group(1) + ";" not in html5:
            return m.group()
        self.families.add("html")
        return unescape(m.group())

    def inline(self, s: str) -> str:
        """A line, or the lines of a paragraph, without markup; code and formulas are put aside first."""
        if not _SPECIAL.search(s):
            return s
        kept: list[str] = []

        def aside(m: re.Match) -> str:
            kept.append(m.group(m.lastindex or 0))
            return f"\x00{len(kept) - 1}\x00"

        if "`" in s:
            self._shown(s)
            s = self._sub("markdown", _CODE, aside, s)
        if "$" in s or "\\" in s:
            s = self._sub("latex", _FORMULA, aside, s)
            if "\\" in s and _COMMAND.search(s):
                self.families.add("latex")
        for family, sign, pattern in _LINKS:
            if sign in s:
                s = self._sub(family, pattern, self._linked, s)
        for family, sign, pattern, to in _INLINE:
            if sign in s:
                s = self._sub(family, pattern, to, s)
        if "<" in s:
            s = self._sub("html", _ANY_TAG, "", s)
            if "<!--" in s:
                self.families.add("html")
        if "&" in s:
            s = _ENTITY.sub(self._entity, s)
            if "<" in s:
                # tags that were escaped once more
                s = _ANY_TAG.sub("", s)
        while "\x00" in s:
            s = re.sub("\x00(\\d+)\x00", lambda m: kept[int(m.group(1))], s)
        return s

    def _shown(self, s: str) -> None:
        """Constructs inside code are kept as they are, and count."""
        inside = "\n".join(m.group(1) for m in _CODE.finditer(s))
        if _SPECIAL.search(inside):
            linked = self.linked
            self.inline(inside.replace("`", " "))
            self.linked = linked

    # lines

    def _unfold(self, text: str) -> str:
        """Block tags and environments as lines, so that one line grammar is enough."""
        if "<" in text:
            sub = lambda p, to, t: self._sub("html", p, to, t)
            text = sub(_SCRIPT, "", sub(_COMMENT, "", text))
            text = sub(_PRE, lambda m: f"\n{_MADE}```\n" + unescape(_ANY_TAG.sub("", m.group(1))).strip("\n") + "\n```\n", text)
            text = sub(_CELL, _SPLIT, text)
            text = sub(_OPEN, lambda m: f"\n\n{_MADE}" + "#" * int(m.group(1)) + " ", text)
            text = sub(_BREAK, "\n", sub(_ITEM, f"\n{_MADE}- ", text))
        if "\\begin" in text:
            text = self._sub("latex", _MATH_BLOCK, lambda m: "\n\n$$" + " ".join(m.group(2).split()) + "$$\n\n", text)
            text = self._sub("latex", _LIST_ENV, "", text)
        return text

    def _add(self, kind: str, text: str, joins: bool = False) -> None:
        """A block, or more lines of the last one."""
        if self.para:
            whole, self.para = "\n".join(self.para), []
            before, self.linked = self.linked, 0
            self._add("para", self.inline(whole).strip())
            self.linked = before
        links, self.linked = self.linked, 0
        if joins and self.blocks and self.blocks[-1].kind == kind:
            last = self.blocks[-1]
            last.text, last.links = f"{last.text}\n{text}", last.links + links
        elif text.strip():
            self.blocks.append(Block(kind, text, links))

    def _flush(self) -> None:
        self._add("none", "")

    def _cells(self, cells: list[str]) -> str:
        return " | ".join(self.inline(c.strip()) for c in cells)

    def _read(self, lines: list[str]) -> None:
        i, last = 0, ""
        while i < len(lines):
            line = lines[i]
            i += 1
            s = line.strip()
            if not s:
                self._flush()
            elif s[0].isalpha() and "|" not in s and _SPLIT not in s:
                self.para.append(line)
            else:
                i = self._structure(lines, i, line, s, last)
            last = line
        self._flush()

    def _structure(self, lines: list[str], i: int, line: str, s: str, last: str) -> int:
        """A line that may be more than prose; ``i`` is the number of the next line, returned after what was consumed."""
        made = s[0] == _MADE
        if made:
            line = s = s[1:]
        family = self.families.add if not made else lambda f: None
        if m := _FENCE.match(line):
            family("markdown")
            j = i
            while j < len(lines) and not lines[j].strip().startswith(m.group(1)[:3]):
                j += 1
            code = lines[i:j]
            for x in code:
                self._code_line(x)
            self._add("code", "```\n" + "\n".join(code) + "\n```")
            return j + 1
        if m := _HEAD.match(line):
            family("markdown")
            self._add("head", m.group(1) + " " + self._apart(m.group(2)))
        elif m := _WIKI_HEAD.match(line):
            family("wiki")
            self._add("head", "#" * len(m.group(1)) + " " + self._apart(m.group(2)))
        elif m := _SECTION.match(line):
            family("latex")
            self._add("head", "#" * _DEPTH[m.group(1)] + " " + self._apart(m.group(2)))
        elif m := _UNDER.match(line):
            self._underline(m.group(1)[0], last)
        elif _OTHER_RULE.match(line):
            family("markdown")
            self._flush()
        elif s == "$$" and (j := next((k for k in range(i, len(lines)) if lines[k].strip() == "$$"), 0)):
            family("latex")
            self._add("math", "$$" + " ".join(" ".join(lines[i:j]).split()) + "$$")
            return j + 1
        elif s.startswith("$$") and s.endswith("$$") and len(s) > 4:
            family("latex")
            self._add("math", s)
        elif line.startswith("{|"):
            return self._wiki_table(lines, i)
        elif s[0] in "|!" or _SPLIT in s or (" | " in s and not self.para and s.count(" | ") > 1):
            self._row(line, s)
        elif m := _BULLET.match(line):
            self._item(m, line, last, made)
        elif m := _NOTE.match(line):
            family("markdown")
            self._add("note", self._apart(m.group(1)))
        elif m := _QUOTE.match(line):
            if m.group(1).strip():
                family("markdown")
            self.para.append(m.group(1))
        else:
            self.para.append(line)
        return i

    def _apart(self, s: str) -> str:
        """The clean text of a line that ends the paragraph above it."""
        self._flush()
        return self.inline(s)

    def _underline(self, sign: str, last: str) -> None:
        """A line of equal signs or dashes: the line above is a heading, or it is a rule."""
        above = last.strip()
        titled = bool(above) and len(last) - len(last.lstrip(" ")) <= 3 and above[0] not in ("=|>#" if sign == "=" else "|>#-")
        if titled or sign == "-" and not above:
            self.families.add("markdown")
        if titled and self.para:
            title = self.para.pop()
            self._add("head", ("# " if sign == "=" else "## ") + self._apart(title.strip()))
        else:
            self._flush()

    def _item(self, m: re.Match, line: str, last: str, made: bool) -> None:
        sign, number = m.group(2), m.group(3)
        if not made and m.group(4):
            pair = _PAIRED.get("." if number else sign or "")
            if sign in ("-", "*") or pair and pair.match(line) and pair.match(last):
                self.families.add("markdown")
            elif not sign and not number:
                self.families.add("latex")
        self._flush()
        mark = f"{number}." if number else "-"
        self._add("list", m.group(1).replace("\t", "    ") + mark + " " + self.inline(m.group(4) or ""), joins=True)

    def _row(self, line: str, s: str) -> None:
        if re.match(r"\|[-}]\s*$", s):
            self.families.add("wiki")
            self._flush()
        elif _TABLE_RULE.match(line):
            if "|" in s.strip("|"):
                self.families.add("markdown")
        elif s[0] == "!" and "!!" not in s:
            self.para.append(line)
        else:
            if s[0] == "!" or re.match(r"\|[^|\n][^\n]*\|\|", line):
                self.families.add("wiki")
            self._flush()
            self._add("table", self._cells(re.split(r"!!" if s[0] == "!" else f"{_SPLIT}|\\|\\|?", s.strip("|!"))), joins=True)

    def _wiki_table(self, lines: list[str], i: int) -> int:
        self.families.add("wiki")
        self._flush()
        rows = []
        while i < len(lines) and not lines[i].startswith("|}"):
            row = lines[i]
            if row[:1] in ("|", "!") and not row.startswith("|-"):
                rows.append(self._cells(re.split(r"\|\||!!", row[1:])))
            i += 1
        self._add("table", "\n".join(rows))
        return i + 1

    def _code_line(self, x: str) -> None:
        """Constructs on a line of code: it is kept as it is."""
        if x.strip() and not x.strip()[0].isalpha() or _SPECIAL.search(x):
            shown = Parse.__new__(Parse)
            shown.families, shown.blocks, shown.linked, shown.para = self.families, [], 0, []
            if not _FENCE.match(x):
                shown._read([x])


def families(text: str | None) -> list[str]:
    """Markup families of which the text holds at least one construct."""
    return _named(Parse(text)) if text else []


def _named(p: Parse) -> list[str]:
    return [f for f in FAMILIES if f in p.families]


def blocks(text: str) -> list[Block]:
    """The labelled blocks of a text."""
    parts = Parse(text).blocks
    label(parts)
    return parts


def _judge(b: Block) -> str:
    if b.kind in ("code", "math", "table"):
        return "text"
    body = b.text.strip()
    if len(body) > SHORT and b.links > LINKY * len(body):
        return "residue"
    if b.kind == "head":
        return "undecided"
    if not body.isascii() and _WIDE.search(body):
        return "text" if len(body) >= SHORT // 4 else "undecided"
    words = _WORD.findall(body.lower()) if len(body) >= SHORT else ()
    density = sum(map(STOP_WORDS.__contains__, words)) / len(words) if words else 0.0
    return "text" if density >= STOP_HIGH or density >= STOP_LOW and len(body) >= LONG else "undecided"


def label(parts: list[Block]) -> None:
    """Both passes."""
    for b in parts:
        b.label = _judge(b)
    decided = [i for i, b in enumerate(parts) if b.label != "undecided"]
    sure = [b.label for b in parts]
    at = 0
    for i, b in enumerate(parts):
        if sure[i] != "undecided":
            continue
        while at < len(decided) and decided[at] < i:
            at += 1
        after = decided[at] if at < len(decided) else None
        before = decided[at - 1] if at else None
        if before is None or after is None:
            pick = after if before is None else before
        elif b.kind == "head":
            pick = after
        elif i - before != after - i:
            pick = before if i - before < after - i else after
        else:
            pick = before if sure[before] == "text" else after
        b.label = "text" if pick is None else sure[pick]


def clean(text: str | None) -> str | None:
    """Clean text with its structure."""
    if not text:
        return text
    return _joined(blocks(text))


def _joined(parts: list[Block]) -> str:
    return "\n\n".join(b.text.rstrip() for b in parts if b.label == "text")


def clean_and_families(text: str | None) -> tuple[str | None, list[str]]:
    """Both results of one pass."""
    if not text:
        return text, []
    p = Parse(text)
    label(p.blocks)
    return _joined(p.blocks), _named(p)


def clean_texts(df: DataFrame, table: str, key: str, text: str, diagram: Column | None = None) -> DataFrame:
    """(item_table, item_key, families, clean_text), one row per key."""
    rows = df.filter(F.col(key).isNotNull()).select(
        F.col(key).cast("string").alias("item_key"), F.col(text).alias("_text"), (F.coalesce(diagram, F.lit(False)) if diagram is not None else F.lit(False)).alias("_diagram")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts, raw = part.column(1).to_pylist(), part.column(2).to_pylist()
                both = [(t, []) if d else clean_and_families(t) for t, d in zip(texts, raw, strict=True)]
                done, found = [x[0] for x in both], [x[1] for x in both]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.string())), pa.array(done, pa.string())], names=["item_key", "families", "clean_text"])

    out = rows.mapInArrow(run, "item_key string, families array<string>, clean_text string")
    return out.select(F.lit(table).alias("item_table"), "*")


def found_families(cleaned: DataFrame) -> DataFrame:
    """(item_table, item_key, family), each once."""
    return cleaned.select("item_table", "item_key", F.explode("families").alias("family")).distinct()


def once(cleaned: DataFrame) -> DataFrame:
    """One row per key: repeated deliveries hold the same text, the smallest result is kept."""
    return cleaned.groupBy("item_table", "item_key").agg(F.min(F.struct("families", "clean_text")).alias("_r")).select("item_table", "item_key", "_r.*")
