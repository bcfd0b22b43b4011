"""Text that was decoded with the wrong character encoding: find the passages and restore them.

Lines, then sentences, that are garbled as a whole are read again by all pairs of encodings (module ``readings``): a reading
counts only if its bytes round-trip, it is plausible in one language and clearly better than all others and than leaving
the line. What remains is matched by one multi-pattern automaton: for every pair (written in W, read in R) the garbled
sequences of a repertoire of characters are computed once per worker. Matches are anchors; what an anchor is worth depends
on its context:

* UTF-8 read in a one-byte encoding gives sequences that correct text hardly holds; they count alone, unless they are
  made of letters that follow each other in the words of that script - then two in a row or a foreign neighbour count;
  characters outside the repertoire are restored where their bytes follow such a match;
* a letter written in one one-byte or GB encoding and read in another counts inside or at the edge of a Latin word,
  where it is no letter, a letter of another script, or a capital after small letters;
* U+FFFD counts always: bytes were lost.

Sequences of double-byte text overlap (three bytes of a Chinese character, two bytes of a GBK character), so passages
around such anchors, and runs of one script that are no plausible words, are turned back into bytes and read again;
the result counts only if it reads better than the run did. Only matched spans are replaced, round after round (text may
have been misread twice); correct text in any script stays as it is, and so does a passage without a clear reading, which
is only reported.

Defined results: null and empty texts are no case; invalid JSON in ``metadata`` is scanned as plain text, in valid JSON
only the strings of affected values change; U+FFFD stays in the restored text because the byte is gone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from math import log

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.readings import ONE_BYTE, improves, reread, table

DOUBLE = ("gb18030", "big5", "shift_jis", "euc_kr")
LOST = "\ufffd"
#: Rounds of restoring; twice misread text needs one for each misreading and one for what stands beside it.
ROUNDS = 6


@lru_cache(None)
def undefined(enc: str) -> frozenset[str]:
    out = set()
    for b in range(128, 256):
        try:
            bytes([b]).decode(enc)
        except UnicodeDecodeError:
            out.add(chr(b))
    return frozenset(out)


@lru_cache(None)
def back(enc: str) -> dict[int, int]:
    return {ord(c): b for b, c in enumerate(table(enc))}


def _misread(data: bytes, enc: str) -> str | None:
    if enc in ONE_BYTE:
        t = table(enc)
        return "".join(t[b] for b in data)
    try:
        return data.decode(enc)
    except UnicodeDecodeError:
        return None


_LATIN = [chr(c) for c in (*range(0xC0, 0x180), 0x1E9E) if chr(c).isalpha()]
_SIGNS = [chr(c) for c in (*range(0x80, 0xC0), 0xD7, 0xF7, *range(0x2010, 0x2027), 0x2030, 0x2039, 0x203A, 0x2044, 0x20AC, 0x2116, 0x2122, 0x2212, 0x2260, 0x2264, 0x2265)]
_CYRILLIC = [chr(c) for c in (*range(0x410, 0x450), 0x401, 0x451, 0x404, 0x406, 0x407, 0x454, 0x456, 0x457, 0x490, 0x491)]
#: Restored from UTF-8 without losses only.
_OTHER = [chr(c) for c in (*range(0x370, 0x3FF), *range(0x401, 0x460), *range(0x5D0, 0x5EB), *range(0x60C, 0x6D6), *range(0xE01, 0xE5C)) if chr(c).isprintable()]
_WIDE = [chr(c) for c in (*range(0x3000, 0x3020), *range(0x3041, 0x30FF), *range(0xFF01, 0xFF5F), 0xFEFF, 0xFFFD)]


def _level_one() -> list[str]:
    """The common characters of GB 2312: its first level, lead bytes B0 to D7."""
    return [bytes([a, b]).decode("gb2312") for a in range(0xB0, 0xD8) for b in range(0xA1, 0xFF) if not (a == 0xD7 and b > 0xF9)]


COMMON_HAN = frozenset(_level_one())
_HANGUL = [bytes([a, b]).decode("euc_kr") for a in range(0xB0, 0xC9) for b in range(0xA1, 0xFF)]
_HAN_SIGNS = frozenset("，。；：！？、“”‘’（）《》—…·【】「」％")
_FREQUENT = frozenset("оеаинтсрвлкмдпу")
#: One-byte writers of Latin letters and their readers.
_LATIN_WRITERS = ("cp1252", "mac_roman", "cp437", "cp850", "gb18030")
_LATIN_READERS = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "koi8-r", "cp866", "gb18030", "big5", "latin-1")
#: Signs that stand at the end of words in correct text.
_USUAL = frozenset("²³¹°±§£€½¼¾µ·ºª™®©")
_TYPOGRAPHY = frozenset("‘’“”–—…·•'\"-‚„«»‹›°´`¨")


class Hit:
    """What an automaton match stands for."""

    __slots__ = ("char", "kind", "reader", "size", "writer")

    def __init__(self, kind: str, writer: str, reader: str, char: str, size: int):
        self.kind, self.writer, self.reader, self.char, self.size = kind, writer, reader, char, size


@lru_cache(None)
def automaton() -> ahocorasick.Automaton:
    found: dict[str, dict[tuple[str, str], Hit]] = {}

    def add(g: str | None, kind: str, w: str, r: str, c: str) -> None:
        if g and g != c and not g.isascii():
            found.setdefault(g, {}).setdefault((kind, r), Hit(kind, w, r, c, len(g)))

    whole = {*_OTHER, *_HANGUL} - {*_CYRILLIC}
    for r in ONE_BYTE:
        lost = undefined(r)
        for c in (*_LATIN, *_SIGNS, *_CYRILLIC, *_OTHER, *_WIDE, *COMMON_HAN, *_HANGUL):
            g = _misread(c.encode("utf-8"), r)
            add(g, "utf8", "utf-8", r, c)
            if c not in whole and any(x in lost for x in g):
                add("".join(LOST if x in lost else x for x in g), "utf8", "utf-8", r, c)
            if r in ("cp1252", "latin-1", "cp1251") and len(g) < 4 and g.lower() != g and c not in COMMON_HAN and c not in _CYRILLIC:
                add(g.lower(), "utf8", "utf-8", r, c)
        add(_misread("🙂".encode()[:2], r), "utf8", "utf-8", r, "")
    for w in _LATIN_WRITERS:
        for r in _LATIN_READERS:
            if w == r or {w, r} <= {"cp1252", "latin-1"}:
                continue
            for c in (*_LATIN, "’", "“", "”", "–", "€", "°", "§"):
                try:
                    data = c.encode(w)
                except UnicodeEncodeError:
                    continue
                if w != "gb18030" and len(data) != 1 or r in DOUBLE and len(data) == 1:
                    continue
                add(_misread(data, r), "letter", w, r, c)
    for c in (*_LATIN, *_SIGNS):
        for r in ("gb18030", "big5"):
            add(_misread(c.encode("utf-8"), r), "letter", "utf-8", r, c)
    for mark in ("ÿþ", "þÿ"):
        add(mark, "mark", "utf-16", "cp1252", "")
    add("锘", "mark", "utf-8", "gb18030", "")
    a = ahocorasick.Automaton()
    for g, hits in found.items():
        a.add_word(g, (g, list(hits.values())))
    a.make_automaton()
    return a


# --- plausibility ---------------------------------------------------------------------------------------------------

_RUS_WORD = re.compile(r"[А-ЯЁ]?[а-яё]+|[А-ЯЁ]+")


def russian(t: str) -> bool:
    """Whether the letters of t make plausible Russian words."""
    words = re.findall(r"[^\W\d_]+", t)
    letters = "".join(words).lower()
    if len(letters) < 4 or not all(_RUS_WORD.fullmatch(w) for w in words):
        return False
    return sum(c in _FREQUENT for c in letters) >= 0.6 * len(letters) and sum(c in "аеёиоуыэюя" for c in letters) >= 0.2 * len(letters)


#: Percentages of the letters in Russian text.
_SHARE = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (10.97, 8.45, 8.01, 7.35, 6.7, 6.26, 5.47, 4.73, 4.54, 4.4, 3.49, 3.21, 2.98, 2.81, 2.62, 2.01, 1.9, 1.74, 1.7, 1.65, 1.59, 1.44, 1.21, 0.97, 0.94, 0.73, 0.64, 0.48, 0.36, 0.32, 0.26, 0.04, 0.04), strict=True))


def likeness(t: str) -> float:
    """Mean log share of the letters in Russian text; words beginning with ъ, ь or ы count against it."""
    low = t.lower()
    letters = [log(_SHARE[c]) for c in low if c in _SHARE]
    return sum(letters) / max(1, len(letters)) - len(re.findall(r"\b[ъьы]", low)) / max(1, len(low.split()))


def chinese(t: str, least: int = 2) -> bool:
    han = [c for c in t if c >= "⺀"]
    n = sum("一" <= c <= "鿿" for c in han)
    return n >= least and sum(c in COMMON_HAN or c in _HAN_SIGNS for c in han) >= 0.9 * len(han) and len(han) >= 0.5 * len(t.replace(" ", ""))


_HIGH = re.compile(r"[^\x00-\x7f]+")
#: A run may cross ASCII signs and digits, and single ASCII letters (second bytes of double-byte characters).
_RUN = re.compile(r"[^\x00-\x7f](?:[^\x00-\x7f\n]|[\x20-\x40\x5b-\x60\x7b-\x7e]{1,3}(?=[^\x00-\x7f])|[A-Za-z](?=[^\x00-\x7f]))*")
_ODD = re.compile("[\x80-\x9f\xa0-\xbf×÷ˆ˜‚-„†-•‰‹›€™─-▟⌠⌡Ђ-ЏЎЈҐІЇђ-џўјґіїєЄѕЅ√≈≤≥∞∑∏π∫Ω∂◊ﬁﬂ]")
_WIDE_ANY = re.compile(r"[⺀-鿿豈-﫿-ㄅ-ㄩ︰-﹏＀-￯]")


_WIDE_RUN = re.compile(_WIDE_ANY.pattern + "+")
_OTHER_RUN = re.compile("[^" + _WIDE_ANY.pattern[1:-1] + "\n]+")


def _encode(t: str, enc: str) -> bytes | None:
    if enc in ONE_BYTE:
        m = back(enc)
        try:
            return bytes(m[ord(c)] for c in t)
        except KeyError:
            return None
    try:
        return t.encode(enc)
    except UnicodeEncodeError:
        return None


def _decode(data: bytes, enc: str, edges: bool) -> tuple[int, int, str] | None:
    """(bytes left at the start, at the end, text between), strict; broken characters at the edges are left if allowed."""
    for a, b in ((0, 0), (0, 1), (1, 0), (1, 1)) if edges else ((0, 0),):
        try:
            return a, b, data[a : len(data) - b].decode(enc)
        except UnicodeDecodeError:
            continue
    return None


_UTF8_HAN = re.compile(rb"(?:[\xe3-\xe9][\x80-\xbf]{2}|\xef[\xbc\xbd][\x80-\xbf]|\xe2\x80[\x80-\xbf]){2,}")
_UTF8_CYR = re.compile(rb"(?:[\xd0\xd1][\x80-\xbf]){4,}")


def _reread_double(run: str, enc: str) -> list[tuple[int, int, str]]:
    """UTF-8 passages inside a run that was read as double-byte text: (start, end, restored)."""
    whole = run.encode(enc, "replace")
    if not _UTF8_HAN.search(whole) and not _UTF8_CYR.search(whole):
        return []
    data, at = bytearray(), []
    for i, c in enumerate(run):
        try:
            b = c.encode(enc)
        except UnicodeEncodeError:
            b = b"\x00"
        data += b
        at += [i] * len(b)
    out = []
    for p, ok in ((_UTF8_HAN, lambda t: chinese(t, 1)), (_UTF8_CYR, russian)):
        for m in p.finditer(bytes(data)):
            t = m.group().decode("utf-8", "replace")
            a, b = at[m.start()], at[m.end() - 1] + 1
            if ok(t) and run[a:b] != t and not ("一" <= run[a] <= "鿿" and sum(c in COMMON_HAN for c in run[a:b]) >= 0.95 * (b - a)):
                out.append((a, b, t))
    return out


def _scripts(run: str) -> tuple[int, int, int]:
    cyr = sum("Ѐ" <= c <= "ӿ" for c in run)
    wide = len(_WIDE_ANY.findall(run))
    return cyr, wide, len(run) - cyr - wide


def _reread_run(run: str) -> str | None:
    """A whole run of implausible text read again in the encoding that makes it plausible."""
    body = run.strip(" ")
    high = len(_HIGH.sub("", body))
    if len(body) - high < 4 or LOST in body and len(body) < 8:
        return None
    cyr, wide, rest = _scripts(body)
    if wide > 0.5 * len(body):
        if chinese(body):
            return None
        readers: tuple[str, ...] = ("big5", "gb18030", "shift_jis", "euc_kr")
        writers: tuple[str, ...] = ("gb18030", "big5", "cp1251", "koi8-r")
    else:
        words = re.findall(r"[Ѐ-ӿ]+", body)
        odd = len(_ODD.findall(body))
        if cyr and not odd and all(_RUS_WORD.fullmatch(w) for w in words) and (russian(body) or cyr < 6):
            return None
        readers = ("cp1251", "koi8-r", "cp866", "cp1252", "latin-1", "cp437", "cp850", "mac_roman")
        writers = ("gb18030", "cp1251", "koi8-r", "cp866", "big5")
    best: tuple[float, str] | None = None
    for r in readers:
        data = _encode(body, r)
        if data is None:
            continue
        for w in writers:
            if w == r:
                continue
            if w in ONE_BYTE:
                t = "".join(table(w)[x] for x in data)
            else:
                # one byte is one character here, so the edges stay as they are
                part = _decode(data, w, r in ONE_BYTE)
                if part is None or not part[2]:
                    continue
                t = body[: part[0]] + part[2] + body[len(body) - part[1] :]
            if t == body or not improves(body, t):
                continue
            if w in ONE_BYTE:
                letters = sum(c.isalpha() for c in t)
                if russian(t) and letters >= 0.7 * len(t.replace(" ", "")) and letters >= 4 and (best is None or likeness(t) > best[0]):
                    best = (likeness(t), t)
            elif w == "gb18030":
                if chinese(t):
                    return run.replace(body, t)
            else:
                han = sum("一" <= c <= "鿿" for c in t)
                if han >= 4 and han + sum(c in _HAN_SIGNS for c in t) >= 0.95 * len(t) and sum(c in COMMON_HAN for c in t) >= 0.45 * han and not chinese(body):
                    return run.replace(body, t)
    return run.replace(body, best[1]) if best else None


# --- matches in context ---------------------------------------------------------------------------------------------


def _latin(c: str) -> bool:
    return "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ɏ" and c not in "×÷"


_NATURAL_CYR = frozenset("ёЁ«»‘’“”„–—…№™§©®°±·іїІЇєЄґҐ \xa0")


def _utf8_counts(text: str, a: int, b: int, hit: Hit, chained: bool) -> bool:
    g = text[a:b]
    before, after = text[a - 1 : a], text[b : b + 1]
    r = hit.reader
    if r in ("cp1252", "latin-1", "cp1250"):
        if len(g) == 2 and g[0] in "ÄÅÎÏÐÑäåîïðñ" and g[1] in "‘’“”–—…«»„‚\xa0":
            return chained or _latin(before)
        if g[0] in "âãäåæçèéï" and g[0].islower() and len(g) == 3 and hit.char in COMMON_HAN:
            return chained or any("\x80" <= c <= "\x9f" for c in g) or not _latin(before)
        return True
    if r in ("cp1251", "koi8-r", "cp866"):
        if "\u0e00" <= hit.char <= "\u0e7f":
            return chained
        letters = all("Ѐ" <= c <= "ӿ" for c in g)
        if r == "cp866" and letters and len(g) == 3:
            return g.startswith("тА") or chained
        if r == "koi8-r" and not letters and g[1] != "\xa0":
            return True
        if r == "cp866" and not letters:
            return True
        if len(g) >= 3 and g.startswith(("вЂ", "п»")):
            return True
        if _latin(before) or _latin(after):
            return True
        if chained:
            return True
        return len(g) == 2 and r == "cp1251" and g[1] not in _NATURAL_CYR and not ("а" <= g[1] <= "я" or "А" <= g[1] <= "Я") and not ("Ѐ" <= after <= "ӿ")
    if r == "mac_roman":
        if g[0] in "–—":
            return chained
        return not (g[0] in "„‚‰ÂÊÁËÈÔ" and all(_latin(c) for c in g[1:]) and _latin(after) and not chained and hit.char in COMMON_HAN)
    return True


def _among_letters(text: str, a: int, b: int) -> bool:
    """Whether a third of the word around a place at least are ASCII letters; other words are read again as a whole."""
    x, y = text.rfind(" ", 0, a) + 1, text.find(" ", b)
    word = text[x : y if y >= 0 else len(text)]
    plain = sum(map(str.isalpha, filter(str.isascii, word)))
    return 3 * plain >= plain + len(_NOT_ASCII.findall(word))


_NOT_ASCII = re.compile(r"[^\x00-\x7f]")


def _letter_counts(text: str, a: int, b: int, hit: Hit) -> bool:
    """Whether a match of a one-byte or double-byte letter or sign counts by what stands around it."""
    return _fits(text, a, b, hit) and (not hit.char.isalpha() or _WIDE_ANY.search(text[a:b]) is not None or _among_letters(text, a, b))


def _fits(text: str, a: int, b: int, hit: Hit) -> bool:
    g, c = text[a:b], hit.char
    before, after = text[a - 1 : a], text[b : b + 1]
    if g.isspace():
        return False
    if c == "’":
        if g in _TYPOGRAPHY or not before.isalpha():
            return False
        tail = re.match(r"(?:t|s|re|ll|ve|d)\b", text[b : b + 3])
        return bool(tail) and _latin(before) and (before == "n" if tail.group() == "t" else not g.islower()) and not (tail.group() == "s" and g.isalpha() and g.islower())
    if c in "“”–€§":
        if c == "–":
            return before == " " and after == " " and g in ("ñ", "û", "Ц", "√")
        if c == "“" and g == "ì":
            return not before.isalnum() and bool(re.match(r"[\w ]{1,40}î", text[b : b + 42]))
        if c == "€":
            return after.isdigit() and before in (" ", "(") and (g.isalpha() or _WIDE_ANY.search(g) is not None)
        return False
    if c == "°":
        return after == "C" and (before.isdigit() or before == " ") and not g.isalnum() and g not in ("°", "º") or hit.reader in ("gb18030", "big5") and after == "C" and before in (" ",)
    if c in _SIGNS:
        if hit.reader in ("gb18030", "big5") and _WIDE_ANY.search(g):
            return (after.isdigit() and c in "£€¥§" and before in (" ", "(")) or c == "µ" and after == "m" and before == " " or c == "½" and before.isdigit()
        return False
    left, right = _latin(before), _latin(after)
    if not (left or right) or not hit.char.isalpha():
        return False
    if hit.reader in ("gb18030", "big5") or _WIDE_ANY.search(g):
        x, y = a, b
        while x > 0 and _WIDE_ANY.match(text[x - 1]):
            x -= 1
        while y < len(text) and _WIDE_ANY.match(text[y]):
            y += 1
        if y - x > 3 * (b - a) or y - x > 3:
            return False
        line = text[max(0, x - 40) : x] + text[y : y + 40]
        return (left and right) or sum(map(_latin, line)) > 3 * len(_WIDE_ANY.findall(line)) + 3
    if hit.writer == "gb18030":
        return any(not (_latin(x) or x.isascii()) for x in g) and (left or right)
    if g in _TYPOGRAPHY and not (left and right and g in "„‚‹›´¨°·"):
        return False
    if g == "·" and before == "l" and after == "l" or g in ("ª", "º", "µ", "™", "®", "©"):
        return False
    if g.isalpha():
        if "Ѐ" <= g <= "ӿ" or "Ͱ" <= g <= "Ͽ":
            word = re.search(r"[^\W\d_]*$", text[max(0, a - 30) : a]).group() + re.match(r"[^\W\d_]*", text[b : b + 30]).group()
            return len(word) >= 3 and all(_latin(x) or x == g for x in word) and (c.islower() or not left)
        if not (c.islower() and g.isupper() and before.isascii() and left) or after.isupper():
            return False
        return before.islower() or after.islower() and after.isascii() and not _latin(text[a - 2 : a - 1] if a > 1 else "")
    if left and right:
        return c.islower() == after.islower() or c.islower() and before.islower()
    if right:
        return (not before or before in " \n(“\"'") and after.islower() and not g.isspace() and g not in "$£¥€§¶¿¡¢±+÷×√≈≤≥<>~|" or g == "÷" and c == "Ö" and after.islower()
    return before.islower() and c.islower() and not g.isspace() and g not in "$£¥€§¶¢±√≈≤≥∞³²¹" and not after.isalnum()


def _utf8_at(text: str, at: int, enc: str, step: int) -> tuple[int, int, str] | None:
    """One UTF-8 character whose bytes were read as characters, from ``at`` on or up to ``at``."""
    for n in (2, 3, 4):
        a, b = (at, at + n) if step > 0 else (at - n, at)
        if a < 0 or b > len(text):
            return None
        data = _encode(text[a:b], enc)
        try:
            t = data.decode("utf-8") if data else ""
        except UnicodeDecodeError:
            continue
        if len(t) == 1 and t.isprintable():
            return a, b, t
    return None


def _chained(text: str, found: list[tuple[int, int, str, bool]], enc: str) -> list[tuple[int, int, str, bool]]:
    """Matches with the characters that follow or precede them directly in the same misreading."""
    taken = sorted(found)
    out = list(taken)
    for i, (a, b, _, _) in enumerate(taken):
        low = taken[i - 1][1] if i else 0
        high = taken[i + 1][0] if i + 1 < len(taken) else len(text)
        for step, at in ((1, b), (-1, a)):
            while (m := _utf8_at(text, at, enc, step)) and m[0] >= max(low, out[-1][1] if step < 0 and out[-1][0] < a else 0) and m[1] <= high:
                if any(m[0] < y and x < m[1] for x, y, _, _ in out[max(0, len(out) - 64) :]):
                    break
                out.append((*m, True))
                at = m[1] if step > 0 else m[0]
    return sorted(out)


def _matches(text: str, quiet: bool = False) -> list[tuple[int, int, str, bool]]:
    """Counting matches (start, end, restored, from UTF-8) of a line, longest first, not overlapping.

    The reader whose matches cover most is taken for UTF-8 sequences, and a pair that has counted once counts again for
    signs and letters of other scripts. In a ``quiet`` line all words are natural, so only letters that stand for signs count.
    """
    raw = [(e - len(g) + 1, e + 1, hits) for e, (g, hits) in automaton().iter(text)]
    raw.sort(key=lambda x: (x[0], x[0] - x[1]))
    by: dict[str, list[tuple[int, int, Hit]]] = {}
    for a, b, hits in raw:
        for h in hits:
            if h.kind == "utf8":
                mine = by.setdefault(h.reader, [])
                if not mine or mine[-1][1] <= a:
                    mine.append((a, b, h))
    best: tuple[int, list[tuple[int, int, str, bool]]] = (0, [])
    reader = ""
    for name, mine in by.items():
        starts, ends = {a for a, _, _ in mine}, {b for _, b, _ in mine}
        ok = [(a, b, h.char or text[a:b], True) for a, b, h in mine if _utf8_counts(text, a, b, h, b in starts or a in ends)]
        cover = sum(b - a for a, b, _, _ in ok)
        if cover > best[0]:
            best, reader = (cover, ok), name
    out = _chained(text, best[1], reader)
    busy = [(a, b) for a, b, _, _ in out]
    free = [(a, b, h) for a, b, hits in raw for h in hits if h.kind != "utf8" and not (quiet and h.char.isalpha()) and not any(a < y and x < b for x, y in busy)]
    pairs: dict[tuple[str, str], int] = {}
    for a, b, h in free:
        if _letter_counts(text, a, b, h) if h.kind == "letter" else a == 0:
            pairs[(h.writer, h.reader)] = pairs.get((h.writer, h.reader), 0) + 1
    free.sort(key=lambda x: (x[0], x[0] - x[1], -pairs.get((x[2].writer, x[2].reader), 0), _LATIN_WRITERS.index(x[2].writer) if x[2].writer in _LATIN_WRITERS else 9))
    at = -1
    for a, b, h in free:
        if a < at:
            continue
        g = text[a:b]
        if h.kind == "mark":
            ok = a == 0
        else:
            ok = _letter_counts(text, a, b, h) or (h.writer, h.reader) in pairs and (not h.char.isalpha() or _WIDE_ANY.search(g) or _among_letters(text, a, b)) and not g.isspace() and (not _latin(g[0]) or h.char in "“”’–") and (g not in _TYPOGRAPHY or len(g) > 1) and not (g in _USUAL and not text[b : b + 1].isalpha())
        if ok:
            out.append((a, b, h.char or g, False))
            at = b
    return out


#: What cannot be misread: words of one script in natural case, Chinese of common characters, signs in their usual place.
#: Letters that stand for those of other Latin alphabets (õ for ő, ð for ğ) and words in Cyrillic capitals are looked at closely.
_UP, _LOW = "A-ZÀ-ÏÑ-ÔÖØ-ÚÜŚŁŹŻĆŃČ", "a-zß-ïñ-ôöø-úüÿśłźżćńęąőűčřě"
_BENIGN = re.compile(
    rf"(?<!\w)(?:[LlDdMmSsCcNnJj]’)?(?:[{_UP}]?[{_LOW}]+|[{_UP}]{{2,}}|[А-ЯЁ]?[а-яё]+)(?:['’-](?:[{_UP}]?[{_LOW}]+|[А-ЯЁ]?[а-яё]+))*(?!\w)"
    r"|(?<=\s)[–—«“„‘](?=[\s\w])|[–—…”’»](?=[\s.,;:!?)]|$)|(?<=\s)[§±](?=\s)|(?<=\s)°C|(?<=\s)µ(?=m)|(?<=\d)[½°]|(?<=[\s(])[€£](?=\d)"
    "|(?<![A-Za-zÀ-ɏ])[" + "".join(sorted(COMMON_HAN | _HAN_SIGNS)) + "]{2,}(?![A-Za-zÀ-ɏ])|第(?=\\d)|[，。！？；：、]"
)


def benign(text: str) -> bool:
    """Quick test: nothing in the text can be misread."""
    return _BENIGN.sub("", text).isascii()


_TOKEN = re.compile("[Ѐ-ӿ─-▟√№°·¤║╙\xa0-\xbf]+")


def _odd_words(text: str) -> list[tuple[int, int, str]]:
    """Lines whose Cyrillic words of unnatural case or signs read well together in another encoding."""
    out, at = [], 0
    for line in text.split("\n"):
        odd = [m for m in _TOKEN.finditer(line) if not all(_RUS_WORD.fullmatch(w) for w in re.findall(r"[^\W\d_]+", m.group())) or _ODD.search(m.group())]
        odd = [m for m in odd if len(m.group()) > 2]
        if len(odd) and sum(len(m.group()) for m in odd) >= 6:
            t = _reread_run(" ".join(m.group().strip("\xa0") for m in odd))
            if t is not None:
                for m, w in zip(odd, t.split(" "), strict=False):
                    out.append((at + m.start(), at + m.end(), w))
        at += len(line) + 1
    return out


def _pieces(text: str) -> Iterator[re.Match]:
    """Runs, cut where double-width text meets other text."""
    for m in _RUN.finditer(text):
        wide = _WIDE_ANY.search(m.group())
        if wide and len(_ODD.findall(m.group())) >= 3:
            for p in (_WIDE_RUN, _OTHER_RUN):
                yield from (x for x in p.finditer(text, m.start(), m.end()) if len(x.group()) > 3)
        else:
            yield m


_PIECE = re.compile(r"(?<=[.!?;:。！？；：])\s+|\t+|\s{2,}|\s[|–—]\s")


def _differing(old: str, new: str, at: int) -> tuple[int, int, str]:
    """The part of a piece that changes, as a span of the text."""
    a = 0
    while a < min(len(old), len(new)) and old[a] == new[a]:
        a += 1
    b = 0
    while b < min(len(old), len(new)) - a and old[-1 - b] == new[-1 - b]:
        b += 1
    return at + a, at + len(old) - b, new[a : len(new) - b]


def _as_a_whole(line: str) -> list[tuple[int, int, str]]:
    """A line, or else its sentences, garbled as a whole and with one clear reading."""
    t = reread(line)
    if t is not None:
        return [_differing(line, t, 0)]
    cuts = [0, *(x for m in _PIECE.finditer(line) for x in m.span()), len(line)]
    out = []
    for a, b in zip(cuts[::2], cuts[1::2], strict=True) if len(cuts) > 2 else ():
        piece = line[a:b]
        if not piece.isascii() and not benign(piece) and (t := reread(piece)) is not None:
            out.append(_differing(piece, t, a))
    return out


def _replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, t in sorted(spans):
        if a >= at:
            out += [text[at:a], t]
            at = b
    return "".join([*out, text[at:]])


def _round(text: str, quiet: bool = False) -> tuple[str, bool]:
    """One round of finding and restoring in a line; a ``quiet`` line holds natural words only."""
    spans = _as_a_whole(text) if not quiet else []
    if spans:
        return _replaced(text, spans), True
    for m in _HIGH.finditer(text):
        run = m.group()
        if len(run) > 1 and _WIDE_ANY.search(run):
            for enc in ("gb18030", "big5"):
                got = _reread_double(run, enc)
                if got:
                    spans += [(m.start() + a, m.start() + b, t) for a, b, t in got]
                    break
    matches = _matches(text, quiet)
    if not spans:
        covered = set()
        for a, b, _, utf8 in matches:
            if utf8:
                covered.update(range(a, b))
        for m in _pieces(text):
            high = [i for i in range(m.start(), m.end()) if text[i] > "\x7f"]
            if sum(i in covered for i in high) > 0.5 * len(high):
                continue
            t = _reread_run(m.group())
            if t is not None:
                spans.append((m.start(), m.end(), t))
        if not spans and not covered:
            spans = _odd_words(text)
    taken = sorted(spans)
    for a, b, t, _ in matches:
        if not any(a < y and x < b for x, y, _ in taken):
            spans.append((a, b, t))
    if not spans:
        return text, False
    return _replaced(text, spans), True


#: A file mark stands at the very beginning of a text.
_MARK = re.compile("^(?:ÿþ|þÿ)")


def repair(text: str | None) -> tuple[str | None, bool]:
    """(restored text, whether a misread passage was found); lines are judged one by one."""
    if not text or text.isascii():
        return text, False
    found = LOST in text
    if not found and benign(text):
        return text, False
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if line.isascii():
            continue
        quiet = LOST not in line and benign(line)
        mark = _MARK.match(line).end() if i and _MARK.match(line) else 0
        now = line[mark:]
        for _ in range(ROUNDS):
            new, changed = _round(now, quiet)
            if not changed:
                break
            found = True
            now = new
        lines[i] = line[:mark] + now
    return "\n".join(lines), found


#: A string of a JSON document; one before a colon is a name and no value.
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"(\s*:)?', re.S)


def repair_json(raw: str | None) -> tuple[str | None, bool]:
    """As ``repair`` for the values of a JSON document, after their escapes are resolved; all other text stays as it is."""
    if not raw or raw.isascii() and "\\u" not in raw:
        return raw, False
    try:
        json.loads(raw)
    except ValueError:
        return repair(raw)
    found = False

    def value(m: re.Match) -> str:
        nonlocal found
        if m.group(1) is not None or m.group().isascii() and "\\u" not in m.group():
            return m.group()
        text = json.loads(m.group())
        done, hit = repair(text)
        found |= hit
        return m.group() if done == text else json.dumps(done, ensure_ascii=False)

    done = _STRING.sub(value, raw)
    return done, found


def repair_fields(df: DataFrame, key: str, fields: dict[str, bool]) -> DataFrame:
    """(key, field_name, restored) of the affected fields; ``fields`` tells which are JSON.

    Rows whose fields are plain ASCII never leave the JVM.
    """
    odd = F.lit(False)
    for f, is_json in fields.items():
        odd = odd | F.coalesce(F.col(f).rlike(r"[^\x00-\x7F]" + (r"|\\u" if is_json else "")), F.lit(False))
    kind = df.schema[key].dataType.simpleString()
    names = list(fields.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, cols = [], ([], [])
            for i, (name, is_json) in enumerate(names):
                for k, t in zip(b.column(0).to_pylist(), b.column(i + 1).to_pylist(), strict=True):
                    done, hit = (repair_json if is_json else repair)(t)
                    if hit:
                        keys.append(k)
                        cols[0].append(name)
                        cols[1].append(done)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string())], names=[key, "field_name", "restored"])

    return df.filter(odd).select(key, *fields).mapInArrow(run, f"{key} {kind}, field_name string, restored string")
