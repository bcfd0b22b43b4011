"""Readings of a garbled line: turn it back into bytes by every reader, decode them by every writer, keep the best.

A reading counts only if the bytes round-trip exactly, its words are plausible in one language of a script, and it is
clearly better than leaving the line and than every other reading; otherwise the line stays as it is. UTF-8 needs no
language: bytes that are not UTF-8 by design hardly ever decode.

Plausible means: words of one script in natural case, no signs inside words, final letters only at the end of words, and
letters about as frequent as in a language of that script. Frequencies follow from the order of the letters alone.
"""

from __future__ import annotations

import re
from functools import lru_cache
from math import log2
from operator import ne
from typing import NamedTuple

#: Letters of languages in the order of their frequency; of Latin scripts those outside ASCII.
ORDER = {
    "cyrillic": ("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфёъ", "оаинвтеірсклдмупязьбгйчхжшцюєїфщґ", "аоеинтрсвлкдпмузябъгчщжцхйшфюь", "аіонецрслкмвдытяупзўьгбчхйжшёюфэ", "аоиенртсвкјудмлпзгшчбцњћжљхђфџ"),
    "greek": ("αοιετσνηυρπκμλωςόγίδάχθήέύφβξζώψϊϋΐΰ",),
    "hebrew": ("יוהלאתרבשמנדפקעםחגסצטזןכךףץ",),
    "arabic": ("اليمنوتربعدسفهكقحجةشصطخذزضثأءىغئظإؤآ",),
    "thai": ("านร่อกเงม้ยลัวดทีสตะปบิคหใไแ์จุชพ็ขำโถผืธศึูซณฉฟญฐษฝภฏฎฆฌฮๆฒฑฤ",),
    "latin": (
        "üäößéà", "éàèêçôùîâëïœûü", "óáéíñúüç", "ãçáéíóêõâúàôü", "àèìòùéî", "äåöéü", "åøæéö", "äõöüšž", "áðíéóúýþæö", "ëéïöüèó",
        "łężóśąćńź", "íáéěšřčžýůúťďňó", "áíéčšžýúľťňôďóĺŕä", "áéöíóüőúű", "ışüğöçâîû", "ăîâșțşţ", "šžčćđ", "ļāēīūšžčģķņ", "ėšžųąįčęū",
    ),
}
_RANGES = (
    ("latin", "A-Za-zÀ-ÖØ-öø-ɏẀ-ỿ"), ("cyrillic", "Ѐ-ӿ"), ("greek", "Ͱ-Ͽἀ-῿"), ("hebrew", "֐-״"), ("arabic", "ؠ-ۿ"), ("thai", "ก-๎"),
    ("hangul", "가-힣"), ("kana", "ぁ-ゖァ-ヺーゝゞ"), ("han", "\u3400-\u9fff\uf900-\ufaff々"),
)
_SCRIPT = {name: re.compile(f"[{r}]") for name, r in _RANGES}
_LETTERS = "".join(r for _, r in _RANGES)
_HIGH = re.compile(r"[^\x00-\x7f]")
#: Controls and private use: no text.
_NO_TEXT = re.compile("[\x80-\x9f\ue000-\uf8ff]")
#: What stands between spaces and is not all ASCII; no-break spaces may be bytes here.
_CHUNK = re.compile(r"[^ \t\n\r\f\v]*[^\x00-\x7f][^ \t\n\r\f\v]*")
_TOKEN = re.compile(rf"[{_LETTERS}]+(?:['’ʼ·-](?=[{_LETTERS}])[{_LETTERS}]+)*|[^\s{_LETTERS}]+")
#: Signs that correct text holds beside its words.
USUAL = frozenset("‘’“”„‚«»‹›–—…•·°§±×÷£€½¼¾²³¹™®©№µ¡¿ªº†‡。，、；：！？（）《》「」『』【】〈〉～…—・　％，​‌‍‎‏،؛؟״׳־")
_CLOSERS = frozenset("’”»›…™®²³¹ªº½¼¾。，、；：！？）》」』】〉％،؛؟")
_OPENERS = frozenset("‘“„‚«‹¡¿§№（《「『【〈")
#: Syllables that Korean text is full of.
_SYLLABLES = frozenset("이다는에의가을를고하지도로은한사기리어자인나대시서그해정수부있스들아보과일상")
_FINAL = {"greek": ("ς", "σ"), "hebrew": ("םןךףץ", "")}

ONE_BYTE = ("cp1252", "latin-1", "cp1250", "cp1251", "koi8-r", "cp866", "cp437", "cp850", "mac_roman")
WRITERS = ("utf-8", "cp1252", "cp850", "cp437", "mac_roman", "cp1250", "iso8859-2", "cp1254", "cp1251", "koi8-r", "koi8-u", "cp866", "cp1253", "iso8859-7", "cp1255", "cp1256", "gb18030", "big5", "shift_jis", "euc_jp", "euc_kr")
READERS = (*ONE_BYTE, "gb18030", "big5", "shift_jis", "euc_kr")


@lru_cache(None)
def _shares(order: str) -> tuple[dict[str, float], float]:
    """(bits of each letter, mean bits) by rank: the share of a letter falls off like 1 / (rank + 4)."""
    weight = [1 / (i + 4) for i in range(len(order))]
    total = sum(weight)
    bits = {c: -log2(w / total) for c, w in zip(order, weight, strict=True)}
    return bits, sum(w / total * bits[c] for c, w in zip(order, weight, strict=True))


@lru_cache(None)
def _common(kind: str) -> frozenset[str]:
    """Common characters of the East Asian sets: their first levels and the syllables in use."""
    rows = {"gb": ("gb2312", range(0xB0, 0xD8)), "jis": ("euc_jp", range(0xB0, 0xD0)), "big5": ("big5", range(0xA4, 0xC7)), "ks": ("euc_kr", range(0xB0, 0xC9))}
    enc, leads = rows[kind]
    out = []
    for a in leads:
        for b in (*range(0x40, 0x7F), *range(0xA1, 0xFF)):
            try:
                out.append(bytes([a, b]).decode(enc))
            except UnicodeDecodeError:
                continue
    return frozenset(c for c in out if len(c) == 1)


class Worth(NamedTuple):
    """How a text reads: share of its signs outside ASCII in plausible words, bits a letter above the language's mean."""

    good: float
    above: float
    script: str
    letters: int


def _natural(w: str) -> bool:
    return w.islower() or w.isupper() or w[0].isupper() and w[1:].islower() or not (w.islower() or w.isupper() or w.istitle()) and w.lower() == w.upper()


@lru_cache(1 << 16)
def _kind(c: str) -> str:
    """The script of a letter, '' for other signs."""
    return next((name for name, p in _SCRIPT.items() if p.match(c)), "")


def _script_of(w: str) -> str:
    found = set(map(_kind, w))
    if len(found) == 1:
        return found.pop()
    return "kana" if found == {"han", "kana"} else "mixed"


def worth(t: str, most_odd: float = 1e9) -> Worth:
    """The plausibility of a text; one with more odd signs than ``most_odd`` is not looked at to its end."""
    words: dict[str, list[str]] = {}
    high = odd = 0
    for m in _TOKEN.finditer(t):
        w = m.group()
        if w.isascii():
            continue
        n = len(_HIGH.findall(w))
        high += n
        first = w[0]
        if not _kind(first):
            before, after = t[m.start() - 1 : m.start()], t[m.end() : m.end() + 1]
            inside = bool(before and after and _kind(before) and _kind(after))
            bad = sum(c > "\x7f" and (c not in USUAL or inside and c not in "’·–—…，。、；：！？《》（）「」　・") for c in w)
            if not bad and (first in _OPENERS and before.isalpha() and before.isascii() or w[-1] in _CLOSERS and w[-1] not in "’”»" and not before.strip() and after.isalpha() and after.isascii()):
                bad = n
            odd += bad
            if odd > most_odd:
                return Worth(0.0, 0.0, "", 0)
            continue
        parts = [p for p in re.split("['’ʼ·-]", w) if p]
        script = _script_of("".join(parts))
        ends, inner = _FINAL.get(script, ("", ""))
        if script == "mixed" or script in ("latin", "cyrillic", "greek") and not all(_natural(p) for p in parts) or ends and any(c in ends for p in parts for c in p[:-1]) or inner and any(p[-1:] in inner for p in parts if len(p) > 1):
            odd += n
            if odd > most_odd:
                return Worth(0.0, 0.0, "", 0)
            continue
        words.setdefault(script, []).append("".join(parts))
    if not high:
        return Worth(1.0, 0.0, "", 0)
    best = max(words, key=lambda s: sum(map(len, words[s])), default="")
    above, letters = 0.0, 0
    for script, ws in words.items():
        low = "".join(ws).lower()
        if script != best and script != "latin" and len(low) < 3 or len(ws) > 2 and script in ("han", "hangul") and sum(len(w) == 1 for w in ws) > 0.6 * len(ws):
            # a letter of another script among words, or single characters among other signs
            odd += len(low)
            continue
        if script == "latin":
            low = "".join(c for c in low if c > "\x7f")
        if not low:
            continue
        if script in ORDER:
            bits, outside = _fit(script, low)
            odd += outside
        else:
            bits, outside = _fit_wide(script, low, "kana" in words or "hangul" in words)
            odd += outside
        if script == best:
            above, letters = bits, len(low)
    return Worth(max(0.0, 1 - odd / high), above, best, letters)


def _fit(script: str, low: str) -> tuple[float, int]:
    """(bits a letter above the mean, letters outside the alphabet) of the language that fits best."""
    best = (9.0, len(low))
    for order in ORDER[script]:
        bits, mean = _shares(order)
        known = [bits[c] for c in low if c in bits]
        outside = len(low) - len(known)
        if not known:
            continue
        fit = (sum(known) / len(known) - mean, outside)
        if (fit[1], fit[0]) < (best[1], best[0]):
            best = fit
    return best


def _fit_wide(script: str, low: str, mixed: bool) -> tuple[float, int]:
    if script == "hangul":
        rare = sum(c not in _common("ks") for c in low)
        return 4 * rare / len(low) + (1.5 if sum(map(_SYLLABLES.__contains__, low)) < 0.12 * len(low) else 0.0), rare if rare > 0.35 * len(low) else 0
    if script == "kana" or mixed:
        sets = ("jis",)
    else:
        sets = ("gb", "big5")
    rare = min(sum(_kind(c) == "han" and c not in _common(s) for c in low) for s in sets)
    return 4 * rare / len(low), rare if rare > 0.35 * len(low) else 0


@lru_cache(None)
def table(enc: str) -> str:
    """The 256 characters of a one-byte encoding; undefined bytes become control characters, as browsers do."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(enc))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@lru_cache(None)
def _back(enc: str) -> dict[str, int]:
    return {c: b for b, c in enumerate(table(enc))}


def to_bytes(t: str, enc: str) -> bytes | None:
    if enc in ONE_BYTE:
        back = _back(enc)
        try:
            return bytes(back[c] for c in t)
        except KeyError:
            return None
    try:
        data = t.encode(enc)
        return data if data.decode(enc) == t else None
    except UnicodeError:
        return None


def from_bytes(data: bytes, enc: str) -> str | None:
    try:
        t = data.decode(enc)
        return t if t.encode(enc) == data else None
    except UnicodeError:
        return None


#: A reading must leave hardly anything odd, fit its language about as well as text does, and stand apart.
LEAST_GOOD, MOST_ABOVE, CLEARER, APART = 0.97, 0.75, 0.6, 0.12
#: A line of plausible words whose letters are no rarer than this is not read again.
SETTLED = 0.3
#: Letters below which a reading is no evidence, and changed letters below which it is not.
FEW, CHANGED = 4, 3


def _rank(w: Worth) -> float:
    """Bits above the language's mean; small alphabets and first guesses do not win by chance."""
    bonus = {"hangul": -0.35, "kana": -0.25}.get(w.script, 0.0)
    return max(w.above, 0.0) + 6 * (1 - w.good) + bonus + (0.05 if w.script == "han" else 0.0)


def reread(line: str) -> str | None:
    """The line as it was written, or None where no reading is clearly right.

    Only what is not ASCII is looked at, in pieces between spaces: spaces are the same byte everywhere.
    """
    pieces = list(_CHUNK.finditer(line))
    t = _reading(" ".join(m.group() for m in pieces)) if pieces else None
    if t is None:
        return None
    out, at = [], 0
    for m, new in zip(pieces, t.split(" "), strict=True):
        out += [line[at : m.start()], new]
        at = m.end()
    return "".join([*out, line[at:]])


def _reading(text: str) -> str | None:
    high = len(_HIGH.findall(text))
    if high < FEW:
        return None
    here = worth(text)
    if here.good >= LEAST_GOOD and here.above <= SETTLED:
        return None
    wide = any(_SCRIPT[k].search(text) for k in ("han", "kana", "hangul"))
    found: dict[str, float] = {}
    sure: dict[str, float] = {}
    spaces = text.count(" ")
    tried: set[bytes | str] = {text}
    for r in READERS:
        data = to_bytes(text, r) if r in ONE_BYTE or wide else None
        if data is None or data in tried:
            continue
        tried.add(data)
        for w in WRITERS:
            if w == r or {w, r} <= {"cp1252", "latin-1"}:
                continue
            t = from_bytes(data, w)
            if t is None or t in tried or _NO_TEXT.search(t) or t.count(" ") != spaces:
                continue
            tried.add(t)
            n = len(_HIGH.findall(t))
            got = worth(t, n if w == "utf-8" else n * (1 - LEAST_GOOD) + 1e-9)
            if w == "utf-8":
                if n >= 2 and got.good > here.good + 0.25 and n < high:
                    sure[t] = min(sure.get(t, 9.0), _rank(got))
            elif got.good >= LEAST_GOOD and (len(t) != len(text) or sum(map(ne, t, text)) >= max(CHANGED, 0.08 * high)) and got.above <= MOST_ABOVE and got.letters >= FEW:
                found[t] = min(found.get(t, 9.0), _rank(got))
    if sure:
        return min(sure, key=sure.get)
    if not found:
        return None
    (best, rank), *others = sorted(found.items(), key=lambda x: x[1])
    clearer = CLEARER if here.good >= 0.9 else 0.3
    if rank > _rank(here) - clearer or others and others[0][1] < rank + APART:
        return None
    return best


def improves(before: str, after: str) -> bool:
    """Whether a restored passage reads better than it did."""
    a, b = worth(before), worth(after)
    return b.good > a.good or _rank(b) < _rank(a)
