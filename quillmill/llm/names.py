"""Variant spellings of names: link every item to the registry entry that its name or its aliases denote.

1. A registry name that a spelling denotes has most of its words in it, somehow written. Candidates therefore come from a
   set-similarity join with two prefix filters, at every size of the registry. Of the words of a registry name, weighted by
   rarity, only the heaviest ones name it: those up to where the rest weighs less than ``NAME_SHARE`` (single characters
   for Han names, ``HAN_SHARE``). Words of spellings meet words of the registry on token q-grams (three letters with word
   ends): of n grams, the rarest n - ceil(GRAM_SHARE * n) + 1 are keys; also on a word that begins with the other one
   and on short forms of given names. Both joins are joins of words and names; no name is compared with all others.
2. Candidates are verified by a soft weighted token similarity. Tokens are aligned one to one; a pair may be equal, a
   nickname, an initial, an abbreviation, a plural or a slip of the keyboard. A token weighs as much as it is rare in
   the registry; titles, articles and legal forms weigh little, but legal forms and version numbers must not differ.
   Acronyms stand for the initials of a name's tokens. Han names are compared character by character: traditional and
   foreign characters are open, abbreviations are subsequences with the same head.
3. Evidence of name and aliases is added per item and entry; the best entry wins if it is ahead of the next one.

Spellings are matched once however many items use them. Defined results: null and blank names and aliases denote
nothing; a spelling that fits two entries equally denotes none unless another spelling decides; repeated deliveries of
one item count once; empty tables give no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.session import cut

#: Share of grams that two words share, of the weight of a name that its words beyond the prefix may have, the same for Han.
GRAM_SHARE, NAME_SHARE, HAN_SHARE = 0.34, 0.5, 0.3
ACCEPT = 0.74
MARGIN = 0.03
COUNTERS = 1 << 22

#: Fixed values.
TITLES = frozenset("dr mr mrs ms miss prof professor sir dame phd md jr sr herr frau mme mlle".split())
SMALL = frozenset("the of for and an und de la le et der die das fur".split())
PLACES = re.compile(r",?\s*\b(?:head office|headquarters|hq|main office)\b", re.I)
LEGAL = {
    "ltd": "limited", "limited": "limited", "inc": "incorporated", "incorporated": "incorporated", "corp": "corporation",
    "corporation": "corporation", "gmbh": "gmbh", "ag": "ag", "bv": "bv", "sa": "sa", "co": "co", "company": "co", "llc": "llc",
    "university": "university", "univ": "university", "association": "association", "assoc": "association", "assn": "association",
    "plc": "plc", "kg": "kg", "nv": "nv", "sarl": "sarl", "srl": "srl", "spa": "spa", "oy": "oy", "ab": "ab",
}
#: Short forms of given names.
NICKNAMES = """
aleksandr: alex sasha sascha alik; alexander: alex sasha sandy; andreas: andi andy dre; anthony: tony ant; benjamin: ben benny benji;
christopher: chris kit topher; dorothea: dora thea dory dorle; elizabeth: liz beth betty lizzie eliza lisa libby; francisco: paco pancho fran cisco;
francois: fanch fran france; frederick: fred freddie freddy rick; gabriela: gabi gaby; guillermo: memo guille willy; johanna: hanna jo hanne joanna;
josephine: jo josie fifi jojo; jurgen: jurg jogi; katharina: kathi kati kat katja trina ina; leonardo: leo nardo; lucia: lucy luz lu lulu; margaret: maggie meg peggy greta marge;
maximilian: max maxi; michael: mike mick; nikolai: kolya nick niko nik; patricia: pat patty trish tricia; penelope: penny nell poppy; ekaterina: katya katia katja kate katerina kat; renee: rene ren nee nene;
richard: rick dick rich ricky richie; robert: bob rob bobby robbie bert; samuel: sam sammy; soren: sorn; susanna: susi sue suzy susan sanna; theodore: ted teddy theo;
victoria: vicky vic tori vicki; william: bill will billy willy liam; zoltan: zoli zolti; thomas: tom tommy; james: jim jimmy jamie; john: jack johnny jon;
edward: ed eddie ted ned; catherine: kate cathy katie cat; daniel: dan danny; david: dave davy; joseph: joe joey; matthew: matt; nicholas: nick nico; stephen: steve;
timothy: tim; charles: charlie chuck; jennifer: jen jenny; jessica: jess; rebecca: becky bec; deborah: deb debbie; barbara: barb; gregory: greg; jeffrey: jeff; kenneth: ken;
peter: pete; philip: phil; ronald: ron; raymond: ray; walter: walt wally; henry: harry hank; martin: marty; isabella: bella isa izzy; alexandra: alex sandra sasha
"""
_NICK: dict[str, frozenset[str]] = {
    k.strip(): frozenset(v.split()) for k, _, v in (x.partition(":") for x in NICKNAMES.replace("\n", " ").split(";"))
}
_FOLD = str.maketrans({"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "ß": "ss", "æ": "ae", "Æ": "Ae", "œ": "oe", "đ": "d", "ı": "i"})
_HAN = re.compile(r"[㐀-鿿]")


def fold(s: str) -> str:
    """Compatibility form without accents, lower case."""
    s = unicodedata.normalize("NFKD", s.translate(_FOLD))
    return "".join(c for c in s if not unicodedata.combining(c)).casefold()


class Name:
    """A parsed spelling."""

    __slots__ = ("abbr", "grams", "han", "legal", "tails", "tokens", "version", "words")

    def __init__(self, raw: str):
        s = unicodedata.normalize("NFKC", raw).strip()
        self.han, self.version, self.legal, self.abbr = "", "", "", set()
        self.tokens: list[str] = []
        self.words: list[str] = []
        self.tails: set[int] = set()
        if len(_HAN.findall(s)) >= 2:
            self.han = re.sub(r"[\s\W_]+", "", s)
            if len(_HAN.findall(self.han)) >= 4:
                self.han = re.sub(r"^[A-Za-z]+|[A-Za-z]+$", "", self.han)
            self.grams = frozenset(self.han)
            return
        s = PLACES.sub("", s)
        s = re.sub(r"\b([A-Za-z])\.\s?([A-Za-z])\.(?=[\s,)]|$)", lambda m: m.group(1) + m.group(2) if (m.group(1) + m.group(2)).lower() in LEGAL else m.group(), s)
        s = re.sub(r"(?<=[a-zß-ÿ])(?=[A-ZÀ-ÖØ-ÞŚŁ][a-zß-ÿ])", " ", s)
        s = re.sub(r"(?<=\d)(?:\.0)+\b", "", s)
        found = list(re.finditer(r"[^\W_]+(?:['’][^\W_]+)*\.?", s))
        parts = [m.group() for m in found]
        hyphen = {i for i, m in enumerate(found) if i and s[found[i - 1].end() : m.start()] == "-"}
        at = 0
        while at < len(parts):
            p = parts[at]
            t = fold(p.rstrip(".")).replace("'", "").replace("’", "")
            at += 1
            if m := re.fullmatch(r"v(?:er|ersion)?(\d+)", t):
                self.version = m.group(1).lstrip("0")
            elif (t in ("v", "ver", "version") or len(t) > 4 and slips(t, "version", 1) <= 1) and at < len(parts) and parts[at].rstrip(".").isdigit():
                self.version = parts[at].rstrip(".").lstrip("0")
                at += 1
            elif t.isdigit():
                self.version = t.lstrip("0")
            elif m := re.fullmatch(r"([a-z]{3,})(\d+)", t):
                self._add(m.group(1), p)
                self.version = m.group(2).lstrip("0")
            elif at == len(parts) >= 3 and t not in LEGAL and len(t) >= 2 and any(len(k) > 2 and k[0] == t[0] and slips(t, k, 1) <= 1 for k in LEGAL):
                self.words.append(t)
                self.legal = next(v for k, v in LEGAL.items() if len(k) > 2 and k[0] == t[0] and slips(t, k, 1) <= 1)
            elif t != "a" or p != "a":
                if at - 1 in hyphen:
                    self.tails.add(len(self.tokens))
                self._add(t, p)
        self.grams = frozenset(g for t in self.tokens for g in word_grams(t))

    def _add(self, t: str, p: str) -> None:
        if not t:
            return
        self.words.append(t)
        if t in LEGAL:
            self.legal = LEGAL[t]
        elif t not in TITLES and t not in SMALL:
            self.tokens.append(t)
            if p.endswith("."):
                self.abbr.add(t)


@lru_cache(20_000)
def parse(raw: str) -> Name:
    return Name(raw)


def slips(a: str, b: str, most: int) -> int:
    """Edits with neighbour swaps between two words, ``most`` + 1 if more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], before[j - 2] + 1)
        if min(row) > most:
            return most + 1
        before = last
    return row[-1]


def _inside(q: str, r: str) -> bool:
    it = iter(r)
    return all(c in it for c in q)


#: Similarity after one, two and three slips.
SLIP1, SLIP2, SLIP3 = 0.93, 0.85, 0.751


@lru_cache(100_000)
def alike(q: str, r: str, dotted: bool) -> float:
    """Similarity of two tokens."""
    if q == r:
        return 1.0
    if len(r) > 1 and len(q) == 1:
        return 0.8 if r[0] == q else 0.0
    if len(r) == 1:
        return 0.0
    if q in _NICK.get(r, ()) or r in _NICK.get(q, ()):
        return 0.95
    if len(q) >= 4 and any(len(n) >= 4 and n[0] == q[0] and slips(q, n, 1) <= 1 for n in _NICK.get(r, ())):
        return 0.86
    if q.rstrip("s") == r.rstrip("s") and len(q) > 3:
        return 0.98
    n = max(len(q), len(r))
    d = slips(q, r, 2 if n >= 7 else 1) if n >= 4 and (q[0] == r[0] or q[:2] == r[1::-1]) else 9
    if d <= (2 if n >= 7 else 1):
        return SLIP1 if d == 1 else SLIP2
    if q[0] == r[0] and 3 <= len(q) < len(r) and _inside(q, r) and (r.startswith(q) or dotted or len(q) <= 4 or q[-1] == r[-1]):
        return 0.88 if r.startswith(q) or dotted or len(q) <= 4 else 0.8
    if dotted and len(q) >= 4 and len(r) > len(q) and slips(q, r[: len(q)], 1) <= 1:
        return 0.75
    if dotted and len(q) >= 4 and len(r) >= len(q) and slips(q, r[: len(q) - 1], 1) <= 1:
        return 0.75
    if n >= 10 and abs(len(q) - len(r)) <= 1 and q[0] == r[0] and slips(q, r, 3) <= 3:
        return SLIP3
    return 0.0


def _acronym(q: Name, r: Name, weight) -> float:
    """One token of q is made of the initials of r, the others are tokens of r."""
    if len(q.words) < 2 or len(r.words) < 2:
        return 0.0
    initials = {w[0] for w in r.words}
    if not any(2 <= len(a) <= 7 and initials.issuperset(a) for a in q.words):
        return 0.0
    best = 0.0
    for i, a in enumerate(q.words):
        if not 2 <= len(a) <= 7 or not initials.issuperset(a):
            continue
        rest = [t for j, t in enumerate(q.words) if j != i and t not in TITLES and t not in SMALL and t not in LEGAL]
        if not rest:
            continue
        used = []
        for t in rest:
            s, w = max(((alike(t, x, t in q.abbr), x) for x in r.tokens if x not in used), default=(0.0, ""))
            if s < 0.75 or len(t) < 4:
                used = None
                break
            used.append(w)
        if not used:
            continue
        forms = set()
        for small in (True, False):
            for legal in (True, False):
                for own in (True, False):
                    ws = [w for w in r.words if (small or w not in SMALL) and (legal or w not in LEGAL) and (own or w not in used)]
                    forms.add("".join(w[0] for w in ws))
        if a in forms and len(a) >= 2:
            best = max(best, 0.86)
    return best


def _open(a: str, b: str, common) -> tuple[int, list[tuple[str, str]]]:
    """(number of open characters, real differences) of two texts of one length."""
    off = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    real = [(x, y) for x, y in off if x in common]
    return len(off) - len(real), real


def _han(q: Name, r: Name, common) -> float:
    a, b = q.han, r.han
    if a == b:
        return 1.0
    if len(b) < 4 or len(a) < 4:
        return 0.0
    if len(a) == len(b):
        free, real = _open(a, b, common)
        if free <= 0.75 * len(b) and not real:
            return 0.95 if free > 1 else 0.92
        swaps = [i for i in range(len(a) - 1) if a[i] != b[i] and (a[i] == b[i + 1] or a[i] not in common or a[i + 1] == b[i])]
        for i in swaps:
            free, real = _open(a[:i] + a[i + 1] + a[i] + a[i + 2 :], b, common)
            if not real and free <= 0.6 * len(b):
                return 0.9
    if abs(len(a) - len(b)) == 1 and min(len(a), len(b)) >= 5:
        for i in range(max(len(a), len(b))):
            x, y = (a, b[:i] + b[i + 1 :]) if len(a) < len(b) else (a[:i] + a[i + 1 :], b)
            free, real = _open(x, y, common)
            if not real and free <= 0.6 * len(y) and (x[-1] == y[-1] or x[-1] not in common):
                return 0.9 if not free else 0.88
    if len(a) < len(b) and a[:2] == b[:2] and _inside(a, b):
        return 0.85 if a[-1] == b[-1] or b.startswith(a) else 0.8
    return 0.0


def similarity(q: Name, r: Name, weight, common, genuine=lambda t: False) -> float:
    """Soft weighted token similarity of a spelling and a registry name, 0 to 1.

    ``genuine`` tells whether a token is a name or word of its own and so no slip of another one.
    """
    if q.han or r.han:
        return _han(q, r, common) if q.han and r.han else 0.0
    if q.version != r.version or not q.tokens or not r.tokens:
        return 0.0
    if q.legal and r.legal and q.legal != r.legal:
        return _acronym(q, r, weight)
    for x in r.tokens:
        # a token of the registry that nothing here resembles leaves only the acronym
        if len(x) > 1 and not any(alike(t, x, t in q.abbr) for t in q.tokens) and not (q.abbr and r.tails):
            return _acronym(q, r, weight)
    pairs = []
    for i, t in enumerate(q.tokens):
        for j, x in enumerate(r.tokens):
            v = alike(t, x, t in q.abbr)
            if v in (SLIP1, SLIP2, SLIP3) and genuine(t) or len(t) == 1 and len(x) > 1 and j:
                v = 0.0
            pairs.append((v, -abs(i - j), i, j))
    pairs.sort(reverse=True)
    qs: dict[int, float] = {}
    rs: dict[int, float] = {}
    whole = 0
    for s, _, i, j in pairs:
        if s <= 0:
            break
        if i in qs or j in rs:
            continue
        qs[i] = rs[j] = s
        whole += len(q.tokens[i]) > 1
    # the rest of a hyphenated word whose head is abbreviated is not missed
    by_head = {i for i, t in enumerate(q.tokens) if t in q.abbr}
    heads = {j for _, _, i, j in pairs if i in by_head and qs.get(i) and rs.get(j)} if by_head else set()
    spared = {j for j in r.tails if j not in rs and j - 1 in heads}
    got = total = 0.0
    for j, x in enumerate(r.tokens):
        if j in spared:
            continue
        w = weight(x) if len(x) > 1 else 0.35
        if len(x) == 1 and j not in rs:
            if any(len(t) == 1 and i not in qs for i, t in enumerate(q.tokens)):
                return _acronym(q, r, weight)
            total += 0.1
            continue
        got += w * rs.get(j, 0.0)
        total += w
    for i, t in enumerate(q.tokens):
        if i not in qs:
            if len(t) >= 2 and t == "".join(w[0] for w in r.words if w not in SMALL):
                continue
            if t in ("".join(w[0] for w in r.words), "".join(w[0] for w in r.tokens)):
                continue
            if len(t) <= 4 and any(slips(t, w, 1) <= 1 for w in ("the", "for", "of", "and")):
                continue
            total += 0.35 if len(t) == 1 else max(weight(t), 4.0)
    if not whole:
        return 0.0
    for j, x in enumerate(r.tokens):
        if len(x) > 1 and rs.get(j, 0.0) == 0.0 and j not in spared:
            return _acronym(q, r, weight)
    if r.legal and not q.legal:
        total += 0.1
    if q.legal and not r.legal:
        total += 1.0
    return max(got / total if total else 0.0, _acronym(q, r, weight) if got / max(total, 1e-9) < ACCEPT else 0.0)


def _parts(t: str) -> list[str]:
    """Heads with the letter after them and tails with the letter before them."""
    return [f"p:{t[: k + 1]}" for k in range(3, len(t) - 2)] + [f"s:{t[k - 1 :]}" for k in range(3, len(t) - 2)] if len(t) >= 6 else []


def _part(x: str) -> str:
    """The head or tail without that letter."""
    return x[:-1] if x[0] == "p" else f"s:{x[3:]}"


def own_word(t: str, count) -> bool:
    """A registry token, or a head and a tail after and before which registry tokens branch: a word of its own."""
    if count(f"t:{t}"):
        return True
    return any(count(f"p:{t[:k]}") >= 3 and count(f"s:{t[k:]}") >= 3 for k in range(3, len(t) - 2))


def _slot(x: str) -> int:
    return xxhash.xxh64_intdigest(x.encode("utf-8", "replace")) & (COUNTERS - 1)


def _count_table(registry: DataFrame, name: str) -> np.ndarray:
    """Hashed counts over all registry names: names with a gram (g:) or token (t:), tokens with a head (p:) or tail (s:)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for b in batches:
            for raw in b.column(0).to_pylist():
                n = parse(raw)
                total.update(_slot(x) for x in {*(f"g:{g}" for g in n.grams), *(f"t:{t}" for t in n.tokens)})
                total[_slot("n")] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["slot", "n"])

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([t for raw in b.column(0).to_pylist() for t in parse(raw).tokens], pa.string())], names=["token"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x for t in b.column(0).to_pylist() for x in _parts(t)], pa.string())], names=["part"])

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [_slot(_part(x)) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([1] * len(at), pa.int64())], names=["slot", "n"])

    names = registry.select(name)
    shape = "slot long, n long"
    pieces = names.mapInArrow(tokens, "token string").distinct().mapInArrow(parts, "part string").distinct().mapInArrow(slots, shape)
    got = names.mapInArrow(run, shape).unionByName(pieces).groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int32)
    out[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return out


def word_grams(t: str) -> frozenset[str]:
    """Three letters with word ends."""
    padded = f"^{t}$"
    return frozenset(padded[i : i + 3] for i in range(max(1, len(padded) - 2)))


_FULL: dict[str, set[str]] = {}
for _full, _shorts in _NICK.items():
    for _short in _shorts:
        _FULL.setdefault(_short, set()).add(_full)


def word_keys(t: str, df, known: bool) -> list[tuple[str, str]]:
    """(key, form) of a word: its rarest grams, itself and its beginnings; words of spellings come in all their forms."""
    out = []
    for u in {t} if known else {t} | _FULL.get(t, set()) | _NICK.get(t, frozenset()):
        grams = sorted(word_grams(u), key=lambda g: (df(g), g))
        out += [(f"g:{g}", u) for g in grams[: len(grams) - ceil(GRAM_SHARE * len(grams) - 1e-9) + 1]]
        begins = [u[:i] for i in range(3, len(u))]
        # a word of a spelling begins a known one, is it, or goes on after it
        out += [(f"p:{x}", u) for x in ([*begins, u] if known else [u])] + [(f"q:{x}", u) for x in ([u] if known else begins)]
    return out


def share_grams(a: str, b: str) -> bool:
    x, y = word_grams(a), word_grams(b)
    return len(x & y) >= GRAM_SHARE * max(len(x), len(y)) - 1e-9


def naming_words(n: Name, weight, df) -> list[str]:
    """The prefix of a registry name: its heaviest words up to where the rest weighs too little to denote it."""
    if n.han:
        ranked, share = sorted(((-log(1 + 1 / (1 + df(c))), f"h:{c}") for c in n.grams)), HAN_SHARE
    else:
        ranked, share = sorted((-weight(t), t) for t in set(n.tokens) if len(t) > 1), NAME_SHARE
    rest = total = -sum(w for w, _ in ranked)
    out = []
    for w, t in ranked:
        if rest < share * total - 1e-9:
            break
        out.append(t)
        rest += w
    return out


def spelling_words(n: Name) -> list[str]:
    return [f"h:{c}" for c in n.grams] if n.han else [t for t in dict.fromkeys(n.tokens) if len(t) > 1]


class _Judge:
    """Verification of candidates with the registry's weights."""

    def __init__(self, count: np.ndarray):
        self.count = count
        self.n = max(1, int(count[_slot("n")]))
        self.weights: dict[str, float] = {}
        self.own: dict[str, bool] = {}
        judge = self

        class Common:
            def __contains__(self, c: str) -> bool:
                return judge.count[_slot(f"g:{c}")] > 0

        self.common = Common()

    def weight(self, t: str) -> float:
        w = self.weights.get(t)
        if w is None:
            if len(self.weights) > 200_000:
                self.weights.clear()
            w = self.weights[t] = max(1.0, log(1 + self.n / (1 + int(self.count[_slot(f"t:{t}")]))))
        return w

    def names_with(self, gram: str) -> int:
        """Number of registry names with a gram."""
        return int(self.count[_slot(f"g:{gram}")])

    def genuine(self, t: str) -> bool:
        g = self.own.get(t)
        if g is None:
            if len(self.own) > 200_000:
                self.own.clear()
            g = self.own[t] = own_word(t, lambda x: int(self.count[_slot(x)]))
        return g

    def __call__(self, q: Name, r: Name) -> float:
        return similarity(q, r, self.weight, self.common, self.genuine)


_OUT = "spelling string, registry_id long, score double"


def _answers(rows: list[tuple[str, int, float]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.float64()), strict=True)], names=["spelling", "registry_id", "score"])


def _table(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows as a batch; ``schema`` as in Spark, of strings and longs."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    cols = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == "long" else pa.string()) for c, k in zip(cols, kinds, strict=True)], names=list(names))


def _known_words(known: DataFrame, key: str, name: str, counters) -> DataFrame:
    """(word, registry_id, registered) for the words that name an entry."""
    schema = "word string, registry_id long, registered string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _Judge(counters.value)
        for b in batches:
            yield _table(schema, [(w, k, x) for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for w in naming_words(Name(x), judge.weight, judge.names_with)])

    return known.select(F.col(key).cast("long"), name).mapInArrow(run, schema)


def _used_words(spellings: DataFrame) -> DataFrame:
    schema = "word string, spelling string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _table(schema, [(w, x) for x in b.column(0).to_pylist() for w in spelling_words(Name(x))])

    return spellings.select("spelling").mapInArrow(run, schema)


def _keyed(words: DataFrame, known: bool, counters) -> DataFrame:
    """(key, word, form) of distinct words."""
    schema = "key string, word string, form string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = _Judge(counters.value).names_with
        for b in batches:
            yield _table(schema, [(k, w, u) for w in b.column(0).to_pylist() for k, u in ([(w, w)] if w.startswith("h:") else word_keys(w, df, known))])

    return words.select("word").distinct().mapInArrow(run, schema)


def alike_words(used: DataFrame, known: DataFrame, counters) -> DataFrame:
    """(word, known_word): words of spellings and of the registry that may stand for each other."""
    met = _keyed(used, False, counters).join(_keyed(known, True, counters).toDF("key", "known_word", "_f"), "key")
    pairs = met.select("word", "form", "known_word", F.col("key").startswith("g:").alias("by_gram")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [not g or share_grams(u, x) for u, x, g in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield b.select([0, 2]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "word string, known_word string").distinct()


def match_spellings(spellings: DataFrame, registry: DataFrame, key: str, name: str) -> DataFrame:
    """(spelling, registry_id, score) of all pairs at or above ``ACCEPT``; ``spellings`` has one distinct column."""
    known = registry.filter(F.col(key).isNotNull() & F.col(name).isNotNull()).select(key, name)
    counters = spellings.sparkSession.sparkContext.broadcast(_count_table(known, name))
    naming = cut(_known_words(known, key, name, counters))
    used = cut(_used_words(spellings))
    entries = alike_words(used, naming, counters).join(naming.withColumnRenamed("word", "known_word"), "known_word").select("word", "registry_id", "registered").distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _Judge(counters.value)
        last, q = None, None
        for b in batches:
            rows = []
            for x, k, y in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if x != last:
                    last, q = x, Name(x)
                if (s := judge(q, parse(y))) >= ACCEPT:
                    rows.append((x, k, s))
            yield _answers(rows)

    # a sort-merge join gives all entries of one spelling in a row, so it is parsed once, and splits hot words
    return used.hint("merge").join(entries, "word").select("spelling", "registry_id", "registered").mapInArrow(verify, _OUT).distinct()


def link_items(items: DataFrame, registry: DataFrame) -> DataFrame:
    """(item_id, name, registry_id, registered, score) of the items that denote an entry."""
    one = items.filter("item_id IS NOT NULL").groupBy("item_id").agg(F.min(F.struct("name", "aliases")).alias("_d")).select("item_id", "_d.name", "_d.aliases")
    every = F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_pos", "spelling")
    used = one.select("item_id", every).filter("spelling IS NOT NULL AND btrim(spelling) <> ''")
    matches = cut(match_spellings(used.select("spelling").distinct(), registry, "registry_id", "name"))
    per = (
        used.join(matches, "spelling")
        .groupBy("item_id", "registry_id")
        .agg(F.max("score").alias("score"), F.max(F.when(F.col("_pos") == 0, F.col("score"))).alias("own"), F.count_distinct("spelling").alias("n"))
        .withColumn("rank", F.col("score") + 0.2 * (F.col("n") - 1) + F.when(F.col("own").isNotNull(), 0.1).otherwise(0.0))
    )
    w = Window.partitionBy("item_id").orderBy(F.desc("rank"), "registry_id")
    best = per.withColumn("_n", F.row_number().over(w)).withColumn("_next", F.lead("rank").over(w)).filter(f"_n = 1 AND (_next IS NULL OR rank - _next > {MARGIN})")
    named = registry.select(F.col("registry_id").cast("long").alias("registry_id"), F.col("name").alias("registered"))
    return best.select("item_id", "registry_id", "score").join(named, "registry_id").join(one.select("item_id", "name"), "item_id").select("item_id", "name", "registry_id", "registered", "score")
