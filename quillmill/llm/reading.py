"""Reading level of each document by regularised ordinal regression, calibrated on graded samples.

Running prose is taken from the text: paragraphs left after markup, code, tables, lists and headings are set aside,
cut into sentences; sentences with code or more than 15 percent figures and signs (data runs) do not count, and figures
are no words. Each sentence gets features of

* lexical diversity (types per token),
* word rarity: in the whole corpus (hashed counts of the same words over all documents, a table of fixed size) and, as
  calibration, in graded text (the smoothed mean band of the samples that use a word, cross-fitted while training, so no
  sample rates itself; words without a grade do not count),
* connectives, a clause-depth proxy (openers of subordinate clauses), and length of words and sentence.

A proportional-odds model with an L2 penalty turns them into an expected band. A document has the weighted median
of its sentences, so odd sentences of another band do not decide. The model is fitted on the driver on the graded samples,
at most ``MAX_SAMPLES`` of them (the table has a fixed size of 250).

Defined results: null, empty and blank texts, diagram sources, texts without running prose and texts in other languages
have no score; language is judged from the text by function words and script, not from ``lang``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm import markup

MAX_SAMPLES = 20_000
COUNTERS = 1 << 22
BANDS = 5
#: A word, for Python and for the engine: both patterns hold letters and letter-like numbers.
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_ENGINE_WORD = r"[\p{L}\p{Nl}\p{No}]+(?:['’-][\p{L}\p{Nl}\p{No}]+)*"
_END = re.compile(r"(?<=[.!?])[\"'”’)]*\s+|(?<=[。！？])")
_SIGN = re.compile(r"[0-9<>=$_{}\[\]\\|#*~/^@+&�]")
#: Code in a sentence: names with underscores, indexes, braces, operators, tags.
_CODE = re.compile(r"\w_\w|\w\[|[{}\\]|[=!<>]=|[=-]>|\w=\w|<[\w/]|&&|\|\|")
_FAR = re.compile("[ɐ-\U0010ffff]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
#: Function words that tell languages apart.
_FUNCTION = {
    "en": "the of and to in on for with by at from is are was were be it its this that these those which who whom whose not but if while each every any all her his our my their has have such than because unless although under near how when where an i you he she they we",
    "de": "der die das den dem des ein eine einen einem einer und oder zu im für mit als von aus bei nach ist sind nicht aber wenn jede alle ohne über während sich auch wird werden gemäß trotz",
    "fr": "le la les un une des du de et ou à au aux en dans pour avec par sur est sont ne pas que qui chaque sans ses sous malgré après selon",
    "pt": "o os as um uma e do da dos das no na nos nas para com por em é são não que cada sem seu sua",
    "es": "el los las un una y del al en para con por es son no que cada sin su sus",
    "it": "il lo gli uno una e del della dei delle nel nella per con è sono non che ogni senza",
    "nl": "de het een en van op voor met als uit bij naar is zijn niet maar elke alle zonder over",
}
_LANG = {k: frozenset(v.split()) for k, v in _FUNCTION.items()}
#: Words that join clauses and sentences.
_CONNECTIVE = frozenset(
    "because although though unless while whereas whenever after before until since if lest albeit insofar notwithstanding provided given whence wherefore therefore thus hence ergo "
    "however moreover nevertheless nonetheless furthermore consequently accordingly otherwise pace qua despite inasmuch".split()
)
_OPENER = frozenset("which that who whom whose whence whereby wherein because although though unless while whereas whenever if lest albeit insofar notwithstanding qua being provided underlying".split())


_CODES = tuple(_LANG)
_HINT = {w: tuple(i for i, k in enumerate(_CODES) if w in _LANG[k]) for w in frozenset().union(*_LANG.values())}


def language(words: list[str]) -> str:
    """The language whose function words are most frequent, the first listed on a tie; '' without any."""
    votes = [0] * len(_CODES)
    for w in filter(_HINT.__contains__, words):
        for i in _HINT[w]:
            votes[i] += 1
    best = max(votes)
    return _CODES[votes.index(best)] if best else ""


def sentences(text: str) -> list[str]:
    """Sentences of the running prose."""
    out = []
    for b in markup.blocks(text):
        if b.kind == "para" and b.label == "text":
            out += [s for x in _END.split(" ".join(b.text.split())) if (s := x.strip())]
    return out


def prose(text: str | None) -> tuple[list[list[str]], bool]:
    """(lower-cased words of the sentences that count, whether the prose is English)."""
    if not text or not text.strip():
        return [], False
    english = other = 0
    out = []
    for s in sentences(text):
        signs = _SIGN.search(s) is not None
        if signs and len(_SIGN.findall(s)) > 0.15 * len(s):
            # a run of data has no language
            continue
        words = _WORD.findall(s.lower())
        weight = sum(map(len, words))
        if s.isascii():
            foreign = False
        else:
            wide = len(_CJK.findall(s))
            weight += 2 * wide
            foreign = wide * 3 > weight or len(_FAR.findall(s)) >= 0.2 * len(s)
        tongue = language(words)
        if foreign or tongue != "en":
            # runs of data and lists of names have no language
            other += weight if foreign or tongue else 0
            continue
        english += weight
        if len(words) >= 4 and not (signs and _CODE.search(s)) and s[-1] in ".?!”\"'’)":
            out.append(words)
    return out, english > other


@lru_cache(200_000)
def slot(word: str) -> int:
    """The counter of a word: the low bits of the engine's own xxhash64."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), seed=42) & (COUNTERS - 1)


def corpus_counts(df: DataFrame, text: str) -> np.ndarray:
    """Hashed word counts over all texts, made in the JVM; a table of fixed size comes back."""
    words = F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(_ENGINE_WORD), F.lit(0))).alias("_w")
    rows = df.filter(F.col(text).isNotNull()).select(words).groupBy(F.pmod(F.xxhash64("_w"), F.lit(COUNTERS)).alias("slot")).agg(F.count("*").alias("n"))
    out = np.zeros(COUNTERS, np.int64)
    got = rows.toArrow()
    out[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return out


class Level:
    """Fitted model: word grades, corpus rarity, standardised weights and thresholds."""

    def __init__(self, samples: list[tuple[int, str]], counts: np.ndarray):
        self.rarity = -np.log((counts + 1.0) / (counts.sum() + len(counts))).astype(np.float32)
        rows = [(b, words) for b, t in samples for words in [[[w.lower() for w in _WORD.findall(s)] for s in _END.split(" ".join((t or "").split())) if _WORD.search(s)]]]
        feats, labels = [], []
        folds = 5
        fold = [xxhash.xxh64_intdigest(str(i)) % folds for i in range(len(samples))]
        for k in range(folds):
            self.seen: dict[str, tuple] = {}
            self.grades = self._grades([r for r, f in zip(rows, fold, strict=True) if f != k])
            for b, ss in (r for r, f in zip(rows, fold, strict=True) if f == k):
                for words in ss:
                    feats.append(self.features(words))
                    labels.append(b)
        self.seen = {}
        self.grades = self._grades(rows)
        x, y = np.array(feats), np.array(labels)
        self.mean, self.std = x.mean(0), x.std(0) + 1e-9
        self.weights, self.cuts = _ordinal((x - self.mean) / self.std, y, BANDS)

    @staticmethod
    def _grades(rows: list[tuple[int, list[list[str]]]]) -> dict[str, float]:
        total: dict[str, list[float]] = {}
        for b, ss in rows:
            for words in ss:
                for w in set(words):
                    t = total.setdefault(w, [0.0, 0.0])
                    t[0] += b
                    t[1] += 1
        return {w: (s + 3.0) / (n + 1.0) for w, (s, n) in total.items()}

    def features(self, words: list[str]) -> list[float]:
        n = len(words)
        facts = [self._facts(w) for w in words]
        known = [f[0] for f in facts if f[0]]
        return [
            sum(known) / len(known) if known else 3.0,
            sum(f[1] for f in facts) / n,
            len(set(words)) / n,
            sum(f[2] for f in facts) / n,
            log(n),
            sum(f[3] for f in facts) / n,
            sum(f[4] for f in facts),
        ]

    def _facts(self, w: str) -> tuple:
        """(grade or 0, corpus rarity, length, connective, opener) of a word, kept in a bounded table."""
        f = self.seen.get(w)
        if f is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            g = self.grades.get(w, 0.0)
            f = self.seen[w] = (g, float(self.rarity[slot(w)]), len(w), w in _CONNECTIVE, w in _OPENER)
        return f

    def score(self, found: list[list[str]]) -> float | None:
        """Median expected band of the sentences, each with the square root of its length as weight."""
        if not found:
            return None
        x = (np.array([self.features(w) for w in found]) - self.mean) / self.std
        z = x @ self.weights
        each = 1.0 + (1 / (1 + np.exp(-(z[:, None] - self.cuts[None, :])))).sum(1)
        order = np.argsort(each, kind="stable")
        weight = np.sqrt([len(found[i]) for i in order]).cumsum()
        low, high = np.searchsorted(weight, weight[-1] / 2 - 1e-9), np.searchsorted(weight, weight[-1] / 2 + 1e-9)
        return float((each[order[low]] + each[order[min(high, len(order) - 1)]]) / 2)


def _ordinal(x: np.ndarray, y: np.ndarray, bands: int, penalty: float = 1e-3, steps: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """Proportional-odds regression by gradient steps with momentum: P(y > k) = sigmoid(x w - cut_k)."""
    w, cuts = np.zeros(x.shape[1]), np.linspace(-2, 2, bands - 1)
    vw, vc = np.zeros_like(w), np.zeros_like(cuts)
    above = (y[:, None] > np.arange(1, bands)[None, :]).astype(float)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-((x @ w)[:, None] - cuts[None, :])))
        e = (p - above) / len(y)
        gw, gc = x.T @ e.sum(1) + penalty * w, -e.sum(0)
        vw, vc = 0.9 * vw + gw, 0.9 * vc + gc
        w, cuts = w - 0.3 * vw, np.sort(cuts - 0.3 * vc)
    return w, cuts


def reading_levels(df: DataFrame, key: str, text: str, samples: DataFrame, diagram=None) -> DataFrame:
    """(key, is_english, n_sentences, score, band) of every row."""
    graded = [(r["band"], r["text"]) for r in samples.filter("text IS NOT NULL AND band IS NOT NULL").orderBy("sample_id").limit(MAX_SAMPLES).collect()]
    model = df.sparkSession.sparkContext.broadcast(Level(graded, corpus_counts(df, text)))
    kind = df.schema[key].dataType.simpleString()
    shown = F.when(F.coalesce(diagram, F.lit(False)), None).otherwise(F.col(text)) if diagram is not None else F.col(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [])
            for t in b.column(1).to_pylist():
                found, english = prose(t)
                score = m.score(found) if english else None
                cols[0].append(english)
                cols[1].append(len(found))
                cols[2].append(score)
                cols[3].append(None if score is None else int(min(BANDS, max(1, round(score)))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.bool_()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int32())], names=[key, "is_english", "n_sentences", "score", "band"])

    return df.select(key, shown.alias("_shown")).mapInArrow(run, f"{key} {kind}, is_english boolean, n_sentences int, score double, band int")
