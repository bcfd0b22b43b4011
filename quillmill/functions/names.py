"""Keys of names and statements.

Exact Unicode rules (NFKC, case folding) have no built-in in Spark, so they run as Arrow functions; each batch is
reduced to its distinct values first. Everything that built-ins can say stays in the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Signs that may wrap a name, and signs without meaning at its edges.
WRAPS = {"'": "'", '"': '"', "`": "`", "“": "”", "‘": "’", "「": "」", "『": "』", "《": "》", "〈": "〉", "(": ")", "[": "]", "{": "}", "【": "】", "（": "）", "［": "］", "｛": "｝"}
EDGES = "。，、．,.;:!?！？…—-–~·\"'“”‘’()[]{}（）【】《》〈〉「」『』"
FINAL_STOPS = "。.!?！？…"
_SPACES = re.compile(r"\s+")


def _unwrap(s: str) -> str:
    while len(s) > 1 and WRAPS.get(s[0]) == s[-1]:
        s = s[1:-1].strip()
    return s


@lru_cache(200_000)
def match_key(name: str | None) -> str:
    """Two names with the same key are literally the same: width, case, wrapping, edge signs and spacing do not count."""
    s = _unwrap(unicodedata.normalize("NFKC", name or "").strip())
    s = _SPACES.sub(" ", s.casefold()).strip()
    for _ in range(2):
        s = _unwrap(s.strip(EDGES).strip())
    return s.strip(EDGES).strip()


def compact_key(name: str | None) -> str:
    """The match key without spaces."""
    return _SPACES.sub("", match_key(name))


def statement_key(statement: str | None) -> str:
    """The match key of a statement without its final stop."""
    return match_key(statement).rstrip(FINAL_STOPS).strip()


def search_key(text: str | None) -> str:
    """Text for matching: width, case and runs of spaces do not count."""
    return " ".join(unicodedata.normalize("NFKC", text or "").casefold().split())


def alias_keys(name: str | None, aliases: list[str] | None) -> list[str]:
    """Distinct keys of a name and its aliases in order; blanks are left out."""
    return [k for k in dict.fromkeys(match_key(n) for n in [name, *(aliases or [])]) if k]


def _arrow(fn: Callable[[str | None], str]) -> Callable[..., Column]:
    @F.arrow_udf(StringType())
    def run(values: pa.Array) -> pa.Array:
        coded = values.dictionary_encode()
        done = pa.array([fn(x) for x in coded.dictionary.to_pylist()], pa.string())
        out = done.take(coded.indices) if len(done) else pa.nulls(len(values), pa.string())
        return out.fill_null(fn(None))

    return run


match_key_col = _arrow(match_key)
compact_key_col = _arrow(compact_key)
statement_key_col = _arrow(statement_key)
search_key_col = _arrow(search_key)


@F.arrow_udf(ArrayType(StringType()))
def search_keys_col(values: pa.Array) -> pa.Array:
    """Distinct search keys of a list in order; blanks are left out, a null list has none."""
    return pa.array([[k for k in dict.fromkeys(map(search_key, x or [])) if k] for x in values.to_pylist()], pa.list_(pa.string()))


@F.arrow_udf(ArrayType(StringType()))
def alias_keys_col(names: pa.Array, aliases: pa.Array) -> pa.Array:
    return pa.array([alias_keys(n, a) for n, a in zip(names.to_pylist(), aliases.to_pylist(), strict=True)], pa.list_(pa.string()))


def name_tokens(key: Column) -> Column:
    """Distinct ASCII word tokens of more than one character of a match key."""
    return F.filter(F.array_distinct(F.regexp_extract_all(key, F.lit("([0-9a-z]+)"), F.lit(1))), lambda t: F.length(t) > 1)


def normalize_name(c: Column) -> Column:
    """Name for ids: spaces collapsed and trimmed, lower case."""
    return F.replace(F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " "))), F.lit("ß"), F.lit("ss"))


def short_hash(c: Column, n: int = 16) -> Column:
    return F.left(F.sha1(c.cast("binary")), F.lit(n))


def knowledge_id(kind: Column, key: Column) -> Column:
    """Id of a knowledge object from its kind and name; the same in every document."""
    return short_hash(F.concat(kind, F.lit(":"), normalize_name(key)))


def relation_id(source: Column, kind: Column, target: Column) -> Column:
    return knowledge_id(F.lit("relation"), F.concat_ws("|", source, kind, target))


def document_id(path: Column) -> Column:
    """Id of a document from its path; slashes, outer spaces and case do not count."""
    return short_hash(F.replace(F.lower(F.trim(F.replace(path, F.lit("\\"), F.lit("/")))), F.lit("ß"), F.lit("ss")))


def section_id(document: Column, path: Column) -> Column:
    return F.concat(document, F.lit("#"), path)
