"""Bytes to text: byte order mark, strict UTF-8, a detector, Chinese encodings, then UTF-8 with replacements."""

from __future__ import annotations

import codecs
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

try:
    from charset_normalizer import from_bytes as _guess
except ImportError:
    _guess = None

#: Expected legacy encodings and byte order marks, longest first.
LEGACY = ("gb18030", "big5")
MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
RESULT = StructType([StructField("text", StringType()), StructField("encoding", StringType()), StructField("had_errors", BooleanType())])


class Decoded(NamedTuple):
    text: str
    encoding: str
    had_errors: bool = False


def _tidy(s: str) -> str:
    return s.replace("\r\n", "\n").replace("\r", "\n")


def _detect(data: bytes, among: tuple[str, ...] | None) -> str | None:
    if _guess is None or not data:
        return None
    try:
        best = (_guess(data, cp_isolation=list(among)) if among else _guess(data)).best()
    except Exception:
        return None
    return best.encoding if best is not None else None


def decode(data: bytes, encoding: str | None = None, diagram: bool = False) -> Decoded:
    """Text of a file; ``diagram`` sources try GB 18030 before any detection.

    A given encoding is taken as it is: bytes that it does not have are replaced, and ``had_errors`` says so.
    """
    if encoding is not None:
        try:
            return Decoded(_tidy(data.decode(encoding)), encoding)
        except UnicodeDecodeError:
            return Decoded(_tidy(data.decode(encoding, "replace")), encoding, True)
    plans: list[str | None] = [next((enc for mark, enc in MARKS if data.startswith(mark)), None), "utf-8"]
    if diagram:
        plans.append("gb18030")
    for enc in plans:
        if enc is None:
            continue
        try:
            return Decoded(_tidy(data.decode(enc)), enc)
        except UnicodeDecodeError:
            continue
    for make in (lambda: _detect(data, LEGACY), lambda: _detect(data, None), *((lambda e=e: e) for e in LEGACY)):
        enc = make()
        if enc is None:
            continue
        try:
            return Decoded(_tidy(data.decode(enc)), enc)
        except (UnicodeDecodeError, LookupError):
            continue
    return Decoded(_tidy(data.decode("utf-8", "replace")), "utf-8", True)


def _struct(rows: list[Decoded | None]) -> pa.Array:
    kind = pa.struct([("text", pa.string()), ("encoding", pa.string()), ("had_errors", pa.bool_())])
    return pa.array([None if r is None else r._asdict() for r in rows], kind)


@F.arrow_udf(RESULT)
def _decode_col(data: pa.Array) -> pa.Array:
    return _struct([None if b is None else decode(b) for b in data.to_pylist()])


@F.arrow_udf(RESULT)
def _decode_diagram_col(data: pa.Array) -> pa.Array:
    return _struct([None if b is None else decode(b, diagram=True) for b in data.to_pylist()])


def decode_column(data: Column, diagram: bool = False) -> Column:
    """struct(text, encoding, had_errors) of a binary column; null stays null."""
    return (_decode_diagram_col if diagram else _decode_col)(data)
