"""Reading raw files: decode, pick the parser by suffix, reject what cannot be read - one scan for all files."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillmill.functions.encoding import decode_column
from quillmill.functions.names import document_id
from quillmill.functions.text import lines, stem, suffix
from quillmill.operators import documents as D

MARKDOWN, TXT, PDF, LW = "markdown", "txt", "pdf", "lw"


class SourceNotFoundError(FileNotFoundError):
    """The path is missing or is no file or folder."""


class UnsupportedFormatError(ValueError):
    """No parser is registered for the suffix."""


Parser = Callable[[DataFrame], DataFrame]
COLUMNS = ("path", "title", "source", "doc_format", "text", "encoding", "had_errors", "line_count", "char_count", "front_matter", "error")


def _plain(df: DataFrame, fmt: str, title: Column, text: Column, front: Column | None = None) -> DataFrame:
    t = F.coalesce(text, F.lit(""))
    return df.select(
        "path", F.coalesce(F.nullif(F.trim(title), F.lit("")), stem(F.col("path"))).alias("title"), F.col("path").alias("source"), F.lit(fmt).alias("doc_format"), t.alias("text"), "d.encoding", "d.had_errors",
        F.size(lines(t)).alias("line_count"), F.char_length(t).alias("char_count"), (front if front is not None else F.lit(None).cast("string")).alias("front_matter"), F.lit(None).cast("string").alias("error"),
    )


def parse_txt(df: DataFrame) -> DataFrame:
    d = df.withColumn("d", decode_column(F.col("content")))
    return _plain(d, TXT, D.first_line(F.col("d.text")), F.col("d.text"))


@F.arrow_udf(StringType())
def _front_json(raw: pa.Array) -> pa.Array:
    """Front matter as JSON: YAML where the library is there, else key: value lines; dates become ISO text."""
    import datetime
    import json

    try:
        import yaml
    except ImportError:
        yaml = None

    def tidy(v):
        if isinstance(v, datetime.date):
            return v.isoformat()
        if isinstance(v, list):
            return [tidy(x) for x in v]
        return {str(k): tidy(x) for k, x in v.items()} if isinstance(v, dict) else v

    def one(text: str) -> str:
        if yaml is not None:
            try:
                got = yaml.safe_load(text)
            except yaml.YAMLError:
                got = None
            if isinstance(got, dict):
                return json.dumps({str(k).strip(): tidy(v) for k, v in got.items()}, ensure_ascii=False, default=str)
        pairs = (x.partition(":") for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#") and ":" in x)
        return json.dumps({k.strip(): v.strip().strip("\"'") for k, _, v in pairs if k.strip()}, ensure_ascii=False)

    return pa.array([None if t is None else one(t) for t in raw.to_pylist()], pa.string())


def parse_markdown(df: DataFrame) -> DataFrame:
    d = df.withColumn("d", decode_column(F.col("content"))).withColumn("f", D.split_front_matter(F.coalesce("d.text", F.lit(""))))
    d = d.withColumn("front", _front_json("f.front"))
    first = D.headings(d.select("path", F.col("f.body").alias("body")), "path", "body").groupBy("path").agg(F.min_by("heading", "line_no").alias("h"))
    d = d.join(first, "path", "left")
    title = F.coalesce(F.nullif(F.trim(F.get_json_object("front", "$.title")), F.lit("")), F.col("h"))
    return _plain(d, MARKDOWN, title, F.col("f.body"), F.col("front"))


def parse_lw(df: DataFrame) -> DataFrame:
    d = df.withColumn("d", decode_column(F.col("content"), diagram=True))
    return _plain(d, LW, F.lit(""), F.col("d.text"))


def pdf_pages(df: DataFrame) -> DataFrame:
    """(path, page_number, text, error) of paged files; without a PDF library every file is one error row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            from pypdf import PdfReader
        except ImportError:
            PdfReader = None
        import io

        for b in batches:
            rows = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if PdfReader is None:
                    rows.append((path, None, None, "no PDF library is installed"))
                    continue
                try:
                    reader = PdfReader(io.BytesIO(data or b""))
                    if reader.is_encrypted and not reader.decrypt(""):
                        raise ValueError("the file is protected by a password")
                    rows += [(path, i, p.extract_text() or "", None) for i, p in enumerate(reader.pages, 1)]
                except Exception as e:
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["path", "page_number", "text", "error"])

    return df.select("path", "content").mapInArrow(run, "path string, page_number int, text string, error string")


def pdf_info(df: DataFrame) -> DataFrame:
    """(path, page_count, encrypted, info, error): the information dictionary of paged files, names without their slash.

    Files that need a password have no page count; without a PDF library every file is an error row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            from pypdf import PdfReader
        except ImportError:
            PdfReader = None
        import io

        kinds = (pa.string(), pa.int32(), pa.bool_(), pa.map_(pa.string(), pa.string()), pa.string())
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                row: tuple = (path, None, None, None, "no PDF library is installed")
                if PdfReader is not None:
                    try:
                        reader = PdfReader(io.BytesIO(data or b""))
                        locked = bool(reader.is_encrypted) and not reader.decrypt("")
                        info = None if locked else [(k.lstrip("/"), str(v)) for k, v in (reader.metadata or {}).items() if v is not None]
                        row = (path, None if locked else len(reader.pages), bool(reader.is_encrypted), info, "the file is protected by a password" if locked else None)
                    except Exception as e:  # the row carries the error
                        row = (path, None, None, None, f"{type(e).__name__}: {e}")
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["path", "page_count", "encrypted", "info", "error"])

    return df.select("path", "content").mapInArrow(run, "path string, page_count int, encrypted boolean, info map<string,string>, error string")


def scan_report(documents: DataFrame) -> DataFrame:
    """(path, status, note) of every scanned file: read, read with a warning, skipped (another suffix) or failed."""
    skipped = F.col("doc_format").isNull()
    status = F.when(skipped, "skipped").when(F.col("error").isNotNull(), "failed").when(F.col("had_errors"), "warning").otherwise("read")
    lost = F.concat(F.lit("some bytes are no "), F.coalesce("encoding", F.lit("text")), F.lit(" and were replaced"))
    return documents.select("path", status.alias("status"), F.coalesce("error", F.when(F.col("had_errors"), lost)).alias("note"))


def parse_pdf(df: DataFrame) -> DataFrame:
    pages = pdf_pages(df)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n\n")
    p = pages.groupBy("path").agg(F.when(F.max("error").isNull(), text).otherwise("").alias("text"), F.max("error").alias("error"))
    return p.select(
        "path", stem(F.col("path")).alias("title"), F.col("path").alias("source"), F.lit(PDF).alias("doc_format"), "text", F.lit(None).cast("string").alias("encoding"), F.lit(False).alias("had_errors"),
        F.size(lines(F.col("text"))).alias("line_count"), F.char_length("text").alias("char_count"), F.lit(None).cast("string").alias("front_matter"), "error",
    )


class ParserRegistry:
    """Parsers by lower-cased suffix."""

    def __init__(self) -> None:
        self._by: dict[str, Parser] = {}

    def register(self, parser: Parser, *extensions: str) -> Parser:
        for e in extensions:
            self._by[e.lower() if e.startswith(".") else f".{e.lower()}"] = parser
        return parser

    def supported_extensions(self) -> list[str]:
        return sorted(self._by)

    def get_parser(self, extension: str) -> Parser:
        try:
            return self._by[extension.lower()]
        except KeyError:
            raise UnsupportedFormatError(f"unsupported file type '{extension}'; supported: {', '.join(self.supported_extensions())}") from None

    def parse_all(self, files: DataFrame) -> DataFrame:
        """Documents of (path, content); files of other suffixes are rows with an error."""
        files = files.withColumn("ext", suffix(F.col("path")))
        out = None
        by_parser: dict[Parser, list[str]] = {}
        for e, p in self._by.items():
            by_parser.setdefault(p, []).append(e)
        for p, exts in by_parser.items():
            part = p(files.filter(F.col("ext").isin(*exts)).select("path", "content")).select(*COLUMNS)
            out = part if out is None else out.unionByName(part)
        none = lambda t: F.lit(None).cast(t)
        rest = files.filter(~F.col("ext").isin(*self._by)).select(
            "path", stem(F.col("path")).alias("title"), F.col("path").alias("source"), none("string").alias("doc_format"), F.lit("").alias("text"), none("string").alias("encoding"), F.lit(False).alias("had_errors"),
            F.lit(0).alias("line_count"), F.lit(0).alias("char_count"), none("string").alias("front_matter"), F.concat(F.lit("unsupported file type '"), "ext", F.lit("'; supported: " + ", ".join(self.supported_extensions()))).alias("error"),
        )
        out = rest if out is None else out.unionByName(rest)
        return out.withColumn("document_id", document_id(F.col("path")))


def create_default_registry() -> ParserRegistry:
    r = ParserRegistry()
    r.register(parse_markdown, ".md", ".markdown")
    r.register(parse_txt, ".txt")
    r.register(parse_pdf, ".pdf")
    r.register(parse_lw, ".lw")
    return r


def read_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, content) of a file or folder; a missing local path raises at once."""
    local = path.removeprefix("file://")
    if "://" not in local and not os.path.exists(local):
        raise SourceNotFoundError(f"source does not exist: '{path}'")
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "content")


def load_documents(spark: SparkSession, path: str, registry: ParserRegistry | None = None) -> DataFrame:
    return (registry or create_default_registry()).parse_all(read_files(spark, path))
