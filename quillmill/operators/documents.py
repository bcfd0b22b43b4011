"""Document structure: headings, section trees, titles and prompts, all as window expressions over lines.

A document is never collected: its lines are rows, fences and parents come from windows per document, and only the
lines of one section are put together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.names import section_id
from quillmill.functions.text import first_line, lines, stem, strip

#: Section kinds.
HEADING, PREAMBLE, PAGE, DOCUMENT = "heading", "preamble", "page", "document"
_FENCE = r"(?U)^\s*(?:```|~~~)"
_ATX = r"(?U)^(#{1,6})\s+(.+?)\s*#*\s*$"
_DEPTH = 6


def text_facts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, title, line_count, char_count): title is the first visible line."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(key, first_line(t).alias("title"), F.size(lines(t)).alias("line_count"), F.char_length(t).alias("char_count"))


def split_front_matter(c: Column) -> Column:
    """struct(front, body): a leading block between --- and --- or ...; without its end all is body."""
    shape = r"(?s)\A[ \t]*---[ \t]*\n(.*?\n)??[ \t]*(?:---|\.\.\.)[ \t]*(?:\n|\z)"
    has = c.rlike(shape)
    return F.struct(
        F.when(has, F.regexp_extract(c, shape, 1)).alias("front"),
        F.when(has, F.regexp_replace(F.regexp_replace(c, shape, ""), r"\A\n+", "")).otherwise(c).alias("body"),
    )


def line_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line, level, heading): level 0 for lines that are no heading outside a fence."""
    rows = docs.select(key, F.posexplode(lines(F.coalesce(F.col(text), F.lit("")))).alias("pos", "line"))
    fence = F.col("line").rlike(_FENCE)
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = F.sum(fence.cast("int")).over(before) % 2 == 1
    rows = rows.withColumn("_open", inside | fence)
    is_head = ~F.col("_open") & F.col("line").rlike(_ATX)
    return rows.select(
        key, "pos", "line",
        F.when(is_head, F.length(F.regexp_extract("line", _ATX, 1))).otherwise(0).alias("level"),
        F.when(is_head, strip(F.regexp_extract("line", _ATX, 2))).alias("heading"),
    )


def headings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, level, heading) of the headings, line numbers from 1."""
    return line_table(docs, key, text).filter("level > 0").select(key, (F.col("pos") + 1).alias("line_no"), "level", "heading")


def _whole(docs: DataFrame, key: str, title: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        key, F.lit("1").alias("path"), F.array(F.lit(1)).alias("sort_path"), F.lit(None).cast("string").alias("parent_path"), F.lit(1).alias("level"),
        F.lit(DOCUMENT).alias("kind"), F.lit(None).cast("int").alias("heading_level"), F.lit(None).cast("int").alias("page_number"),
        F.lit(1).alias("line_start"), F.greatest(F.size(lines(t)), F.lit(1)).alias("line_end"), F.col(title).alias("title"), t.alias("content"),
    )


def _trimmed(pos: Column, line: Column) -> Column:
    """Lines in order, joined, blank lines at both ends dropped."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos.alias("p"), line.alias("l")))), lambda x: x["l"]), "\n")
    return F.regexp_replace(F.regexp_replace(body, r"(?U)\A(?:[^\S\n]*\n)+", ""), r"(?U)(?:\n[^\S\n]*)+\z", "")


def markdown_sections(docs: DataFrame, key: str, title: str, text: str) -> DataFrame:
    """Section rows of Markdown documents; documents without heading are one section.

    The parent of a heading is the nearest earlier heading of a smaller level: for each level k the last position with
    that level comes from a window, the largest of those below the own level is the parent. Ordinals count siblings;
    paths are joined over at most six levels.
    """
    rows = line_table(docs.select(key, text), key, text)
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("head_pos", F.max(F.when(F.col("level") > 0, F.col("pos"))).over(upto))
    body = rows.groupBy(key, "head_pos").agg(
        F.max(F.when(F.col("level") > 0, F.col("level"))).alias("heading_level"),
        F.max("heading").alias("title"),
        F.max("pos").alias("last"),
        _trimmed(F.col("pos"), F.when(F.col("level") == 0, F.col("line"))).alias("content"),
    )
    has_head = Window.partitionBy(key)
    body = body.withColumn("_n", F.count("head_pos").over(has_head)).filter("_n > 0")
    body = body.filter("head_pos IS NOT NULL OR content <> ''")
    order = Window.partitionBy(key).orderBy(F.col("head_pos").asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("heading_level") == k, F.col("head_pos"))).over(before).alias(f"l{k}") for k in range(1, _DEPTH + 1)]
    body = body.select("*", *last)
    # greatest ignores nulls; a level k below the own level whose last heading came after all smaller ones is the parent
    parent = F.lit(None).cast("int")
    for own in range(_DEPTH, 1, -1):
        lower = [F.col(f"l{k}") for k in range(1, own)]
        parent = F.when(F.col("heading_level") == own, F.greatest(*lower) if len(lower) > 1 else lower[0]).otherwise(parent)
    body = body.withColumn("parent_pos", parent)
    siblings = Window.partitionBy(key, "parent_pos").orderBy(F.col("head_pos").asc_nulls_first())
    body = body.withColumn("ordinal", F.row_number().over(siblings)).drop(*[f"l{k}" for k in range(1, _DEPTH + 1)], "_n")
    # walk up the tree inside a document: the ancestors' ordinals, at most six of them
    tree = body.select(key, F.col("head_pos").alias("node"), F.col("parent_pos").alias("up"), F.array("ordinal").alias("sort_path"))
    step = body.filter("head_pos IS NOT NULL").select(key, F.col("head_pos").alias("up"), F.col("parent_pos").alias("next"), F.col("ordinal").alias("o"))
    for _ in range(_DEPTH - 1):
        tree = tree.join(step, [key, "up"], "left").select(key, "node", F.col("next").alias("up"), F.when(F.col("o").isNotNull(), F.concat(F.array("o"), "sort_path")).otherwise(F.col("sort_path")).alias("sort_path"))
    path = F.array_join(F.transform("sort_path", lambda x: x.cast("string")), ".")
    tree = tree.select(key, F.coalesce("node", F.lit(-1)).alias("node"), "sort_path", path.alias("path"))
    made = body.withColumn("node", F.coalesce("head_pos", F.lit(-1))).join(tree, [key, "node"]).select(
        key, "path", "sort_path",
        F.when(F.size("sort_path") > 1, F.regexp_replace("path", r"\.[0-9]+$", "")).alias("parent_path"),
        F.size("sort_path").alias("level"),
        F.when(F.col("head_pos").isNull(), PREAMBLE).otherwise(HEADING).alias("kind"),
        "heading_level", F.lit(None).cast("int").alias("page_number"),
        F.when(F.col("head_pos").isNull(), 1).otherwise(F.col("head_pos") + 1).alias("line_start"),
        (F.col("last") + 1).alias("line_end"),
        F.coalesce("title", F.lit("")).alias("title"), "content",
    )
    plain = docs.join(made.select(key).distinct(), key, "left_anti")
    return made.unionByName(_whole(plain, key, title, text))


def page_sections(pages: DataFrame, key: str) -> DataFrame:
    """Section rows of paged documents from (key, page_number, text)."""
    n = F.row_number().over(Window.partitionBy(key).orderBy("page_number"))
    return pages.withColumn("_n", n).select(
        key, F.col("_n").cast("string").alias("path"), F.array("_n").alias("sort_path"), F.lit(None).cast("string").alias("parent_path"), F.lit(1).alias("level"),
        F.lit(PAGE).alias("kind"), F.lit(None).cast("int").alias("heading_level"), F.col("page_number").cast("int").alias("page_number"),
        F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"),
        F.concat(F.lit("Page "), F.col("page_number").cast("string")).alias("title"), F.coalesce("text", F.lit("")).alias("content"),
    )


def build_sections(docs: DataFrame, key: str, doc_format: str, title: str, text: str, pages: DataFrame | None = None) -> DataFrame:
    """Section rows of all documents by format; paged documents without pages are one section."""
    md = docs.filter(F.col(doc_format) == "markdown")
    rest = docs.filter(F.coalesce(F.col(doc_format), F.lit("")) != "markdown")
    out = markdown_sections(md, key, title, text)
    if pages is not None:
        paged = page_sections(pages.join(rest.filter(F.col(doc_format) == "pdf").select(key), key, "left_semi"), key)
        out = out.unionByName(paged)
        rest = rest.join(pages.select(key).distinct(), key, "left_anti")
    return out.unionByName(_whole(rest, key, title, text))


def with_section_ids(sections: DataFrame, key: str) -> DataFrame:
    return sections.withColumn("section_id", section_id(F.col(key).cast("string"), F.col("path")))


def document_titles(docs: DataFrame, key: str, front_title: Column, heading_key: DataFrame, path: str) -> DataFrame:
    """(key, title): title of the front matter, else the first heading, else the file stem."""
    first = heading_key.groupBy(key).agg(F.min_by("heading", "line_no").alias("_h"))
    return docs.join(first, key, "left").select(key, F.coalesce(F.nullif(F.trim(front_title), F.lit("")), F.col("_h"), stem(F.col(path))).alias("title"))


def user_prompts(docs: DataFrame, sections: DataFrame, key: str, title: str, source: str, doc_format: str) -> DataFrame:
    """(key, prompt): the document header and one labelled block per section, in tree order."""
    head = F.concat(
        F.lit("[section "), F.col("section_id"),
        F.when(F.col("page_number").isNotNull(), F.concat(F.lit(" | page "), F.col("page_number").cast("string"))).otherwise(""), F.lit("]"),
    )
    block = F.concat(F.lit("\n"), head, F.lit("\n"), F.when(F.col("title") != "", F.concat("title", F.lit("\n"))).otherwise(""), F.col("content"))
    blocks = sections.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sort_path", block.alias("b")))), lambda x: x["b"]), "\n").alias("_blocks"))
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    top = F.concat(F.lit("Document\nid: "), s(key), F.lit("\ntitle: "), s(title), F.lit("\nsource: "), s(source), F.lit("\nformat: "), s(doc_format), F.lit("\n\n"))
    intro = F.lit('Sections (cite these ids in "sources"; a section header is not part of its text):\n')
    return docs.join(blocks, key).select(key, F.concat(top, intro, "_blocks", F.lit("\n\nNow return the JSON object.")).alias("prompt"))
