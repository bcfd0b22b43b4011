"""Wiki pages: file names, routing of facts and relations to pages, numbered sources, rendered text.

Routing is an equi-join of endpoint keys with page keys. What belongs on a page are rows in a fixed order. A page of at most
``MOST_LINES`` rows is one text; a longer one (a name with a share of all edges) comes in parts of so many rows, so that
no page is ever collected. Parts joined by line ends are the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.names import alias_keys_col, match_key_col, short_hash, statement_key_col
from quillmill.functions.text import short
from quillmill.operators.graph import kind_rank
from quillmill.operators.knowledge import SOURCE, source_rows

MAX_STEM, MAX_QUOTE = 80, 300
#: Rows of facts, relations and sources that one text holds.
MOST_LINES = 5000
HEADINGS = ((2, "Facts"), (3, "Relations"), (4, "Sources"))
#: Device names that cannot be file names.
RESERVED = ("con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10)))


def safe_stem(name: Column, object_id: Column) -> Column:
    """File-safe base name; readable names in any script stay."""
    s = F.trim(F.replace(F.coalesce(name, F.lit("")), F.lit("\xa0"), F.lit(" ")))
    s = F.regexp_replace(F.regexp_replace(s, r'[\\/:*?"<>|\x00-\x1f]+', "-"), "-{2,}", "-")
    s = F.regexp_replace(F.regexp_replace(F.trim(s), r"^\.+", ""), r"[ .]+$", "")
    tail = F.when(F.coalesce(object_id, F.lit("")) != "", F.left(object_id, F.lit(8))).otherwise(short_hash(s, 8))
    cut = F.concat(F.regexp_replace(F.left(s, F.greatest(F.lit(MAX_STEM) - F.length(tail) - 1, F.lit(1))), r"\s+$", ""), F.lit("-"), tail)
    s = F.when(F.char_length(s) > MAX_STEM, cut).otherwise(s)
    s = F.when(F.lower(s).isin(*RESERVED), F.concat(F.lit("_"), s)).otherwise(s)
    return F.when(F.regexp_replace(s, "^[-.]+|[-.]+$", "") == "", "page").otherwise(s)


def page_targets(view: DataFrame) -> DataFrame:
    """(object_id, kind, title, ord): one page per object."""
    g = view.groupBy("id").agg(F.min(F.struct(kind_rank(F.col("kind")).alias("r"), "item_id", "kind", "name")).alias("_f"))
    return g.select(F.col("id").alias("object_id"), "_f.kind", F.col("_f.name").alias("title"))


def page_paths(targets: DataFrame, extension: str = ".md", reserved: tuple[str, ...] = ("index",)) -> DataFrame:
    """(object_id, kind, title, path): unique without regard to case.

    Stems that collide get their kind, then the start of their id, then a number in page order.
    """
    s = targets.withColumn("_stem", safe_stem(F.col("title"), F.col("object_id"))).withColumn("_low", F.lower("_stem"))
    many = F.count("*").over(Window.partitionBy("_low"))
    style = F.when(many > 1, F.concat("_stem", F.lit("-"), "kind")).otherwise(F.col("_stem"))
    s = s.withColumn("_style", style).withColumn("_key", match_key_col("title"))
    order = [kind_rank(F.col("kind")), F.col("_key"), F.col("object_id")]
    first = F.row_number().over(Window.partitionBy(F.lower("_style")).orderBy(*order))
    longer = F.concat("_style", F.lit("-"), F.left("object_id", F.lit(8)))
    taken = F.lower("_style").isin(*[r.lower() for r in reserved]) if reserved else F.lit(False)
    s = s.withColumn("_name", F.when((first == 1) & ~taken, F.col("_style")).otherwise(longer))
    again = F.row_number().over(Window.partitionBy(F.lower("_name")).orderBy(*order))
    return s.withColumn("_again", again).select("object_id", "kind", "title", F.concat("_name", F.when(F.col("_again") > 1, F.concat(F.lit("-"), F.col("_again").cast("string"))).otherwise(""), F.lit(extension)).alias("path"))


def page_keys(view: DataFrame) -> DataFrame:
    return view.select(F.col("id").alias("object_id"), F.explode(alias_keys_col("name", "aliases")).alias("key")).distinct()


def route(links: DataFrame, keys: DataFrame, ref: str, first: str, second: str) -> DataFrame:
    """(object_id, ref, direction): each fact or relation goes to every page that one of its ends names."""
    ends = links.select(ref, match_key_col(first).alias("k1"), match_key_col(second).alias("k2"))
    side = F.explode(F.array(F.struct(F.col("k1").alias("key"), F.lit(0).alias("in_")), F.struct(F.col("k2").alias("key"), F.lit(1).alias("in_"))))
    hit = ends.select(ref, side.alias("_s")).select(ref, "_s.key", "_s.in_").filter("key <> ''").join(keys, "key")
    return hit.groupBy("object_id", ref).agg(F.min("in_").alias("_in")).select("object_id", ref, F.when(F.col("_in") == 0, "out").otherwise("in").alias("direction"))


def unattached(links: DataFrame, routed: DataFrame, ref: str) -> DataFrame:
    return links.join(routed.select(ref).distinct(), ref, "left_anti")


def page_sources(view: DataFrame, facts: DataFrame, relations: DataFrame, fact_routes: DataFrame, relation_routes: DataFrame) -> DataFrame:
    """(object_id, number, document_id, section_id, page_number, quote): distinct sources of a page, numbered in order."""
    own = source_rows(view.withColumnRenamed("id", "object_id"), "object_id", "item_id").select("object_id", *SOURCE)
    f = fact_routes.join(facts.select("fact_id", "sources"), "fact_id").select("object_id", F.explode("sources").alias("_s")).select("object_id", *[F.col(f"_s.{c}").alias(c) for c in SOURCE])
    r = relation_routes.join(relations.select("edge_id", "sources"), "edge_id").select("object_id", F.explode("sources").alias("_s")).select("object_id", *[F.col(f"_s.{c}").alias(c) for c in SOURCE])
    every = own.unionByName(f).unionByName(r).withColumn("quote", F.coalesce("quote", F.lit(""))).distinct()
    order = [F.coalesce("document_id", F.lit("")), F.coalesce("section_id", F.lit("")), F.coalesce("page_number", F.lit(-1)), F.col("quote")]
    return every.withColumn("number", F.row_number().over(Window.partitionBy("object_id").orderBy(*order, F.col("section_id").isNull())))


def source_line(number: Column) -> Column:
    """One entry of a list of sources."""
    parts = F.concat_ws(
        " · ", F.concat(F.lit("**"), F.coalesce("document_id", F.lit("")), F.lit("**")), F.when(F.coalesce("section_id", F.lit("")) != "", F.concat(F.lit("section `"), "section_id", F.lit("`"))),
        F.when(F.col("page_number").isNotNull(), F.concat(F.lit("page "), F.col("page_number").cast("string"))),
    )
    quote = short(F.col("quote"), MAX_QUOTE)
    return F.concat(number.cast("string"), F.lit(". "), parts, F.when(quote != "", F.concat(F.lit(" — “"), quote, F.lit("”"))).otherwise(""))


def relation_text(direction: Column) -> Column:
    arrow = F.when(F.col("type") != "", F.concat(F.lit("—"), "type", F.lit("→"))).otherwise("→")
    text = F.concat_ws(" ", F.col("source"), arrow, F.col("target"))
    return F.when(direction == "in", F.concat(F.lit("← "), text)).otherwise(text)


def _ordered(c: Column) -> Column:
    """A number as text of the same order."""
    return F.lpad(c.cast("string"), 20, "0")


def _lines(df: DataFrame, rank: int, order: list[Column], line: Column) -> DataFrame:
    return df.select("object_id", F.lit(rank).alias("rank"), F.concat_ws("\x01", *order).alias("o"), line.alias("line"))


def _joined(lines: DataFrame, out: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("o", "line")))
    return lines.groupBy("object_id").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias(out))


def _entries(links: DataFrame, ref: str, rank: int, order: list[Column], line: Column) -> DataFrame:
    """(object_id, rank, ref, o, line, cited, source): a row with the text of each entry of a page and one for each source it cites."""
    none = F.lit(None).cast("string")
    told = F.struct(F.concat_ws("\x01", *order).alias("o"), line.alias("line"), F.lit(False).alias("cited"), *_source_of(None))
    cites = F.transform(F.coalesce("sources", F.array().cast(links.schema["sources"].dataType)), lambda s: F.struct(none.alias("o"), none.alias("line"), F.lit(True).alias("cited"), *_source_of(s)))
    return links.select("object_id", F.lit(rank).alias("rank"), F.col(ref).cast("long").alias("ref"), F.explode(F.concat(F.array(told), cites)).alias("_e")).select("object_id", "rank", "ref", "_e.*")


def _source_of(s: Column | None) -> list[Column]:
    types = dict.fromkeys(SOURCE, "string") | {"page_number": "int"}
    return [(F.lit(None) if s is None else s[c]).cast(types[c]).alias(c) for c in SOURCE]


def _page_lines(entries: DataFrame) -> DataFrame:
    """(object_id, rank, o, line) of all entries with the numbers of their sources, and of the sources.

    Numbers, marks and the list of sources come from the order of a page's rows, without a join by source.
    """
    e = entries.withColumn("quote", F.coalesce("quote", F.lit("")))
    order = [F.coalesce("document_id", F.lit("")), F.coalesce("section_id", F.lit("")), F.coalesce("page_number", F.lit(-1)), F.col("quote"), F.col("section_id").isNull(), F.col("document_id").isNull(), F.col("page_number").isNull()]
    w = Window.partitionBy("object_id").orderBy(~F.col("cited"), *order)
    e = e.withColumn("number", F.dense_rank().over(w)).withColumn("_before", F.lag("number", 1, 0).over(w))
    row = lambda rank, ref, o, line, number: F.struct(rank.alias("rank"), ref.cast("long").alias("ref"), o.cast("string").alias("o"), line.cast("string").alias("line"), number.cast("int").alias("number"))
    none, n = F.lit(None), F.col("number")
    mark = F.when(F.col("cited") & F.col("ref").isNotNull(), row(F.col("rank"), F.col("ref"), none, none, n))
    source = F.when(F.col("cited") & (n != F.col("_before")), row(F.lit(4), n, _ordered(n), source_line(n), none))
    text = F.when(~F.col("cited"), row(F.col("rank"), F.col("ref"), F.col("o"), F.col("line"), none))
    rows = e.select("object_id", F.explode(F.filter(F.array(text, mark, source), lambda x: x.isNotNull())).alias("_r")).select("object_id", "_r.*")
    marks = F.array_sort(F.collect_set("number"))
    lines = rows.groupBy("object_id", "rank", "ref").agg(F.max("o").alias("o"), F.max("line").alias("line"), marks.alias("_m"))
    told = F.when(F.size("_m") > 0, F.concat(F.lit(" "), F.array_join(F.transform("_m", lambda x: F.concat(F.lit("["), x.cast("string"), F.lit("]"))), ""))).otherwise("")
    return lines.select("object_id", "rank", "o", F.concat("line", told).alias("line"))


def _yaml(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def render_pages(view: DataFrame, node_table: DataFrame, facts: DataFrame, relations: DataFrame, front_matter: bool = True, most: int = MOST_LINES) -> DataFrame:
    """(path, object_id, kind, title, part, section, text): front matter, description, facts, relations, sources.

    A page of up to ``most`` lines is part 0 with a null section; a longer one has parts 0, 1... of one section each.
    """
    paths, keys = page_paths(page_targets(view)), page_keys(view)
    fr, rr = route(facts, keys, "fact_id", "subject", "object"), route(relations, keys, "edge_id", "source", "target")
    fl = fr.join(facts.select("fact_id", "statement", "sources", statement_key_col("statement").alias("_k")), "fact_id")
    fl = _entries(fl, "fact_id", 2, [F.col("_k"), _ordered(F.col("fact_id"))], F.concat(F.lit("- "), "statement"))
    keyed = relations.select("edge_id", "source", "type", "target", "sources", *[match_key_col(c).alias(f"_{c}") for c in ("source", "type", "target")])
    rl = _entries(rr.join(keyed, "edge_id"), "edge_id", 3, [F.col("_source"), F.col("_type"), F.col("_target"), _ordered(F.col("edge_id"))], F.concat(F.lit("- "), relation_text(F.col("direction"))))
    own = _entries(view.select(F.col("id").alias("object_id"), "sources", F.lit(None).alias("_ref")), "_ref", 0, [F.lit("")], F.lit("")).filter("cited")
    lines = _page_lines(fl.unionByName(rl).unionByName(own))
    al = view.select(F.col("id").alias("object_id"), "item_id", F.posexplode("aliases").alias("p", "alias")).filter("btrim(alias) <> ''")
    al = al.groupBy("object_id", "alias").agg(F.min(F.struct("item_id", "p")).alias("_o"))
    al = _joined(_lines(al, 0, [_ordered(F.col("_o.item_id")), _ordered(F.col("_o.p")), F.col("alias")], F.concat(F.lit("  - "), _yaml(F.col("alias")))), "_aliases")
    p = paths.join(node_table.select(F.col("id").alias("object_id"), "type", "description"), "object_id", "left").join(al, "object_id", "left")
    front = F.concat(
        F.lit("---\nid: "), _yaml(F.col("object_id")), F.lit("\nkind: "), _yaml(F.col("kind")), F.when(F.coalesce("type", F.lit("")) != "", F.concat(F.lit("\ntype: "), _yaml(F.col("type")))).otherwise(""),
        F.when(F.col("_aliases").isNotNull(), F.concat(F.lit("\naliases:\n"), "_aliases")).otherwise(""), F.lit("\npage: "), _yaml(F.col("path")), F.lit("\n---\n"),
    )
    block = lambda title, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"## {title}\n\n"), c, F.lit("\n\n"))).otherwise("")
    p = p.withColumn("_head", F.concat(front if front_matter else F.lit(""), F.lit("# "), "title", F.lit("\n\n"), block("Description", F.col("description"))))
    cols = ("path", "object_id", "kind", "title")
    # the rows of a long page are numbered in each section, after its heading; all others are one group
    n = F.count("*").over(Window.partitionBy("object_id"))
    at = F.row_number().over(Window.partitionBy("object_id", "rank").orderBy("o", "line"))
    lines = lines.withColumn("_at", at).withColumn("_long", n > most)
    lines = lines.withColumn("_rank", F.when(F.col("_long"), F.col("rank"))).withColumn("_k", F.when(F.col("_long"), F.floor(F.col("_at") / F.lit(most))))
    texts = lines.groupBy("object_id", "_long", "_rank", "_k").agg(F.array_sort(F.collect_list(F.struct("rank", "o", "line"))).alias("_rows"))
    joined = lambda rows: F.array_join(F.transform(rows, lambda x: x["line"]), "\n")
    of = lambda rank: F.filter("_rows", lambda x: x["rank"] == rank)
    blocks = F.concat(*[block(title, joined(of(rank))) for rank, title in HEADINGS])
    heading = F.when(F.col("_k") == 0, F.element_at(F.create_map(*[F.lit(x) for h in HEADINGS for x in (h[0], f"\n## {h[1]}\n\n")]), F.col("_rank"))).otherwise("")
    section = F.element_at(F.create_map(*[F.lit(x) for h in HEADINGS for x in h]), F.col("_rank"))
    part = F.row_number().over(Window.partitionBy("object_id").orderBy("_rank", "_k"))
    texts = texts.select("object_id", "_long", F.when(F.col("_long"), section).alias("section"), F.when(F.col("_long"), F.concat(heading, joined(F.col("_rows")))).otherwise(blocks).alias("_text"), F.when(F.col("_long"), part).otherwise(0).alias("part"))
    end = lambda c: F.regexp_replace(c, r"\n+\z", "")
    row = lambda number, section, text: F.struct(number.alias("part"), section.cast("string").alias("section"), text.alias("text"))
    p = p.join(texts, "object_id", "left")
    # a long page begins with a part of its head
    top = F.when(F.col("part") == 1, row(F.lit(0), F.lit(""), end(F.col("_head"))))
    whole = row(F.lit(0), F.lit(None), F.concat(end(F.concat("_head", F.coalesce("_text", F.lit("")))), F.lit("\n")))
    rows = F.when(F.col("_long"), F.array(top, row(F.col("part"), F.col("section"), F.col("_text")))).otherwise(F.array(whole))
    return p.select(*cols, F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("_r")).select(*cols, "_r.*")


def whole_pages(pages: DataFrame) -> DataFrame:
    """Rendered pages with the parts of each put together, for pages whose size is known to be small."""
    text = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "\n"), F.lit("\n"))
    long = pages.filter("section IS NOT NULL").groupBy("path", "object_id", "kind", "title").agg(text.alias("text"))
    return pages.filter("section IS NULL").select("path", "object_id", "kind", "title", "text").unionByName(long)


def index_counts(documents: DataFrame, paths: DataFrame, lost_facts: DataFrame, lost_relations: DataFrame) -> DataFrame:
    """One row with the figures of the overview page."""
    d = documents.select(F.count_distinct("document_id").alias("documents"))
    p = paths.agg(F.count_if(F.col("kind") == "entity").alias("entity_pages"), F.count_if(F.col("kind") == "concept").alias("concept_pages"))
    f, r = lost_facts.agg(F.count("*").alias("unattached_facts")), lost_relations.agg(F.count("*").alias("unattached_relations"))
    one = F.lit(1).alias("_j")
    return d.select(one, "*").join(p.select(one, "*"), "_j").join(f.select(one, "*"), "_j").join(r.select(one, "*"), "_j").drop("_j")


def _numbered(sources: DataFrame) -> DataFrame:
    """Distinct sources with their number in order; ranks inside parts of the order and sums over the parts, so no task sorts all."""
    every = sources.withColumn("quote", F.coalesce("quote", F.lit(""))).distinct()
    every = every.withColumn("_part", F.left(F.coalesce("document_id", F.lit("")), F.lit(2)))
    order = [F.coalesce("document_id", F.lit("")), F.coalesce("section_id", F.lit("")), F.coalesce("page_number", F.lit(-1)), F.col("quote"), F.col("section_id").isNull()]
    per = every.groupBy("_part").agg(F.count("*").alias("_n"))
    per = per.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return every.withColumn("_r", rank).join(F.broadcast(per), "_part").select(*SOURCE, (F.col("_r") + F.col("_before")).alias("number"))


def unattached_lists(lost_facts: DataFrame, lost_relations: DataFrame) -> DataFrame:
    """(part, sort, line) of the facts and relations that belong on no page, with their numbered sources."""
    f = lost_facts.select(F.lit(20).alias("part"), F.concat_ws("\x01", statement_key_col("statement"), F.lpad(F.col("fact_id").cast("string"), 20, "0")).alias("sort"), F.concat(F.lit("- "), "statement").alias("line"), "sources")
    keys = F.concat_ws("\x01", *[match_key_col(c) for c in ("source", "type", "target")], F.lpad(F.col("edge_id").cast("string"), 20, "0"))
    r = lost_relations.select(F.lit(21).alias("part"), keys.alias("sort"), F.concat(F.lit("- "), relation_text(F.lit("out"))).alias("line"), "sources")
    both = f.unionByName(r)
    cited = both.select("part", "sort", F.explode("sources").alias("_s")).select("part", "sort", *[F.col(f"_s.{c}").alias(c) for c in SOURCE]).withColumn("quote", F.coalesce("quote", F.lit("")))
    numbered = _numbered(cited.select(*SOURCE))
    same = F.col("c.quote") == F.col("n.quote")
    for c in ("document_id", "section_id", "page_number"):
        same = same & F.col(f"c.{c}").eqNullSafe(F.col(f"n.{c}"))
    hits = cited.alias("c").join(numbered.alias("n"), same).select("c.part", "c.sort", "n.number").distinct()
    marks = hits.groupBy("part", "sort").agg(F.concat(F.lit(" "), F.array_join(F.transform(F.array_sort(F.collect_list("number")), lambda x: F.concat(F.lit("["), x.cast("string"), F.lit("]"))), "")).alias("marks"))
    lines = both.join(marks, ["part", "sort"], "left").select("part", "sort", F.concat("line", F.coalesce("marks", F.lit(""))).alias("line"))
    return lines.unionByName(numbered.select(F.lit(22).alias("part"), F.lpad(F.col("number").cast("string"), 20, "0").alias("sort"), source_line(F.col("number")).alias("line")))


def index_page(counts: DataFrame, documents: DataFrame, paths: DataFrame, lost_facts: DataFrame | None = None, lost_relations: DataFrame | None = None) -> DataFrame:
    """(part, sort, line) of the overview page in its order; rows, because it grows with the wiki."""
    head = counts.select(
        F.lit(0).alias("part"), F.lit("").alias("sort"),
        F.concat_ws(" · ", *[F.concat(F.col(c).cast("string"), F.lit(f" {t}")) for c, t in (("documents", "document(s)"), ("entity_pages", "entity page(s)"), ("concept_pages", "concept page(s)"), ("unattached_facts", "unattached fact(s)"), ("unattached_relations", "unattached relation(s)"))]).alias("line"),
    )
    docs = documents.select("document_id", "title", "source").groupBy("document_id").agg(F.min(F.struct("title", "source")).alias("_d")).select(
        F.lit(1).alias("part"), F.col("document_id").alias("sort"),
        F.concat(F.lit("- `"), "document_id", F.lit("` — "), F.coalesce(F.nullif(F.col("_d.title"), F.lit("")), F.col("document_id")), F.when(F.coalesce("_d.source", F.lit("")) != "", F.concat(F.lit(" ("), "_d.source", F.lit(")"))).otherwise("")).alias("line"),
    )
    pages = paths.select((kind_rank(F.col("kind")) + 2).alias("part"), F.concat_ws("\x01", match_key_col("title"), "object_id").alias("sort"), F.concat(F.lit("- "), "title", F.lit(" → "), "path").alias("line"))
    out = head.unionByName(docs).unionByName(pages)
    return out if lost_facts is None else out.unionByName(unattached_lists(lost_facts, lost_relations))

