"""Registered queries of the reference's own operators, with their SQL.

The SQL says keys with regular expressions; names in width variants or with nested wraps would need NFKC, which DuckDB
does not have, and do not occur in the test tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.names import document_id, match_key_col
from quillmill.functions.text import link_targets
from quillmill.operators import candidates as C
from quillmill.operators import documents as D
from quillmill.operators import extraction as X
from quillmill.operators import graph as G
from quillmill.operators import knowledge as K
from quillmill.operators import lint as L
from quillmill.operators import linker as N
from quillmill.operators import search as S
from quillmill.operators import wiki as W
from quillmill.plans.kb import KnowledgeBase
from quillmill.session import cut
from quillmill.sources import diagram as M

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Callable[[KnowledgeBase], DataFrame]):
        QUERIES[fn.__name__] = lambda spark, d: fn(KnowledgeBase(spark, d))
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


# --- SQL pieces -----------------------------------------------------------------------------------------------------

_SP = r"[\s\x{00A0}\x{3000}]"
_EDGE = r"[\s\x{00A0}\x{3000}`。，、．,.;:!?！？…—\-–~·\"''“”‘’()\[\]{}（）【】《》〈〉「」『』]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SP}+|{_SP}+$', '', 'g')"


def _key(x: str) -> str:
    plain = f"replace(translate(coalesce({x}, ''), '，：；！？（）［］｛｝．', ',:;!?()[]{{}}.'), '…', '...')"
    one = f"regexp_replace(replace(lower({plain}), 'ß', 'ss'), '{_SP}+', ' ', 'g')"
    return f"regexp_replace({one}, '^{_EDGE}+|{_EDGE}+$', '', 'g')"


def _norm(x: str) -> str:
    return f"replace(lower(trim(regexp_replace({x}, '{_SP}+', ' ', 'g'))), 'ß', 'ss')"


def _first(t: str, key: str) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY loaded_at NULLS LAST) AS _n FROM {t} WHERE {key} IS NOT NULL) WHERE _n = 1)"


_ITEMS = f"""iv AS (SELECT item_id, coalesce(kind, 'entity') AS kind, coalesce(name, '') AS name, {_key('name')} AS key,
  left(sha1(coalesce(kind, 'entity') || ':' || {_norm("coalesce(name, '')")}), 16) AS id, coalesce(nullif({_strip('item_type')}, ''), 'other') AS type,
  coalesce(description, '') AS description, coalesce(aliases, []) AS aliases, sources FROM {_first('items', 'item_id')}),
ik AS (SELECT DISTINCT item_id, kind, id, {_key('n')} AS key FROM (SELECT item_id, kind, id, unnest(list_prepend(name, aliases)) AS n FROM iv) WHERE {_key('n')} <> ''),
nk AS (SELECT DISTINCT id, key FROM ik)"""
_FACTS = f"""fv AS (SELECT fact_id, coalesce(statement, '') AS statement, coalesce({_strip('fact_subject')}, '') AS subject, coalesce({_strip('fact_predicate')}, '') AS predicate,
  coalesce({_strip('fact_object')}, '') AS object, sources, rtrim(rtrim({_key('statement')}, '。.!?！？…')) AS key FROM {_first('facts', 'fact_id')})"""
_RELATIONS = f"""rv AS (SELECT edge_id, coalesce({_strip('source')}, '') AS source, coalesce({_strip('target')}, '') AS target, coalesce({_strip('edge_type')}, '') AS type,
  coalesce({_strip('description')}, '') AS description, sources FROM {_first('edges', 'edge_id')} WHERE kind = 'relation' AND coalesce({_strip('source')}, '') <> '' AND coalesce({_strip('target')}, '') <> '')"""
_GROUPS = """lk AS (SELECT DISTINCT a, b FROM (
  SELECT f AS a, item_id AS b FROM (SELECT item_id, min(item_id) OVER (PARTITION BY kind, key) AS f FROM iv WHERE key <> '') WHERE f <> item_id
  UNION ALL SELECT v.left_id, v.right_id FROM verdicts v JOIN iv x ON x.item_id = v.left_id JOIN iv y ON y.item_id = v.right_id WHERE v.same AND v.left_id <> v.right_id AND x.kind = y.kind)),
l2 AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk),
reach AS (SELECT a AS id, b AS o FROM l2 UNION SELECT r.id, l2.b FROM reach r JOIN l2 ON l2.a = r.o),
gr AS (SELECT iv.item_id, least(iv.item_id, coalesce(g.m, iv.item_id)) AS group_id FROM iv LEFT JOIN (SELECT id, min(o) AS m FROM reach GROUP BY id) g ON g.id = iv.item_id),
cn AS (SELECT group_id, arg_min(s, r) AS canonical_name FROM (
  SELECT group_id, s, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, e DESC, f) AS r FROM (
    SELECT group_id, key, count(*) AS n, sum(coalesce(len(sources), 0)) AS e, min(item_id) AS f, arg_min(""" + _strip("name") + """, item_id) AS s FROM iv JOIN gr USING (item_id) WHERE key <> '' GROUP BY group_id, key)) GROUP BY group_id),
nm AS (SELECT group_id, coalesce(canonical_name, own) AS canonical_name FROM (SELECT group_id, arg_min(name, item_id) AS own FROM iv JOIN gr USING (item_id) GROUP BY group_id) LEFT JOIN cn USING (group_id))"""
_NAMES = """mp AS (SELECT key, arg_min(canonical_name, r) AS canonical_name FROM (
  SELECT ik.key, nm.canonical_name, row_number() OVER (PARTITION BY ik.key ORDER BY CASE WHEN ik.kind = 'concept' THEN 0 ELSE 1 END, gr.group_id) AS r
  FROM ik JOIN gr USING (item_id) JOIN nm USING (group_id)) GROUP BY key)"""
_GRAPH = f"""ix AS (SELECT key, count(*) AS n, CASE WHEN count(*) = 1 THEN min(id) END AS id FROM nk GROUP BY key),
ls AS (SELECT 'relation' AS kind, edge_id AS ref_id, source, type, target, description, 0 AS ord FROM rv
  UNION ALL SELECT 'fact', fact_id, subject, predicate, object, '', 1 FROM fv WHERE subject <> '' AND predicate <> '' AND object <> ''),
lr AS (SELECT ls.*, {_key('ls.source')} AS sk, {_key('ls.target')} AS tk, {_key('ls.type')} AS yk FROM ls),
rs AS (SELECT lr.*, coalesce(s.n, 0) AS sn, s.id AS sid, coalesce(t.n, 0) AS tn, t.id AS tid FROM lr LEFT JOIN ix s ON s.key = lr.sk LEFT JOIN ix t ON t.key = lr.tk),
ed AS (SELECT sk AS source_key, yk AS type_key, tk AS target_key, arg_min(source, (ord, ref_id)) AS source, arg_min(type, (ord, ref_id)) AS type, arg_min(target, (ord, ref_id)) AS target,
  arg_min(kind, (ord, ref_id)) AS kind, max(sid) AS source_id, max(tid) AS target_id, count(*) FILTER (kind = 'relation') AS n_relations, count(*) FILTER (kind = 'fact') AS n_facts,
  bool_or(sn > 1) AS ambiguous_source, bool_or(tn > 1) AS ambiguous_target FROM rs WHERE sn > 0 AND tn > 0 GROUP BY sk, yk, tk),
ts AS (SELECT source_id AS id, source_key, type_key, target_key FROM ed WHERE source_id IS NOT NULL UNION ALL SELECT nk.id, source_key, type_key, target_key FROM ed JOIN nk ON nk.key = source_key WHERE source_id IS NULL),
tt AS (SELECT target_id AS id, source_key, type_key, target_key FROM ed WHERE target_id IS NOT NULL UNION ALL SELECT nk.id, source_key, type_key, target_key FROM ed JOIN nk ON nk.key = target_key WHERE target_id IS NULL),
nd AS (SELECT DISTINCT id FROM iv),
dg AS (SELECT nd.id, coalesce(a.n, 0) AS n_out, coalesce(b.n, 0) AS n_in FROM nd LEFT JOIN (SELECT id, count(*) AS n FROM ts GROUP BY id) a USING (id) LEFT JOIN (SELECT id, count(*) AS n FROM tt GROUP BY id) b USING (id))"""
_KB = f"WITH RECURSIVE {_ITEMS}, {_FACTS}, {_RELATIONS}, {_GROUPS}, {_NAMES}"
_KG = f"WITH {_ITEMS}, {_FACTS}, {_RELATIONS}, {_GRAPH}"
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_LINES = f"""ln AS (SELECT doc_id, pos - 1 AS pos, l AS line FROM (
  SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS pos FROM (
    SELECT doc_id, CASE WHEN t = '' THEN [] WHEN a[-1] = '' THEN a[:-2] ELSE a END AS ls FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_split_to_array(coalesce(text, ''), '{_LINE_END}') AS a, doc_format FROM documents)))),
fe AS (SELECT *, regexp_matches(line, '^{_SP}*(?:```|~~~)') AS f FROM ln),
op AS (SELECT *, f OR sum(CAST(f AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) % 2 = 1 AS o FROM fe),
hd AS (SELECT doc_id, pos, line, CASE WHEN NOT o AND regexp_matches(line, '^#{{1,6}}{_SP}+[^\\n]+') AND {_strip("regexp_replace(regexp_extract(line, '^#{1,6}" + _SP + "+(.+)$', 1), '" + _SP + "*#*" + _SP + "*$', '')")} <> ''
  THEN length(regexp_extract(line, '^(#{{1,6}}){_SP}', 1)) ELSE 0 END AS level,
  {_strip("regexp_replace(regexp_extract(line, '^#{1,6}" + _SP + "+(.+)$', 1), '" + _SP + "*#*" + _SP + "*$', '')")} AS heading FROM op)"""


# --- documents ------------------------------------------------------------------------------------------------------


@query(f"WITH {_LINES} SELECT d.doc_id, coalesce((SELECT left({_strip('arg_min(line, pos)')}, 120) FROM ln WHERE ln.doc_id = d.doc_id AND {_strip('line')} <> ''), '') AS title, (SELECT count(*) FROM ln WHERE ln.doc_id = d.doc_id) AS line_count, length(coalesce(text, '')) AS char_count FROM documents d")
def doc_text_facts(kb: KnowledgeBase) -> DataFrame:
    return D.text_facts(kb.documents, "doc_id", "text")


@query(f"WITH {_LINES} SELECT doc_id, pos + 1 AS line_no, level, heading FROM hd WHERE level > 0")
def doc_headings(kb: KnowledgeBase) -> DataFrame:
    return D.headings(kb.documents, "doc_id", "text")


@query(f"""WITH {_LINES}, md AS (SELECT hd.* FROM hd JOIN documents USING (doc_id) WHERE doc_format = 'markdown'),
hp AS (SELECT *, max(CASE WHEN level > 0 THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) AS h FROM md),
sc AS (SELECT doc_id, h, max(CASE WHEN level > 0 THEN level END) AS lv, max(CASE WHEN level > 0 THEN heading END) AS title, max(pos) + 1 AS line_end FROM hp GROUP BY doc_id, h),
hs AS (SELECT * FROM sc WHERE h IS NOT NULL),
pa AS (SELECT a.*, (SELECT max(b.h) FROM hs b WHERE b.doc_id = a.doc_id AND b.h < a.h AND b.lv < a.lv) AS p FROM hs a)
SELECT doc_id, h + 1 AS line_start, line_end, lv AS heading_level, title, p + 1 AS parent_line FROM pa""")
def doc_sections(kb: KnowledgeBase) -> DataFrame:
    """Heading sections with the line of their parent heading."""
    s = kb.sections.filter("kind = 'heading'")
    up = s.select("doc_id", F.col("path").alias("parent_path"), F.col("line_start").alias("parent_line"))
    return s.join(up, ["doc_id", "parent_path"], "left").select("doc_id", "line_start", "line_end", "heading_level", "title", "parent_line")


_BLANK = r"[ \t\r\f\v\x{00A0}\x{3000}]*"
_TREE = f"""WITH RECURSIVE {_LINES}, md AS (SELECT hd.* FROM hd JOIN documents USING (doc_id) WHERE doc_format = 'markdown'),
hp AS (SELECT *, max(CASE WHEN level > 0 THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) AS h FROM md),
sc AS (SELECT doc_id, h, max(CASE WHEN level > 0 THEN level END) AS lv, max(CASE WHEN level > 0 THEN heading END) AS title, max(pos) + 1 AS line_end,
  regexp_replace(regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (level = 0), ''), '\\A(?:{_BLANK}\\n)+', ''), '(?:\\n{_BLANK})+\\z', '') AS content FROM hp GROUP BY doc_id, h),
hs AS (SELECT * FROM sc WHERE doc_id IN (SELECT doc_id FROM sc WHERE h IS NOT NULL) AND (h IS NOT NULL OR content <> '')),
pa AS (SELECT a.*, (SELECT max(b.h) FROM hs b WHERE b.doc_id = a.doc_id AND b.h < a.h AND b.lv < a.lv) AS p FROM hs a),
od AS (SELECT *, row_number() OVER (PARTITION BY doc_id, p ORDER BY h NULLS FIRST) AS k FROM pa),
tr AS (SELECT doc_id, h, [k] AS way FROM od WHERE p IS NULL UNION ALL SELECT od.doc_id, od.h, list_append(tr.way, od.k) FROM od JOIN tr ON tr.doc_id = od.doc_id AND tr.h = od.p),
tt AS (SELECT od.doc_id, array_to_string(way, '.') AS path, way, array_to_string(way[:-2], '.') AS up, len(way) AS level, CASE WHEN od.h IS NULL THEN 'preamble' ELSE 'heading' END AS kind, lv, coalesce(od.h, 0) + 1 AS line_start, line_end, coalesce(title, '') AS title, content
    FROM od JOIN tr ON tr.doc_id = od.doc_id AND tr.h IS NOT DISTINCT FROM od.h
  UNION ALL SELECT doc_id, '1', [1], '', 1, 'document', NULL, 1, greatest((SELECT count(*) FROM ln WHERE ln.doc_id = d.doc_id), 1), coalesce(title, ''), coalesce(text, '') FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM hs))"""


@query(f"""{_TREE} SELECT doc_id, doc_id || '#' || path AS section_id, path, nullif(up, '') AS parent_path, CAST(level AS INTEGER) AS level, kind, CAST(lv AS INTEGER) AS heading_level, CAST(line_start AS INTEGER) AS line_start, CAST(line_end AS INTEGER) AS line_end, title, content FROM tt""")
def doc_section_tree(kb: KnowledgeBase) -> DataFrame:
    """All sections with ids, tree order and contents."""
    return kb.sections.select("doc_id", "section_id", "path", "parent_path", "level", "kind", "heading_level", "line_start", "line_end", "title", "content")


@query(r"SELECT doc_id, left(sha1(replace(lower(trim(replace(path, '\', '/'))), 'ß', 'ss')), 16) AS made_id FROM documents")
def doc_ids(kb: KnowledgeBase) -> DataFrame:
    return kb.documents.select("doc_id", document_id(F.col("path")).alias("made_id"))


@query(f"""{_TREE}, bl AS (SELECT doc_id, string_agg(chr(10) || '[section ' || doc_id || '#' || path || ']' || chr(10) || CASE WHEN title <> '' THEN title || chr(10) ELSE '' END || content, chr(10) ORDER BY way) AS b FROM tt GROUP BY doc_id)
SELECT d.doc_id, 'Document' || chr(10) || 'id: ' || d.doc_id || chr(10) || 'title: ' || coalesce(title, '') || chr(10) || 'source: ' || coalesce(source, '') || chr(10) || 'format: ' || coalesce(doc_format, '') || chr(10) || chr(10)
|| 'Sections (cite these ids in "sources"; a section header is not part of its text):' || chr(10) || b || chr(10) || chr(10) || 'Now return the JSON object.' AS prompt FROM documents d JOIN bl USING (doc_id)""")
def doc_prompts(kb: KnowledgeBase) -> DataFrame:
    return D.user_prompts(kb.documents, kb.sections, "doc_id", "title", "source", "doc_format")


@query(r"""SELECT doc_id, target FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\[[^\]]*\]\(([^)]*)\)', 1)) AS target FROM documents WHERE text IS NOT NULL)""")
def doc_links(kb: KnowledgeBase) -> DataFrame:
    return kb.documents.filter("text IS NOT NULL").select("doc_id", F.explode(link_targets(F.col("text"))).alias("target"))


# --- extraction -----------------------------------------------------------------------------------------------------


def _answers(kb: KnowledgeBase) -> DataFrame:
    """One fenced answer per fact, as a model would write it."""
    f = kb.facts.select("fact_id", F.to_json(F.struct(F.array().cast("array<string>").alias("entities"), F.array().cast("array<string>").alias("concepts"), F.array(F.struct("statement", "subject", "predicate", "object", "sources")).alias("facts"), F.array().cast("array<string>").alias("relations"))).alias("j"))
    return f.select("fact_id", F.concat(F.lit("```json\n"), "j", F.lit("\n```")).alias("raw"))


@query(f"""WITH {_FACTS} SELECT fact_id, left(sha1('fact:' || {_norm(_strip('statement'))}), 16) AS id, {_strip('statement')} AS statement, subject, predicate, object FROM fv WHERE {_strip('statement')} <> ''""")
def extract_facts(kb: KnowledgeBase) -> DataFrame:
    """Answers read, checked and turned into fact rows; answers with an empty statement are rejected."""
    items = X.payload_items(X.check_contract(X.read_answers(_answers(kb), "fact_id"), "fact_id"), "fact_id")
    good = X.with_ids(X.accepted(items, X.item_errors(items, "fact_id"), "fact_id"))
    return good.select("fact_id", "id", "statement", "subject", "predicate", "object")


def _document_answers(kb: KnowledgeBase) -> DataFrame:
    """(document_id, raw): what was read from each document as one answer with all four lists, as a model would write it."""
    cited = F.transform("sources", lambda s: F.struct(s["section_id"].alias("section_id"), s["page_number"].alias("page_number"), s["quote"].alias("quote"))).alias("sources")

    def first(table: str, key: str, *cols: str) -> DataFrame:
        t = kb.table(table).filter(f"{key} IS NOT NULL AND document_id IS NOT NULL")
        return t.groupBy(key).agg(F.min(F.struct("document_id", *cols, "sources")).alias("_d")).select(F.col(key).alias("ref"), "_d.*")

    def listed(rows: DataFrame, name: str, *fields) -> DataFrame:
        each = F.array_sort(F.collect_list(F.struct("ref", F.struct(*fields, cited).alias("item"))))
        return rows.groupBy("document_id").agg(F.transform(each, lambda x: x["item"]).alias(name))

    items = first("items", "item_id", "kind", "name", "item_type", "description", "aliases")
    shown = ("name", F.col("item_type").alias("type"), "description", "aliases")
    concept = F.coalesce("kind", F.lit("entity")) == "concept"
    facts = first("facts", "fact_id", "statement", "fact_subject", "fact_predicate", "fact_object")
    edges = first("edges", "edge_id", "source", "target", "edge_type", "kind", "description").filter("kind = 'relation'")
    parts = [
        listed(items.filter(~concept), "entities", *shown), listed(items.filter(concept), "concepts", *shown),
        listed(facts, "facts", "statement", F.col("fact_subject").alias("subject"), F.col("fact_predicate").alias("predicate"), F.col("fact_object").alias("object")),
        listed(edges, "relations", "source", "target", F.col("edge_type").alias("type"), "description"),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.join(p, "document_id", "full")
    lists = [F.coalesce(F.col(k), F.array().cast(whole.schema[k].dataType)).alias(k) for k in X.LISTS]
    return whole.select("document_id", F.concat(F.lit("Here it is:\n```json\n"), F.to_json(F.struct(*lists)), F.lit("\n```")).alias("raw"))


def _read_items(kb: KnowledgeBase) -> DataFrame:
    return cut(X.payload_items(X.check_contract(X.read_answers(_document_answers(kb), "document_id"), "document_id"), "document_id"))


def _good_items(kb: KnowledgeBase) -> DataFrame:
    items = _read_items(kb)
    return X.with_ids(X.accepted(items, X.item_errors(items, "document_id"), "document_id"))


_NS = lambda c: f"coalesce({_strip(c)}, '')"
_EX = f"""WITH el AS (
  SELECT document_id, CASE WHEN kind = 'concept' THEN 'concepts' ELSE 'entities' END AS list, item_id AS ref, {_NS('name')} AS name, {_NS('description')} AS description, '' AS statement, '' AS source, '' AS type, '' AS target, sources FROM {_first('items', 'item_id')}
  UNION ALL SELECT document_id, 'facts', fact_id, '', '', {_NS('statement')}, '', '', '', sources FROM {_first('facts', 'fact_id')}
  UNION ALL SELECT document_id, 'relations', edge_id, '', {_NS('description')}, '', {_NS('source')}, {_NS('edge_type')}, {_NS('target')}, sources FROM {_first('edges', 'edge_id')} WHERE kind = 'relation'),
en AS (SELECT *, CAST(row_number() OVER (PARTITION BY document_id, list ORDER BY ref) - 1 AS INTEGER) AS index,
  CASE WHEN list IN ('entities', 'concepts') AND name = '' THEN 'name' WHEN list = 'facts' AND statement = '' THEN 'statement' WHEN list = 'relations' AND source = '' THEN 'source' WHEN list = 'relations' AND target = '' THEN 'target' END AS need FROM el WHERE document_id IS NOT NULL),
gd AS (SELECT *, CASE list WHEN 'entities' THEN 'entity' WHEN 'concepts' THEN 'concept' WHEN 'facts' THEN 'fact' ELSE 'relation' END AS kind,
  left(sha1(CASE list WHEN 'entities' THEN 'entity:' || {_norm('name')} WHEN 'concepts' THEN 'concept:' || {_norm('name')} WHEN 'facts' THEN 'fact:' || {_norm('statement')} ELSE 'relation:' || {_norm("source || '|' || type || '|' || target")} END), 16) AS id
  FROM en WHERE document_id NOT IN (SELECT document_id FROM en WHERE need IS NOT NULL))"""


@query(f"{_EX} SELECT document_id, list, index, kind, id, name, statement FROM gd")
def extract_items(kb: KnowledgeBase) -> DataFrame:
    """Elements of all lists of the answers that hold no error, with their ids."""
    return _good_items(kb).select("document_id", "list", "index", "kind", "id", "name", "statement")


@query(f"{_EX} SELECT document_id, list, index, list || '[' || index || ']: ''' || need || ''' must be a non-empty string' AS error FROM en WHERE need IS NOT NULL")
def extract_rejected(kb: KnowledgeBase) -> DataFrame:
    return X.item_errors(_read_items(kb), "document_id")


@query(f"{_EX} SELECT document_id, count(*) FILTER (list = 'entities') AS entities, count(*) FILTER (list = 'concepts') AS concepts, count(*) FILTER (list = 'facts') AS facts, count(*) FILTER (list = 'relations') AS relations FROM gd GROUP BY document_id")
def extract_counts(kb: KnowledgeBase) -> DataFrame:
    return X.item_counts(_good_items(kb), "document_id")


@query(f"""{_EX}, nn AS (SELECT document_id, {_norm('name')} AS n, arg_min(id, (CASE list WHEN 'entities' THEN 0 ELSE 1 END, index)) AS id FROM gd WHERE list IN ('entities', 'concepts') GROUP BY ALL)
SELECT gd.document_id, gd.index, source, target, a.id AS source_id, b.id AS target_id FROM gd LEFT JOIN nn a ON a.document_id = gd.document_id AND a.n = {_norm('source')} LEFT JOIN nn b ON b.document_id = gd.document_id AND b.n = {_norm('target')} WHERE list = 'relations'""")
def extract_endpoints(kb: KnowledgeBase) -> DataFrame:
    return X.resolve_endpoints(_good_items(kb), "document_id").select("document_id", "index", "source", "target", "source_id", "target_id")


@query(f"{_EX} SELECT document_id, kind, id, min(index) AS first_index, count(*) AS n, coalesce(arg_min(description, index) FILTER (description <> ''), '') AS description FROM gd GROUP BY document_id, kind, id")
def extract_duplicates(kb: KnowledgeBase) -> DataFrame:
    """Elements of one document that are one object."""
    return X.merge_duplicates(_good_items(kb), "document_id")


_REPAIRED = f"""rp AS (SELECT document_id, list, index, CAST(pos AS INTEGER) AS pos, nullif({_strip('s.section_id')}, '') AS asked, s.page_number AS claimed, coalesce({_strip('s.quote')}, '') AS quote
  FROM (SELECT document_id, list, index, unnest(sources) AS s, generate_subscripts(sources, 1) - 1 AS pos FROM gd)),
ks AS (SELECT document_id, section_id, max(page_number) AS page FROM sections WHERE section_id IS NOT NULL GROUP BY document_id, section_id),
kp AS (SELECT DISTINCT document_id, page_number FROM sections WHERE page_number IS NOT NULL),
fx AS (SELECT rp.*, ks.section_id, ks.page, kp.page_number IS NOT NULL AS page_known, rp.document_id IN (SELECT document_id FROM kp WHERE document_id IS NOT NULL) AS paged
  FROM rp LEFT JOIN ks ON ks.document_id = rp.document_id AND ks.section_id = asked LEFT JOIN kp ON kp.document_id = rp.document_id AND kp.page_number = claimed)"""


@query(f"""{_EX}, {_REPAIRED} SELECT document_id, list, index, pos, section_id, coalesce(page, CASE WHEN paged AND NOT page_known THEN NULL ELSE claimed END) AS page_number, quote,
nullif(concat_ws('; ', CASE WHEN asked IS NOT NULL AND section_id IS NULL THEN 'unknown section id ''' || asked || ''' dropped' END, CASE WHEN page IS NOT NULL AND claimed IS NOT NULL AND page <> claimed THEN 'the section page is used' END,
  CASE WHEN page IS NULL AND paged AND claimed IS NOT NULL AND NOT page_known THEN 'unknown page number ' || claimed || ' dropped' END), '') AS note FROM fx""")
def extract_sources(kb: KnowledgeBase) -> DataFrame:
    """Citations of the answers repaired against the sections of their documents."""
    sections = kb.table("sections").filter("section_id IS NOT NULL AND document_id IS NOT NULL").select("document_id", "section_id", "page_number")
    return X.repair_sources(_good_items(kb), "document_id", sections)


@query(f"SELECT verdict_id, same, coalesce({_strip('verdict_reason')}, '') AS reason, CASE WHEN same IS NULL THEN '''same'' must be true or false' END AS error FROM verdicts")
def extract_verdicts(kb: KnowledgeBase) -> DataFrame:
    raw = kb.table("verdicts").select("verdict_id", F.to_json(F.struct("same", F.col("verdict_reason").alias("reason"))).alias("raw"))
    return X.verdict_rows(raw, "verdict_id")


# --- merge ----------------------------------------------------------------------------------------------------------


@query(f"SELECT name, {_key('name')} AS key FROM (SELECT DISTINCT name FROM items)")
def merge_keys(kb: KnowledgeBase) -> DataFrame:
    return kb.table("items").select("name").distinct().select("name", match_key_col("name").alias("key"))


@query(f"WITH {_ITEMS} SELECT kind, key, min(item_id) AS first_item, count(*) AS n FROM iv WHERE key <> '' GROUP BY kind, key HAVING count(*) > 1")
def merge_auto_groups(kb: KnowledgeBase) -> DataFrame:
    return K.auto_merge_groups(kb.items)


@query(f"{_KB} SELECT * FROM gr")
def merge_groups(kb: KnowledgeBase) -> DataFrame:
    return kb.groups


@query(f"""{_KB}, ty AS (SELECT group_id, arg_min(type, r) AS type FROM (SELECT group_id, type, row_number() OVER (PARTITION BY group_id ORDER BY count(*) DESC, min(item_id)) AS r FROM iv JOIN gr USING (item_id) WHERE kind = 'entity' AND type <> 'other' GROUP BY group_id, type) GROUP BY group_id)
SELECT g.group_id, g.kind, CASE WHEN n_items > 1 THEN left(sha1(g.kind || ':' || {_norm('canonical_name')}), 16) ELSE own_id END AS id, canonical_name, CASE WHEN g.kind = 'entity' THEN coalesce(ty.type, 'other') END AS type, n_items
FROM (SELECT group_id, arg_min(kind, item_id) AS kind, arg_min(id, item_id) AS own_id, count(*) AS n_items FROM iv JOIN gr USING (item_id) GROUP BY group_id) g JOIN nm USING (group_id) LEFT JOIN ty USING (group_id)""")
def merge_items(kb: KnowledgeBase) -> DataFrame:
    return kb.merged


@query(f"""{_KB}, al AS (SELECT group_id, item_id, p, {_strip('a')} AS alias, {_key('a')} AS key FROM (SELECT group_id, item_id, unnest(list_prepend(name, aliases)) AS a, generate_subscripts(list_prepend(name, aliases), 1) AS p FROM iv JOIN gr USING (item_id))),
fa AS (SELECT group_id, key, arg_min(alias, (item_id, p)) AS alias, min((item_id, p)) AS pl FROM al WHERE key <> '' AND alias <> '' GROUP BY group_id, key)
SELECT group_id, alias, CAST(row_number() OVER (PARTITION BY group_id ORDER BY pl) AS INTEGER) AS ord FROM fa WHERE NOT EXISTS (SELECT 1 FROM nm WHERE nm.group_id = fa.group_id AND {_key('nm.canonical_name')} = fa.key)""")
def merge_aliases(kb: KnowledgeBase) -> DataFrame:
    return K.merged_aliases(kb.items, kb.groups, K.canonical_names(kb.items, kb.groups))


@query(f"""{_KB}, ds AS (SELECT group_id, item_id, {_strip('description')} AS description, {_key('description')} AS key FROM iv JOIN gr USING (item_id)),
fd AS (SELECT group_id, arg_min(description, item_id) AS description, min(item_id) AS i FROM ds WHERE description <> '' GROUP BY group_id, key)
SELECT group_id, description, CAST(row_number() OVER (PARTITION BY group_id ORDER BY i) AS INTEGER) AS ord FROM fd""")
def merge_descriptions(kb: KnowledgeBase) -> DataFrame:
    return K.merged_descriptions(kb.items, kb.groups)


@query(f"{_KB} SELECT group_id, s.document_id AS document_id, s.section_id AS section_id, s.page_number AS page_number, s.quote AS quote, min(item_id) AS first_item FROM (SELECT group_id, item_id, unnest(sources) AS s FROM iv JOIN gr USING (item_id)) GROUP BY ALL")
def merge_sources(kb: KnowledgeBase) -> DataFrame:
    return K.merged_sources(kb.items, kb.groups)


@query(f"{_KB} SELECT * FROM mp")
def merge_name_map(kb: KnowledgeBase) -> DataFrame:
    return kb.names


@query(f"""{_KB}, ff AS (SELECT CASE WHEN key <> '' THEN key ELSE left(sha1('fact:' || {_norm('statement')}), 16) END AS key, fact_id, statement, subject, predicate, object FROM fv),
fg AS (SELECT key, min(fact_id) AS fact_id, arg_min(statement, fact_id) AS statement, arg_min(subject, fact_id) AS subject, arg_min(predicate, fact_id) AS predicate, arg_min(object, fact_id) AS object, count(*) AS n_facts FROM ff GROUP BY key)
SELECT fg.key, fact_id, statement, coalesce(a.canonical_name, subject) AS subject, predicate, coalesce(b.canonical_name, object) AS object, n_facts FROM fg LEFT JOIN mp a ON a.key = {_key('subject')} LEFT JOIN mp b ON b.key = {_key('object')}""")
def merge_facts(kb: KnowledgeBase) -> DataFrame:
    return K.canonical_facts(K.distinct_facts(kb.facts), kb.names).select("key", "fact_id", "statement", "subject", "predicate", "object", "n_facts")


@query(f"""{_KB}, rc AS (SELECT edge_id, coalesce(a.canonical_name, source) AS source, type, coalesce(b.canonical_name, target) AS target FROM rv LEFT JOIN mp a ON a.key = {_key('source')} LEFT JOIN mp b ON b.key = {_key('target')})
SELECT {_key('source')} AS source_key, {_key('type')} AS type_key, {_key('target')} AS target_key, min(edge_id) AS edge_id, arg_min(source, edge_id) AS source, arg_min(type, edge_id) AS type, arg_min(target, edge_id) AS target, count(*) AS n_relations FROM rc GROUP BY 1, 2, 3""")
def merge_relations(kb: KnowledgeBase) -> DataFrame:
    return K.distinct_relations(kb.relations, kb.names)


_FF = f"ff AS (SELECT CASE WHEN key <> '' THEN key ELSE left(sha1('fact:' || {_norm('statement')}), 16) END AS key, fact_id, statement, sources FROM fv)"
_RC = f"""rc AS (SELECT edge_id, {_key('coalesce(a.canonical_name, source)')} AS source_key, {_key('type')} AS type_key, {_key('coalesce(b.canonical_name, target)')} AS target_key, description, sources
  FROM rv LEFT JOIN mp a ON a.key = {_key('source')} LEFT JOIN mp b ON b.key = {_key('target')})"""
_REF = "s.document_id AS document_id, s.section_id AS section_id, s.page_number AS page_number, s.quote AS quote"


@query(f"WITH {_FACTS}, {_FF} SELECT key, arg_min(left(sha1('fact:' || {_norm('statement')}), 16), fact_id) AS id FROM ff GROUP BY key")
def merge_fact_ids(kb: KnowledgeBase) -> DataFrame:
    return K.distinct_facts(kb.facts).select("key", "id")


@query(f"WITH {_FACTS}, {_FF} SELECT key, {_REF}, min(fact_id) AS first_fact FROM (SELECT key, fact_id, unnest(sources) AS s FROM ff) GROUP BY ALL")
def merge_fact_sources(kb: KnowledgeBase) -> DataFrame:
    return K.merged_fact_sources(kb.facts)


@query(f"{_KB}, {_RC} SELECT source_key, type_key, target_key, {_REF}, min(edge_id) AS first_edge FROM (SELECT source_key, type_key, target_key, edge_id, unnest(sources) AS s FROM rc) GROUP BY ALL")
def merge_relation_sources(kb: KnowledgeBase) -> DataFrame:
    return K.merged_relation_sources(kb.relations, kb.names)


@query(f"""{_KB}, {_RC}, dd AS (SELECT source_key, type_key, target_key, arg_min(description, edge_id) AS description, min(edge_id) AS e FROM rc WHERE description <> '' GROUP BY source_key, type_key, target_key, {_key('description')})
SELECT source_key, type_key, target_key, description, CAST(row_number() OVER (PARTITION BY source_key, type_key, target_key ORDER BY e) AS INTEGER) AS ord FROM dd""")
def merge_relation_descriptions(kb: KnowledgeBase) -> DataFrame:
    return K.merged_relation_descriptions(kb.relations, kb.names)


@query(f"""{_KB}, {_RC}, mi AS (SELECT group_id, kind, CASE WHEN n > 1 THEN left(sha1(kind || ':' || {_norm('canonical_name')}), 16) ELSE own END AS id
  FROM (SELECT group_id, arg_min(kind, item_id) AS kind, arg_min(id, item_id) AS own, count(*) AS n FROM iv JOIN gr USING (item_id) GROUP BY group_id) JOIN nm USING (group_id)),
ib AS (SELECT key, arg_min(id, r) AS id FROM (SELECT ik.key, mi.id, row_number() OVER (PARTITION BY ik.key ORDER BY CASE WHEN mi.kind = 'concept' THEN 1 ELSE 0 END, group_id) AS r FROM ik JOIN gr USING (item_id) JOIN mi USING (group_id)) GROUP BY key)
SELECT DISTINCT source_key, type_key, target_key, s.id AS source_id, t.id AS target_id FROM rc LEFT JOIN ib s ON s.key = source_key LEFT JOIN ib t ON t.key = target_key""")
def merge_relation_ids(kb: KnowledgeBase) -> DataFrame:
    """Merged relations with the ids of the objects at their ends."""
    r = K.with_end_ids(K.distinct_relations(kb.relations, kb.names), K.ids_by_key(kb.items, kb.groups, kb.merged))
    return r.select("source_key", "type_key", "target_key", "source_id", "target_id")


@query(f"""{_KB}, ks AS (SELECT group_id, min(key) = max(key) AS one, count(*) AS n_items, arg_min(kind, item_id) AS kind FROM iv JOIN gr USING (item_id) GROUP BY group_id)
SELECT group_id, kind, canonical_name, n_items, CASE WHEN one THEN 'normalized-name' ELSE 'judge' END AS method FROM ks JOIN nm USING (group_id) WHERE n_items > 1""")
def merge_report(kb: KnowledgeBase) -> DataFrame:
    return K.merge_report(kb.items, kb.groups, kb.merged)


@query(f"""{_KB}, jp AS (SELECT least(left_id, right_id) AS l, greatest(left_id, right_id) AS r, bool_or(same) AS same FROM verdicts WHERE left_id <> right_id AND same IS NOT NULL GROUP BY ALL)
SELECT 'items' AS name, count(*) AS n FROM iv UNION ALL SELECT 'groups', count(DISTINCT group_id) FROM gr UNION ALL SELECT 'merges', count(*) FROM (SELECT group_id FROM gr GROUP BY group_id HAVING count(*) > 1)
UNION ALL SELECT 'judged_pairs', count(*) FROM jp UNION ALL SELECT 'judged_same', count(*) FROM jp WHERE same UNION ALL SELECT 'judge_failures', count(*) FROM verdicts WHERE error IS NOT NULL""")
def merge_summary(kb: KnowledgeBase) -> DataFrame:
    return K.merge_summary(kb.items, kb.groups, kb.table("verdicts"))


_CANDIDATES = rf"""nv AS (SELECT kind, key, min(item_id) AS item_id, regexp_replace(key, '{_SP}', '', 'g') AS c, list_filter(list_distinct(regexp_extract_all(key, '[0-9a-z]+')), lambda t: length(t) > 1) AS t FROM iv WHERE key <> '' GROUP BY ALL),
al AS (SELECT DISTINCT iv.kind, iv.key, ik.key AS v FROM iv JOIN ik USING (item_id) WHERE iv.key <> ''),
p1 AS (SELECT DISTINCT a.kind, a.key AS l, b.key AS r FROM al a JOIN al b ON a.kind = b.kind AND a.v = b.v AND a.key < b.key),
p2 AS (SELECT a.kind, a.key AS l, b.key AS r FROM nv a JOIN nv b ON a.kind = b.kind AND a.c = b.c AND a.key < b.key),
bl AS (SELECT a.kind, a.key AS l, b.key AS r, CASE WHEN a.item_id < b.item_id THEN a.c ELSE b.c END AS x, CASE WHEN a.item_id < b.item_id THEN b.c ELSE a.c END AS y, a.t AS lt, b.t AS rt
  FROM nv a JOIN nv b ON a.kind = b.kind AND a.key < b.key AND (left(a.c, 1) = left(b.c, 1) OR right(a.c, 1) = right(b.c, 1) OR list_has_any(a.t, b.t))),
p3 AS (SELECT kind, l, r, round(least(length(x), length(y)) / greatest(length(x), length(y)), 4) AS score FROM bl WHERE length(x) <> length(y) AND least(length(x), length(y)) >= 0.6 * greatest(length(x), length(y)) AND (contains(x, y) OR contains(y, x))),
p4 AS (SELECT kind, l, r, round(len(list_intersect(lt, rt)) / len(list_distinct(lt || rt)), 4) AS score FROM bl WHERE len(list_intersect(lt, rt)) >= 0.5 * len(list_distinct(lt || rt)) AND len(lt) > 0 AND len(rt) > 0)"""
# levenshtein counts bytes, up to four a letter
_BLOCK_OF = "list_max(list_transform(range(1, length(x) + 1), lambda i: struct_pack(n := coalesce(list_max(list_filter(range(1, length(x) - i + 2), lambda k: contains(y, substr(x, i, k)))), 0), i := -i)))"
# the longest common block, the first one on a tie, then the same to its left and right
_RATIO = f"""mt AS (SELECT kind, l, r, x, y, {_BLOCK_OF} AS b FROM bl WHERE levenshtein(x, y) <= CASE WHEN strlen(x || y) = length(x || y) THEN 0.15 ELSE 0.6 END * length(x || y) + 1e-9
  UNION ALL SELECT kind, l, r, x, y, {_BLOCK_OF} FROM (SELECT kind, l, r, unnest([substr(x, 1, i - 1), substr(x, i + n)]) AS x, unnest([substr(y, 1, j - 1), substr(y, j + n)]) AS y
    FROM (SELECT kind, l, r, x, y, -b.i AS i, b.n AS n, instr(y, substr(x, -b.i, b.n)) AS j FROM mt WHERE b.n > 0)) WHERE x <> '' AND y <> ''),
p5 AS (SELECT kind, l, r, round(2 * n / (length(x) + length(y)), 4) AS score FROM (SELECT kind, l, r, sum(b.n) AS n FROM mt GROUP BY ALL) JOIN bl USING (kind, l, r) WHERE 2 * n / (length(x) + length(y)) >= 0.85),
cp AS (SELECT kind, l, r, arg_min(reason, rule) AS reason, CAST(min(rule) AS INTEGER) AS rule FROM (
  SELECT kind, l, r, 'shared name or alias' AS reason, 1 AS rule FROM p1 UNION ALL SELECT kind, l, r, 'same name without whitespace', 2 FROM p2 UNION ALL SELECT kind, l, r, 'one name contains the other', 3 FROM p3
  UNION ALL SELECT kind, l, r, 'token overlap', 4 FROM p4 UNION ALL SELECT kind, l, r, 'similar spelling', 5 FROM p5) GROUP BY ALL)"""
_CP = f"WITH RECURSIVE {_ITEMS}, {_CANDIDATES}, {_RATIO}"


@query(f"WITH {_ITEMS}, {_CANDIDATES} SELECT kind, l, r, 'shared name or alias' AS reason FROM p1")
def candidates_alias(kb: KnowledgeBase) -> DataFrame:
    return C.shared_alias(kb.items)


@query(f"WITH {_ITEMS}, {_CANDIDATES} SELECT kind, l, r, 'same name without whitespace' AS reason FROM p2")
def candidates_compact(kb: KnowledgeBase) -> DataFrame:
    return C.same_compact(C.distinct_names(kb.items))


@query(f"WITH {_ITEMS}, {_CANDIDATES} SELECT kind, l, r, 'token overlap' AS reason, score FROM p4")
def candidates_tokens(kb: KnowledgeBase) -> DataFrame:
    return C.token_overlap(C.distinct_names(kb.items))


@query(f"{_CP} SELECT kind, l, r, 'one name contains the other' AS reason, score FROM p3 UNION ALL SELECT kind, l, r, 'similar spelling', score FROM p5 ANTI JOIN p3 USING (kind, l, r)")
def candidates_spelling(kb: KnowledgeBase) -> DataFrame:
    return C.near_spelling(C.distinct_names(kb.items))


@query(f"{_CP} SELECT * FROM cp")
def candidates_all(kb: KnowledgeBase) -> DataFrame:
    return C.candidate_pairs(kb.items)


@query(f"{_CP} SELECT kind, count(*) AS n_pairs, least(count(*), 200) AS n_kept, CASE WHEN count(*) > 200 THEN 'candidate pairs truncated to 200 (of ' || count(*) || '); raise max_judgements to judge more' END AS warning FROM cp GROUP BY kind")
def candidates_truncation(kb: KnowledgeBase) -> DataFrame:
    return C.truncation(C.candidate_pairs(kb.items))


_PROMPTS = f"""ri AS (SELECT kind, key, min(item_id) AS item_id FROM iv WHERE key <> '' GROUP BY ALL),
ds AS (SELECT ri.kind, ri.key, concat_ws(chr(10), 'name: ' || name, CASE WHEN ri.kind = 'entity' AND type <> '' THEN 'type: ' || type END, CASE WHEN len(al) > 0 THEN 'aliases: ' || array_to_string(al, ', ') END,
  CASE WHEN len(qs) > 0 THEN array_to_string(list_transform(qs[1:3], lambda q: 'quote: ' || q), chr(10)) END) AS text
  FROM (SELECT item_id, name, type, list_filter(aliases, lambda a: {_strip('a')} <> '') AS al, list_filter(list_transform(sources, lambda s: left({_strip("coalesce(s.quote, '')")}, 200)), lambda q: q <> '') AS qs FROM iv) JOIN ri USING (item_id)),
tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY rule, l, r) AS n FROM cp) WHERE n <= 200)"""


@query(f"{_CP}, {_PROMPTS} SELECT tp.kind, l, r, 'kind: ' || tp.kind || chr(10) || chr(10) || 'A' || chr(10) || a.text || chr(10) || chr(10) || 'B' || chr(10) || b.text AS prompt FROM tp JOIN ds a ON a.kind = tp.kind AND a.key = l JOIN ds b ON b.kind = tp.kind AND b.key = r")
def judge_prompts(kb: KnowledgeBase) -> DataFrame:
    """Prompts for the strongest candidates of each kind, as many as a judge may be asked."""
    return X.judge_prompts(cut(C.limited_pairs(C.candidate_pairs(kb.items))), C.distinct_names(kb.items), kb.items)


# --- graph ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {_ITEMS}, o AS (SELECT *, CASE kind WHEN 'entity' THEN 0 WHEN 'concept' THEN 1 ELSE 9 END AS r FROM iv),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r, item_id) AS n, first_value(description) OVER (PARTITION BY id ORDER BY length(description) DESC, r, item_id) AS d FROM o)
SELECT id, kind, name AS title, CASE WHEN kind = 'entity' THEN type END AS type, d AS description FROM f WHERE n = 1""")
def graph_nodes(kb: KnowledgeBase) -> DataFrame:
    return kb.nodes


@query(f"{_KG} SELECT source_key, type_key, target_key, source, type, target, kind, source_id, target_id, n_relations, n_facts, ambiguous_source, ambiguous_target, source_key = target_key AS self_loop FROM ed")
def graph_edges(kb: KnowledgeBase) -> DataFrame:
    return kb.edges.drop("description")


@query(f"""{_KG} SELECT kind, ref_id, source, target, concat_ws('; ', CASE WHEN sn = 0 THEN 'source ''' || source || ''' matches no node' END, CASE WHEN tn = 0 THEN 'target ''' || target || ''' matches no node' END) AS reason FROM rs WHERE sn = 0 OR tn = 0""")
def graph_unlinked(kb: KnowledgeBase) -> DataFrame:
    return G.unlinked(kb.resolved)


@query(f"{_KG} SELECT DISTINCT sk AS name, sn AS n_nodes FROM rs WHERE sn > 1 UNION SELECT DISTINCT tk, tn FROM rs WHERE tn > 1")
def graph_ambiguous(kb: KnowledgeBase) -> DataFrame:
    return G.ambiguous_names(kb.resolved)


@query(f"{_KG} SELECT * FROM dg")
def graph_degrees(kb: KnowledgeBase) -> DataFrame:
    return G.degrees(kb.nodes, kb.edges, kb.keys)


@query(f"{_KG}, p AS (SELECT ts.id, tt.id AS o FROM ts JOIN tt USING (source_key, type_key, target_key)) SELECT id, o AS neighbor_id FROM p UNION SELECT o, id FROM p")
def graph_neighbors(kb: KnowledgeBase) -> DataFrame:
    return G.neighbors(kb.edges, kb.keys)


@query(f"WITH {_ITEMS} SELECT id, s.document_id AS document_id, s.section_id AS section_id, s.page_number AS page_number, s.quote AS quote, min(item_id) AS first_item FROM (SELECT id, item_id, unnest(sources) AS s FROM iv) GROUP BY ALL")
def graph_node_sources(kb: KnowledgeBase) -> DataFrame:
    return G.node_sources(kb.items)


_LINKED = "lz AS (SELECT rs.*, z.sources, z.statement FROM rs JOIN (SELECT 'relation' AS kind, edge_id AS ref_id, sources, NULL AS statement FROM rv UNION ALL SELECT 'fact', fact_id, sources, statement FROM fv) z USING (kind, ref_id) WHERE sn > 0 AND tn > 0)"


def _links(kb: KnowledgeBase) -> DataFrame:
    return G.resolve(G.links_of(kb.relations, kb.facts, "sources"), G.name_index(kb.keys))


@query(f"{_KG}, {_LINKED} SELECT sk AS source_key, yk AS type_key, tk AS target_key, {_REF}, count(*) AS n FROM (SELECT sk, yk, tk, unnest(sources) AS s FROM lz) GROUP BY ALL")
def graph_edge_sources(kb: KnowledgeBase) -> DataFrame:
    return G.edge_sources(_links(kb))


@query(f"{_KG}, {_LINKED} SELECT sk AS source_key, yk AS type_key, tk AS target_key, statement, min(ref_id) AS first_fact FROM lz WHERE statement IS NOT NULL GROUP BY ALL")
def graph_edge_statements(kb: KnowledgeBase) -> DataFrame:
    return G.edge_statements(kb.resolved)


@query(f"{_KG} SELECT source_key, type_key, target_key, CASE WHEN n_facts > 0 AND n_relations > 0 THEN 'fact,relation' WHEN n_facts > 0 THEN 'fact' ELSE 'relation' END AS kinds FROM ed")
def graph_edge_kinds(kb: KnowledgeBase) -> DataFrame:
    return G.edge_kinds(kb.edges).withColumn("kinds", F.array_join("kinds", ","))


@query(f"""WITH {_ITEMS}, r AS (SELECT *, CASE kind WHEN 'entity' THEN 0 WHEN 'concept' THEN 1 ELSE 9 END AS r FROM iv), ti AS (SELECT id, {_key('arg_min(name, (r, item_id))')} AS key FROM r GROUP BY id),
al AS (SELECT id, a AS alias, {_key('a')} AS key, (r, item_id, p) AS pl FROM (SELECT id, r, item_id, unnest(list_prepend(name, aliases)) AS a, generate_subscripts(list_prepend(name, aliases), 1) AS p FROM r)),
fa AS (SELECT id, key, arg_min(alias, pl) AS alias, min(pl) AS pl FROM al WHERE key <> '' GROUP BY id, key)
SELECT id, alias, CAST(row_number() OVER (PARTITION BY id ORDER BY pl) AS INTEGER) AS ord FROM fa ANTI JOIN ti USING (id, key)""")
def graph_node_aliases(kb: KnowledgeBase) -> DataFrame:
    return G.node_aliases(kb.items, kb.nodes)


@query()
def graph_layout_key(kb: KnowledgeBase) -> DataFrame:
    return G.layout_key(kb.nodes)


# --- lint -----------------------------------------------------------------------------------------------------------


def _owners(kb: KnowledgeBase) -> DataFrame:
    i = kb.items.select("kind", F.col("item_id").cast("string").alias("object_id"), "name", "sources")
    f = kb.facts.select(F.lit("fact").alias("kind"), F.col("fact_id").cast("string").alias("object_id"), F.col("statement").alias("name"), "sources")
    r = kb.relations.select(F.lit("relation").alias("kind"), F.col("edge_id").cast("string").alias("object_id"), F.concat_ws(" -> ", "source", "target").alias("name"), "sources")
    return i.unionByName(f).unionByName(r)


def _issues(kb: KnowledgeBase) -> DataFrame:
    un, amb = G.unlinked(kb.resolved), G.ambiguous_names(kb.resolved).select("name", F.lit("graph").alias("by"))
    return L.all_issues(
        L.missing_sources(_owners(kb)), L.unlinked_facts(G.incomplete_facts(kb.facts), un, kb.facts), L.unlinked_relations(un), L.ambiguous_names(amb),
        L.dangling_edges(kb.edges, kb.nodes, kb.keys), L.isolated_nodes(kb.nodes, G.degrees(kb.nodes, kb.edges, kb.keys)), L.self_loops(kb.edges),
    )


_ISSUES = f"""{_KG}, iss AS (
  SELECT 'missing_source' AS rule, 'warning' AS severity, CAST(item_id AS VARCHAR) AS object_id FROM iv WHERE coalesce(len(sources), 0) = 0
  UNION ALL SELECT 'missing_source', 'warning', CAST(fact_id AS VARCHAR) FROM fv WHERE coalesce(len(sources), 0) = 0
  UNION ALL SELECT 'missing_source', 'warning', CAST(edge_id AS VARCHAR) FROM rv WHERE coalesce(len(sources), 0) = 0
  UNION ALL SELECT 'unlinked_fact', 'warning', CAST(fact_id AS VARCHAR) FROM fv WHERE subject = '' OR predicate = '' OR object = ''
  UNION ALL SELECT 'unlinked_fact', 'warning', CAST(ref_id AS VARCHAR) FROM rs WHERE kind = 'fact' AND (sn = 0 OR tn = 0)
  UNION ALL SELECT 'unlinked_relation', 'warning', CAST(ref_id AS VARCHAR) FROM rs WHERE kind = 'relation' AND (sn = 0 OR tn = 0)
  UNION ALL SELECT 'ambiguous_name', 'warning', '' FROM (SELECT sk FROM rs WHERE sn > 1 UNION SELECT tk FROM rs WHERE tn > 1)
  UNION ALL SELECT 'isolated_node', 'warning', id FROM dg WHERE n_out = 0 AND n_in = 0
  UNION ALL SELECT 'self_loop', 'info', coalesce(source_id, '') FROM ed WHERE source_key = target_key)"""


@query(f"{_ISSUES} SELECT * FROM iss")
def lint_knowledge(kb: KnowledgeBase) -> DataFrame:
    return _issues(kb).select("rule", "severity", "object_id")


@query(f"{_ISSUES} SELECT name, n FROM (" + " UNION ALL ".join([f"SELECT '{s}s' AS name, count(*) AS n FROM iss WHERE severity = '{s}'" for s in L.SEVERITY_RANK] + [f"SELECT '{r}', count(*) FROM iss WHERE rule = '{r}'" for r in L.SEVERITY] + ["SELECT 'graph_problems', count(*) FROM iss WHERE rule IN ('dangling_edge', 'isolated_node')"]) + ")")
def lint_counts(kb: KnowledgeBase) -> DataFrame:
    return L.count_issues(_issues(kb))


def _document_pages(kb: KnowledgeBase) -> DataFrame:
    return kb.documents.filter("path IS NOT NULL").groupBy("path").agg(F.max("text").alias("text")).withColumn("kind", F.lit("page"))


@query(r"""WITH p AS (SELECT path, max(text) AS text FROM documents WHERE path IS NOT NULL GROUP BY path),
l AS (SELECT path, unnest(regexp_extract_all(text, '\[[^\]]*\]\(([^)]*)\)', 1)) AS target FROM p WHERE text IS NOT NULL)
SELECT path, target FROM l WHERE target <> '' AND NOT contains(target, '://') AND NOT regexp_matches(target, '^(#|/|mailto:|tel:)') AND NOT EXISTS (SELECT 1 FROM p WHERE p.path = regexp_replace(l.path, '[^/]*$', '') || l.target)""")
def lint_dead_links(kb: KnowledgeBase) -> DataFrame:
    """Links of documents that lead to no document."""
    return L.dead_links(_document_pages(kb)).select("path", F.get_json_object("metadata", "$.target").alias("target"))


@query()
def lint_pages(kb: KnowledgeBase) -> DataFrame:
    """Dead links and orphans of the linked wiki pages."""
    linked = N.link_pages(kb.pages, _link_index(kb)).select("path", "part", "text").join(kb.pages.select("path", "part", "kind"), ["path", "part"])
    return L.all_issues(L.dead_links(linked), L.orphan_pages(linked)).select("rule", "path")


# --- wiki, links, search --------------------------------------------------------------------------------------------

_STEM = r"""st AS (SELECT *, CASE WHEN regexp_replace(s2, '^[-.]+|[-.]+$', '', 'g') = '' THEN 'page' WHEN length(s2) > 80 THEN rtrim(left(s2, 71)) || '-' || left(object_id, 8) ELSE s2 END AS stem FROM (
  SELECT *, regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(trim(replace(title, chr(160), ' ')), '[\\/:*?"<>|\x00-\x1f]+', '-', 'g'), '-{2,}', '-', 'g')), '^\.+', ''), '[ .]+$', '') AS s2 FROM tg))"""
_PATHS = f"""o AS (SELECT *, CASE kind WHEN 'entity' THEN 0 WHEN 'concept' THEN 1 ELSE 9 END AS r FROM iv),
tg AS (SELECT id AS object_id, arg_min(kind, (r, item_id)) AS kind, arg_min(name, (r, item_id)) AS title FROM o GROUP BY id), {_STEM},
sy AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY lower(stem)) > 1 THEN stem || '-' || kind ELSE stem END AS style FROM st),
nm2 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY lower(style) ORDER BY CASE kind WHEN 'entity' THEN 0 WHEN 'concept' THEN 1 ELSE 9 END, {_key('title')}, object_id) = 1 AND lower(style) <> 'index' THEN style ELSE style || '-' || left(object_id, 8) END AS nm FROM sy)"""


@query(f"WITH {_ITEMS}, {_PATHS} SELECT object_id, kind, title, nm || '.md' AS path FROM nm2")
def wiki_paths(kb: KnowledgeBase) -> DataFrame:
    return kb.page_paths


@query(f"""WITH {_ITEMS}, {_FACTS}, {_RELATIONS}, e AS (SELECT 'fact' AS kind, fact_id AS ref_id, {_key('subject')} AS a, {_key('object')} AS b FROM fv UNION ALL SELECT 'relation', edge_id, {_key('source')}, {_key('target')} FROM rv),
h AS (SELECT nk.id, e.kind, e.ref_id, 0 AS i FROM e JOIN nk ON nk.key = e.a UNION ALL SELECT nk.id, e.kind, e.ref_id, 1 FROM e JOIN nk ON nk.key = e.b)
SELECT id AS object_id, kind, ref_id, CASE WHEN min(i) = 0 THEN 'out' ELSE 'in' END AS direction FROM h GROUP BY id, kind, ref_id""")
def wiki_routes(kb: KnowledgeBase) -> DataFrame:
    keys = W.page_keys(kb.items)
    f = W.route(kb.facts, keys, "fact_id", "subject", "object").select("object_id", F.lit("fact").alias("kind"), F.col("fact_id").alias("ref_id"), "direction")
    return f.unionByName(W.route(kb.relations, keys, "edge_id", "source", "target").select("object_id", F.lit("relation").alias("kind"), F.col("edge_id").alias("ref_id"), "direction"))


@query(f"""WITH {_ITEMS}, {_FACTS}, {_RELATIONS}, e AS (SELECT 'fact' AS kind, fact_id AS ref_id, {_key('subject')} AS a, {_key('object')} AS b, sources FROM fv UNION ALL SELECT 'relation', edge_id, {_key('source')}, {_key('target')}, sources FROM rv),
c AS (SELECT id, unnest(sources) AS s FROM iv UNION ALL SELECT nk.id, unnest(e.sources) FROM e JOIN nk ON nk.key = e.a UNION ALL SELECT nk.id, unnest(e.sources) FROM e JOIN nk ON nk.key = e.b),
d AS (SELECT DISTINCT id AS object_id, s.document_id AS document_id, s.section_id AS section_id, s.page_number AS page_number, coalesce(s.quote, '') AS quote FROM c)
SELECT *, CAST(row_number() OVER (PARTITION BY object_id ORDER BY coalesce(document_id, ''), coalesce(section_id, ''), coalesce(page_number, -1), quote, section_id IS NULL) AS INTEGER) AS number FROM d""")
def wiki_sources(kb: KnowledgeBase) -> DataFrame:
    keys = W.page_keys(kb.items)
    return W.page_sources(kb.items, kb.facts, kb.relations, W.route(kb.facts, keys, "fact_id", "subject", "object"), W.route(kb.relations, keys, "edge_id", "source", "target"))


_SOURCE_LINE = f"""number || '. ' || concat_ws(' · ', '**' || coalesce(document_id, '') || '**', CASE WHEN coalesce(section_id, '') <> '' THEN 'section `' || section_id || '`' END, CASE WHEN page_number IS NOT NULL THEN 'page ' || page_number END)
  || CASE WHEN q = '' THEN '' WHEN length(q) <= 300 THEN ' — “' || q || '”' ELSE ' — “' || rtrim(left(q, 300)) || '…”' END"""
_COLLAPSED = _strip(f"regexp_replace(coalesce(quote, ''), '{_SP}+', ' ', 'g')")
_QUOTED = lambda x: f"""'"' || replace(replace({x}, '\\', '\\\\'), '"', '\\"') || '"'"""
_PAGES = f"""WITH {_ITEMS}, {_FACTS}, {_RELATIONS}, {_PATHS},
e AS (SELECT 'Facts' AS sec, fact_id AS ref_id, {_key('subject')} AS a, {_key('object')} AS b, sources, key || chr(1) || lpad(CAST(fact_id AS VARCHAR), 20, '0') AS o, statement AS body FROM fv
  UNION ALL SELECT 'Relations', edge_id, {_key('source')}, {_key('target')}, sources, {_key('source')} || chr(1) || {_key('type')} || chr(1) || {_key('target')} || chr(1) || lpad(CAST(edge_id AS VARCHAR), 20, '0'),
    source || ' ' || CASE WHEN type <> '' THEN '—' || type || '→' ELSE '→' END || ' ' || target FROM rv),
rt AS (SELECT id, sec, ref_id, min(i) AS dir FROM (SELECT nk.id, sec, ref_id, 0 AS i FROM e JOIN nk ON nk.key = e.a UNION ALL SELECT nk.id, sec, ref_id, 1 FROM e JOIN nk ON nk.key = e.b) GROUP BY ALL),
ci AS (SELECT id, NULL AS sec, NULL AS ref_id, unnest(sources) AS s FROM iv UNION ALL SELECT rt.id, rt.sec, rt.ref_id, unnest(e.sources) FROM rt JOIN e ON e.sec = rt.sec AND e.ref_id = rt.ref_id),
cc AS (SELECT id, sec, ref_id, s.document_id AS document_id, s.section_id AS section_id, s.page_number AS page_number, coalesce(s.quote, '') AS quote FROM ci),
nu AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(document_id, ''), coalesce(section_id, ''), coalesce(page_number, -1), quote, section_id IS NULL) AS number FROM (SELECT DISTINCT id, document_id, section_id, page_number, quote FROM cc)),
mk AS (SELECT id, sec, ref_id, ' ' || string_agg('[' || number || ']', '' ORDER BY number) AS marks FROM (SELECT DISTINCT cc.id, cc.sec, cc.ref_id, nu.number FROM cc JOIN nu ON nu.id = cc.id AND nu.quote = cc.quote
  AND nu.document_id IS NOT DISTINCT FROM cc.document_id AND nu.section_id IS NOT DISTINCT FROM cc.section_id AND nu.page_number IS NOT DISTINCT FROM cc.page_number WHERE cc.ref_id IS NOT NULL) GROUP BY id, sec, ref_id),
li AS (SELECT rt.id, rt.sec, e.o, '- ' || CASE WHEN rt.sec = 'Relations' AND rt.dir = 1 THEN '← ' ELSE '' END || e.body || coalesce(mk.marks, '') AS line FROM rt JOIN e ON e.sec = rt.sec AND e.ref_id = rt.ref_id LEFT JOIN mk ON mk.id = rt.id AND mk.sec = rt.sec AND mk.ref_id = rt.ref_id
  UNION ALL SELECT id, 'Sources', lpad(CAST(number AS VARCHAR), 20, '0'), {_SOURCE_LINE} FROM (SELECT *, {_COLLAPSED} AS q FROM nu)),
ag AS (SELECT id, '## ' || sec || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY o, line) || chr(10) || chr(10) AS block, sec FROM li GROUP BY id, sec),
ax AS (SELECT id, string_agg('  - ' || {_QUOTED('alias')}, chr(10) ORDER BY pl, alias) AS aliases FROM (SELECT id, alias, min((item_id, p)) AS pl FROM (SELECT id, item_id, unnest(aliases) AS alias, generate_subscripts(aliases, 1) AS p FROM iv) WHERE trim(alias) <> '' GROUP BY id, alias) GROUP BY id),
fn AS (SELECT id, CASE WHEN kind = 'entity' THEN type END AS type, d AS description FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r, item_id) AS n, first_value(description) OVER (PARTITION BY id ORDER BY length(description) DESC, r, item_id) AS d FROM o) WHERE n = 1),
pg AS (SELECT nm2.object_id, nm2.kind, nm2.title, nm || '.md' AS path, '---' || chr(10) || 'id: ' || {_QUOTED('nm2.object_id')} || chr(10) || 'kind: ' || {_QUOTED('nm2.kind')} || CASE WHEN coalesce(fn.type, '') <> '' THEN chr(10) || 'type: ' || {_QUOTED('fn.type')} ELSE '' END
  || CASE WHEN ax.aliases IS NOT NULL THEN chr(10) || 'aliases:' || chr(10) || ax.aliases ELSE '' END || chr(10) || 'page: ' || {_QUOTED("nm || '.md'")} || chr(10) || '---' || chr(10) || '# ' || nm2.title || chr(10) || chr(10)
  || CASE WHEN coalesce(fn.description, '') <> '' THEN '## Description' || chr(10) || chr(10) || fn.description || chr(10) || chr(10) ELSE '' END || coalesce(f.block, '') || coalesce(r.block, '') || coalesce(s.block, '') AS text
  FROM nm2 LEFT JOIN fn ON fn.id = nm2.object_id LEFT JOIN ax ON ax.id = nm2.object_id LEFT JOIN ag f ON f.id = nm2.object_id AND f.sec = 'Facts' LEFT JOIN ag r ON r.id = nm2.object_id AND r.sec = 'Relations' LEFT JOIN ag s ON s.id = nm2.object_id AND s.sec = 'Sources')"""


@query(f"{_PAGES} SELECT path, object_id, kind, title, 0 AS part, CAST(NULL AS VARCHAR) AS section, rtrim(text, chr(10)) || chr(10) AS text FROM pg")
def wiki_pages(kb: KnowledgeBase) -> DataFrame:
    """Rendered pages; the SQL has no pages in parts, which begin at 5,000 rows of one page."""
    return kb.rendered


@query(f"""WITH {_ITEMS}, {_FACTS}, {_RELATIONS}, k AS (SELECT DISTINCT key FROM nk)
SELECT (SELECT count(DISTINCT document_id) FROM documents) AS documents, (SELECT count(DISTINCT id) FROM iv WHERE kind = 'entity') AS entity_pages, (SELECT count(DISTINCT id) FROM iv WHERE kind = 'concept') AS concept_pages,
(SELECT count(*) FROM fv WHERE {_key('subject')} NOT IN (SELECT key FROM k) AND {_key('object')} NOT IN (SELECT key FROM k)) AS unattached_facts, (SELECT count(*) FROM rv WHERE {_key('source')} NOT IN (SELECT key FROM k) AND {_key('target')} NOT IN (SELECT key FROM k)) AS unattached_relations""")
def wiki_index_counts(kb: KnowledgeBase) -> DataFrame:
    keys = W.page_keys(kb.items)
    f, r = W.route(kb.facts, keys, "fact_id", "subject", "object"), W.route(kb.relations, keys, "edge_id", "source", "target")
    return W.index_counts(kb.documents, kb.page_paths, W.unattached(kb.facts, f, "fact_id"), W.unattached(kb.relations, r, "edge_id"))


_INDEX = f"""k AS (SELECT DISTINCT key FROM nk),
lf AS (SELECT *, {_key('subject')} AS a, {_key('object')} AS b FROM fv WHERE a NOT IN (SELECT key FROM k) AND b NOT IN (SELECT key FROM k)),
lr AS (SELECT *, {_key('source')} AS a, {_key('target')} AS b FROM rv WHERE a NOT IN (SELECT key FROM k) AND b NOT IN (SELECT key FROM k)),
en AS (SELECT 20 AS part, key || chr(1) || lpad(CAST(fact_id AS VARCHAR), 20, '0') AS sort, '- ' || statement AS line, sources FROM lf
  UNION ALL SELECT 21, a || chr(1) || {_key('type')} || chr(1) || b || chr(1) || lpad(CAST(edge_id AS VARCHAR), 20, '0'), '- ' || source || ' ' || CASE WHEN type <> '' THEN '—' || type || '→' ELSE '→' END || ' ' || target, sources FROM lr),
ci AS (SELECT part, sort, s.document_id AS document_id, s.section_id AS section_id, s.page_number AS page_number, coalesce(s.quote, '') AS quote FROM (SELECT part, sort, unnest(sources) AS s FROM en)),
nu AS (SELECT *, row_number() OVER (ORDER BY coalesce(document_id, ''), coalesce(section_id, ''), coalesce(page_number, -1), quote, section_id IS NULL) AS number FROM (SELECT DISTINCT document_id, section_id, page_number, quote FROM ci)),
mk AS (SELECT part, sort, ' ' || string_agg('[' || number || ']', '' ORDER BY number) AS marks FROM (SELECT DISTINCT ci.part, ci.sort, nu.number FROM ci JOIN nu ON ci.quote = nu.quote AND ci.document_id IS NOT DISTINCT FROM nu.document_id AND ci.section_id IS NOT DISTINCT FROM nu.section_id AND ci.page_number IS NOT DISTINCT FROM nu.page_number) GROUP BY part, sort)"""


@query(f"""WITH {_ITEMS}, {_FACTS}, {_RELATIONS}, {_PATHS}, {_INDEX}
SELECT 0 AS part, '' AS sort, (SELECT count(DISTINCT document_id) FROM documents) || ' document(s) · ' || (SELECT count(DISTINCT id) FROM iv WHERE kind = 'entity') || ' entity page(s) · ' || (SELECT count(DISTINCT id) FROM iv WHERE kind = 'concept') || ' concept page(s) · ' || (SELECT count(*) FROM lf) || ' unattached fact(s) · ' || (SELECT count(*) FROM lr) || ' unattached relation(s)' AS line
UNION ALL SELECT 1, document_id, '- `' || document_id || '` — ' || coalesce(nullif(t, ''), document_id) || CASE WHEN coalesce(s, '') <> '' THEN ' (' || s || ')' ELSE '' END
  FROM (SELECT document_id, d.t AS t, d.s AS s FROM (SELECT document_id, arg_min(struct_pack(t := title, s := source), (title IS NOT NULL, title, source IS NOT NULL, source)) AS d FROM documents GROUP BY document_id))
UNION ALL SELECT CASE kind WHEN 'entity' THEN 2 WHEN 'concept' THEN 3 ELSE 11 END, {_key('title')} || chr(1) || object_id, '- ' || title || ' → ' || nm || '.md' FROM nm2
UNION ALL SELECT part, sort, line || coalesce(marks, '') FROM en LEFT JOIN mk USING (part, sort)
UNION ALL SELECT 22, lpad(CAST(number AS VARCHAR), 20, '0'), {_SOURCE_LINE} FROM (SELECT *, {_COLLAPSED} AS q FROM nu)""")
def wiki_index(kb: KnowledgeBase) -> DataFrame:
    keys = W.page_keys(kb.items)
    f = W.unattached(kb.facts, W.route(kb.facts, keys, "fact_id", "subject", "object"), "fact_id")
    r = W.unattached(kb.relations, W.route(kb.relations, keys, "edge_id", "source", "target"), "edge_id")
    return W.index_page(W.index_counts(kb.documents, kb.page_paths, f, r), kb.documents, kb.page_paths, f, r)


def _link_index(kb: KnowledgeBase) -> DataFrame:
    named = kb.items.select(F.col("id").alias("object_id"), "name", "aliases").groupBy("object_id", "name", "aliases").count()
    return N.link_index(kb.page_paths.select("object_id", "path", "kind").join(named, "object_id").select("path", "kind", F.col("name").alias("title"), "aliases"))


@query(f"""WITH {_ITEMS}, {_PATHS}, c AS (SELECT DISTINCT nk.key, nm || '.md' AS path, nm2.kind FROM nk JOIN nm2 ON nm2.object_id = nk.id)
SELECT key, CASE WHEN count(DISTINCT path) = 1 THEN min(path) END AS path, count(DISTINCT path) AS n_pages, min(path) FILTER (kind = 'entity') AS entity_path FROM c GROUP BY key""")
def link_index(kb: KnowledgeBase) -> DataFrame:
    return _link_index(kb)


@query()
def link_pages(kb: KnowledgeBase) -> DataFrame:
    return N.link_pages(kb.pages, _link_index(kb))


def _search_table(kb: KnowledgeBase) -> DataFrame:
    d = kb.documents.select(F.col("doc_id").cast("string").alias("path"), F.coalesce("title", F.lit("")).alias("title"), F.lit("page").alias("kind"), F.col("document_id").alias("object_id"), F.array().cast("array<string>").alias("normalized_aliases"), F.coalesce("text", F.lit("")).alias("display_text"))
    return d.withColumn("normalized_title", S.normalized(F.col("title"))).withColumn("normalized_text", S.normalized(F.col("display_text")))


def _search_sql(phrase: str) -> str:
    terms = phrase.split()
    t, b = (f"replace(regexp_replace({_strip(f'''replace(lower(coalesce({c}, '')), 'ß', 'ss')''')}, '{_SP}+', ' ', 'g'), '…', '...')" for c in ("title", "text"))
    per = [f"CASE WHEN t = '{w}' THEN 100 WHEN contains(t, '{w}') THEN 10 WHEN contains(b, '{w}') THEN 1 ELSE 0 END" for w in terms]
    return f"""WITH n AS (SELECT CAST(doc_id AS VARCHAR) AS path, coalesce(title, '') AS title, {t} AS t, {b} AS b FROM documents),
s AS (SELECT path, title, CASE WHEN t = '{phrase}' THEN 100 WHEN contains(t, '{phrase}') THEN 10 WHEN contains(b, '{phrase}') THEN 1 WHEN {' AND '.join(f'({p}) > 0' for p in per)} THEN {' + '.join(per)} ELSE 0 END AS score FROM n)
SELECT path, title, score FROM s WHERE score > 0"""


@query(_search_sql("binary trace"))
def search_all(kb: KnowledgeBase) -> DataFrame:
    return S.search(_search_table(kb), "Binary  trace", snippet=False).select("path", "title", "score")


@query(_search_sql("binary trace") + " ORDER BY score DESC, path LIMIT 20")
def search_top(kb: KnowledgeBase) -> DataFrame:
    return S.search(_search_table(kb), "binary trace", limit=20, snippet=False).select("path", "title", "score")


_SNIPPET = f"""sn AS (SELECT CAST(doc_id AS VARCHAR) AS path, coalesce(text, '') AS b, list_min(list_filter([strpos(lower(coalesce(text, '')), 'binary'), strpos(lower(coalesce(text, '')), 'trace')], lambda p: p > 0)) AS p FROM documents),
so AS (SELECT path, b, coalesce(greatest(p - 81, 0), 0) AS a, coalesce(least(p - 1 + CASE WHEN strpos(lower(b), 'binary') = p THEN 6 ELSE 5 END + 80, length(b)), least(160, length(b))) AS z FROM sn),
sp AS (SELECT path, a, z, b, {_strip(f"regexp_replace(substr(b, a + 1, z - a), '{_SP}+', ' ', 'g')")} AS w FROM so)"""


@query(_search_sql("binary trace").replace("WITH n AS", f"WITH {_SNIPPET}, n AS").replace("SELECT path, title, score FROM s WHERE score > 0", "SELECT path, title, score, CASE WHEN w = '' THEN '' ELSE CASE WHEN a > 0 THEN '…' ELSE '' END || w || CASE WHEN z < length(b) THEN '…' ELSE '' END END AS snippet FROM s JOIN sp USING (path) WHERE score > 0 ORDER BY score DESC, path LIMIT 20"))
def search_snippets(kb: KnowledgeBase) -> DataFrame:
    return S.search(_search_table(kb), "binary trace", limit=20).select("path", "title", "score", "snippet")


@query(f"""{_PAGES}, la AS (SELECT id, list(replace(lower({_strip(f"regexp_replace(alias, '{_SP}+', ' ', 'g')")}), 'ß', 'ss')) AS al FROM (SELECT id, unnest(aliases) AS alias FROM iv) WHERE trim(alias) <> '' GROUP BY id),
sw AS (SELECT path, lower({_strip(f"regexp_replace(title, '{_SP}+', ' ', 'g')")}) AS t, coalesce(al, []) AS al, lower(regexp_replace(text, '(?s)\\A---\\n.*?\\n---\\n', '')) AS b FROM pg LEFT JOIN la ON la.id = pg.object_id)
SELECT path, score FROM (SELECT path, CASE WHEN t = 'parser' THEN 100 WHEN list_contains(al, 'parser') THEN 50 WHEN contains(t, 'parser') THEN 10 WHEN contains(b, 'parser') THEN 1 WHEN len(list_filter(al, lambda a: contains(a, 'parser'))) > 0 THEN 5 ELSE 0 END AS score FROM sw) WHERE score > 0 ORDER BY score DESC, path LIMIT 50""")
def search_wiki(kb: KnowledgeBase) -> DataFrame:
    """Names, aliases and texts of the rendered pages."""
    return S.search(S.search_pages(kb.rendered), "parser", limit=50).select("path", "score")


# --- diagrams -------------------------------------------------------------------------------------------------------


def _diagrams(kb: KnowledgeBase) -> DataFrame:
    return M.parse_diagrams(kb.documents.filter("doc_format = 'lw' AND text IS NOT NULL"), "doc_id", "text")


_LW = r"""WITH ll AS (SELECT doc_id, n AS line, trim(regexp_replace(l, '%%.*$', '')) AS l FROM (
  SELECT doc_id, unnest(a) AS l, generate_subscripts(a, 1) AS n FROM (SELECT doc_id, string_split(replace(text, chr(13), ''), chr(10)) AS a FROM documents WHERE doc_format = 'lw' AND text IS NOT NULL)))"""


@query(_LW + r""" SELECT doc_id, regexp_extract(l, '^(\S+?)\[', 1) AS id, regexp_extract(l, '\[([^\]]*)\]$', 1) AS title, CAST(min(line) AS INTEGER) AS line FROM ll WHERE regexp_matches(l, '^\S+?\[[^\]]*\]$') GROUP BY ALL""")
def lw_nodes(kb: KnowledgeBase) -> DataFrame:
    return M.diagram_nodes(_diagrams(kb), "doc_id").select("doc_id", "id", "title", "line")


@query(_LW + r""" SELECT doc_id, regexp_extract(l, '^(\S+) -->', 1) AS source, regexp_extract(l, '(\S+)$', 1) AS target, regexp_extract(l, '\|([^|]*)\|', 1) AS type, count(*) AS n, CAST(min(line) AS INTEGER) AS line FROM ll WHERE regexp_matches(l, '^\S+ -->\|[^|]*\| \S+$') GROUP BY ALL""")
def lw_edges(kb: KnowledgeBase) -> DataFrame:
    return M.diagram_edges(_diagrams(kb), "doc_id")


@query(_LW + r""" SELECT doc_id, CAST(n AS INTEGER) AS line, CAST(p AS INTEGER) AS "column", 'link operator ''==>'' is not supported in this version; use ''-->''' AS message FROM (
  SELECT doc_id, min(n) AS n, arg_min(strpos(l, '-->'), n) AS p FROM (SELECT doc_id, n, regexp_replace(l, '%%.*$', '') AS l FROM (
    SELECT doc_id, unnest(a) AS l, generate_subscripts(a, 1) AS n FROM (SELECT doc_id, string_split(replace(text, chr(13), ''), chr(10)) AS a FROM documents WHERE doc_format = 'lw' AND text IS NOT NULL))) WHERE contains(l, '-->') GROUP BY doc_id)""")
def lw_errors(kb: KnowledgeBase) -> DataFrame:
    """Errors of all diagrams when their arrows are typed as an operator that the language does not have."""
    thick = kb.documents.filter("doc_format = 'lw' AND text IS NOT NULL").select("doc_id", F.replace("text", F.lit("-->"), F.lit("==>")).alias("text"))
    return M.diagram_errors(M.parse_diagrams(thick, "doc_id", "text"), "doc_id")
