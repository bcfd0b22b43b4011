"""Registered queries on missing records, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmill.operators import references as R
from quillmill.session import table


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = {n: table(spark, d, n) for n in ("documents", "sections", "items", "facts", "edges")}
    return R.references(t["items"], t["facts"], t["edges"]), R.existence(t["documents"], t["sections"], t["items"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return R.orphan_references(*_parts(spark, d))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return R.orphan_report(p3_found(spark, d))


def p3_current(spark: SparkSession, d: str) -> DataFrame:
    return R.current_orphans(*_parts(spark, d))


QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p3_current": p3_current}

_SPACE = r"[\s\x{00A0}\x{3000}]+"


def _key(x: str) -> str:
    return f"nullif(lower(regexp_replace({x}, '^{_SPACE}|{_SPACE}$', '', 'g')), '')"


def _name(x: str) -> str:
    return _key(f"regexp_replace({x}, '{_SPACE}', ' ', 'g')")


def _first(t: str, i: str, cols: str) -> str:
    return f"SELECT {i} AS row_id, loaded_at, {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {i} ORDER BY loaded_at NULLS LAST) AS _n FROM {t} WHERE {i} IS NOT NULL) WHERE _n = 1"


_BASE = f"""
WITH f_items AS ({_first('items', 'item_id', 'sources')}),
f_facts AS ({_first('facts', 'fact_id', 'sources')}),
f_edges AS ({_first('edges', 'edge_id', 'sources, source, target')}),
cited AS (
  SELECT 'items' AS ref_table, row_id, loaded_at, unnest(sources) AS s, generate_subscripts(sources, 1) AS p FROM f_items
  UNION ALL SELECT 'facts', row_id, loaded_at, unnest(sources), generate_subscripts(sources, 1) FROM f_facts
  UNION ALL SELECT 'edges', row_id, loaded_at, unnest(sources), generate_subscripts(sources, 1) FROM f_edges),
refs AS (SELECT * FROM (
  SELECT ref_table, row_id, 'document_id' AS field_name, CAST(p AS INTEGER) AS ref_pos, 'd' AS space, {_key('s.document_id')} AS key, loaded_at AS t FROM cited
  UNION ALL SELECT ref_table, row_id, 'section_id', CAST(p AS INTEGER), 's', {_key('s.section_id')}, loaded_at FROM cited
  UNION ALL SELECT 'edges', row_id, 'source', 0, 'n', {_name('source')}, loaded_at FROM f_edges
  UNION ALL SELECT 'edges', row_id, 'target', 0, 'n', {_name('target')}, loaded_at FROM f_edges) WHERE key IS NOT NULL),
lives AS (
  SELECT 'd' AS space, {_key('document_id')} AS key, loaded_at, deleted_at FROM documents
  UNION ALL SELECT 's', {_key('section_id')}, loaded_at, deleted_at FROM sections
  UNION ALL SELECT 'n', {_name('name')}, loaded_at, deleted_at FROM items
  UNION ALL SELECT 'n', {_name('a')}, loaded_at, deleted_at FROM (SELECT unnest(aliases) AS a, loaded_at, deleted_at FROM items)),
orphans AS (
  SELECT ref_table, row_id, field_name, ref_pos, strftime(t, '%Y-%m') AS period FROM refs
  WHERE NOT EXISTS (SELECT 1 FROM lives l WHERE l.space = refs.space AND l.key = refs.key AND l.loaded_at <= refs.t AND (l.deleted_at IS NULL OR l.deleted_at > refs.t)))
"""

ORACLE = {
    "p3_found": _BASE + "SELECT * FROM orphans",
    "p3_report": _BASE + "SELECT ref_table, field_name, period, count(*) AS orphans FROM orphans GROUP BY ALL",
    "p3_current": _BASE
    + """SELECT r.space, r.key, r.n AS n_refs FROM (SELECT space, key, count(*) AS n FROM refs GROUP BY ALL) r
WHERE NOT EXISTS (SELECT 1 FROM lives l WHERE l.space = r.space AND l.key = r.key AND l.loaded_at IS NOT NULL AND l.deleted_at IS NULL)""",
}
