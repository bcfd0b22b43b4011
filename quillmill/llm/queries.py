"""Registered queries of the dealt problems, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import bpe, components, markup, mojibake, names, neardup, packing, reading, splitting
from quillmill.operators.references import name_key
from quillmill.session import cut, table


def _limit(spark: SparkSession, d: str, name: str) -> tuple[int, int]:
    r = table(spark, d, "size_limits").filter(F.col("limit_name") == name).first()
    return r["max_size"], r["overlap_size"]


# --- 1 oversized texts ----------------------------------------------------------------------------------------------


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    docs = splitting.split_oversized(table(spark, d, "documents"), "documents", "doc_id", "text", *_limit(spark, d, "document_piece"))
    return docs.unionByName(splitting.split_oversized(table(spark, d, "sections"), "sections", "section_id", "content", *_limit(spark, d, "section_piece")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_pieces(spark, d).filter("piece_no = 1").select("item_table", "item_key")


def p1_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the pieces: their new parts give the text back, none is too long, neighbours overlap as stated."""
    limit = table(spark, d, "size_limits").select(F.regexp_replace("limit_name", "_piece$", "s").alias("item_table"), "max_size", "overlap_size")
    p = p1_pieces(spark, d).join(F.broadcast(limit), "item_table")
    new = F.expr("substring(piece, new_start - start + 1)")
    lap = (F.col("piece_no") == 1) | (F.col("new_start") - F.col("start") == F.col("overlap_size"))
    one = p.groupBy("item_table", "item_key").agg(F.array_sort(F.collect_list(F.struct("piece_no", new.alias("new")))).alias("_p"), F.min(F.char_length("piece") <= F.col("max_size")).alias("within_limit"), F.min(lap).alias("overlap_kept"))
    return one.select("item_table", "item_key", F.md5(F.array_join(F.transform("_p", lambda x: x["new"]), "").cast("binary")).alias("text_hash"), "within_limit", "overlap_kept")


# --- 2 misread text -------------------------------------------------------------------------------------------------


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.repair_fields(table(spark, d, "documents"), "doc_id", {"text": False, "metadata": True})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_repaired(spark, d).select("doc_id", "field_name")


# --- 4 variant names ------------------------------------------------------------------------------------------------


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    return names.link_items(table(spark, d, "items"), table(spark, d, "name_registry"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Linked items whose own name is not the registered one."""
    differs = F.coalesce(name_key(F.col("name")), F.lit("")) != name_key(F.col("registered"))
    return p4_links(spark, d).filter(differs).select("item_id", "registry_id")


# --- 5 markup -------------------------------------------------------------------------------------------------------


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    """Clean text and families of documents and sections; sections of diagram documents count as diagrams."""
    documents, sections = table(spark, d, "documents"), table(spark, d, "sections")
    diagrams = documents.filter("doc_format = 'lw'").select("document_id").distinct().withColumn("_lw", F.lit(True))
    docs = markup.clean_texts(documents, "documents", "doc_id", "text", F.col("doc_format") == "lw")
    secs = markup.clean_texts(sections.select("section_id", "document_id", "content").join(diagrams, "document_id", "left"), "sections", "section_id", "content", F.col("_lw"))
    return docs.unionByName(markup.once(secs))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.found_families(p5_clean(spark, d))


# --- 6 near-duplicate records ---------------------------------------------------------------------------------------


def _near(spark: SparkSession, d: str) -> neardup.NearDuplicates:
    return neardup.NearDuplicates(
        [
            neardup.records(table(spark, d, "facts"), "facts", "fact_id", "statement"),
            neardup.records(table(spark, d, "items"), "items", "item_id", "description"),
        ]
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).pairs()


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).groups()


# --- 7 groups of matches --------------------------------------------------------------------------------------------


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    links = components.linked_pairs(table(spark, d, "verdicts"), "left_id", "right_id", F.col("same"))
    return components.components(links).select(F.col("id").alias("item_id"), "group_id")


# --- 8 token ids ----------------------------------------------------------------------------------------------------


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_column(table(spark, d, "documents"), "text", "doc_id", bpe.vocabulary_path(spark))


# --- 9 containers ---------------------------------------------------------------------------------------------------


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = cut(bpe.count_tokens(table(spark, d, "documents"), "text", "doc_id", bpe.vocabulary_path(spark)))
    limits = {r["limit_name"]: r["max_size"] for r in table(spark, d, "size_limits").filter(F.col("limit_name").startswith("container")).collect()}
    out = None
    for name, capacity in sorted(limits.items()):
        part = packing.assign_containers(sizes, "doc_id", "n_tokens", capacity).select(F.lit(name).alias("limit_name"), F.lit(capacity).alias("max_size"), "doc_id", "piece_no", "n_tokens", "container_id")
        out = part if out is None else out.unionByName(part)
    return out


def p9_checked(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers: every document is there, none is above its capacity, none is split without need."""
    a = p9_containers(spark, d)
    over = a.groupBy("limit_name", "max_size", "container_id").agg(F.sum("n_tokens").alias("t")).groupBy("limit_name").agg(F.count_if(F.col("t") > F.col("max_size")).alias("overfull"))
    doc = a.groupBy("limit_name", "max_size", "doc_id").agg(F.count("*").alias("k"), F.sum("n_tokens").alias("t"))
    needed = F.greatest(F.ceil(F.col("t") / F.col("max_size")), F.lit(1))
    docs = doc.groupBy("limit_name").agg(F.count("*").alias("documents"), F.count_if(F.col("k") > needed).alias("split_without_need"))
    return docs.join(over, "limit_name").select("limit_name", "documents", "overfull", "split_without_need")


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p9_containers(spark, d), "limit_name", "max_size")


# --- 10 reading level -----------------------------------------------------------------------------------------------


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "reading_samples"), F.col("doc_format") == "lw")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_levels(spark, d).filter("is_english AND band >= 4").select("doc_id")


QUERIES = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p1_rebuilt": p1_rebuilt,
    "p2_found": p2_found,
    "p2_repaired": p2_repaired,
    "p4_found": p4_found,
    "p4_links": p4_links,
    "p5_found": p5_found,
    "p5_clean": p5_clean,
    "p6_found": p6_found,
    "p6_groups": p6_groups,
    "p7_found": p7_found,
    "p8_ids": p8_ids,
    "p9_containers": p9_containers,
    "p9_checked": p9_checked,
    "p9_fill": p9_fill,
    "p10_found": p10_found,
    "p10_levels": p10_levels,
}

ORACLE = {
    "p1_found": """
SELECT DISTINCT 'documents' AS item_table, CAST(doc_id AS VARCHAR) AS item_key FROM documents, size_limits
WHERE limit_name = 'document_piece' AND length(text) > max_size AND doc_id IS NOT NULL
UNION SELECT DISTINCT 'sections', section_id FROM sections, size_limits
WHERE limit_name = 'section_piece' AND length(content) > max_size AND section_id IS NOT NULL""",
    "p1_rebuilt": """
SELECT 'documents' AS item_table, CAST(doc_id AS VARCHAR) AS item_key, md5(min(text)) AS text_hash, true AS within_limit, true AS overlap_kept FROM documents, size_limits
WHERE limit_name = 'document_piece' AND length(text) > max_size AND doc_id IS NOT NULL GROUP BY doc_id
UNION ALL SELECT 'sections', section_id, md5(min(content)), true, true FROM sections, size_limits
WHERE limit_name = 'section_piece' AND length(content) > max_size AND section_id IS NOT NULL GROUP BY section_id""",
    "p9_checked": "SELECT limit_name, (SELECT count(*) FROM documents) AS documents, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS split_without_need FROM size_limits WHERE starts_with(limit_name, 'container')",
    "p6_found": r"""
WITH t AS (
  SELECT DISTINCT 'facts' AS record_table, fact_id AS id, list_sort(regexp_extract_all(lower(statement), '[\p{L}\p{N}]+')) AS w FROM facts WHERE statement IS NOT NULL
  UNION SELECT DISTINCT 'items', item_id, list_sort(regexp_extract_all(lower(description), '[\p{L}\p{N}]+')) FROM items WHERE description IS NOT NULL),
u AS (SELECT record_table, id, len(w) AS n, w FROM t WHERE len(w) >= 8),
x AS (SELECT record_table, id, n, unnest(w) AS word FROM u),
c AS (SELECT record_table, id, any_value(n) AS n, word, count(*) AS k FROM x GROUP BY record_table, id, word),
f AS (SELECT record_table, word, count(*) AS df FROM c GROUP BY ALL),
rare AS (SELECT c.*, sum(k) OVER (PARTITION BY c.record_table, id ORDER BY df, c.word) - k AS before FROM c JOIN f ON c.record_table = f.record_table AND c.word = f.word),
prefix AS (SELECT record_table, id, n, word FROM rare WHERE before <= n - ceil(0.8 * n - 1e-9)),
cand AS (SELECT DISTINCT a.record_table, a.id AS low_id, b.id AS high_id, greatest(a.n, b.n) AS longest
  FROM prefix a JOIN prefix b ON a.record_table = b.record_table AND a.word = b.word AND a.id < b.id AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9)
SELECT cand.record_table, low_id, high_id FROM cand
JOIN c a ON a.record_table = cand.record_table AND a.id = low_id JOIN c b ON b.record_table = cand.record_table AND b.id = high_id AND a.word = b.word
GROUP BY cand.record_table, low_id, high_id, longest HAVING sum(least(a.k, b.k)) >= 0.8 * longest - 1e-9""",
    "p6_groups": r"""
WITH RECURSIVE t AS (
  SELECT DISTINCT 'facts' AS record_table, fact_id AS id, list_sort(regexp_extract_all(lower(statement), '[\p{L}\p{N}]+')) AS w FROM facts WHERE statement IS NOT NULL
  UNION SELECT DISTINCT 'items', item_id, list_sort(regexp_extract_all(lower(description), '[\p{L}\p{N}]+')) FROM items WHERE description IS NOT NULL),
u AS (SELECT record_table, id, w FROM t WHERE len(w) >= 8),
rp AS (SELECT record_table, w, min(id) AS rep, count(*) AS n FROM u GROUP BY record_table, w),
c AS (SELECT record_table, rep, word, count(*) AS k FROM (SELECT record_table, rep, unnest(w) AS word FROM rp) GROUP BY record_table, rep, word),
m AS (SELECT a.record_table, a.rep AS a, b.rep AS b, sum(least(a.k, b.k)) AS shared FROM c a JOIN c b ON a.record_table = b.record_table AND a.word = b.word AND a.rep < b.rep GROUP BY ALL HAVING sum(least(a.k, b.k)) >= 7),
lk AS (SELECT m.record_table, a, b FROM m JOIN rp x ON x.record_table = m.record_table AND x.rep = a JOIN rp y ON y.record_table = m.record_table AND y.rep = b WHERE shared >= 0.8 * greatest(len(x.w), len(y.w)) - 1e-9),
l2 AS (SELECT record_table, a, b FROM lk UNION SELECT record_table, b, a FROM lk),
reach AS (SELECT record_table, a AS id, b AS o FROM l2 UNION SELECT r.record_table, r.id, l2.b FROM reach r JOIN l2 ON l2.record_table = r.record_table AND l2.a = r.o),
g AS (SELECT record_table, id, least(id, min(o)) AS group_id FROM reach GROUP BY record_table, id),
d AS (SELECT record_table, a AS id, count(*) AS n_links FROM l2 GROUP BY ALL)
SELECT u.record_table, u.id AS record_id, coalesce(g.group_id, rp.rep) AS group_id, coalesce(d.n_links, 0) AS n_links
FROM u JOIN rp ON rp.record_table = u.record_table AND rp.w = u.w LEFT JOIN g ON g.record_table = u.record_table AND g.id = rp.rep LEFT JOIN d ON d.record_table = u.record_table AND d.id = rp.rep
WHERE g.id IS NOT NULL OR rp.n > 1""",
    "p7_found": """
WITH RECURSIVE l AS (SELECT left_id AS a, right_id AS b FROM verdicts WHERE same AND left_id <> right_id
  UNION SELECT right_id, left_id FROM verdicts WHERE same AND left_id <> right_id),
r AS (SELECT a AS id, b AS other FROM l UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.other)
SELECT id AS item_id, least(id, min(other)) AS group_id FROM r GROUP BY id""",
}
