"""Knowledge graph: nodes and edges as tables, resolution of endpoints, neighbourhoods and degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.names import alias_keys_col, match_key_col
from quillmill.operators.knowledge import SOURCE, source_rows

RELATION, FACT = "relation", "fact"


def kind_rank(c: Column) -> Column:
    return F.when(c == "entity", 0).when(c == "concept", 1).otherwise(9)


def nodes(view: DataFrame) -> DataFrame:
    """(id, kind, title, type, description): items of one id are one node; the longest description, first on a tie."""
    return view.groupBy("id").agg(
        F.min(F.struct(kind_rank(F.col("kind")).alias("r"), "item_id", "kind", "name", "type")).alias("_f"),
        F.min(F.struct((-F.char_length("description")).alias("n"), kind_rank(F.col("kind")).alias("r"), "item_id", "description")).alias("_d"),
    ).select("id", "_f.kind", F.col("_f.name").alias("title"), F.when(F.col("_f.kind") == "entity", F.col("_f.type")).alias("type"), "_d.description")


def node_keys(view: DataFrame) -> DataFrame:
    """(id, key): every key a node answers to."""
    return view.select("id", F.explode(alias_keys_col("name", "aliases")).alias("key")).distinct()


def node_sources(view: DataFrame) -> DataFrame:
    return source_rows(view, "id", "item_id").groupBy("id", *SOURCE).agg(F.min("_o").alias("first_item"))


def name_index(keys: DataFrame) -> DataFrame:
    """(key, n_nodes, node_id): the node only where the key is unique."""
    g = keys.groupBy("key").agg(F.count("*").alias("n_nodes"), F.min("id").alias("_id"))
    return g.select("key", "n_nodes", F.when(F.col("n_nodes") == 1, F.col("_id")).alias("node_id"))


def resolve(links: DataFrame, index: DataFrame, node_ids: DataFrame | None = None) -> DataFrame:
    """Adds source_key, target_key, type_key, source_id, target_id, source_nodes and target_nodes (0: not found).

    Links may carry ``source_ref`` and ``target_ref``, ids that were given with them: one that is the id of a node
    (``node_ids``: id) goes before the name, and one that is not is ignored.
    """
    out = links.select("*", match_key_col("source").alias("source_key"), match_key_col("target").alias("target_key"), match_key_col("type").alias("type_key"))
    for side in ("source", "target"):
        out = out.join(index.toDF(f"{side}_key", f"{side}_nodes", f"{side}_id"), f"{side}_key", "left").withColumn(f"{side}_nodes", F.coalesce(f"{side}_nodes", F.lit(0)))
        ref = f"{side}_ref"
        if node_ids is not None and ref in links.columns:
            known = node_ids.select(F.col("id").alias(ref), F.lit(True).alias("_known")).distinct()
            out = out.join(known, ref, "left").withColumn(f"{side}_id", F.when(F.col("_known"), F.col(ref)).otherwise(F.col(f"{side}_id")))
            out = out.withColumn(f"{side}_nodes", F.when(F.col("_known"), 1).otherwise(F.col(f"{side}_nodes"))).drop("_known")
    return out


def links_of(relations: DataFrame, facts: DataFrame, *more: str) -> DataFrame:
    """Relations and complete facts as one table: kind, ref_id, source, type, target, statement, description, ord, ``more``."""
    r = relations.select(F.lit(RELATION).alias("kind"), F.col("edge_id").alias("ref_id"), "source", "type", "target", F.lit(None).cast("string").alias("statement"), "description", F.lit(0).alias("ord"), *more)
    f = facts.filter("subject <> '' AND predicate <> '' AND object <> ''").select(
        F.lit(FACT).alias("kind"), F.col("fact_id").alias("ref_id"), F.col("subject").alias("source"), F.col("predicate").alias("type"), F.col("object").alias("target"), "statement", F.lit("").alias("description"), F.lit(1).alias("ord"), *more
    )
    return r.unionByName(f)


def edges(resolved: DataFrame) -> DataFrame:
    """One row per (source, type, target) keys; both ends must be found, an ambiguous end has no id."""
    ok = resolved.filter("source_nodes > 0 AND target_nodes > 0")
    first = F.min(F.struct("ord", "ref_id", "source", "type", "target", "kind")).alias("_f")
    said = F.min(F.when(F.col("description") != "", F.struct("ord", "ref_id", "description"))).alias("_d")
    g = ok.groupBy("source_key", "type_key", "target_key").agg(
        first, said, F.max("source_id").alias("source_id"), F.max("target_id").alias("target_id"), F.count_if(F.col("kind") == RELATION).alias("n_relations"), F.count_if(F.col("kind") == FACT).alias("n_facts"),
        F.max(F.col("source_nodes") > 1).alias("ambiguous_source"), F.max(F.col("target_nodes") > 1).alias("ambiguous_target"),
    )
    return g.select(
        "source_key", "type_key", "target_key", "_f.source", "_f.type", "_f.target", "_f.kind", "source_id", "target_id", F.coalesce("_d.description", F.lit("")).alias("description"),
        "n_relations", "n_facts", "ambiguous_source", "ambiguous_target", (F.col("source_key") == F.col("target_key")).alias("self_loop"),
    )


EDGE = ("source_key", "type_key", "target_key")


def _linked(resolved: DataFrame) -> DataFrame:
    return resolved.filter("source_nodes > 0 AND target_nodes > 0")


def edge_sources(resolved: DataFrame) -> DataFrame:
    """(edge keys, document_id, section_id, page_number, quote, n): the union of the sources of all links of an edge."""
    s = _linked(resolved).select(*EDGE, F.explode("sources").alias("_s")).select(*EDGE, *[F.col(f"_s.{c}").alias(c) for c in SOURCE])
    return s.groupBy(*EDGE, *SOURCE).agg(F.count("*").alias("n"))


def edge_statements(resolved: DataFrame) -> DataFrame:
    """(edge keys, statement, first_fact): the distinct statements of the facts behind an edge."""
    return _linked(resolved).filter("statement IS NOT NULL").groupBy(*EDGE, "statement").agg(F.min("ref_id").alias("first_fact"))


def edge_kinds(edge_table: DataFrame) -> DataFrame:
    """(edge keys, kinds): what an edge is made of, in the order of the names."""
    kinds = F.filter(F.array(F.when(F.col("n_facts") > 0, FACT), F.when(F.col("n_relations") > 0, RELATION)), lambda k: k.isNotNull())
    return edge_table.select(*EDGE, kinds.alias("kinds"))


def node_aliases(view: DataFrame, node_table: DataFrame) -> DataFrame:
    """(id, alias, ord): every other spelling of a node once per key, the earliest spelling first."""
    v = view.select("id", "item_id", kind_rank(F.col("kind")).alias("_r"), F.posexplode(F.concat(F.array("name"), "aliases")).alias("p", "alias"))
    v = v.select("id", F.struct("_r", "item_id", "p").alias("at"), "alias", match_key_col("alias").alias("key")).filter("key <> ''")
    first = v.groupBy("id", "key").agg(F.min(F.struct("at", "alias")).alias("_f"))
    kept = first.join(node_table.select("id", match_key_col("title").alias("key")), ["id", "key"], "left_anti")
    return kept.select("id", F.col("_f.alias").alias("alias"), F.row_number().over(Window.partitionBy("id").orderBy("_f.at")).alias("ord"))


def unlinked(resolved: DataFrame) -> DataFrame:
    """(kind, ref_id, source, target, reason) of relations and complete facts with an end that is no node."""
    no = resolved.filter("source_nodes = 0 OR target_nodes = 0")
    side = lambda s: F.when(F.col(f"{s}_nodes") == 0, F.concat(F.lit(f"{s} '"), F.col(s), F.lit("' matches no node")))
    return no.select("kind", "ref_id", "source", "target", F.concat_ws("; ", side("source"), side("target")).alias("reason"))


def incomplete_facts(facts: DataFrame) -> DataFrame:
    return facts.filter("subject = '' OR predicate = '' OR object = ''").select("fact_id", "statement", "subject", "predicate", "object")


def ambiguous_names(resolved: DataFrame) -> DataFrame:
    """(name, n_nodes) of endpoint names that several nodes answer to."""
    s = resolved.filter("source_nodes > 1").select(F.col("source_key").alias("name"), F.col("source_nodes").alias("n_nodes"))
    t = resolved.filter("target_nodes > 1").select(F.col("target_key").alias("name"), F.col("target_nodes").alias("n_nodes"))
    return s.unionByName(t).distinct()


def touches(edge_table: DataFrame, keys: DataFrame, side: str) -> DataFrame:
    """(id, edge columns): pinned ends touch their node, others every node that answers to the name."""
    cols = ("source_key", "type_key", "target_key")
    pinned = edge_table.filter(F.col(f"{side}_id").isNotNull()).select(F.col(f"{side}_id").alias("id"), *cols)
    loose = edge_table.filter(F.col(f"{side}_id").isNull()).join(keys.toDF("id", f"{side}_key"), f"{side}_key").select("id", *cols)
    return pinned.unionByName(loose)


def degrees(node_table: DataFrame, edge_table: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, n_out, n_in) of every node; self loops count on both sides."""
    out = touches(edge_table, keys, "source").groupBy("id").agg(F.count("*").alias("n_out"))
    inn = touches(edge_table, keys, "target").groupBy("id").agg(F.count("*").alias("n_in"))
    return node_table.select("id").join(out, "id", "left").join(inn, "id", "left").select("id", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"))


def neighbors(edge_table: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, neighbor_id): nodes joined by an edge in either direction, each once."""
    cols = ["source_key", "type_key", "target_key"]
    s, t = touches(edge_table, keys, "source"), touches(edge_table, keys, "target").withColumnRenamed("id", "neighbor_id")
    one = s.join(t, cols).select("id", "neighbor_id")
    return one.unionByName(one.select(F.col("neighbor_id").alias("id"), F.col("id").alias("neighbor_id"))).distinct()


def layout_key(node_table: DataFrame, source: str = "", version: str = "1") -> DataFrame:
    """One row: a key of the node ids, for saved layouts. Built from a digest per node, combined in order of 4096 parts."""
    part = F.pmod(F.xxhash64("id"), F.lit(4096))
    parts = node_table.select("id", part.alias("p")).groupBy("p").agg(F.sum(F.conv(F.left(F.sha1(F.col("id").cast("binary")), F.lit(12)), 16, 10).cast("decimal(20,0)")).alias("s"), F.count("*").alias("n"))
    line = F.concat_ws(":", "p", "s", "n")
    whole = F.array_join(F.array_sort(F.collect_list(line)), "\n")
    return parts.agg(F.left(F.sha1(F.concat_ws("\n", F.lit(version), F.lit(source), whole).cast("binary")), F.lit(16)).alias("layout_key"))
