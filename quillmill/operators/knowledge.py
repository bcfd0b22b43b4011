"""The knowledge base as tables, and the rules that merge items of one name.

Lists of the data model (aliases, sources, statements) are child tables with an explicit order, not arrays that grow
with a hot name: every group-by here has partial aggregation and no group is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.names import alias_keys_col, knowledge_id, match_key_col, relation_id, statement_key_col
from quillmill.functions.text import strip
from quillmill.operators.closure import components

OTHER = "other"
SOURCE = ("document_id", "section_id", "page_number", "quote")


def items_view(items: DataFrame) -> DataFrame:
    """(item_id, kind, name, key, id, type, description, aliases, sources), one row per item, in the order of item_id."""
    cols = ("kind", "name", "item_type", "description", "aliases", "sources")
    first = F.min(F.struct(F.col("loaded_at").isNull().alias("_l"), "loaded_at", *cols)).alias("_d")
    one = items.filter("item_id IS NOT NULL").groupBy("item_id").agg(first).select("item_id", *[f"_d.{c}" for c in cols])
    kind = F.coalesce("kind", F.lit("entity"))
    name = F.coalesce("name", F.lit(""))
    return one.select(
        "item_id", kind.alias("kind"), name.alias("name"), match_key_col("name").alias("key"), knowledge_id(kind, name).alias("id"),
        F.coalesce(F.nullif(strip(F.col("item_type")), F.lit("")), F.lit(OTHER)).alias("type"),
        F.coalesce("description", F.lit("")).alias("description"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "sources",
    )


def auto_merge_groups(view: DataFrame) -> DataFrame:
    """(kind, key, first_item, n) of the names that several items write with the same key."""
    g = view.filter("key <> ''").groupBy("kind", "key").agg(F.min("item_id").alias("first_item"), F.count("*").alias("n"))
    return g.filter("n > 1")


def _judged(view: DataFrame, verdicts: DataFrame) -> DataFrame:
    return verdicts.filter("same AND left_id IS NOT NULL AND right_id IS NOT NULL AND left_id <> right_id").select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))


def merge_groups(view: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(item_id, group_id): items of one kind are one if their keys agree or a verdict says so, directly or in a chain.

    A name's items are tied to its first item, so a hot name gives as many links as rows and not their square.
    """
    first = view.filter("key <> ''").groupBy("kind", "key").agg(F.min("item_id").alias("first_item"))
    tied = view.join(first, ["kind", "key"]).filter("first_item <> item_id").select(F.col("first_item").alias("a"), F.col("item_id").alias("b"))
    kinds = view.select("item_id", "kind")
    said = _judged(view, verdicts).join(kinds.toDF("a", "ka"), "a").join(kinds.toDF("b", "kb"), "b").filter("ka = kb").select("a", "b")
    comp = components(tied.unionByName(said))
    return view.select("item_id").join(comp.withColumnRenamed("id", "item_id"), "item_id", "left").select("item_id", F.coalesce("group_id", "item_id").alias("group_id"))


def _best(df: DataFrame, group: str, value: Column, *order: Column) -> DataFrame:
    """The value with the smallest order per group."""
    return df.groupBy(group).agg(F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], value.alias("v"))).alias("_b")).select(group, F.col("_b.v").alias("v"))


def canonical_names(view: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, canonical_name): the key with most items, then most sources, then the earliest; its first spelling."""
    v = view.join(groups, "item_id").filter("key <> ''")
    per = v.groupBy("group_id", "key").agg(
        F.count("*").alias("n"), F.sum(F.coalesce(F.size("sources"), F.lit(0))).alias("e"), F.min("item_id").alias("f"), F.min(F.struct("item_id", strip(F.col("name")).alias("s"))).alias("_s")
    )
    named = _best(per, "group_id", F.col("_s.s"), -F.col("n"), -F.col("e"), F.col("f")).withColumnRenamed("v", "canonical_name")
    bare = _best(view.join(groups, "item_id"), "group_id", F.col("name"), F.col("item_id"))
    return bare.join(named, "group_id", "left").select("group_id", F.coalesce("canonical_name", "v").alias("canonical_name"))


def merged_types(view: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, type): the most common type other than 'other', the earliest on a tie."""
    v = view.filter("kind = 'entity'").join(groups, "item_id")
    per = v.filter(F.col("type") != OTHER).groupBy("group_id", "type").agg(F.count("*").alias("n"), F.min("item_id").alias("f"))
    best = _best(per, "group_id", F.col("type"), -F.col("n"), F.col("f"))
    return v.select("group_id").distinct().join(best, "group_id", "left").select("group_id", F.coalesce("v", F.lit(OTHER)).alias("type"))


def merged_aliases(view: DataFrame, groups: DataFrame, names: DataFrame) -> DataFrame:
    """(group_id, alias, ord): every other spelling once per key, the earliest spelling first."""
    v = view.join(groups, "item_id").select("group_id", "item_id", F.posexplode(F.concat(F.array("name"), "aliases")).alias("p", "alias"))
    v = v.select("group_id", F.struct("item_id", "p").alias("at"), strip(F.col("alias")).alias("alias"), match_key_col("alias").alias("key")).filter("key <> '' AND alias <> ''")
    first = v.groupBy("group_id", "key").agg(F.min(F.struct("at", "alias")).alias("_f"))
    own = names.select("group_id", match_key_col("canonical_name").alias("key"))
    kept = first.join(own, ["group_id", "key"], "left_anti")
    return kept.select("group_id", F.col("_f.alias").alias("alias"), F.row_number().over(Window.partitionBy("group_id").orderBy("_f.at")).alias("ord"))


def merged_descriptions(view: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, description, ord): distinct descriptions by key, the earliest writing of each."""
    v = view.join(groups, "item_id").select("group_id", "item_id", strip(F.col("description")).alias("description"), match_key_col("description").alias("key")).filter("description <> ''")
    first = v.groupBy("group_id", "key").agg(F.min(F.struct("item_id", "description")).alias("_f"))
    return first.select("group_id", F.col("_f.description").alias("description"), F.row_number().over(Window.partitionBy("group_id").orderBy("_f.item_id")).alias("ord"))


def source_rows(df: DataFrame, owner: str, order: str, sources: str = "sources") -> DataFrame:
    """(owner, order, pos, document_id, section_id, page_number, quote) of every cited source."""
    s = df.select(owner, F.col(order).alias("_o"), F.posexplode(sources).alias("_p", "_s"))
    return s.select(owner, "_o", "_p", *[F.col(f"_s.{c}").alias(c) for c in SOURCE])


def merged_sources(view: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, document_id, section_id, page_number, quote, first_item): the union of sources, none is dropped."""
    rows = source_rows(view.join(groups, "item_id"), "group_id", "item_id")
    return rows.groupBy("group_id", *SOURCE).agg(F.min("_o").alias("first_item"))


def merged_items(view: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, kind, id, canonical_name, type, n_items): groups of one keep their id, others get that of their name."""
    names, types = canonical_names(view, groups), merged_types(view, groups)
    base = view.join(groups, "item_id").groupBy("group_id").agg(F.min_by("kind", "item_id").alias("kind"), F.min_by("id", "item_id").alias("own_id"), F.count("*").alias("n_items"))
    out = base.join(names, "group_id").join(types, "group_id", "left")
    made = knowledge_id(F.col("kind"), F.col("canonical_name"))
    return out.select("group_id", "kind", F.when(F.col("n_items") > 1, made).otherwise(F.col("own_id")).alias("id"), "canonical_name", F.when(F.col("kind") == "entity", F.col("type")).alias("type"), "n_items")


def name_map(view: DataFrame, groups: DataFrame, merged: DataFrame) -> DataFrame:
    """(key, canonical_name): of a key's groups concepts go before entities, then the earliest group."""
    keys = view.join(groups, "item_id").select("group_id", "kind", F.explode(alias_keys_col("name", "aliases")).alias("key")).distinct()
    k = keys.join(merged.select("group_id", "canonical_name"), "group_id")
    rank = F.when(F.col("kind") == "concept", 0).otherwise(1)
    return _best(k, "key", F.col("canonical_name"), rank, F.col("group_id")).withColumnRenamed("v", "canonical_name")


def facts_view(facts: DataFrame) -> DataFrame:
    """(fact_id, statement, subject, predicate, object, sources, key), one row per fact."""
    cols = ("statement", "fact_subject", "fact_predicate", "fact_object", "sources")
    first = F.min(F.struct(F.col("loaded_at").isNull().alias("_l"), "loaded_at", *cols)).alias("_d")
    one = facts.filter("fact_id IS NOT NULL").groupBy("fact_id").agg(first).select("fact_id", *[f"_d.{c}" for c in cols])
    blank = lambda c: F.coalesce(strip(F.col(c)), F.lit(""))
    return one.select("fact_id", F.coalesce("statement", F.lit("")).alias("statement"), blank("fact_subject").alias("subject"), blank("fact_predicate").alias("predicate"), blank("fact_object").alias("object"), "sources", statement_key_col("statement").alias("key"))


def distinct_facts(view: DataFrame) -> DataFrame:
    """(key, fact_id, statement, subject, predicate, object, n_facts, id): the first fact of each statement key is kept."""
    first = F.min(F.struct("fact_id", "statement", "subject", "predicate", "object")).alias("_f")
    g = view.withColumn("key", _fact_key()).groupBy("key").agg(first, F.count("*").alias("n_facts"))
    return g.select("key", "_f.*", "n_facts", knowledge_id(F.lit("fact"), F.col("_f.statement")).alias("id"))


def _fact_key() -> Column:
    return F.when(F.col("key") != "", F.col("key")).otherwise(knowledge_id(F.lit("fact"), F.col("statement")))


def merged_fact_sources(view: DataFrame) -> DataFrame:
    """(key, document_id, section_id, page_number, quote, first_fact): the union of sources of equal facts, none is dropped."""
    rows = source_rows(view.withColumn("key", _fact_key()), "key", "fact_id")
    return rows.groupBy("key", *SOURCE).agg(F.min("_o").alias("first_fact"))


def canonical_facts(facts: DataFrame, names: DataFrame) -> DataFrame:
    """Facts whose subject and object are the canonical names."""
    out = facts
    for c in ("subject", "object"):
        out = out.withColumn("_k", match_key_col(c)).join(names.toDF("_k", "_c"), "_k", "left").withColumn(c, F.coalesce("_c", c)).drop("_k", "_c")
    return out


def relations_view(edges: DataFrame, kind: str | None = "relation") -> DataFrame:
    """(edge_id, source, target, type, kind, description, sources, id) with both ends named, one row per edge."""
    cols = ("source", "target", "edge_type", "kind", "description", "sources")
    first = F.min(F.struct(F.col("loaded_at").isNull().alias("_l"), "loaded_at", *cols)).alias("_d")
    one = edges.filter("edge_id IS NOT NULL").groupBy("edge_id").agg(first).select("edge_id", *[f"_d.{c}" for c in cols])
    if kind is not None:
        one = one.filter(F.col("kind") == kind)
    t = lambda c: F.coalesce(strip(F.col(c)), F.lit(""))
    v = one.select("edge_id", t("source").alias("source"), t("target").alias("target"), t("edge_type").alias("type"), "kind", t("description").alias("description"), "sources")
    return v.filter("source <> '' AND target <> ''").withColumn("id", relation_id(F.col("source"), F.col("type"), F.col("target")))


ENDS = ("source_key", "type_key", "target_key")


def canonical_relations(view: DataFrame, names: DataFrame) -> DataFrame:
    """Relations between canonical names, with the keys of both ends and of the type."""
    out = view
    for c in ("source", "target"):
        out = out.withColumn("_k", match_key_col(c)).join(names.select(F.col("key").alias("_k"), F.col("canonical_name").alias("_c")), "_k", "left").withColumn(c, F.coalesce("_c", c)).drop("_k", "_c")
    return out.select("*", match_key_col("source").alias("source_key"), match_key_col("type").alias("type_key"), match_key_col("target").alias("target_key"))


def distinct_relations(view: DataFrame, names: DataFrame) -> DataFrame:
    """(source_key, type_key, target_key, edge_id, source, type, target, n_relations) after canonical naming."""
    first = F.min(F.struct("edge_id", "source", "type", "target")).alias("_f")
    return canonical_relations(view, names).groupBy(*ENDS).agg(first, F.count("*").alias("n_relations")).select(*ENDS, "_f.*", "n_relations")


def ids_by_key(view: DataFrame, groups: DataFrame, merged: DataFrame) -> DataFrame:
    """(key, id): the merged object that a key stands for; of a key's groups entities go first, then the earliest group."""
    keys = view.join(groups, "item_id").select("group_id", F.explode(alias_keys_col("name", "aliases")).alias("key")).distinct()
    k = keys.join(merged.select("group_id", "kind", "id"), "group_id")
    return _best(k, "key", F.col("id"), F.when(F.col("kind") == "concept", 1).otherwise(0), F.col("group_id")).withColumnRenamed("v", "id")


def with_end_ids(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct relations with the ids of the objects at their ends, null where no object answers to the key."""
    out = relations
    for side in ("source", "target"):
        out = out.join(ids.select(F.col("key").alias(f"{side}_key"), F.col("id").alias(f"{side}_id")), f"{side}_key", "left")
    return out


def merged_relation_sources(view: DataFrame, names: DataFrame) -> DataFrame:
    """(source_key, type_key, target_key, document_id, section_id, page_number, quote, first_edge): the union of sources."""
    c = canonical_relations(view, names).select(*ENDS, "edge_id", F.explode("sources").alias("_s"))
    return c.select(*ENDS, "edge_id", *[F.col(f"_s.{x}").alias(x) for x in SOURCE]).groupBy(*ENDS, *SOURCE).agg(F.min("edge_id").alias("first_edge"))


def merged_relation_descriptions(view: DataFrame, names: DataFrame) -> DataFrame:
    """(source_key, type_key, target_key, description, ord): distinct descriptions by key, the earliest writing of each."""
    c = canonical_relations(view, names).filter("description <> ''").select(*ENDS, "edge_id", "description", match_key_col("description").alias("_k"))
    first = c.groupBy(*ENDS, "_k").agg(F.min(F.struct("edge_id", "description")).alias("_f"))
    return first.select(*ENDS, F.col("_f.description").alias("description"), F.row_number().over(Window.partitionBy(*ENDS).orderBy("_f.edge_id")).alias("ord"))


def merge_report(view: DataFrame, groups: DataFrame, merged: DataFrame) -> DataFrame:
    """(kind, canonical_name, n_items, method) of every group of several items; method tells what joined them."""
    keys = view.join(groups, "item_id").groupBy("group_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    m = merged.filter("n_items > 1").join(keys, "group_id")
    return m.select("group_id", "kind", "canonical_name", "n_items", F.when(F.col("lo") == F.col("hi"), "normalized-name").otherwise("judge").alias("method"))


def merge_summary(view: DataFrame, groups: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(name, n): items, groups, merges, judged pairs (in either order, once), pairs judged the same, failed verdicts."""
    g = groups.groupBy("group_id").agg(F.count("*").alias("k")).agg(F.count("*").alias("groups"), F.count_if(F.col("k") > 1).alias("merges"))
    pair = F.struct(F.least("left_id", "right_id"), F.greatest("left_id", "right_id"))
    asked = verdicts.filter("left_id IS NOT NULL AND right_id IS NOT NULL AND left_id <> right_id AND same IS NOT NULL").groupBy(pair.alias("p")).agg(F.max("same").alias("same"))
    j = asked.agg(F.count("*").alias("judged_pairs"), F.count_if("same").alias("judged_same"))
    f = verdicts.agg(F.count_if(F.col("error").isNotNull()).alias("judge_failures"))
    one = F.lit(1).alias("_j")
    whole = view.agg(F.count("*").alias("items")).select(one, "*")
    for part in (g, j, f):
        whole = whole.join(part.select(one, "*"), "_j")
    return whole.drop("_j").unpivot([], ["items", "groups", "merges", "judged_pairs", "judged_same", "judge_failures"], "name", "n")
