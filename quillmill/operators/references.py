"""References to records that do not exist (yet, or any more).

Every change of existence and every reference is a signed delta on a key.

* ``current_orphans``: the sums of both kinds of deltas per key; keys with references and no row are the report. The
  counts are a table that ``add_counts`` carries on from batch to batch.
* ``orphan_references``: a reference is judged at the moment its row arrives. From the existence deltas alone the running
  count per key gives the *gaps* of each key, the times at which its count is zero. References meet the gaps of their key
  by an equi-join and are never sorted by time. Deltas are counted in two levels (days of a key, then inside a day), so
  that a key with many rows is not one task; gaps come in chunks of at most ``CHUNK``, so no group grows without
  bound; a key with many references is split by the skew join, because the gaps of one key are few.

Defined results: null and blank keys are no references; rows whose ``deleted_at`` is not after ``loaded_at`` and rows
without ``loaded_at`` never exist; a citing row without ``loaded_at`` is judged against the end of time and has a null
period; empty tables give empty reports; repeated deliveries of a citing row count once (the earliest); extra columns
are ignored because only named columns are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Space, tab, line breaks, no-break and ideographic space.
_OUTER = " \t\n\r\x0b\x0c 　"
_END_OF_TIME = "9999-12-31 00:00:00"
#: Gaps of one key in one row.
CHUNK = 64


def plain_key(c: Column) -> Column:
    """Key without case and outer spaces; null if blank."""
    return F.nullif(F.lower(F.btrim(c, F.lit(_OUTER))), F.lit(""))


def name_key(c: Column) -> Column:
    """Key without case, outer spaces and repeated spaces; null if blank."""
    return F.nullif(F.lower(F.btrim(F.regexp_replace(c, "(?U)\\s+", " "), F.lit(_OUTER))), F.lit(""))


def first_delivery(df: DataFrame, id_col: str, *cols: str | Column) -> DataFrame:
    """The earliest delivery of each id (ties: the smallest content); rows without id are left out."""
    d = F.min(F.struct(F.col("loaded_at").isNull().alias("_late"), F.col("loaded_at"), *cols)).alias("_d")
    return df.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("row_id")).agg(d).select("row_id", "_d.*").drop("_late")


def _source_refs(first: DataFrame, table: str) -> DataFrame:
    each = first.select("row_id", "loaded_at", F.posexplode("_sources").alias("_p", "_s"))
    field = F.explode(
        F.array(
            F.struct(F.lit("document_id").alias("field_name"), F.lit("d").alias("space"), plain_key(F.col("_s.document_id")).alias("key")),
            F.struct(F.lit("section_id").alias("field_name"), F.lit("s").alias("space"), plain_key(F.col("_s.section_id")).alias("key")),
        )
    ).alias("_f")
    return each.select("row_id", "loaded_at", (F.col("_p") + 1).alias("ref_pos"), field).select(
        F.lit(table).alias("ref_table"), "row_id", "_f.field_name", "ref_pos", "_f.space", "_f.key", "loaded_at"
    )


def _endpoint_refs(first: DataFrame) -> DataFrame:
    field = F.explode(
        F.array(*[F.struct(F.lit(c).alias("field_name"), name_key(F.col(c)).alias("key")) for c in ("source", "target")])
    ).alias("_f")
    return first.select("row_id", "loaded_at", field).select(
        F.lit("edges").alias("ref_table"), "row_id", "_f.field_name", F.lit(0).alias("ref_pos"), F.lit("n").alias("space"), "_f.key", "loaded_at"
    )


def references(items: DataFrame, facts: DataFrame, edges: DataFrame) -> DataFrame:
    """All references of the first deliveries: ref_table, row_id, field_name, ref_pos, space, key, loaded_at."""
    slim = F.transform("sources", lambda s: F.struct(s["document_id"].alias("document_id"), s["section_id"].alias("section_id"))).alias("_sources")
    e = first_delivery(edges, "edge_id", slim, "source", "target")
    parts = [
        _source_refs(first_delivery(items, "item_id", slim), "items"),
        _source_refs(first_delivery(facts, "fact_id", slim), "facts"),
        _source_refs(e, "edges"),
        _endpoint_refs(e),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.col("key").isNotNull())


def existence(documents: DataFrame, sections: DataFrame, items: DataFrame) -> DataFrame:
    """Lifetimes of keys: space, key, loaded_at, deleted_at; one row per row and name."""
    names = F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_n")
    life = ("loaded_at", "deleted_at")
    out = (
        documents.select(F.lit("d").alias("space"), plain_key(F.col("document_id")).alias("key"), *life)
        .unionByName(sections.select(F.lit("s").alias("space"), plain_key(F.col("section_id")).alias("key"), *life))
        .unionByName(items.select(names, *life).select(F.lit("n").alias("space"), name_key(F.col("_n")).alias("key"), *life))
    )
    alive = F.col("deleted_at").isNull() | (F.col("deleted_at") > F.col("loaded_at"))
    return out.filter(F.col("key").isNotNull() & F.col("loaded_at").isNotNull() & alive)


def deltas(lives: DataFrame) -> DataFrame:
    """Signed existence deltas: space, key, t, delta."""
    change = F.explode(
        F.array(
            F.struct(F.col("loaded_at").alias("t"), F.lit(1).cast("long").alias("delta")),
            F.struct(F.col("deleted_at").alias("t"), F.lit(-1).cast("long").alias("delta")),
        )
    ).alias("_c")
    return lives.select("space", "key", change).select("space", "key", "_c.t", "_c.delta").filter(F.col("t").isNotNull())


def gaps(lives: DataFrame) -> DataFrame:
    """(space, key, gaps, low, high): when no row with the key existed, in chunks that cover [low, high) of all time.

    A gap is struct(since, until), open-ended where null; every key that ever existed has at least the gap before its
    first row.
    """
    day = F.unix_date(F.to_date("t")).alias("day")
    each = ["space", "key", "day"]
    change = deltas(lives).select("space", "key", day, "t", "delta").repartition(*each).groupBy(*each, "t").agg(F.sum("delta").alias("delta"))
    in_day = Window.partitionBy(*each).orderBy("t")
    steps = change.select(*each, "t", F.sum("delta").over(in_day).alias("n"), F.lead("t").over(in_day).alias("next"))
    days = change.groupBy(*each).agg(F.sum("delta").alias("delta"), F.min("t").alias("first"))
    of_key = Window.partitionBy("space", "key").orderBy("day")
    days = days.select(*each, "first", F.sum("delta").over(of_key.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.lead("first").over(of_key).alias("next_day"))
    zero = steps.join(days, each).filter(F.col("n") + F.coalesce("before", F.lit(0)) == 0).select("space", "key", F.col("t").alias("since"), F.coalesce("next", "next_day").alias("until"))
    start = days.filter("before IS NULL").select("space", "key", F.lit(None).cast(lives.schema["loaded_at"].dataType).alias("since"), F.col("first").alias("until"))
    ordered = Window.partitionBy("space", "key").orderBy(F.asc_nulls_first("since"))
    lined = start.unionByName(zero).select("*", F.row_number().over(ordered).alias("n"), F.lead("since").over(ordered).alias("then"))
    chunk = F.floor((F.col("n") - 1) / CHUNK).alias("chunk")
    chunks = lined.groupBy("space", "key", chunk).agg(F.collect_list(F.struct("since", "until")).alias("gaps"), F.min_by("since", "n").alias("low"), F.max_by("then", "n").alias("high"))
    return chunks.drop("chunk")


def orphan_references(refs: DataFrame, lives: DataFrame) -> DataFrame:
    """References whose key did not exist when the citing row arrived; see the module text for the method."""
    t = F.coalesce("loaded_at", F.lit(_END_OF_TIME).cast(dict(refs.dtypes)["loaded_at"]))
    state = gaps(lives).toDF("_space", "_key", "gaps", "low", "high")
    meets = (F.col("space") == F.col("_space")) & (F.col("key") == F.col("_key")) & (F.col("low").isNull() | (F.col("t") >= F.col("low"))) & (F.col("high").isNull() | (F.col("t") < F.col("high")))
    met = refs.withColumn("t", t).join(state, meets, "left")
    missing = F.exists("gaps", lambda g: (g["since"].isNull() | (F.col("t") >= g["since"])) & (g["until"].isNull() | (F.col("t") < g["until"])))
    return met.filter(F.col("_key").isNull() | missing).select("ref_table", "row_id", "field_name", "ref_pos", F.date_format("loaded_at", "yyyy-MM").alias("period"))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan references per citing table, field and month."""
    return orphans.groupBy("ref_table", "field_name", "period").agg(F.count("*").alias("orphans"))


def signed_counts(refs: DataFrame | None, lives: DataFrame | None) -> DataFrame:
    """(space, key, n_refs, n_rows): signed counts of what is given, partial sums before the shuffle."""
    parts = []
    if refs is not None:
        parts.append(refs.select("space", "key", F.lit(1).cast("long").alias("n_refs"), F.lit(0).cast("long").alias("n_rows")))
    if lives is not None:
        parts.append(deltas(lives).select("space", "key", F.lit(0).cast("long").alias("n_refs"), F.col("delta").alias("n_rows")))
    return _summed(reduce(DataFrame.unionByName, parts))


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("space", "key").agg(F.sum("n_refs").alias("n_refs"), F.sum("n_rows").alias("n_rows"))


def add_counts(counts: DataFrame, change: DataFrame) -> DataFrame:
    """Maintained counts with the counts of one more batch; keys whose counts are both zero are left out."""
    return _summed(counts.unionByName(change)).filter("n_refs <> 0 OR n_rows <> 0")


def orphans_of(counts: DataFrame) -> DataFrame:
    """(space, key, n_refs) of the keys with references and no existing row."""
    return counts.filter("n_refs > 0 AND n_rows = 0").select("space", "key", "n_refs")


def current_orphans(refs: DataFrame, lives: DataFrame) -> DataFrame:
    """Keys with references now and no existing row now."""
    return orphans_of(signed_counts(refs, lives))
