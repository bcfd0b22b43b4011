"""Model answers to knowledge rows: tolerant JSON reading, contract checks, citation repair, duplicates.

The model itself is a callable given by the user (no service is part of this package); its answers are a table. All
checks are expressions over VARIANT and typed JSON; violations and repairs are rows, so nothing is lost silently.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.names import knowledge_id, normalize_name, relation_id
from quillmill.functions.text import strip

#: The four lists of the contract.
LISTS = ("entities", "concepts", "facts", "relations")
_SRC = "array<struct<section_id:string,page_number:string,quote:string>>"
_ITEM = f"struct<name:string,type:string,description:string,aliases:array<string>,statement:string,subject:string,predicate:string,object:string,source:string,target:string,sources:{_SRC}>"
_SCHEMA = "struct<" + ",".join(f"{k}:array<{_ITEM}>" for k in LISTS) + ">"


class Client(Protocol):
    def complete(self, *, system_prompt: str, user_prompt: str) -> str: ...


def _held(df: DataFrame) -> DataFrame:
    """The same rows behind a generator, so that later steps use the columns and do not repeat their expressions."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def ask_model(prompts: DataFrame, key: str, system_prompt: str, make_client: Callable[[], Client]) -> DataFrame:
    """(key, raw, error): one call per row, one client per partition. Store the result before using it twice."""
    kind = prompts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make_client()
        for b in batches:
            raw, err = [], []
            for p in b.column(1).to_pylist():
                try:
                    raw.append(client.complete(system_prompt=system_prompt, user_prompt=p or ""))
                    err.append(None)
                except Exception as e:  # the row carries the error
                    raw.append(None)
                    err.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.string()), pa.array(err, pa.string())], names=[key, "raw", "error"])

    return prompts.select(key, "prompt").mapInArrow(run, f"{key} {kind}, raw string, error string")


def read_answers(answers: DataFrame, key: str, raw: str = "raw") -> DataFrame:
    """(key, json, warning, error): code fences and text around the object are tolerated and reported."""
    t = strip(F.coalesce(F.col(raw), F.lit("")))
    bare = strip(F.regexp_replace(t, r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", ""))
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    ok = lambda c: F.try_parse_json(c)
    a = _held(answers.select(key, t.alias("_t"), bare.alias("_b"), inner.alias("_i")))
    a = _held(a.withColumn("json", F.when(ok(F.col("_b")).isNotNull(), F.col("_b")).when((F.col("_i") != "") & ok(F.col("_i")).isNotNull(), F.col("_i"))))
    shape = F.schema_of_variant(ok(F.col("json")))
    error = (
        F.when(F.col("_t") == "", "the answer is empty")
        .when(F.col("json").isNull(), "the answer is not valid JSON")
        .when(~shape.startswith("OBJECT"), "the answer must be a JSON object")
    )
    warning = F.concat_ws("; ", F.when(F.col("_b") != F.col("_t"), "stripped a code fence"), F.when(F.col("json") != F.col("_b"), "ignored text around the object"))
    a = _held(a.select(key, "json", warning.alias("_w"), error.alias("error")))
    return _held(a.select(key, F.when(F.col("error").isNull(), F.col("json")).alias("json"), F.nullif("_w", F.lit("")).alias("warning"), "error"))


def check_contract(read: DataFrame, key: str) -> DataFrame:
    """Adds to ``error``: missing lists, lists of a wrong type, elements that are no objects."""
    v = F.try_parse_json("json")
    kind = lambda k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
    missing = F.concat_ws(", ", *[F.when(F.col("json").isNotNull() & F.try_variant_get(v, f"$.{k}", "variant").isNull(), k) for k in LISTS])
    wrong = F.concat_ws(", ", *[F.when(F.try_variant_get(v, f"$.{k}", "variant").isNotNull() & ~kind(k).startswith("ARRAY"), k) for k in LISTS])
    odd = F.concat_ws(", ", *[F.when(kind(k).startswith("ARRAY") & ~kind(k).rlike(r"^ARRAY<(?:OBJECT|VOID)"), k) for k in LISTS])
    r = _held(read.select("*", missing.alias("_m"), wrong.alias("_w"), odd.alias("_o")))
    error = F.coalesce(
        "error", F.when(F.col("_m") != "", F.concat(F.lit("missing required field(s): "), "_m")), F.when(F.col("_w") != "", F.concat("_w", F.lit(" must be a list"))), F.when(F.col("_o") != "", F.concat("_o", F.lit(" must hold objects")))
    )
    r = _held(r.select(key, "json", "warning", error.alias("error")))
    return _held(r.select(key, F.when(F.col("error").isNull(), F.col("json")).alias("json"), "warning", "error"))


def payload_items(checked: DataFrame, key: str) -> DataFrame:
    """(key, list, index, item...) of every element of the four lists."""
    p = checked.filter("json IS NOT NULL").select(key, F.from_json("json", _SCHEMA).alias("p"))
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("list"), F.col(f"p.{k}").alias("items")) for k in LISTS])).alias("l")
    out = p.select(key, named).select(key, "l.list", F.posexplode("l.items").alias("index", "i"))
    text = lambda c: F.coalesce(strip(F.col(f"i.{c}")), F.lit(""))
    aliases = F.array_distinct(F.filter(F.transform(F.coalesce("i.aliases", F.array().cast("array<string>")), lambda a: strip(a)), lambda a: a.isNotNull() & (a != "")))
    cols = ("name", "type", "description", "statement", "subject", "predicate", "object", "source", "target")
    return out.select(key, "list", "index", *[text(c).alias(c) for c in cols], aliases.alias("aliases"), F.col("i.sources").alias("sources"))


def item_errors(items: DataFrame, key: str) -> DataFrame:
    """(key, list, index, error) of elements without their required text; one error rejects the whole answer."""
    need = F.when(F.col("list").isin("entities", "concepts") & (F.col("name") == ""), "name").when((F.col("list") == "facts") & (F.col("statement") == ""), "statement").when(
        (F.col("list") == "relations") & (F.col("source") == ""), "source").when((F.col("list") == "relations") & (F.col("target") == ""), "target")
    return items.withColumn("_f", need).filter("_f IS NOT NULL").select(key, "list", "index", F.concat("list", F.lit("["), F.col("index").cast("string"), F.lit("]: '"), "_f", F.lit("' must be a non-empty string")).alias("error"))


def accepted(items: DataFrame, errors: DataFrame, key: str) -> DataFrame:
    return items.join(errors.select(key).distinct(), key, "left_anti")


def with_ids(items: DataFrame) -> DataFrame:
    kind = F.when(F.col("list") == "entities", "entity").when(F.col("list") == "concepts", "concept").when(F.col("list") == "facts", "fact").otherwise("relation")
    named = knowledge_id(kind, F.when(F.col("list") == "facts", F.col("statement")).otherwise(F.col("name")))
    return items.withColumn("kind", kind).withColumn("id", F.when(F.col("list") == "relations", relation_id(F.col("source"), F.col("type"), F.col("target"))).otherwise(named))


def repair_sources(items: DataFrame, key: str, sections: DataFrame) -> DataFrame:
    """(key, list, index, pos, section_id, page_number, quote, note): unknown sections are dropped, the section's page wins.

    ``sections`` has (key, section_id, page_number).
    """
    s = items.select(key, "list", "index", F.posexplode("sources").alias("pos", "s"))
    page = F.col("s.page_number").try_cast("int")
    s = s.select(key, "list", "index", "pos", F.nullif(strip(F.col("s.section_id")), F.lit("")).alias("asked"), page.alias("claimed"), F.col("s.page_number").alias("raw_page"), F.coalesce(strip(F.col("s.quote")), F.lit("")).alias("quote"))
    known = sections.groupBy(key, "section_id").agg(F.max("page_number").alias("section_page"))
    pages = sections.filter("page_number IS NOT NULL").select(key, F.col("page_number").alias("claimed")).distinct().withColumn("_page_known", F.lit(True))
    paged = sections.filter("page_number IS NOT NULL").select(key).distinct().withColumn("_paged", F.lit(True))
    j = s.join(known.withColumnRenamed("section_id", "asked").withColumn("_known", F.lit(True)), [key, "asked"], "left").join(pages, [key, "claimed"], "left").join(paged, key, "left")
    section = F.when(F.col("_known"), F.col("asked"))
    number = F.coalesce("section_page", F.when(F.col("_paged").isNotNull() & F.col("_page_known").isNull(), None).otherwise(F.col("claimed")))
    note = F.concat_ws(
        "; ", F.when(F.col("asked").isNotNull() & F.col("_known").isNull(), F.concat(F.lit("unknown section id '"), "asked", F.lit("' dropped"))),
        F.when(F.col("raw_page").isNotNull() & F.col("claimed").isNull(), "ignored invalid page_number"),
        F.when(F.col("section_page").isNotNull() & F.col("claimed").isNotNull() & (F.col("section_page") != F.col("claimed")), "the section page is used"),
        F.when(F.col("section_page").isNull() & F.col("_paged").isNotNull() & F.col("claimed").isNotNull() & F.col("_page_known").isNull(), F.concat(F.lit("unknown page number "), F.col("claimed").cast("string"), F.lit(" dropped"))),
    )
    return j.select(key, "list", "index", "pos", section.alias("section_id"), number.alias("page_number"), "quote", F.nullif(note, F.lit("")).alias("note"))


def resolve_endpoints(items: DataFrame, key: str) -> DataFrame:
    """(key, index, source, target, source_id, target_id) of relations: names registered entities first, the first wins."""
    named = items.filter("list IN ('entities', 'concepts')").select(key, normalize_name(F.col("name")).alias("n"), "id", F.when(F.col("list") == "entities", 0).otherwise(1).alias("r"), "index")
    first = named.groupBy(key, "n").agg(F.min(F.struct("r", "index", "id")).alias("_f")).select(key, "n", F.col("_f.id").alias("id"))
    r = items.filter("list = 'relations'").select(key, "index", "source", "target", "type")
    for side in ("source", "target"):
        r = r.withColumn("n", normalize_name(F.col(side))).join(first.withColumnRenamed("id", f"{side}_id"), [key, "n"], "left").drop("n")
    return r


def merge_duplicates(items: DataFrame, key: str) -> DataFrame:
    """(key, kind, id, first_index, n, description) of one document's items: same id is one item, the first description counts."""
    return items.groupBy(key, "kind", "id").agg(
        F.min("index").alias("first_index"), F.count("*").alias("n"), F.coalesce(F.min_by("description", F.when(F.col("description") != "", F.col("index"))), F.lit("")).alias("description")
    )


def duplicate_sources(repaired: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """(key, id, section_id, page_number, quote, ord): union of sources of merged items in order."""
    s = repaired.join(ids.select(key, "list", "index", "id"), [key, "list", "index"])
    g = s.groupBy(key, "id", "section_id", "page_number", "quote").agg(F.min(F.struct("index", "pos")).alias("_o"))
    return g.select(key, "id", "section_id", "page_number", "quote", F.row_number().over(Window.partitionBy(key, "id").orderBy("_o")).alias("ord"))


def item_counts(items: DataFrame, key: str) -> DataFrame:
    """(key, entities, concepts, facts, relations) per document."""
    return items.groupBy(key).agg(*[F.count_if(F.col("list") == k).alias(k) for k in LISTS])


def verdict_rows(answers: DataFrame, key: str, raw: str = "raw") -> DataFrame:
    """(key, same, reason, error) of judge answers: same is true or false, also as text; reason is text."""
    read = read_answers(answers, key, raw)
    v = F.try_parse_json("json")
    kind = F.schema_of_variant(F.try_variant_get(v, "$.same", "variant"))
    text = F.lower(strip(F.try_variant_get(v, "$.same", "string")))
    same = F.when(kind.isin("BOOLEAN", "STRING") & text.isin("true", "false"), text == "true")
    reason_kind = F.schema_of_variant(F.try_variant_get(v, "$.reason", "variant"))
    error = F.coalesce("error", F.when(same.isNull(), "'same' must be true or false"), F.when(F.try_variant_get(v, "$.reason", "variant").isNotNull() & ~reason_kind.isin("STRING", "VOID"), "'reason' must be a string"))
    return read.select(key, F.when(error.isNull(), same).alias("same"), F.coalesce(strip(F.try_variant_get(v, "$.reason", "string")), F.lit("")).alias("reason"), error.alias("error"))


def enforce(rows: DataFrame, policy: str = "skip", error: str = "error") -> DataFrame:
    """Rows without an error ('skip'), or the same rows where the first error ends the job ('raise')."""
    if policy == "skip":
        return rows.filter(F.col(error).isNull())
    if policy == "raise":
        return rows.filter(F.when(F.col(error).isNotNull(), F.raise_error(F.col(error)).cast("boolean")).otherwise(F.lit(True)))
    raise ValueError(f"unknown policy {policy!r}; expected 'skip' or 'raise'")


#: What a model is told; the user's own wording may be given instead.
SYSTEM_PROMPT = (
    "Read one document and return one JSON object with the lists entities, concepts, facts and relations and nothing else. Use only what the text says. "
    "Entities and concepts have name, description and aliases (entities also type), facts have statement, subject, predicate and object, relations have source, target, type and description. "
    "Every item has sources: section_id as shown in the text, page_number or null, and a short literal quote. Keep the language of the document. Empty lists stay empty."
)
JUDGE_PROMPT = 'Do the two descriptions mean the same thing? Answer with one JSON object: {"same": true or false, "reason": "short text"}. Different things with related names are not the same.'
MAX_QUOTES, MAX_QUOTE = 3, 200


def describe_item(name: Column, kind: Column, aliases: Column, sources: Column) -> Column:
    """Lines that describe an item to a judge: name, type, aliases and up to three quotes."""
    quotes = F.filter(F.transform(sources, lambda s: F.left(strip(F.coalesce(s["quote"], F.lit(""))), F.lit(MAX_QUOTE))), lambda q: q != "")
    named = F.filter(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: strip(a) != "")
    return F.concat_ws(
        "\n", F.concat(F.lit("name: "), name), F.when(F.coalesce(kind, F.lit("")) != "", F.concat(F.lit("type: "), kind)), F.when(F.size(named) > 0, F.concat(F.lit("aliases: "), F.array_join(named, ", "))),
        F.when(F.size(quotes) > 0, F.array_join(F.transform(F.slice(quotes, 1, MAX_QUOTES), lambda q: F.concat(F.lit("quote: "), q)), "\n")),
    )


def judge_prompts(pairs: DataFrame, names: DataFrame, view: DataFrame) -> DataFrame:
    """(kind, l, r, prompt) of candidate pairs of names; each pair is asked once, whatever the number of its items.

    ``names`` gives the item that stands for each key, ``view`` the items.
    """
    asked = pairs.select("kind", F.explode(F.array("l", "r")).alias("key"))
    told = names.select("kind", "key", "item_id").join(asked, ["kind", "key"], "left_semi").join(view.select("item_id", "name", "type", "aliases", "sources"), "item_id")
    told = told.select("kind", "key", describe_item(F.col("name"), F.when(F.col("kind") == "entity", F.col("type")), F.col("aliases"), F.coalesce("sources", F.array().cast(view.schema["sources"].dataType))).alias("text"))
    p = pairs.select("kind", "l", "r").distinct().join(told.toDF("kind", "l", "tl"), ["kind", "l"]).join(told.toDF("kind", "r", "tr"), ["kind", "r"])
    return p.select("kind", "l", "r", F.concat_ws("\n\n", F.concat(F.lit("kind: "), "kind"), F.concat(F.lit("A\n"), "tl"), F.concat(F.lit("B\n"), "tr")).alias("prompt"))
