"""Command line: one input (diagram file, knowledge base JSON, graph JSON or saved key), counts, JSON or a check.

Exit codes: 0 fine, 2 an input that cannot be used, 3 a saved key that cannot be loaded.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.encoding import decode
from quillmill.operators import graph as G
from quillmill.sources import diagram, store


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillmill", description="Read one graph source and print its counts or JSON.")
    one = p.add_mutually_exclusive_group(required=True)
    one.add_argument("--lw", help="diagram source")
    one.add_argument("--kb", help="knowledge base JSON")
    one.add_argument("--graph-json", help="graph JSON")
    one.add_argument("--load", help="key of a saved graph")
    p.add_argument("--store", default="quillmill-store", help="folder of saved tables")
    p.add_argument("--save", help="save the graph under this key")
    p.add_argument("--check", action="store_true", help="only counts")
    p.add_argument("--json", action="store_true", help="the graph as JSON")
    p.add_argument("--quiet", action="store_true")
    return p


def _diagram(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    if not path.lower().endswith(".lw"):
        raise store.StoreError(f"not a .lw file: {path}")
    try:
        with open(path, "rb") as f:
            text = decode(f.read(), diagram=True).text
    except OSError as e:
        raise store.StoreError(str(e)) from e
    rows = diagram.parse_diagrams(spark.createDataFrame([(path, text)], "path string, text string"), "path", "text").cache()
    if bad := rows.filter("kind = 'error'").first():
        raise store.StoreError(f"{path}:{bad.line}:{bad.column}: {bad.label}")
    n, e = diagram.diagram_nodes(rows, "path"), diagram.diagram_edges(rows, "path")
    return n.select("id", F.lit("lw").alias("kind"), "title", "aliases"), e.select("source", "target", "type", F.lit("relation").alias("kind"))


def _knowledge(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    t = store.read_knowledge_json(spark, path)
    from quillmill.functions.names import knowledge_id, match_key_col

    def named(kind: str, df: DataFrame) -> DataFrame:
        blank = F.coalesce("name", F.lit(""))
        return df.select(F.col("ord").alias("item_id"), F.lit(kind).alias("kind"), blank.alias("name"), match_key_col("name").alias("key"), F.coalesce("id", knowledge_id(F.lit(kind), blank)).alias("id"), F.coalesce("type", F.lit("other")).alias("type"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "sources")

    view = named("entity", t["entities"]).unionByName(named("concept", t["concepts"]))
    rel = t["relations"].select(F.col("ord").alias("edge_id"), "source", "target", F.coalesce("type", F.lit("")).alias("type"), F.coalesce("description", F.lit("")).alias("description"), "sources")
    e = lambda c: F.coalesce(c, F.lit(""))
    facts = t["facts"].select(F.col("ord").alias("fact_id"), "statement", e("subject").alias("subject"), e("predicate").alias("predicate"), e("object").alias("object"), "sources")
    edges = G.edges(G.resolve(G.links_of(rel, facts), G.name_index(G.node_keys(view))))
    return G.nodes(view).select("id", "kind", "title", F.array().cast("array<string>").alias("aliases")), edges.select("source", "target", "type", "kind")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = build_parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    tables = store.TableStore(spark, a.store)
    try:
        if a.lw:
            nodes, edges = _diagram(spark, a.lw)
        elif a.kb:
            nodes, edges = _knowledge(spark, a.kb)
        elif a.graph_json:
            nodes, edges = (x.drop("ord") for x in store.read_graph_json(spark, a.graph_json))
        else:
            nodes, edges = tables.load_graph(a.load)
    except (store.StoreError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 3 if a.load else 2
    if a.save:
        tables.save_graph(nodes, edges, a.save)
    if a.json:
        print(json.dumps(store.graph_payload(nodes, edges), ensure_ascii=False))
    elif a.check or not a.quiet:
        print(f"nodes: {nodes.count()}\nedges: {edges.count()}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
