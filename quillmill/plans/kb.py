"""The knowledge base of a data directory, made once per query from its tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators import documents as D
from quillmill.operators import graph as G
from quillmill.operators import knowledge as K
from quillmill.operators import wiki as W
from quillmill.session import cut, table


class KnowledgeBase:
    """Views of one directory; results that several steps read are cut."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    @cached_property
    def items(self) -> DataFrame:
        return K.items_view(self.table("items"))

    @cached_property
    def facts(self) -> DataFrame:
        return K.facts_view(self.table("facts"))

    @cached_property
    def relations(self) -> DataFrame:
        return K.relations_view(self.table("edges"))

    @cached_property
    def groups(self) -> DataFrame:
        return cut(K.merge_groups(self.items, self.table("verdicts")))

    @cached_property
    def merged(self) -> DataFrame:
        return K.merged_items(self.items, self.groups)

    @cached_property
    def names(self) -> DataFrame:
        return K.name_map(self.items, self.groups, self.merged)

    @cached_property
    def keys(self) -> DataFrame:
        return G.node_keys(self.items)

    @cached_property
    def nodes(self) -> DataFrame:
        return G.nodes(self.items)

    @cached_property
    def resolved(self) -> DataFrame:
        return cut(G.resolve(G.links_of(self.relations, self.facts), G.name_index(self.keys)))

    @cached_property
    def edges(self) -> DataFrame:
        return cut(G.edges(self.resolved))

    @cached_property
    def page_paths(self) -> DataFrame:
        return W.page_paths(W.page_targets(self.items))

    @cached_property
    def rendered(self) -> DataFrame:
        """The pages for one reader."""
        return W.render_pages(self.items, self.nodes, self.facts, self.relations)

    @cached_property
    def pages(self) -> DataFrame:
        return cut(self.rendered)

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @cached_property
    def sections(self) -> DataFrame:
        """Section rows of all documents by format."""
        d = self.documents.select("doc_id", "doc_format", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))
        return D.with_section_ids(D.build_sections(d, "doc_id", "doc_format", "title", "text"), "doc_id")
