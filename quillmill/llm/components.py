"""Consolidating pairwise matches into groups (connected components by seed-tree pruning).

Each round every vertex tells its neighbourhood (and itself) the smallest id it sees. A vertex that nobody names as
smallest is pruned: it leaves the graph and hangs under the smallest id it was told of, in a propagation forest. The
ids a vertex was told of stay connected through the smallest of them. The graph shrinks geometrically; what remains of
a component is its smallest id, the seed. Seed ids then flow down the forest, from the last round to the first.

Rounds are cut with ``checkpoint()`` in the shared folder, so executors may be lost. Nothing is collected: only the
emptiness of the next graph is asked for. Joins on a hub vertex put the many rows on one side only, which adaptive
skew joins split; group-bys have partial aggregation.

Defined results: null ids, pairs of an id with itself and repeated pairs are ignored; an empty table gives no rows;
extra columns are ignored. Ids may be of any ordered type; the group id is the smallest id of the group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.session import cut


def linked_pairs(df: DataFrame, left: str, right: str, where: Column | None = None) -> DataFrame:
    """Distinct undirected links (a < b)."""
    keep = F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right))
    if where is not None:
        keep = keep & where
    return df.filter(keep).select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).distinct()


def _prune_round(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(told, lowest): who was told of which minima, and per vertex the smallest and whether it was named itself."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    told = cut(both.join(least, "u").select(F.col("v").alias("u"), "m").unionByName(least.select("u", "m")).distinct())
    lowest = told.groupBy("u").agg(F.min("m").alias("low"), F.max(F.col("u") == F.col("m")).alias("named"))
    return told, lowest


def components(links: DataFrame) -> DataFrame:
    """(id, group_id) of every vertex of ``links`` (columns a, b); group_id is the smallest id of the component."""
    graph = cut(links.select("a", "b").filter("a <> b").distinct())
    everyone = graph.select(F.col("a").alias("id")).unionByName(graph.select(F.col("b").alias("id"))).distinct()
    forest: list[DataFrame] = []
    now = graph
    while not now.isEmpty():
        told, lowest = _prune_round(now)
        forest.append(cut(lowest.filter(~F.col("named")).select(F.col("u").alias("child"), F.col("low").alias("parent"))))
        now = cut(
            told.join(lowest.select("u", "low"), "u")
            .filter("m <> low")
            .select(F.least("m", "low").alias("a"), F.greatest("m", "low").alias("b"))
            .distinct()
        )
    if not forest:
        return everyone.select("id", F.col("id").alias("group_id"))
    known = forest[-1].select(F.col("child").alias("id"), F.col("parent").alias("group_id"))
    for trees in reversed(forest[:-1]):
        up = trees.join(known.withColumnRenamed("id", "parent"), "parent", "left")
        # only the new level is written; the levels before stay as they are
        known = known.unionByName(cut(up.select(F.col("child").alias("id"), F.coalesce("group_id", "parent").alias("group_id"))))
    return everyone.join(known, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))


def groups_of(pairs: list[DataFrame]) -> DataFrame:
    """Components over several link tables of columns a, b."""
    return components(reduce(DataFrame.unionByName, pairs))
