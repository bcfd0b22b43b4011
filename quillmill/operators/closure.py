"""Transitive closure of links: smallest id per connected group.

Every round each vertex takes the smallest label among itself and its neighbours and then follows that label's own
label once (pointer jumping), so chains halve. Rounds are cut with ``checkpoint()``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.session import cut


def components(links: DataFrame) -> DataFrame:
    """(id, group_id) of every vertex of the links (a, b); null and self links are ignored."""
    clean = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = cut(clean.select("a", "b").unionByName(clean.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("group_id")))
    while True:
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("group_id").alias("_near"))
        low = label.join(near, "id").select("id", F.col("group_id").alias("_was"), F.least("group_id", "_near").alias("_low"))
        jump = label.toDF("_low", "_jump")
        now = cut(low.join(jump, "_low", "left").select("id", "_was", F.least("_low", F.coalesce("_jump", "_low")).alias("group_id")))
        label = now.select("id", "group_id")
        if now.filter("_was <> group_id").isEmpty():
            return label
