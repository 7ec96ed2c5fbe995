"""Connected components of a link table by alternating large-star and small-star steps.

Each step is a grouped minimum (combined before the shuffle) and a join back, which adaptive
execution splits where one node has very many links.  Tables are staged, so no lineage grows and a
lost executor costs one step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import stage


def _star(links: DataFrame, large: bool) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    out = (both.where("v > u") if large else near).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of *links* (u, v); the component is its smallest node.

    Nulls and loops are ignored; an empty table gives an empty result.
    """
    now = stage(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    for _ in range(most_rounds):
        # done when every node has one link, to a node that is linked to nothing smaller
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
            now.select(F.col("v").alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b"))
        )
        if ends.groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a > 1 OR a > 0 AND b > 0").isEmpty():
            break
        now = stage(_star(_star(now, True), False).distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
