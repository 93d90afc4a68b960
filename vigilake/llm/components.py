"""Connected components of a link table, by alternating stars; nothing is gathered on the driver.

Each round rewires every node to the smallest neighbour it knows (large star: larger neighbours; small
star: smaller ones) until each component is a star around its smallest id.  A round is two grouped minima
and two equi-joins on the link table.  A hub's links meet in a join whose other side has one row per node,
so adaptive execution splits it; minima are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    rest = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).unionByName(rest).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b) of ids -> (node, component): the smallest id reachable, for every node with a link.

    Self links and repeated links are ignored; rows with a null end are ignored; no links give no rows.
    """
    now = scratch.save(edges.select("a", "b").filter("a <> b").distinct())
    mark = None
    for _ in range(max_rounds):
        then = scratch.save(_small_star(_large_star(now)))
        scratch.drop(now)
        now = then
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
    else:
        raise RuntimeError(f"links did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
