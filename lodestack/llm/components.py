"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import drop_stored, stored


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of links; root is the smallest node it is connected with.

    Alternates large-star and small-star steps (Kiveris et al., 2014): the number of links
    never grows, and a component of n nodes becomes a star in about log2(n)^2 rounds at worst.
    Every round is two aggregations with map-side combine and two equi-joins whose skew adaptive
    execution can split; it ends in a table in the shared folder. The driver sees two numbers a round.
    """
    now = _directed(links.select(F.col(a).alias("u"), F.col(b).alias("v")))
    table, mark = _kept(now, 0)
    rounds = 0
    while mark[0]:
        rounds += 1
        both = table.unionAll(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _directed(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select("u", F.col("m").alias("v")).unionAll(joined.select(F.col("v").alias("u"), F.col("m").alias("v")))
        before, was = table, mark
        table, mark = _kept(_directed(small), rounds)
        drop_stored(before)
        if mark == was:
            break
    return table.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        table.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _directed(links: DataFrame) -> DataFrame:
    """Each link once, from its larger node u to its smaller node v."""
    return links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _kept(links: DataFrame, n: int) -> tuple[DataFrame, tuple]:
    table = stored(links, f"links-{n}")
    mark = table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return table, tuple(mark)
