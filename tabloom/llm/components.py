"""Connected components of an undirected link table by alternating large and small stars.

Every round is a few equi-joins on link rows; no component is gathered anywhere. A round ends in
a table below the shared folder, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.support import stage_table


def _mark(links: DataFrame):
    row = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
    return row["n"], row["x"]


def smallest_reachable(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, component: the smallest node reachable, for every node that has a smaller one.

    Null ends and loops are no links.
    """
    x, y = F.col(a), F.col(b)
    links = links.filter(x != y).select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")).distinct()
    links = stage_table(links, "links")
    mark = _mark(links)
    while mark[0]:
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            links.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi")
        small = low.select("hi", F.col("m").alias("lo")).unionByName(
            small.filter("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        )
        links = stage_table(small.distinct(), "links")
        mark, old = _mark(links), mark
        if mark == old:
            break
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
