"""Connected components by alternating large and small stars, in tables of links.

Each round is two aggregations and two joins over the links; nothing is collected. A hub's links are
pre-aggregated before the shuffle and its join partition is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.session import settle


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node on the smallest of them."""
    if large:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    near = both.join(low, "u")
    if large:
        moved = near.filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        moved = near.select(F.col("v").alias("u"), F.col("low").alias("v")).union(low.select("u", F.col("low").alias("v")))
    return moved.filter("u <> v").distinct()


def connected_components(links: DataFrame, name: str = "links") -> DataFrame:
    """``(node, component)`` for every node of the links ``(u, v)``; component is its smallest node.

    Links with a null end or to itself are left out. No link gives no row.
    """
    links = settle(links.filter("u <> v").select("u", "v").distinct(), name)
    state = None
    while True:
        links = settle(_stars(_stars(links, large=True), large=False), name)
        sums = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if sums == state:
            break
        state = sums
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
