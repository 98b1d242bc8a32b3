"""Connected components by alternating star contraction, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written


def _large_star(edges: DataFrame) -> DataFrame:
    """Hangs each node's larger neighbours under the smallest of its neighbourhood."""
    both = edges.select(F.col("v").alias("w"), F.col("u").alias("x")).union(edges.select(F.col("u").alias("w"), F.col("v").alias("x")))
    least = both.groupBy("w").agg(F.min("x").alias("m")).select("w", F.least("w", "m").alias("m"))
    return edges.join(least, edges.v == least.w).select("u", F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hangs each node and its smaller neighbours under the smallest of those."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of `links` (src, dst) but the components' own smallest nodes.

    Nodes may be of any type that orders. Loops, repeated links and either direction are
    fine; null ends are dropped; no links give no rows. Each round is written to the
    shared folder, so no round is computed twice. Hubs with any number of links are met
    by partial minima and by joins whose large partitions Spark splits.
    """
    a, b = F.col("src"), F.col("dst")
    held = Written(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    state = _state(held.df)
    while state[0]:
        following = Written(_small_star(_large_star(held.df)), "links")
        now = _state(following.df)
        held.drop()
        held = following
        if now == state:
            break
        state = now
    return held.df.select(F.col("u").alias("node"), F.col("v").alias("component"))
