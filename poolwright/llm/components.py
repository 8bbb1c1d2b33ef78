"""Connected components of links, by alternating stars.

Large stars: every node sends its larger neighbours to its smallest one. Small
stars: every node sends its smaller neighbours, and itself, to the smallest. When
nothing changes, each component is a star around its smallest node. Every step is a
minimum per node and an equality join, and is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from poolwright.session import drop, materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """(a, b) pairs of longs to (node, comp): the smallest node that can be reached. Nodes without links are absent."""
    edges = materialize(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        drop(large, edges)
        edges, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return roots.unionByName(roots.select(F.col("comp").alias("node"), "comp").distinct())
