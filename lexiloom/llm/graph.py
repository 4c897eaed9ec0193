"""Connected components by alternating large-star and small-star steps.

Each step is an aggregate (with partial results in the map tasks) and a join of two tables, so a
node with very many links is split over tasks. The number of steps grows with the logarithm of the
number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import dropped, saved


def _starred(links: DataFrame, ends: DataFrame) -> DataFrame:
    """Each (u, v) of ``ends`` with m, the least node among u and its neighbours in ``links``."""
    least = saved(links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return ends.join(least, "u")


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for each node of ``pairs`` (a, b), long ids; root is the least node it is connected to.

    Pairs may be repeated, in either order, or join a node to itself. No pairs give no row.
    """
    down = F.least("a", "b"), F.greatest("a", "b")
    links = saved(pairs.select(down[1].alias("u"), down[0].alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: neighbours above u move to the least neighbour of u.
        moved = _starred(both, links.select(F.col("v").alias("u"), F.col("u").alias("v"))).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = saved(moved.where("u <> v").distinct())
        # Small star: u and its neighbours below move to the least of these.
        below = _starred(large, large)
        moved = below.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("l")).select("l.u", "l.v")
        new = saved(moved.where("u <> v").distinct())
        dropped(links, large)
        links = new
        mark = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.expr("u % 1000003 - v % 1000003"))).first()
        if mark == state:
            break
        state = mark
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
