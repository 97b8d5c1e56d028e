"""Connected components of a graph given as edges, by contracting stars: every round joins edges to the least neighbour of an end, and no neighbour list is ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablewright.sources.scratch import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (u, v): the least node that can be reached. Nodes of any orderable type; loops and repeated edges don't matter, nulls are left out.

    A large star hands the least of a node's neighbourhood to its greater neighbours, a small star to its lesser ones; both keep what is connected. Rounds grow with the logarithm of the
    longest path; each is written down.
    """
    now = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = cut(now)
    state = _state(now)
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        lesser = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lesser, "u").select("u", "v", "m")
        now = cut(small.select(F.inline(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))).filter("u <> v").distinct())
        before, state = state, _state(now)
        if before == state:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
