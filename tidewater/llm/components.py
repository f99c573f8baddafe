"""Connected components of a graph given as an edge table, by alternating large and small stars.

Every round rewrites the edges by joins and minima only, so no component is ever in one task or on the driver; a node
with very many neighbours is a hot key of an inner join, which AQE splits. Each round's edges are written to the shared
folder. Rounds grow with the logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def _mark(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
    return r["n"], r["x"]


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for all nodes of ``edges`` (u, v: long). Loops and repeated edges are allowed."""
    e = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _mark(e)
    while before[0]:
        both = e.union(e.select("v", "u")).toDF("a", "b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        star = written(both.join(least, "a").filter("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct())
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        rest = star.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(rest.union(low).distinct())
        after = _mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
