"""Connected components of an edge table, by alternating big-star and small-star steps.

Edges stay distributed and every step is a grouped minimum and a join, so a hub with a third of all edges is
pre-aggregated within each partition and its join can be split. The number of steps grows with the logarithm of the
number of nodes at most; after each step the edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): each node of `edges` with the least node that it reaches. Loops and repeats are harmless."""
    now = written(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct(), "edges")
    before = None
    while True:
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before or mark[0] == 0:
            break
        before = mark
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        big = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        down = big.groupBy("b").agg(F.min("a").alias("m"))
        small = big.join(down, "b").select(F.col("m").alias("x"), "a", "b")
        small = small.select(F.col("x").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct()
        now = written(small, "edges")
    roots = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
