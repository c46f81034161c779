"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.llm.storage import discard, written


def connected(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of the edges ``(a, b)``; ``root`` is the smallest node of its component. The result is a written table.

    Each round links every node to the smallest node that it or a neighbour knows, until nothing changes: about
    log(nodes) rounds. A round reads a written table, so a lost executor costs that round at most.
    """
    near = Window.partitionBy("u")
    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == mark or seen[0] == 0:
            break
        mark = seen
        # Large star: every larger neighbour of u points to the smallest around u.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.select("u", "v", F.least("u", F.min("v").over(near)).alias("m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours point to the smallest of them.
        least = large.select("u", "v", F.min("v").over(near).alias("m"))
        small = least.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        after = written(small.where("u != v").distinct(), "links")
        discard(now)
        now = after
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = written(roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct(), "components")
    discard(now)
    return out
