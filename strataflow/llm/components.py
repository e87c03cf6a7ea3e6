"""Connected components of an edge table, in rounds of joins; no vertex or component is gathered anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm import scratch


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, comp) with comp the least id that is reachable, for every id of ``edges`` (a, b).

    Rounds of large-star and small-star: every vertex hands the least of its neighbours to its larger
    ones, then to its smaller ones, until all edges point to the least vertex of their component. Self
    loops and repeated edges do no harm; ids are not null.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = scratch.write(edges, "cc-edges")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    seen, rows = None, edges.count()
    for _ in range(rounds):
        # large-star: every larger neighbour of a vertex goes to the least of its neighbours and itself
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = edges.join(least.withColumnRenamed("a", "b"), "b").select("a", F.col("m").alias("b")).where("a <> b").distinct()
        # the vertex itself keeps its link to the least one
        own = least.where("m <> a").select("a", F.col("m").alias("b"))
        large = scratch.write(large.unionByName(own).distinct(), "cc-large", 2 * rows)
        # small-star: the smaller neighbours of a vertex and itself go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = scratch.write(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "cc-small", 2 * rows)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen, rows = now, now[0]
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("comp")).unionByName(roots)
