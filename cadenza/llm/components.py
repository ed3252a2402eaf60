"""Connected components by alternating large-star and small-star steps, a union-find whose links stay in distributed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, rounds: int | None = None, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (u long, v long); component is the smallest node reachable. With rounds, so many
    are run and no more: nodes with one component are then connected, but connected nodes may still have different ones.

    Loops and repeated edges do no harm; nulls are dropped; no edges give no rows. Each round groups by node with partial
    aggregation and joins on it, so a node with very many links is summed up in parts and its join can be split. Rounds are
    written to the shared folder, the one before is deleted. Every third of a path is cut off in a round, so rounds grow
    with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    staged = common.Staged(spark, "components")
    clean = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = staged.write(clean, "edges")
    before = None
    for n in range(max_rounds):
        # Large star: neighbours above a node move to the smallest of it and its neighbours.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its neighbours below move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        moved = large.join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = moved.unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct()
        after = staged.write(small, "edges")
        staged.drop(now)
        now = after
        if n + 1 == rounds:
            both = now.unionByName(now.select(F.col("v").alias("u"), "v"))
            return staged.keep(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")))
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    return staged.keep(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
