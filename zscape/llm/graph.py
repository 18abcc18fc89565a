"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, evenly_joined, scratch, stored


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``(node, component)`` for every node of ``edges(src, dst)``; component is the smallest node.

    Each round joins a node's neighbours to the smallest node near it, once upwards and once
    downwards, until nothing changes; the number of rounds grows with the logarithm of a
    component's diameter. A round is two grouped minima (summed before the shuffle, so that a hub
    sends one row from each task) and two equi-joins that deal out the edges of a hub; it is written,
    and the round before it deleted. Null ends and loops carry no link and are left out; repeated
    edges count once; no edges give no rows.
    """
    spark = edges.sparkSession
    path = scratch(spark, "edges")
    e = stored(edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct(), path)
    state = lambda: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    now, seen = state(), None
    for _ in range(max_rounds):
        if now == seen or not now[0]:
            break
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        up = both.where(F.col("b") > F.col("a"))
        large = evenly_joined(up, near.select("a", F.least("a", "m").alias("m")), "a", near.select("a", "n"), F.xxhash64("b"), rows=2 * now[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        near = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        down = evenly_joined(large, near.select("a", "m"), "a", near.select("a", "n"), F.xxhash64("b"), rows=now[0])
        small = down.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(near.select("a", "m")).distinct()
        before, path = path, scratch(spark, "edges")
        e = stored(small, path)
        discard(spark, before)
        now, seen = state(), now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
