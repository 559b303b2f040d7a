"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm._store import discard, stage


def _star(pairs: DataFrame) -> DataFrame:
    """Large-star: every larger neighbour of a node is joined to the node's least neighbour."""
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    far = both.filter(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("w"))
    big = far.select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    # Small-star: a node and its smaller neighbours are joined to the least of them.
    low = big.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "w")
    near = big.join(low, F.col("a") == F.col("w"))
    return near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("w").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on an edge (a, b); the component is its least node."""
    pairs = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not now[0] or now == mark:
            break
        mark, last = now, pairs
        pairs = stage(_star(pairs), "edges")
        discard(last)
    out = stage(pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct(), "labels")
    discard(pairs)
    return out
