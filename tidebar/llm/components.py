"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Parts into which the edges of a node are dealt.
SALTS = 16


def _unsettled(e: DataFrame) -> bool:
    """Whether some node has several lesser neighbours, or a lesser and a greater one; else each edge ends at its component."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("low"), F.lit(0).alias("high")).union(e.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("x").agg(F.sum("low").alias("low"), F.max("high").alias("high"))
    return nodes.agg(F.count_if((F.col("low") > 1) | ((F.col("low") > 0) & (F.col("high") > 0)))).first()[0] > 0


def _with_least(e: DataFrame, m: Column) -> DataFrame:
    """u, v and m, an expression of u and its least neighbour m. The edges of a node are joined in SALTS parts, so that one with
    very many edges spreads over tasks."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    least = e.groupBy("u").agg(F.min("v").alias("m")).select("u", m.alias("m"), salts.alias("salt"))
    return e.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(least, ["u", "salt"]).select("u", "v", "m")


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (smallest node reachable) for every node of an undirected edge table of longs.

    Each round is two aggregations and two joins over the edges, written to the shared folder;
    the number of rounds grows with the logarithm of the longest path, and a table of stars needs none.
    Nothing but one number reaches the driver. Null ends and loops are ignored. Tables of earlier rounds are deleted; ``discard`` deletes the result's.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("ok")).where("ok and u != v").select("u", "v").distinct()
    e = materialize(e, "edges")
    while _unsettled(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, F.least("u", "m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "edges")
        small = _with_least(large, F.col("m")).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        discard(e)
        e = materialize(small, "edges")
        discard(large)
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out._path = e._path
    return out
