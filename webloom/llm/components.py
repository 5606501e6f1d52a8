"""Connected components of an edge list by alternating large and small stars.

Each round joins every node's edges with one row, its smallest neighbour, so a
node of any degree is split by adaptive skew joins and never gathered in one
task. Edges end as stars around the smallest id of each component after a number
of rounds that grows with the logarithm of the number of nodes. Each round is
written to the shared folder, which cuts the lineage and survives lost
executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return r[0], r[1]


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
    moved = edges.join(least, F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id) of each id that has an edge; component_id is the smallest id reachable."""
    e = stored(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = _state(e)
    while state[0]:
        nxt = stored(_small(_large(e)))
        new = _state(nxt)
        e = nxt
        if new == state:
            break
        state = new
    return e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
