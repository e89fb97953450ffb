"""Connected components of a distributed edge list, by alternating large and small stars.

DataFrame operations only; every round's edges are a stored table, so lost executors cost one round at most, and no
edge or label reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import look_up, stored, unstore


def _with_least(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs (u, v) plus m, the least v of each u; the second table is a stored one to drop when done."""
    least = stored(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "stars")
    total = least.agg(F.sum("n")).first()[0] or 0
    return look_up(pairs, least, ["u"], "n", total), least


def connected(edges: DataFrame) -> DataFrame:
    """(u, v) of any comparable type -> stored (v, root): for each vertex but the least of its component, that least one.

    Loops and repeated edges are allowed; an empty edge list gives an empty result. Hot vertices (stars with many
    leaves) are joined by look_up().
    """
    now = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        # large star: every larger neighbour of u is linked to the least of u and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near, a = _with_least(both)
        large = stored(near.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "edges")
        # small star: every smaller neighbour of u, and u, is linked to the least of them
        near, b = _with_least(large)
        small = near.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        nxt = stored(small.filter("u <> v").distinct(), "edges")
        for t in (a, b, now, large):
            unstore(t)
        now = nxt
        found = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if found == mark:
            return now.select(F.col("u").alias("v"), F.col("v").alias("root"))
        mark = found
