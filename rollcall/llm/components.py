"""Connected components by alternating large-star and small-star rounds.

Every round is two grouped minima and joins; its edges and minima are written to
the shared folder. The edges of a node with very many neighbours are salted for
the join with its minimum, and neighbours are never gathered into one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rollcall.operators.ranks import salted_join

from .storage import stage

#: Edges of a node from which it is salted.
HOT = 1000


def components(edges: DataFrame) -> DataFrame:
    """``edges``: columns a, b. Returns (node, component) of every node in an
    edge; the component is its least node."""
    e = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "cc")
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), "cc-least")
        large = stage(salted_join(both, least, ["u"], "n", HOT).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
        low = stage(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "cc-low")
        small = salted_join(large, low, ["u"], "n", HOT).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stage(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                  .union(low.select("u", F.col("m").alias("v"))).distinct(), "cc")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")) \
        .union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
