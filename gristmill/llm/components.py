"""Connected components of an edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.session import staged


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long, nulls and loops left out). Returns id, root: every id that stands in an edge, with the least id it is connected to.

    Each round is written to the shared folder. A node's least neighbour is a grouped minimum and comes back by a plain join, whose skew
    Spark may split, so a hub's edges never meet in one task. Repeated edges count once; no edges give no rows.
    """
    a, b = F.col("a"), F.col("b")
    held = staged(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    before = None
    while True:
        both = held.union(held.select(b.alias("a"), a.alias("b")))
        least = staged(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a")), "least")
        large = both.join(least, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b"))
        large = large.where(a != b).distinct()
        large = staged(large.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "large")
        least = staged(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        held = staged(small.where(a != b).distinct(), "edges")
        now = held.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        before = now
    roots = held.select(b.alias("id"), b.alias("root")).distinct()
    return held.select(a.alias("id"), b.alias("root")).union(roots)
