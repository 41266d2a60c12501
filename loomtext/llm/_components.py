"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.session import drop, written


def components(edges: DataFrame) -> DataFrame:
    """node and the smallest node connected with it, by alternating large-star and small-star steps."""
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    stamp = None
    while True:
        # large star: everything above u hangs on the smallest of u and its neighbours
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        # small star: u and its smaller neighbours hang on the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        hung = large.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).union(low).filter("u != v").distinct()
        last, edges = edges, written(hung, "edges")
        drop(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == stamp:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        stamp = now
