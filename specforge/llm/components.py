"""Connected components of distributed links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) for every id of links (a, b); ids are longs without nulls.

    Alternates two steps until no link changes: each id hands its larger neighbours to its smallest neighbour, then its
    smaller ones. Links and labels stay distributed; hubs are aggregated before they are dealt out.
    """
    edge = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = materialize(edge(links), "links")
    mark = edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        # larger neighbours of u go to u's smallest neighbour
        large = edges.join(least, edges["b"] == least["u"]).select(F.col("a"), F.col("m").alias("b"))
        large = edge(large)
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(low, large["a"] == low["u"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = materialize(edge(small.union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))), "links")
        new_mark = new.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        drop(edges)
        edges = new
        if new_mark == mark:
            break
        mark = new_mark
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
