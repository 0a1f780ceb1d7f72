"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens.llm.store import staged


def components(edges: DataFrame, folder: str, name: str = "components") -> DataFrame:
    """(u, component): every id that an edge (a, b) touches, with the smallest id it can reach.

    A round is two written tables, so no lineage grows; adaptive execution may split the hot keys (the hub of a
    large group) of its joins. Minima are combined on the map side. Ends when the edges are stars around the roots; the number of rounds grows with the logarithm of the
    group size, not with its diameter.
    """
    e = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
               folder, f"{name}-0")
    k = 0
    while not _stars(e):
        k += 1
        # large star: larger neighbours of u, and u, move to u's smallest neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        larger = e.select(F.col("v").alias("u"), F.col("u").alias("w")).unionByName(e.select("u", F.col("u").alias("w")))
        e = staged(larger.join(low, "u").filter("w <> m").select(F.greatest("w", "m").alias("u"), F.least("w", "m").alias("v")), folder, f"{name}-{k}-large")
        # small star: smaller neighbours of u, and u, move to the smallest of them
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = staged(e.join(low, "u").filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
                   .unionByName(low.select("u", F.col("m").alias("v"))).distinct(), folder, f"{name}-{k}-small")
    return e.select("u", F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("u"), F.col("v").alias("component"))).distinct()


def _stars(e: DataFrame) -> bool:
    """Does every larger end have one smaller end, which is nobody's larger end?"""
    ends = e.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        e.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up = 1 AND down = 1").isEmpty()
