"""Connected components of a link table, by alternating large and small stars.

Each step is one grouped minimum and one join, whatever the shape of the
links; a star with very many leaves is split by the adaptive skew join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large: link each greater neighbour of a node to its least neighbour.
    Small: link a node and its lesser neighbours to the least of them."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of a link; component is the least node
    it reaches. Links may repeat, run both ways, or join a node to itself (such
    a link alone names no component); links with a null end are left out."""
    edges = (links.select(F.col(a).alias("u"), F.col(b).alias("v"))
             .filter("u is not null and v is not null and u != v").distinct())
    edges = materialize(edges, keep_partitioning=False)
    before = None
    while True:
        # (links, their digest): equal twice means every component is a star.
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        edges = materialize(_stars(_stars(edges, large=True), large=False), keep_partitioning=False)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
