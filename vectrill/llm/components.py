"""Connected components by alternating stars, all in DataFrames: neither links nor labels ever meet in one place.

A large star hangs a node's larger neighbours on its smallest one, a small star its smaller neighbours; both keep
components and flatten trees (Kiveris et al., 2014). Each round is one minimum by key and one join, written to the
shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b). Neighbours as (u, v) rows; each u's smallest neighbour or itself is m."""
    if large:
        pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
    else:
        pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = pairs.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
    joined = pairs.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return out.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b, integers): the smallest node that it reaches."""
    told = {"n": F.count(F.lit(1)), "sum": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    now = Cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", **told)
    last = None
    while now.found != last and now.found["n"]:
        last, before = now.found, now
        now = Cut(_star(_star(now.df, True), False), "edges", **told)
        before.drop()
    return now.df.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.df.select("b", "b").distinct())
