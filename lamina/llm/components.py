"""Connected components by alternating large and small stars.

Every round is two aggregations and two joins over an edge table that is written to
the shared folder; the number of rounds grows with the logarithm of the longest path.
The least node of a component's star is its label. Stars with very many leaves are
aggregated before the shuffle, and spread over many join keys, never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, hot_join


def _large(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return hot_join(both.where("v > u"), low, "u", "n", total=2 * n).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame, n: int) -> DataFrame:
    """edges have u > v."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    rest = hot_join(edges, low, "u", "n", total=n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(low.select("u", F.col("m").alias("v")))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: (u, v) of longs; loops and repeats are allowed, nulls are dropped.

    Returns (node, label) for every node with an edge to another node; label is the
    least node of the component. An empty input gives an empty result.
    """
    pairs = edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = Stored(pairs, "edges")
    mark = _mark(now.df)
    while mark[0]:
        wide = _large(now.df, mark[0]).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        then = Stored(_small(wide, mark[0]).where("u <> v").distinct(), "edges")
        now.drop()
        now, last = then, mark
        mark = _mark(now.df)
        if mark == last:
            break
    leaves = now.df.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return leaves.union(now.df.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
