"""Connected components by large-star and small-star rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import discard, stage


def _least(edges: DataFrame) -> DataFrame:
    """(w, m): the least smaller neighbour m of each vertex that has one. Summed up before the shuffle, and staged:
    then Spark sees both sides of the joins with it, and can split the rows of a vertex with very many neighbours."""
    return stage(edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")), "least")


def _roots(forest: DataFrame) -> DataFrame:
    """The edges of a forest, (u, v) with one smaller v for each u, led to the roots: each step halves the paths."""
    while True:
        up = forest.select(F.col("u").alias("w"), F.col("v").alias("m"))
        jumped = stage(forest.join(up, F.col("v") == F.col("w"), "left").select("u", F.coalesce("m", "v").alias("v"), F.col("m").isNotNull().alias("moved")), "roots")
        discard(forest)
        forest = jumped.select("u", "v")
        if jumped.filter("moved").isEmpty():
            return forest


def components(edges: DataFrame) -> DataFrame:
    """(v, label) of every vertex of the edges (u, v): label is the least vertex of its component.

    Vertices may be of any type that can be ordered; loops and repeated edges do not matter.
    Rounds of stars go on until every vertex has one smaller neighbour, which is a forest; its paths
    are then halved down to the roots. Each round is staged (and the one before deleted); only
    counts go to the driver.
    """
    now = stage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    least = _least(now)
    while least.count() < now.count():
        # large star: the greater neighbours of a vertex move on to its least one
        large = now.join(least, F.col("v") == F.col("w"), "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        large = stage(large, "large-star")
        # small star: a vertex and its smaller neighbours meet at the least of these
        lesser = _least(large)
        small = large.join(lesser, F.col("u") == F.col("w")).select("u", "v", "m")
        new = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lesser.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()
        new = stage(new, "edges")
        for old in (now, least, large, lesser):
            discard(old)
        now, least = new, _least(new)
    discard(least)
    now = _roots(now)
    heads = now.select(F.col("v")).distinct().select("v", F.col("v").alias("label"))
    return now.select(F.col("u").alias("v"), F.col("v").alias("label")).unionByName(heads)
