"""Connected components over edge tables, by alternating large-star and small-star steps; all in shuffles.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).  A vertex with many edges only ever meets a
partial aggregate (min) and a join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges: distinct (a, b) with a > b.  Large-star ties greater neighbours to the least one, small-star the lesser."""
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("__m")).select("a", F.least("a", "__m").alias("__m"))
    tied = both.join(least, "a")
    if small:
        out = tied.select(F.col("b").alias("v"), "__m").unionByName(least.select(F.col("a").alias("v"), "__m"))
    else:
        out = tied.where("b > a").select(F.col("b").alias("v"), "__m").unionByName(least.where("__m < a").select(F.col("a").alias("v"), "__m"))
    return out.where("v > __m").select(F.col("v").alias("a"), F.col("__m").alias("b")).distinct()


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Each vertex is tied to one lesser vertex at most, and those that others are tied to, to none."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").agg(F.count("*")).first()[0]


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(v, component) for every vertex with an edge; component is the least vertex it reaches.

    edges: columns a and b, any order, repeats and loops allowed; nulls are dropped."""
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while not _is_forest_of_stars(now):
        last, now = now, materialise(_star(_star(now, False), True), name)
        discard(last)
    return now.select(F.col("a").alias("v"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("v"), F.col("b").alias("component")).distinct())
