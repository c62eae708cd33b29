"""Connected components of a links table, by alternating large and small stars.

No list of links or components reaches the driver: each round is two group-bys over the links,
written to the shared folder; it ends when all that is left are stars around the least nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, saved


def _stars(links: DataFrame) -> bool:
    """Whether each node either has one link to a lesser node, and none from a greater, or none to a lesser."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return not ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down + up > 1").limit(1).count()


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): for each node with a link, the least node that it reaches. Loops and repeated links are no matter."""
    spark, path = links.sparkSession, None
    now = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u > v").distinct()
    now, path = saved(now, "links")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v")).filter("u > v").distinct()
        new, new_path = saved(small, "links")
        drop(spark, path)
        now, path = new, new_path
    heads = now.groupBy("u").agg(F.min("v").alias("component"))
    return heads.withColumnRenamed("u", "node").unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
