"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Scratch


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Tie the neighbours of each node to the smallest of them: the larger ones (large star) or the others (small star)."""
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = both.unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else both
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    tied = both.join(least, "u")
    if large:
        out = tied.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b"))
    return out


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Star links (a, b): b is the smallest node of a's component. ``links`` has columns a, b of one sortable type.

    Each pass keeps at most as many links as it gets. The loop ends when a pass changes nothing; passes grow with the
    logarithm of a component's width.
    """
    size = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")]
    now = scratch.write(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    seen = now.agg(*size).first()
    while seen["n"]:
        new = scratch.write(_star(_star(now, large=True).distinct(), large=False).distinct())
        scratch.drop(now)
        now, last, seen = new, seen, new.agg(*size).first()
        if last == seen:
            break
    return now
