"""Connected components of a links table, by alternating star contractions.

Links are pairs of longs.  Each round makes every node point at the least node
it knows of (large star, then small star), so the number of rounds grows with
the logarithm of the longest path.  Rounds are written to the shared folder,
which cuts lineage; nothing but a count comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, made, release, store


def _alone(least: DataFrame) -> DataFrame:
    """Written down, so that both sides of the join with the links are dealt out for it alone and a hub's partition can be split."""
    return store(least, "least-neighbours")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _alone(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v")
    least = _alone(down.groupBy("u").agg(F.min("v").alias("m")))
    hung = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x"))
    return hung.select("x.u", "x.v").filter("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (least node of its component) for every node of links (u, v); self-links and repeats count for nothing."""
    spark = links.sparkSession
    now = store(links.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u != v").distinct(), "links")
    mark = None
    while True:
        since = made()
        large = store(_large_star(now), "links")
        new = store(_small_star(large), "links")
        release(spark, since, keep=(new._scratch_path,))
        discard(spark, now._scratch_path)
        now = new
        # the links are a set, so an order-free sum of hashes and a count tell whether it has changed
        seen = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
