"""Connected components of a link table by alternating large and small stars.

Each round replaces links by stars around the smallest neighbour, first over
larger neighbours, then over smaller ones; the links end as one star per
component, in a number of rounds that is logarithmic in practice.  A round is
two aggregations (with map-side partial minima) and joins, which AQE splits
where a hub is hot.  Every round is written to the shared folder, so lineage
stays short and executors may be lost.  Nothing is collected but the count and
checksum that tell when the links no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sellerdesk.session import stage


def _checksum(links: DataFrame) -> tuple:
    mixed = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(links.agg(F.count("*"), mixed).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
    least = least.withColumn("m", F.least("c", "m"))
    larger = both.where(F.col("v") > F.col("u"))
    return larger.join(least, F.col("u") == F.col("c")).select(
        F.col("m").alias("u"), "v"
    ).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    # links hold u < v: u are the smaller neighbours of v
    least = links.groupBy(F.col("v").alias("c")).agg(F.min("u").alias("m"))
    rest = links.join(least, F.col("v") == F.col("c")).where(F.col("u") != F.col("m"))
    rest = rest.select(F.col("m").alias("u"), F.col("u").alias("v"))
    own = least.select(F.col("m").alias("u"), F.col("c").alias("v"))
    return rest.unionByName(own).distinct()


def stars(links: DataFrame) -> DataFrame:
    """Stars (u, v) with u the smallest node of v's component, v every other node.

    ``links(u, v)``: pairs of longs in any order, repeats and loops allowed.
    """
    links = links.where("u <> v").select(
        F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
    )
    links = stage(links.distinct(), "links")
    seen = _checksum(links)
    while True:
        links = stage(_small_star(_large_star(links)), "links")
        now = _checksum(links)
        if now == seen:
            return links
        seen = now
