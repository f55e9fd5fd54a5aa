"""Connected components of a table of links, by alternating star steps.

Each half step is a grouped minimum and a join whose hubs are spread (``heavy_join``); its result is written to the shared
folder and read back, which also cuts the lineage. No link, label or component
goes to the driver, only a row count and a checksum per step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.heavy import heavy_join, heavy_keys
from ..session import scratch_path


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours.
    ``total``: rows of ``links``, each of which is seen from both ends."""
    near = _both_ways(links)
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    heavy = heavy_keys(least.select("a", "n"), 2 * total)
    return heavy_join(near.filter("b > a"), least.drop("n"), ["a"], heavy, ["b"]).select(F.col("m").alias("a"), "b")


def _small_star(links: DataFrame, total: int) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = links.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n"))
    heavy = heavy_keys(least.select("b", "n"), total)
    near = heavy_join(links, least.drop("n"), ["b"], heavy, ["a"])
    return near.filter("a > m").select(F.col("m").alias("a"), F.col("a").alias("b")).union(
        least.select(F.col("m").alias("a"), "b"))


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node of its component.

    ``links`` has columns a and b (any order, repeats and loops allowed, nulls ignored)."""
    def kept(df: DataFrame) -> DataFrame:
        folder = scratch_path(spark, "links")
        df.filter("a < b").distinct().write.parquet(folder)
        return spark.read.parquet(folder)

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = kept(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    was = state(now)
    while True:
        large = kept(_large_star(now, was[0]))
        now = kept(_small_star(large, was[0]))     # a large star leaves at most as many links
        new = state(now)
        if new == was:
            break
        was = new
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        now.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("root")))
