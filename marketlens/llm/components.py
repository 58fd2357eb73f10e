"""Connected components of a graph given as links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.storage import BROADCAST_ROWS, few_tasks, written


def components(links: DataFrame) -> DataFrame:
    """(key, root) of every key that has a link; the root is the smallest key it is connected with.

    Links are pairs (a, b) of longs, of a written table, as they are read several times. Every round is
    written to the shared folder, until only stars are left. The groups are minima, which Spark combines
    before it shuffles, and joins that it may split: a key with very many links needs no single task.
    About log n rounds.
    """
    edges = links.select("a", "b").where("a <> b")
    # the minima of few links are broadcast, so that only they are shuffled
    rows = edges.count()
    meant = F.broadcast if rows <= BROADCAST_ROWS else lambda df: df
    while not starred(edges, rows):
        both = edges.select("a", "b").union(edges.select("b", "a")).toDF("u", "v")
        least = meant(few_tasks(both.groupBy("u").agg(F.min("v").alias("m")), rows).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = meant(few_tasks(down.groupBy("u").agg(F.min("v").alias("m")), rows))
        small = down.join(least, "u").select("v", "m").where("v <> m").union(least.select("u", "m")).toDF("a", "b")
        edges = written(few_tasks(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), rows), "stars")
    stars = edges.select(F.greatest("a", "b").alias("key"), F.least("a", "b").alias("root")).distinct()
    return stars.union(stars.select("root", "root").distinct()).toDF("key", "root")


def starred(edges: DataFrame, rows: int) -> bool:
    """Whether every larger key of a link is linked with one smaller key only, which is no larger one itself."""
    ends = edges.select(F.greatest("a", "b").alias("key"), F.least("a", "b").alias("low"))
    ends = ends.union(edges.select(F.least("a", "b"), F.lit(None).cast("long")))
    lows = ends.groupBy("key").agg(F.min("low").alias("low"), F.max("low").alias("high"), F.bool_or(F.col("low").isNull()).alias("centre"))
    return few_tasks(lows, rows).where("low <> high or (centre and low is not null)").count() == 0
