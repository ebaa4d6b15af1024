"""Connected components of a link table, by alternating large-star and small-star steps.

Each step sends a node's neighbours to the smallest node it knows, so a component of any shape
becomes a star in a logarithmic number of rounds. Every round is a join and an aggregate over the
link table, written to the shared folder: nothing is gathered on the driver but a row of totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classcraft.llm.common import drop_path, fresh_path


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``links`` holds long columns ``a`` and ``b``; returns (node, root) for every node that is not its own root.

    The root is the smallest node of the component. Nodes in no link, self links and nulls give no row.
    """
    spark = links.sparkSession
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    path, seen = fresh_path(spark, "links"), None
    edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().write.parquet(path)
    while True:
        edges = spark.read.schema("u long, v long").parquet(path)
        mark = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")),
                               F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        following = fresh_path(spark, "links")
        _small_star(_large_star(edges)).write.parquet(following)
        drop_path(spark, path)
        path, seen = following, mark
