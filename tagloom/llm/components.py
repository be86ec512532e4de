"""Connected components of links by alternating star contraction, without collecting them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, remove


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex points its larger neighbours to the smallest vertex it knows."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
    return _ordered(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex points its smaller neighbours, and itself, to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("low"))
    moved = edges.join(low, "u")
    return _ordered(moved.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v"))))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every vertex that some link of two different vertices touches; a component goes by its smallest vertex.

    Links may be repeated or stand both ways round. Each round is written to the shared folder; a
    vertex's links meet only as partial minima and in joins that the adaptive plan can split.
    """
    spark = edges.sparkSession
    now, path = materialize(spark, _ordered(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))), "links")
    state = None
    while True:
        next_, next_path = materialize(spark, _small_star(_large_star(now)), "links")
        seen = next_.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        remove(spark, path)
        now, path = next_, next_path
        if seen == state:
            break
        state = seen
    roots = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
