"""Cumulative-capacity buckets: rows in order fill cluster 1, then cluster 2, and so on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardinal.functions.ranking import global_rank


def bounds(sizes: DataFrame, cluster: str = "cluster", size: str = "size") -> DataFrame:
    """One row with the array of cumulative sizes by cluster."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(F.col(cluster).alias("c"), F.col(size).cast("bigint").alias("s")))), lambda x: x["s"])
    sums = F.transform(F.sequence(F.lit(1), F.size("s")), lambda i: F.aggregate(F.slice("s", 1, i), F.lit(0).cast("bigint"), lambda a, v: a + v))
    return sizes.agg(ordered.alias("s")).select(sums.alias("bounds"))


def cluster_of(rank: Column, bounds_col: Column) -> Column:
    """1 + the number of clusters that are full before this rank; null beyond the last. A size of 0 leaves an empty cluster."""
    c = 1 + F.size(F.filter(bounds_col, lambda b: b < rank))
    return F.when(c <= F.size(bounds_col), c.cast("bigint"))


def fill(df: DataFrame, sizes: DataFrame, *order: Column) -> DataFrame:
    """Adds `cluster` by the order (a total one). The bounds are one row."""
    ranked = global_rank(df, *order, name="__rank")
    return ranked.crossJoin(F.broadcast(bounds(sizes))).withColumn("cluster", cluster_of(F.col("__rank"), F.col("bounds"))).drop("__rank", "bounds")


def fill_groups(df: DataFrame, sizes: DataFrame, group: list[str], *order: Column) -> DataFrame:
    """The same within each group (a dataset, a particle)."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint"))
    return ranked.crossJoin(F.broadcast(bounds(sizes))).withColumn("cluster", cluster_of(F.col("__rank"), F.col("bounds"))).drop("__rank", "bounds")


def cluster_sizes(assigned: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, n) for every cluster, empty ones included."""
    counts = assigned.groupBy("cluster").agg(F.count("*").alias("n"))
    return clusters.join(counts, "cluster", "left").select("cluster", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def size_penalty(assigned: DataFrame, sizes: DataFrame, weight: float) -> DataFrame:
    """One row: total deviation from the sizes, and the weighted penalty."""
    found = cluster_sizes(assigned, sizes.select("cluster")).join(sizes, "cluster")
    return found.agg(F.sum(F.abs(F.col("n") - F.col("size"))).cast("bigint").alias("deviation"), (F.sum(F.abs(F.col("n") - F.col("size"))) * weight).cast("double").alias("penalty"))
