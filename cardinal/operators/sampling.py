"""Exact samples, drawn by a key that doesn't depend on how rows are dealt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardinal.functions.ranking import global_rank


def shuffle_key(row_id: Column, seed: int) -> Column:
    """An arithmetic key, the same in any SQL engine; ties go by the row id."""
    return F.pmod(row_id.cast("bigint") * F.lit(1103515245) + F.lit(seed), F.lit(2147483647))


def quotas(df: DataFrame, stratum: str, n: int) -> DataFrame:
    """(stratum, size, quota) of an exact stratified sample: one row of each class, the rest in proportion to what is left, by largest remainder; first class wins ties. Null is a class.

    With n at least the rows, all; with fewer than the classes, no quota holds and the sample is a plain one.
    """
    sizes = df.groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("size"))
    # One row for each class: a single-partition window over classes, not over rows.
    whole = Window.partitionBy(F.lit(0))
    t = sizes.withColumns({"total": F.sum("size").over(whole), "classes": F.count("*").over(whole)})
    t = t.withColumn("left", F.col("size") - 1).withColumn("budget", F.lit(n) - F.col("classes"))
    t = t.withColumn("desired", F.when(F.col("total") > F.col("classes"), (F.col("left") / (F.col("total") - F.col("classes"))) * F.col("budget")).otherwise(F.lit(0.0)))
    t = t.withColumn("base", F.least(F.floor("desired"), F.col("left"))).withColumn("fraction", F.col("desired") - F.floor("desired"))
    t = t.withColumn("short", F.col("budget") - F.sum("base").over(whole))
    t = t.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("fraction").desc(), F.col("stratum").asc_nulls_first())))
    quota = F.when(F.lit(n) >= F.col("total"), F.col("size")).otherwise(1 + F.col("base") + F.when(F.col("place") <= F.col("short"), 1).otherwise(0))
    return t.select("stratum", "size", quota.cast("bigint").alias("quota"))


def stratified_sample(df: DataFrame, stratum: str, row_id: str, n: int, seed: int) -> DataFrame:
    places = Window.partitionBy(stratum).orderBy(shuffle_key(F.col(row_id), seed), row_id)
    q = quotas(df, stratum, n).select(F.col("stratum").alias("__stratum"), "quota")
    ranked = df.withColumn("__place", F.row_number().over(places))
    return ranked.join(q, F.col(stratum).eqNullSafe(F.col("__stratum"))).where("__place <= quota").drop("__place", "__stratum", "quota")


def random_sample(df: DataFrame, row_id: str, n: int, seed: int) -> DataFrame:
    """Exactly n rows without replacement (all, if there are fewer)."""
    return df.orderBy(shuffle_key(F.col(row_id), seed), row_id).limit(n)


def sample_dataset(df: DataFrame, target: str | None, row_id: str, max_rows: int, seed: int) -> DataFrame:
    """All rows if max_rows isn't positive or isn't exceeded; else stratified by the target if it has several classes, else plain."""
    n = df.count()
    if max_rows <= 0 or n <= max_rows:
        return df
    classes = df.select(target).distinct().count() if target else 0
    if classes > 1 and max_rows >= classes:
        return stratified_sample(df, target, row_id, max_rows, seed)
    return random_sample(df, row_id, max_rows, seed)


def random_sample_by_rank(df: DataFrame, row_id: str, n: int, seed: int) -> DataFrame:
    """The same rows as random_sample(), for an n too large for one task to gather."""
    return global_rank(df, shuffle_key(F.col(row_id), seed), F.col(row_id), name="__place").where(F.col("__place") <= n).drop("__place")
