"""Catalog operators: keep-first deduplication, filters, profiles and name resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardinal.functions.text import candidate_names, normalize_key


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row, by the order, of each combination of keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")


def dedup_catalog(catalog: DataFrame, order: str = "ord") -> DataFrame:
    """Keep-first by (classes, instances), then by lower-case name; then the filters. A row that they drop can have hidden another."""
    first = keep_first(catalog, ["NumberOfClasses", "NumberOfInstances"], [order])
    second = keep_first(first.withColumn("__lower", F.lower("name")), ["__lower"], [order]).drop("__lower")
    return complete_rows(second)


def complete_rows(catalog: DataFrame) -> DataFrame:
    return catalog.where("NumberOfSymbolicFeatures <= 1 and NumberOfMissingValues = 0")


def dedup_signatures(catalog: DataFrame, order: str = "ord") -> DataFrame:
    return keep_first(catalog, ["NumberOfClasses", "NumberOfInstances", "class_dist_signature"], [order])


def consistent_classes(catalog: DataFrame) -> DataFrame:
    """Rows whose class distribution has as many classes as the catalog says."""
    return catalog.where(F.size("class_distribution_vector") == F.col("NumberOfClasses"))


def resolve(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """(query, data_id): digits are an id; else the first spelling with a match wins, exact matches before others, then active ones, then the newest version. Unmatched queries have no row."""
    digits = queries.where(F.col("query").rlike("^[0-9]+$")).select("query", F.col("query").cast("bigint").alias("data_id"))
    names = queries.where(~F.col("query").rlike("^[0-9]+$")).select("query", F.posexplode(candidate_names(F.col("query"))).alias("pos", "spelling"))
    met = names.join(catalog, normalize_key(F.col("spelling")) == normalize_key(F.col("name")))
    best = Window.partitionBy("query").orderBy("pos", (F.col("spelling") == F.col("name")).desc(), (F.col("status") == "active").desc(), F.col("version").desc(), "data_id")
    named = met.withColumn("__place", F.row_number().over(best)).where("__place = 1").select("query", "data_id")
    return digits.unionByName(named)
