"""Datasets in the normal form (data_id, row_id, x, y), catalogs, configurations and result files."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("n", T.LongType()), T.StructField("k", T.LongType()), T.StructField("y_predict", T.StringType()), T.StructField("y_true", T.StringType()),
    T.StructField("target_cardinality", T.StringType()), T.StructField("cardinality_pred", T.StringType()), T.StructField("Execution_Time", T.DoubleType()), T.StructField("ARI", T.DoubleType()),
    T.StructField("AMI", T.DoubleType()), T.StructField("NMI", T.DoubleType()), T.StructField("Silhouette_mean", T.DoubleType()),
])
CONFIG_DEFAULTS = {"max_rows": 2000, "output_dir": "samples", "random_state": 42}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, x, y) of the embeddings table; components are doubles before any arithmetic."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("bigint").alias("y"))


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A cached dataset, or None if it can't be read; the caller goes on with the others."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def unique_names(names: list[str]) -> list[str]:
    """Repeated names get .1, .2, ... and stay clear of names that are there."""
    seen, out = set(), []
    for name in names:
        k, fresh = 0, name
        while fresh in seen or (k and fresh in names):
            k += 1
            fresh = f"{name}.{k}"
        seen.add(fresh)
        out.append(fresh)
    return out


def id_column(columns: list[str]) -> str:
    return _first_of(columns, ("did", "data_id", "dataset_id"))


def name_column(columns: list[str]) -> str:
    return _first_of(columns, ("name", "data_name"))


def _first_of(columns: list[str], names: tuple[str, ...]) -> str:
    for name in names:
        if name in columns:
            return name
    raise ValueError(f"none of {', '.join(names)} is a column")


def catalog_scan(catalog: DataFrame, features=(4, 6), instances=(150, 250), classes=(2, 3)) -> DataFrame:
    """Catalog rows within the ranges; the predicates reach the Parquet scan."""
    ranges = {"NumberOfFeatures": features, "NumberOfInstances": instances, "NumberOfClasses": classes}
    for c, (low, high) in ranges.items():
        catalog = catalog.where(F.col(c).between(low, high))
    return catalog


def load_config(text: str) -> dict:
    """A sampler configuration from JSON; defaults fill what is missing."""
    config = json.loads(text)
    config["defaults"] = CONFIG_DEFAULTS | config.get("defaults", {})
    config.setdefault("groups", {})
    return config


def read_predictions(spark: SparkSession, *paths: str) -> DataFrame:
    """Prediction files with the algorithm from the file's name; files without a column get nulls there."""
    frames = []
    for path in paths:
        name = re.search(r"pred_([^/]+)\.csv$", path)[1]
        frames.append(spark.read.option("header", True).csv(path).withColumn("algorithm", F.lit(name)))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select("algorithm", *(_cast(out, f) for f in RESULT_SCHEMA))


def _cast(df: DataFrame, field: T.StructField) -> Column:
    return (F.col(field.name) if field.name in df.columns else F.lit(None)).cast(field.dataType).alias(field.name)


def write_predictions(results: DataFrame, path: str) -> bool:
    """One CSV file with a header; nothing is written if there are no rows."""
    if results.isEmpty():
        return False
    results.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return True


def append_log(spark: SparkSession, path: str, call: str, seconds: float, algorithm: str, total_mib: float | None = None, peak_mib: float | None = None) -> None:
    """One row of the resource log. Appends add files, so that writers don't race for one."""
    row = spark.range(1).select(
        F.lit(call).alias("Function_Call"), F.lit(seconds).cast("double").alias("Elapsed_Time_sec"), F.lit(total_mib).cast("double").alias("Total_RAM_Used_MiB"),
        F.lit(peak_mib).cast("double").alias("Peak_RAM_Used_MiB"), F.lit(algorithm).alias("Algoritmo"), F.current_timestamp().alias("Fecha"),
    )
    row.write.mode("append").parquet(path)
