"""The dataset sampler: names or ids from a configuration are resolved in a catalog, loaded, sampled exactly and written.

python -m cardinal.plans.sampler --catalog DIR --datasets-dir DIR [--config FILE] [--group NAME | --datasets A B] [--max-rows N] [--output-dir DIR] [--random-state N]
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardinal.operators import catalog as C
from cardinal.operators import prepare, sampling
from cardinal.sources.tables import load_config, read_or_none, unique_names

ROW = "__row"


def sample_one(spark: SparkSession, catalog: DataFrame, datasets_dir: str, query: str, max_rows: int, seed: int) -> tuple[DataFrame, dict]:
    """(sample, metadata) of one dataset; ValueError if it can't be resolved or read. The rows need a stable id: column `row_id`, or all columns hashed."""
    found = C.resolve(spark.createDataFrame([(query,)], "query string"), catalog).first()
    if found is None:
        raise ValueError(f"no dataset is named {query}")
    data_id = found["data_id"]
    df = read_or_none(spark, f"{datasets_dir}/{data_id}.parquet")
    if df is None:
        raise ValueError(f"dataset {data_id} can't be read")
    df = df.toDF(*unique_names(df.columns))
    names = [c for c in df.columns if c != "row_id"]
    target = prepare.target_column(names)
    keyed = df.withColumn(ROW, F.col("row_id") if "row_id" in df.columns else F.xxhash64(*names))
    rows = keyed.count()
    sample = sampling.sample_dataset(keyed, target, ROW, max_rows, seed).drop(ROW)
    named = catalog.where(F.col("data_id") == data_id).select("name").first()
    strings = sum(t == "string" for c, t in df.dtypes if c != target)
    classes = df.select(target).distinct().count() if target else None
    return sample, {
        "query": query, "resolved_dataset_id": data_id, "resolved_dataset_name": named["name"] if named else None, "target_name": target, "original_rows": rows, "sample_rows": sample.count(),
        "n_features_without_target": len(names) - (target is not None), "n_classes": classes, "sampled": 0 < max_rows < rows, "random_state": seed, "categorical_feature_count": strings,
    }


def run(spark: SparkSession, catalog: DataFrame, datasets_dir: str, names: list[str], output_dir: str, max_rows: int, seed: int) -> DataFrame:
    """Writes a CSV and a Parquet sample for each name that works, and the metadata of all; returns the metadata, with an error for each that doesn't."""
    summary = []
    for query in names:
        try:
            sample, meta = sample_one(spark, catalog, datasets_dir, query, max_rows, seed)
            base = f"{output_dir}/{meta['resolved_dataset_id']}"
            sample.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{base}.csv")
            try:
                sample.write.mode("overwrite").parquet(f"{base}.parquet")
                parquet = f"{base}.parquet"
            except Exception:  # the CSV is the result; Parquet is a copy where it can be written
                parquet = None
            summary.append(meta | {"csv_path": f"{base}.csv", "parquet_path": parquet, "error": None})
        except ValueError as e:
            summary.append({"query": query, "error": str(e)})
    schema = (
        "query string, resolved_dataset_id bigint, resolved_dataset_name string, target_name string, original_rows bigint, sample_rows bigint, n_features_without_target int, n_classes int, "
        "sampled boolean, random_state int, categorical_feature_count int, csv_path string, parquet_path string, error string"
    )
    out = spark.createDataFrame([tuple(m.get(c.split()[0]) for c in schema.split(", ")) for m in summary], schema)
    out.coalesce(1).write.mode("overwrite").json(f"{output_dir}/summary.json")
    return out


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser()
    p.add_argument("--catalog", required=True)
    p.add_argument("--datasets-dir", required=True)
    p.add_argument("--config")
    p.add_argument("--group")
    p.add_argument("--datasets", nargs="*")
    p.add_argument("--max-rows", type=int)
    p.add_argument("--output-dir")
    p.add_argument("--random-state", type=int)
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    text = "\n".join(r[0] for r in spark.read.text(a.config, wholetext=True).collect()) if a.config else "{}"
    config = load_config(text)
    own = config["defaults"]
    pick = lambda given, name: given if given is not None else own[name]
    names = a.datasets or [n for g in ([a.group] if a.group else config["groups"]) for n in config["groups"][g]]
    out = run(spark, spark.read.parquet(a.catalog), a.datasets_dir, names, pick(a.output_dir, "output_dir"), pick(a.max_rows, "max_rows"), pick(a.random_state, "random_state"))
    print(json.dumps([r.asDict() for r in out.collect()], indent=1))


if __name__ == "__main__":
    main()
