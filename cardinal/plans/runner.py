"""Runs algorithms over datasets: a task for each (algorithm, dataset), so that a slow algorithm doesn't hold up the others."""

from __future__ import annotations

import inspect
import resource
import time

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardinal.operators import kernels as K
from cardinal.operators.metrics import scores
from cardinal.operators import catalog as C
from cardinal.operators.prepare import class_sizes, eligible, prepare, union_all
from cardinal.plans.algorithms import ALGORITHMS, BY_NAME, aco_restart
from cardinal.sources import tables

RESULT = (
    "algorithm string, data_id bigint, name string, n bigint, k bigint, y_predict string, y_true string, target_cardinality string, cardinality_pred string, "
    "Execution_Time double, ARI double, AMI double, NMI double, Silhouette_mean double, hyperparams map<string,string>, error string"
)


def labels_of(algorithm: str, pdf: pd.DataFrame, **parameters) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(x, y codes, sizes, labels) of one dataset; the required sizes are those of the classes."""
    pdf = pdf.sort_values("row_id")
    x = np.stack(pdf.x.to_numpy()).astype(float)
    y = pdf.y_code.to_numpy().astype(np.int64) - 1
    sizes = np.bincount(y)
    if not eligible(sizes.tolist(), len(x)):
        raise ValueError("the sizes can't be met")
    return x, y, sizes, BY_NAME[algorithm](x, sizes, **parameters)


def hyperparams(algorithm: str, given: dict) -> dict[str, str]:
    """The parameters of a run, defaults included, as text."""
    defaults = {k: p.default for k, p in inspect.signature(BY_NAME[algorithm]).parameters.items() if p.default is not inspect.Parameter.empty}
    return {k: str(v) for k, v in (defaults | given).items() if v is not None}


def run(datasets: DataFrame, algorithms: list[str], parameters: dict[str, dict] | None = None) -> DataFrame:
    """One result row for each algorithm and dataset of (data_id, name, row_id, x, y_code); an error is a column, not a failure."""
    settings = parameters or {}

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        algorithm, data_id, name = pdf.algorithm.iloc[0], int(pdf.data_id.iloc[0]), pdf.name.iloc[0] if not callable(pdf.name) else pdf["name"].iloc[0]
        row = dict.fromkeys(("n", "k", "y_predict", "y_true", "target_cardinality", "cardinality_pred", "Execution_Time", "ARI", "AMI", "NMI", "Silhouette_mean", "hyperparams", "error"))
        row["hyperparams"] = hyperparams(algorithm, settings.get(algorithm, {}))
        row |= {"algorithm": algorithm, "data_id": data_id, "name": name, "n": len(pdf)}
        try:
            began = time.perf_counter()
            x, y, sizes, label = labels_of(algorithm, pdf, **settings.get(algorithm, {}))
            row["Execution_Time"] = time.perf_counter() - began
            row["ARI"], row["AMI"], row["NMI"] = scores(y, label)
            s = K.silhouette_mean(K.CosineSums(x), label, len(sizes))
            text = lambda v: " ".join(map(str, v))
            row |= {"k": len(np.unique(label)), "y_predict": text(label + 1), "y_true": text(y + 1), "target_cardinality": text(sizes), "cardinality_pred": text(np.bincount(label, minlength=len(sizes))), "Silhouette_mean": s if np.isfinite(s) else None}
        except Exception as e:  # one dataset's failure must not end the others'
            row["error"] = f"{type(e).__name__}: {e}"
        return pd.DataFrame([row])[[c.split()[0] for c in RESULT.split(", ")]]

    each = datasets.withColumn("algorithm", F.explode(F.array(*map(F.lit, algorithms))))
    return each.groupBy("algorithm", "data_id").applyInPandas(one, RESULT)


def execute(datasets: DataFrame, number: int, output_dir: str | None = None) -> DataFrame:
    """Menu: 1-8 one algorithm, 9 all. With an output folder, each algorithm's good rows go to pred_NAME.csv there, and its time and the driver's memory to the resource log."""
    if number not in (*ALGORITHMS, 9):
        raise ValueError("choose 1 to 9")
    names = [name for n, (name, _) in ALGORITHMS.items() if number in (n, 9)]
    if output_dir is None:
        return run(datasets, names)
    spark, found = datasets.sparkSession, []
    for name in names:
        began = time.perf_counter()
        result = run(datasets, [name]).cache()
        tables.write_predictions(result.where("error is null").select(*(f.name for f in tables.RESULT_SCHEMA)), f"{output_dir}/pred_{name}.csv")
        peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
        tables.append_log(spark, f"{output_dir}/resource_log", name, time.perf_counter() - began, name, None, peak)
        found.append(result)
    return union_all(found)


def load_datasets(spark, catalog: DataFrame, datasets_dir: str) -> DataFrame:
    """(data_id, name, row_id, x, y, y_code) of the catalog's datasets: rows within the scan's ranges, deduplicated, loaded, with as many classes as the catalog says, one of each signature. What can't be read is left out."""
    frames, kept = [], set()
    for row in C.dedup_catalog(tables.catalog_scan(catalog)).orderBy("ord").collect():  # one row for each dataset
        raw = tables.read_or_none(spark, f"{datasets_dir}/{row['data_id']}.parquet")
        if raw is None:
            continue
        raw = raw.toDF(*tables.unique_names(raw.columns))
        keyed = raw if "row_id" in raw.columns else raw.withColumn("row_id", F.monotonically_increasing_id())
        ready = prepare(keyed, "row_id", row["data_id"])
        sizes = [] if ready is None else sorted(r["n"] for r in class_sizes(ready).collect())
        mark = (row["NumberOfClasses"], row["NumberOfInstances"], *sizes)
        if len(sizes) != row["NumberOfClasses"] or mark in kept:
            continue
        kept.add(mark)
        frames.append(ready.withColumn("name", F.lit(row["name"])))
    if not frames:
        raise ValueError("no dataset of the catalog can be used")
    return union_all(frames)


def aco_restarts(rows: DataFrame, ants: int = 50, rounds: int = 20, seed: int = 1, tasks: int = 32) -> DataFrame:
    """(row_id, y, cluster) of the best of ants * rounds independent restarts, which are dealt out to tasks. The dataset, which every ant needs whole, goes to each task as one row."""
    one = rows.agg(F.sort_array(F.collect_list(F.struct("row_id", "x", "y"))).alias("rows"))
    jobs = rows.sparkSession.range(tasks, numPartitions=tasks).withColumnRenamed("id", "task")
    total = ants * rounds

    def batches(frames):
        for frame in frames:
            for task, data in zip(frame["task"].to_pylist(), frame["rows"], strict=True):
                x, y = (data.values.field(name) for name in ("x", "y"))
                x = np.stack(x.to_numpy(zero_copy_only=False)).astype(float)
                sizes, d = np.unique(y.to_numpy(zero_copy_only=False), return_counts=True)[1], K.CosineSums(x)
                found = [(*aco_restart(x, d, sizes, seed + i), i) for i in range(int(task), total, tasks)]
                if found:
                    value, label, i = max(found, key=lambda r: (r[0], -r[2]))
                    yield pa.RecordBatch.from_pydict({"score": [value], "restart": [i], "labels": pa.array([label], pa.list_(pa.int64()))})

    best = jobs.crossJoin(F.broadcast(one)).mapInArrow(batches, "score double, restart bigint, labels array<bigint>")
    top = best.agg(F.max(F.struct("score", (-F.col("restart")).alias("r"), "labels")).alias("b")).select("b.labels")
    return one.crossJoin(F.broadcast(top)).select(F.explode(F.arrays_zip("rows", "labels")).alias("z")).select("z.rows.row_id", "z.rows.y", (F.col("z.labels") + 1).alias("cluster"))


def report(results: DataFrame) -> DataFrame:
    """(algorithm, name, metric, value): mean scores in long form, ready to plot."""
    grouped = results.groupBy("algorithm", "name").agg(*(F.avg(m).alias(m) for m in ("ARI", "AMI", "NMI")))
    return grouped.unpivot(["algorithm", "name"], ["ARI", "AMI", "NMI"], "metric", "value")


def ranking(results: DataFrame, metric: str = "Silhouette_mean") -> DataFrame:
    """(algorithm, value): mean of a metric, best first."""
    return results.groupBy("algorithm").agg(F.avg(metric).alias("value")).orderBy(F.col("value").desc(), "algorithm")
