"""Every registered clustering query against its SQL, and operators on made-up rows."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from cardinal.functions import text as T
from cardinal.functions.ranking import global_rank
from cardinal.functions.vectors import cosine_distance
from cardinal.operators import buckets, catalog, centroids, metrics, pairs, prepare, sampling
from cardinal.plans import queries, runner
from cardinal.sources import tables

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, data, duck, name):
    df = queries.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    cursor = duck.execute(queries.ORACLES[name])
    own = [d[0] for d in cursor.description]
    assert sorted(own) == columns
    expected = sorted(repr(tuple(r[own.index(c)] for c in columns)) for r in cursor.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == expected


def test_runner_isolates_errors(spark):
    rows = [(d, f"set{d}", i, [float(i % 3), float(i)], 1 + i % 2 if d else 1) for d in (0, 1) for i in range(8)]
    datasets = spark.createDataFrame(rows, "data_id bigint, name string, row_id bigint, x array<double>, y_code bigint")
    found = {(r["algorithm"], r["data_id"]): r for r in runner.run(datasets, ["SCK1", "HCAKC"]).collect()}
    assert len(found) == 4
    assert all(found[a, 0]["error"] and found[a, 1]["error"] is None for a in ("SCK1", "HCAKC"))
    assert found["SCK1", 1]["cardinality_pred"] == found["SCK1", 1]["target_cardinality"] == "4 4"


def test_row_order_and_partitions_do_not_matter(spark, data):
    rows = tables.embeddings(spark, data)
    expected = {tuple(r) for r in queries.filled(rows).select("row_id", "cluster").collect()}
    dealt = rows.orderBy(F.xxhash64("row_id")).repartition(7)
    assert {tuple(r) for r in queries.filled(dealt).select("row_id", "cluster").collect()} == expected


def test_empty_cluster_and_ties(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(5)], "row_id bigint, d double")
    sizes = spark.createDataFrame([(1, 2), (2, 0), (3, 3)], "cluster bigint, size bigint")
    out = {r["row_id"]: r["cluster"] for r in buckets.fill(df, sizes, F.col("d"), F.col("row_id")).collect()}
    assert out == {0: 1, 1: 1, 2: 3, 3: 3, 4: 3}


def test_global_rank_with_carried_columns(spark, tmp_path):
    n, parts = 3_000_000, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    try:
        df = spark.range(n, numPartitions=8).select((F.xxhash64("id") % 1000).alias("a"), "id", F.concat(F.lit("carried "), F.col("id")).alias("text"))
        global_rank(df, F.col("a"), F.col("id")).write.parquet(f"{tmp_path}/ranked")
        ranked = spark.read.parquet(f"{tmp_path}/ranked")
        assert ranked.agg(F.count("*"), F.min("rn"), F.max("rn"), F.countDistinct("rn")).first() == (n, 1, n, n)
        both = ranked.select("rn", F.struct("a", "id").alias("k")).where("rn % 1000 < 2")
        pairs = both.alias("x").join(both.alias("y"), F.expr("x.rn + 1 = y.rn"))
        assert pairs.count() == n // 1000 - 1 and pairs.where("x.k >= y.k").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_global_rank_edges(spark):
    empty = spark.createDataFrame([], "v bigint, w string")
    assert global_rank(empty, F.col("v")).count() == 0
    few = spark.createDataFrame([(None, "b"), (2, "a"), (None, "a"), (1, None), (1, "x")], "v bigint, w string")
    assert [tuple(r) for r in global_rank(few, F.col("v"), F.col("w")).orderBy("rn").collect()] == [(None, "a", 1), (None, "b", 2), (1, None, 3), (1, "x", 4), (2, "a", 5)]


def test_many_rows_without_a_matrix(spark):
    n = 200_000  # rows x rows would be 320 GB
    datasets = spark.range(n).selectExpr("0L AS data_id", "'set0' AS name", "id AS row_id", "array(double(id % 3 + 1), double(id % 7)) AS x", "1 + id % 2 AS y_code")
    out = runner.run(datasets, ["HCAKC"]).first()
    assert out["error"] is None and out["k"] == 2 and out["cardinality_pred"] == f"{n // 2} {n // 2}" and abs(out["Silhouette_mean"]) < 1e-3


def test_restarts_without_a_matrix(spark):
    n = 200_000
    rows = spark.range(n).selectExpr("id AS row_id", "array(double(id % 3 + 1), double(id % 7)) AS x", "id % 2 AS y")
    out = runner.aco_restarts(rows, ants=1, rounds=2, tasks=2)
    assert {tuple(r) for r in out.groupBy("cluster").count().collect()} == {(1, n // 2), (2, n // 2)}
    assert out.agg(F.countDistinct("row_id")).first()[0] == n and out.where("y != row_id % 2").count() == 0


def test_menu_writes_predictions_and_a_log(spark, tmp_path):
    rows = [(0, "set0", i, [float(i % 3), float(i)], 1 + i % 2) for i in range(8)]
    datasets = spark.createDataFrame(rows, "data_id bigint, name string, row_id bigint, x array<double>, y_code bigint")
    out = runner.execute(datasets, 6, str(tmp_path)).collect()
    assert [r["algorithm"] for r in out] == ["HCAKC"] and out[0]["hyperparams"]["seed"] == "0"
    back = tables.read_predictions(spark, f"{tmp_path}/pred_HCAKC.csv").collect()
    assert [(r["algorithm"], r["ARI"]) for r in back] == [("HCAKC", out[0]["ARI"])]
    log = spark.read.parquet(f"{tmp_path}/resource_log").first()
    assert log["Algoritmo"] == "HCAKC" and log["Elapsed_Time_sec"] > 0 and log["Peak_RAM_Used_MiB"] > 0
    assert [runner.ALGORITHMS[n][0] for n in range(1, 9)] == ["BAT", "CSCLP", "KMEDOIDS", "ACO", "PSO", "HCAKC", "KM-MILP", "SCK1"]


def test_catalog_to_datasets(spark, tmp_path):
    for k, classes in ((1, 3), (2, 2), (3, 2), (4, 2)):
        data = [(i, float(i), float(i % 7), float(i % 5), float(i % 3), str(i % classes)) for i in range(160 if k != 3 else 170)]
        if k != 4:
            spark.createDataFrame(data, "row_id bigint, a double, b double, c double, d double, class string").write.parquet(f"{tmp_path}/{k}.parquet")
    catalog = spark.createDataFrame([(1, 1, "one", 3, 160, 4, 0, 0), (2, 2, "two", 3, 161, 4, 0, 0), (3, 3, "three", 2, 170, 4, 0, 0), (4, 4, "four", 2, 180, 4, 0, 0), (5, 5, "big", 2, 999, 4, 0, 0)],
        "ord bigint, data_id bigint, name string, NumberOfClasses int, NumberOfInstances int, NumberOfFeatures int, NumberOfSymbolicFeatures int, NumberOfMissingValues int")
    found = runner.load_datasets(spark, catalog, str(tmp_path))
    assert {tuple(r) for r in found.groupBy("data_id", "name").count().collect()} == {(1, "one", 160), (3, "three", 170)}
    assert runner.run(found, ["HCAKC"]).where("error is null").count() == 2


#: Contingency tables of published labellings, with their ARI, AMI and NMI.
PUBLISHED = [
    ([[44, 3, 3], [4, 37, 9], [2, 10, 38]], 0.486710204081633, 0.433855467465025, 0.440853075155304),
    ([[31, 88], [88, 43]], 0.163114039257262, 0.123629706187536, 0.126177994695471),
    ([[132, 12, 6], [10, 23, 2], [8, 0, 22]], 0.490383419060191, 0.35939665931007, 0.366986173192086),
    ([[50, 0, 0], [0, 47, 3], [0, 3, 47]], 0.885665306122449, 0.860546511692628, 0.86227017189976),
    ([[61, 58], [58, 73]], 0.00118585889242056, 0.000622231051561558, 0.00352819774358502),
    ([[54, 65], [65, 66]], -0.00241254511568703, -0.00161282579036666, 0.00129963994630161),
    ([[150, 0, 0], [0, 35, 0], [0, 0, 30]], 1, 1, 1),
]


@pytest.mark.parametrize("published", PUBLISHED)
def test_metrics_equal_published_scores(spark, published):
    import numpy as np

    from cardinal.operators.metrics import scores

    cells, ari, ami, nmi = published
    y, c = (np.array(x) for x in zip(*((i, j) for i, row in enumerate(cells) for j, n in enumerate(row) for _ in range(n)), strict=True))
    ours = scores(y, c)
    assert (ours[0], ours[2]) == pytest.approx((ari, nmi), abs=1e-12) and ours[1] == pytest.approx(ami, abs=1e-7)
    df = spark.createDataFrame(list(zip(y.tolist(), c.tolist(), strict=True)), "y int, cluster int")
    assert metrics.ari(df).first()[0] == pytest.approx(ari, abs=1e-9) and metrics.nmi(df).first()[0] == pytest.approx(nmi, abs=1e-9)
    assert metrics.ami(df).first()[0] == pytest.approx(ami, abs=1e-7)


def test_id_and_name_columns():
    assert tables.id_column(["x", "dataset_id", "data_id"]) == "data_id" and tables.name_column(["data_name"]) == "data_name"
    with pytest.raises(ValueError):
        tables.id_column(["id"])


def test_global_rank(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v"))
    assert all(r["rn"] == r["v"] + 1 for r in global_rank(df, F.col("v")).collect())


@pytest.mark.parametrize("n", [3, 4, 9, 50, 200])
def test_quotas_are_exact(spark, n):
    rows = [(i, None if i % 10 == 0 else "abc"[i % 3]) for i in range(100)]
    df = spark.createDataFrame(rows, "id bigint, y string")
    if n > 3:
        got = sampling.stratified_sample(df, "y", "id", n, 1).groupBy("y").count().collect()
        assert sum(r["count"] for r in got) == min(n, 100) and len(got) == 4
    assert sampling.sample_dataset(df, "y", "id", n, 1).count() == min(n, 100)
    assert sampling.random_sample_by_rank(df, "id", n, 1).count() == min(n, 100)


def test_prepare(spark):
    rows = [(1, "b", True, 1.0, 7, "x"), (2, "a", False, None, 7, "y"), (3, "b", None, 1.0, 7, "x")]
    df = spark.createDataFrame(rows, "row_id bigint, s string, flag boolean, v double, fixed int, class string")
    out = {r["row_id"]: (r["x"], r["y_code"]) for r in prepare.prepare(df, "row_id").collect()}
    assert out == {1: ([2.0, 1.0, 1.0], 1), 2: ([1.0, 0.0, None], 2), 3: ([2.0, None, 1.0], 1)}
    assert prepare.prepare(df.select("row_id", "fixed", "class"), "row_id") is None
    assert prepare.prepare(df.select("row_id", "class"), "row_id") is None
    assert prepare.target_column(["a", "class", "b"]) == "class" and prepare.target_column(["a", "b"]) == "b"


def test_catalog_shadowing(spark):
    rows = [(1, "A", 2, 10, 5, 0), (2, "B", 2, 10, 0, 0), (3, "c", 3, 9, 1, 0), (4, "C", 3, 8, 0, 0), (5, "d", 4, 4, None, 0)]
    df = spark.createDataFrame(rows, "ord bigint, name string, NumberOfClasses int, NumberOfInstances int, NumberOfSymbolicFeatures int, NumberOfMissingValues int")
    assert [r["ord"] for r in catalog.dedup_catalog(df).collect()] == [3]  # 1 hides 2 and is dropped, 3 hides 4


def test_resolution(spark):
    known = spark.createDataFrame([(1, "mnist_784", "active", 1), (2, "mnist_784", "active", 2), (3, "mnist_784", "old", 3), (4, "Fashion-MNIST", "active", 1)], "data_id bigint, name string, status string, version int")
    asked = spark.createDataFrame([("mnist",), ("moda-mnist",), ("554",), ("nothing",)], "query string")
    assert {tuple(r) for r in catalog.resolve(asked, known).collect()} == {("mnist", 2), ("moda-mnist", 4), ("554", 554)}


def test_strings(spark):
    one = spark.createDataFrame([("  A-b C!! ", "x, y")], "a string, t string")
    r = one.select(T.slugify(F.col("a")), T.normalize_key(F.col("a")), T.first_target(F.col("t"))).first()
    assert tuple(r) == ("a_b_c", "abc!!", "x")


def test_unsigned_silhouette_equals_pairs(spark, data):
    rows = tables.embeddings(spark, data).where("row_id < 60").withColumn("cluster", F.col("y"))
    import numpy as np

    from cardinal.operators import kernels as K

    pdf = rows.orderBy("row_id").toPandas()
    x, label = np.stack(pdf.x.to_numpy()), np.unique(pdf.cluster, return_inverse=True)[1]
    for signed in (True, False):
        mean = pairs.silhouette(rows, signed).agg(F.avg("s")).first()[0]
        assert mean == pytest.approx(K.silhouette_mean(K.cosine_matrix(x, signed=signed), label, label.max() + 1))
    small = pairs.cosine_pairs(rows, block_rows=16)
    assert small.count() == 60 * 59 // 2


def test_many_points_in_blocks(spark, data, monkeypatch):
    rows = tables.embeddings(spark, data).where("row_id < 60")
    labelled = rows.withColumn("cluster", F.col("y"))

    def found():
        points = queries.first_rows(rows)
        near = centroids.nearest(rows, points, digits=9).drop("x")
        own = rows.withColumn("own", F.col("y") + 1)
        simple = centroids.simplified_silhouette(own, centroids.means(own, "own").withColumnRenamed("own", "cluster"))
        frames = near, centroids.distances(rows, points, digits=9).drop("x"), simple.withColumn("s", F.round("s", 9)), pairs.silhouette(labelled).withColumn("s", F.round("s", 9))
        return [sorted(map(tuple, f.collect())) for f in frames]

    expected = found()
    monkeypatch.setattr(centroids, "POINTS", 3)
    assert found() == expected and len(expected[0]) == 60


def test_pairs_round_once_and_copy_no_rows(spark, tmp_path, monkeypatch):
    near = [0.1234564999997, 0.1234565000003, 0.9999994999998, 1e-6]
    made = [(0, [1.0, 0.0], 0), *((i + 1, [1 - d, (1 - (1 - d) ** 2) ** 0.5], 0) for i, d in enumerate(near))]
    spark.createDataFrame(made, "vec_id bigint, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    expected = sorted(con.execute(queries.ORACLES["pairwise_cosine"]).fetchall())
    assert [d for _, _, d in expected[:4]] == [0.123456, 0.123457, 0.999999, 0.000001]
    assert sorted(map(tuple, queries.QUERIES["pairwise_cosine"](spark, str(tmp_path)).collect())) == expected
    odd = spark.createDataFrame([*made, (9, [0.0, 0.0], 0), (10, None, 0), (11, [None, 1.0], 0)], "row_id bigint, x array<double>, y int")
    monkeypatch.setattr(pairs, "BROADCAST_VALUES", 5)  # several broadcasts
    for rows in (1, 2, 3, 100):
        out = pairs.cosine_pairs(odd, block_rows=rows, digits=6)
        assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()  # no row goes out once for each block
        found = {(r["i"], r["j"]): r["d"] for r in out.collect()}
        assert len(found) == out.count() == 28 and sum(d is None for d in found.values()) == 18
        assert sorted((*k, d) for k, d in found.items() if d is not None) == expected
    assert pairs.cosine_pairs(odd.limit(0)).count() == 0


def test_pairs_go_out_in_order_of_distance(spark, tmp_path, monkeypatch):
    import glob

    import numpy as np
    import pyarrow.parquet as pq

    x = np.random.default_rng(3).normal(size=(700, 5))
    x[7] = 0
    rows = spark.createDataFrame([(i * 3 - 900, v.tolist()) for i, v in enumerate(x)], "row_id bigint, x array<double>")
    pairs.cosine_pairs(rows, digits=3).write.option("parquet.enable.dictionary", "false").parquet(f"{tmp_path}/out")
    files = [pq.ParquetFile(f) for f in glob.glob(f"{tmp_path}/out/*.parquet")]
    chunks = [f.metadata.row_group(g).column(2) for f in files for g in range(f.metadata.num_row_groups)]
    assert sum(c.num_values for c in chunks) == 700 * 699 // 2
    assert sum(c.total_compressed_size for c in chunks) < 2 * 700 * 699 // 2  # bytes of distances; not as they come, 8 each when they are many
    for f in files:
        d = f.read(["d"])["d"].to_numpy()
        assert (np.diff(d[~np.isnan(d)]) >= 0).all()
    small = rows.where("row_id < -630")
    met = small.alias("a").join(small.alias("b"), F.expr("a.row_id < b.row_id"))
    expected = sorted(map(tuple, met.select("a.row_id", "b.row_id", cosine_distance(F.col("a.x"), F.col("b.x"))).collect()), key=lambda r: r[:2])
    for most, row_bits, met_bits in ((40, 3, 4), (200, 2, 2), (1 << 20, 4, 7)):  # sorted in many groups, blocks cut
        monkeypatch.setattr(pairs, "SORTED_PAIRS", most)
        monkeypatch.setattr(pairs, "ROW_BITS", row_bits)
        monkeypatch.setattr(pairs, "MET_BITS", met_bits)
        for size in (16, 100):
            found = sorted(map(tuple, pairs.cosine_pairs(small, block_rows=size).collect()), key=lambda r: r[:2])
            assert [r[:2] for r in found] == [r[:2] for r in expected] and len(found) == 90 * 89 // 2
            assert all((r[2] is None) == (e[2] is None) and (r[2] is None or abs(r[2] - e[2]) < 1e-9) for r, e in zip(found, expected, strict=True))


def test_vectors_without_direction(spark):
    made = [(0, [0.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [0.0, 1.0], 2), (4, [0.0, 0.0], 3)]
    rows = spark.createDataFrame(made, "row_id bigint, x array<double>, cluster bigint")
    points = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 3.0])], "cluster bigint, centroid array<double>")
    near = {r["row_id"]: (r["cluster"], r["d"]) for r in centroids.nearest(rows.drop("cluster"), points).collect()}
    assert near == {0: (None, None), 1: (2, 1.0), 2: (2, 1.0), 3: (2, 0.0), 4: (None, None)}
    assert {r["row_id"]: r["s"] for r in pairs.silhouette(rows).collect()} == {0: None, 1: 1.0, 2: 1.0, 3: 0.0, 4: None}
    assert {r["cluster"]: r["cost"] for r in pairs.within_cost(rows).collect()} == {1: 0.0, 2: 0.0}
    none = centroids.nearest(rows.drop("cluster"), points.limit(0)).collect()
    assert len(none) == 5 and all(r["cluster"] is None for r in none)


def test_metrics_on_unequal_sizes(spark):
    df = spark.createDataFrame([(a, b) for a, b in zip([0, 0, 0, 1, 1, 1], [0, 0, 1, 1, 2, 2], strict=True)], "y int, cluster int")
    from cardinal.operators.metrics import scores

    expected = scores(*(__import__("numpy").array(x) for x in ([0, 0, 0, 1, 1, 1], [0, 0, 1, 1, 2, 2])))
    got = [metrics.ari(df).first()[0], metrics.ami(df).first()[0], metrics.nmi(df).first()[0]]
    assert got == pytest.approx(expected)


def test_names_and_config(tmp_path, spark):
    assert tables.unique_names(["x", "y", "x", "x", "x.1"]) == ["x", "y", "x.2", "x.3", "x.1"]
    config = tables.load_config('{"groups": {"1": ["mnist"]}, "defaults": {"max_rows": 5}}')
    assert config["defaults"] == {"max_rows": 5, "output_dir": "samples", "random_state": 42}
    tables.append_log(spark, f"{tmp_path}/log", "f", 1.5, "SCK1")
    tables.append_log(spark, f"{tmp_path}/log", "g", 2.5, "PSO")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 2
    assert tables.read_or_none(spark, f"{tmp_path}/missing") is None


def test_entry_without_the_training_operators(monkeypatch):
    import importlib
    import sys

    for name in [m for m in sys.modules if m.startswith(("cardinal.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "cardinal.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(queries.QUERIES) and set(entry.oracle_sql()) == set(queries.ORACLES)
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_sampler(spark, tmp_path):
    from cardinal.plans import sampler

    spark.createDataFrame([(7, "Toy-set", "active", 1)], "data_id bigint, name string, status string, version int").write.parquet(f"{tmp_path}/catalog")
    spark.createDataFrame([(i, float(i % 7), "ab"[i % 4 == 0]) for i in range(80)], "row_id bigint, v double, class string").write.parquet(f"{tmp_path}/7.parquet")
    (tmp_path / "c.json").write_text('{"groups": {"1": ["toy_set", "missing"]}, "defaults": {"max_rows": 20}}')
    sampler.main(["--catalog", f"{tmp_path}/catalog", "--datasets-dir", str(tmp_path), "--config", f"{tmp_path}/c.json", "--group", "1", "--output-dir", f"{tmp_path}/out"])
    done = {r["query"]: r for r in spark.read.json(f"{tmp_path}/out/summary.json").collect()}
    assert done["toy_set"]["sample_rows"] == 20 and done["toy_set"]["n_classes"] == 2 and done["missing"]["error"]
    counts = {r["class"]: r["count"] for r in spark.read.parquet(f"{tmp_path}/out/7.parquet").groupBy("class").count().collect()}
    assert counts == {"a": 15, "b": 5}
