"""Centroids and distances to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from cardinal.functions.vectors import dot, norm, squared_distance

#: Points that go out to every task on one row; more go in blocks of about this many.
POINTS = 1000


def long_means(rows: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, pos, mean), pos from 0; sums are partial before the shuffle."""
    return rows.select(cluster, F.posexplode("x").alias("pos", "v")).groupBy(cluster, "pos").agg(F.avg("v").alias("mean"))


def means(rows: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, centroid)."""
    packed = F.sort_array(F.collect_list(F.struct("pos", "mean")))
    return long_means(rows, cluster).groupBy(cluster).agg(F.transform(packed, lambda p: p["mean"]).alias("centroid"))


def filled_means(rows: DataFrame, clusters: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """(cluster, pos, mean) for every cluster; an empty one gets its old centroid (cluster, pos, mean) or, without old, the mean of all rows."""
    own = long_means(rows)
    if old is None:
        spare = rows.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("spare"))
        grid = clusters.select("cluster").join(spare, F.lit(True))  # clusters x dimensions
    else:
        grid = old.withColumnRenamed("mean", "spare")
    return grid.join(own, ["cluster", "pos"], "left").select("cluster", "pos", F.coalesce("mean", "spare").alias("mean"))


def beside(rows: DataFrame, points: DataFrame) -> tuple[DataFrame, int]:
    """(rows with the array `points`, blocks): every point, as a struct of its columns, beside every row.

    Up to POINTS points are collected once and broadcast on one row. More are dealt to blocks of about that size by hash
    of `cluster`: a row meets one block at a time by an equi-join, salted by row_id, and comes once for each block.
    """
    spark, few = rows.sparkSession, points.limit(POINTS + 1).collect()
    if len(few) <= POINTS:
        one = spark.createDataFrame([([tuple(p) for p in few],)], StructType([StructField("points", ArrayType(points.schema))]))
        return rows.crossJoin(F.broadcast(one)), 1
    blocks, salts = -(-points.count() // POINTS), int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = points.groupBy(F.pmod(F.xxhash64("cluster"), F.lit(blocks)).alias("__block")).agg(F.collect_list(F.struct(*points.columns)).alias("points"))
    copies = packed.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64("row_id"), F.lit(salts)).cast("int")).withColumn("__block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    return dealt.hint("shuffle_hash").join(copies, ["__block", "__salt"]).select(*rows.columns, "points"), blocks


def _measured(rows: DataFrame, points: DataFrame, cluster: str, vector: str, kind: str, digits: int | None) -> tuple[DataFrame, int]:
    """Rows with the array `near` of (d, cluster) beside them. Lengths are taken before rows and points meet."""
    v = F.col(vector)
    met, blocks = beside(rows.withColumn("__length", norm(F.col("x"))), points.select(F.col(cluster).alias("cluster"), v.alias("v"), norm(v).alias("length")))

    def distance(p):
        if kind != "cosine":
            d = squared_distance(F.col("x"), p["v"])
            d = F.sqrt(d) if kind == "euclidean" else d
        else:
            lengths = F.col("__length") * p["length"]
            d = 1 - F.when(lengths > 0, dot(F.col("x"), p["v"]) / lengths)
        return F.struct((F.round(d, digits) if digits is not None else d).alias("d"), p["cluster"].alias("cluster"))

    return met.withColumn("near", F.transform("points", distance)).drop("points", "__length"), blocks


def distances(rows: DataFrame, points: DataFrame, cluster: str = "cluster", vector: str = "centroid", kind: str = "cosine", digits: int | None = None) -> DataFrame:
    """Adds (cluster, d) for each row and point."""
    each = _measured(rows, points, cluster, vector, kind, digits)[0].select(*rows.columns, F.explode("near").alias("__p"))
    return each.select(*rows.columns, F.col("__p.cluster").alias("cluster"), F.col("__p.d").alias("d"))


def nearest(rows: DataFrame, points: DataFrame, cluster: str = "cluster", vector: str = "centroid", kind: str = "cosine", digits: int | None = None) -> DataFrame:
    """Adds (cluster, d) of the nearest point; the smaller cluster wins ties. Both are null if no distance is defined. Row ids are unique."""
    met, blocks = _measured(rows, points, cluster, vector, kind, digits)
    best = met.withColumn("__best", F.array_min(F.filter("near", lambda p: p["d"].isNotNull()))).drop("near")
    if blocks > 1:
        others = [F.first(c).alias(c) for c in rows.columns if c != "row_id"]
        best = best.groupBy("row_id").agg(*others, F.min("__best").alias("__best"))
    return best.select(*rows.columns, F.col("__best.cluster").alias("cluster"), F.col("__best.d").alias("d"))


def moved(old: DataFrame, new: DataFrame) -> float:
    """The largest change of a coordinate."""
    both = old.withColumnRenamed("mean", "o").join(new, ["cluster", "pos"])
    return both.agg(F.max(F.abs(F.col("o") - F.col("mean")))).first()[0] or 0.0


def simplified_silhouette(rows: DataFrame, points: DataFrame) -> DataFrame:
    """(row_id, s): from the Euclidean distance to the own centroid and to the nearest other one; rows carry `own`."""
    met, blocks = _measured(rows.select("row_id", "x", "own"), points, "cluster", "centroid", "euclidean", None)
    least = lambda keep: F.array_min(F.transform(F.filter("near", keep), lambda p: p["d"]))
    ab = met.select("row_id", least(lambda p: p["cluster"] == F.col("own")).alias("a"), least(lambda p: p["cluster"] != F.col("own")).alias("b"))
    if blocks > 1:
        ab = ab.groupBy("row_id").agg(F.min("a").alias("a"), F.min("b").alias("b"))
    return ab.select("row_id", F.when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("s"))
