"""Global ranks without a single-partition window."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sampled keys for each partition, from which its borders are taken.
SAMPLE = 32


def global_rank(df: DataFrame, *order: Column, name: str = "rn") -> DataFrame:
    """Adds the 1-based rank in a total, ascending order (nulls first).

    Borders between ranges are fixed once, from a sample of SAMPLE keys for each partition, and are constants in the plan:
    the rows that are ranked within their range and those that are counted for the ranges before it are told apart by the
    same comparisons, however often the input is computed. Borders only decide how even the ranges are. No window holds
    more than one range, and the counts are one row for each.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [c.alias(f"k{i}") for i, c in enumerate(order)]
    sample = df.select(*keys).orderBy(F.rand(17)).limit(SAMPLE * parts).agg(F.sort_array(F.collect_list(F.struct(*(f"k{i}" for i in range(len(order)))))).alias("s"))
    found = sample.first()["s"]
    borders = [found[len(found) * i // parts] for i in range(1, parts)] if found else []
    ranged = df.withColumn("__part", _range_of(F.struct(*keys), borders, sample.schema["s"].dataType))
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    counts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    dealt = ranged.repartitionById(parts, F.col("__part"))
    local = dealt.withColumn("__local", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return local.join(F.broadcast(counts), "__part").withColumn(name, (F.col("__local") + F.col("__before")).cast("bigint")).drop("__part", "__local", "__before")


def _range_of(key: Column, borders: list, kind) -> Column:
    """The number of borders that aren't above the key, found in two steps: among every m-th border, then among the m after it."""
    if not borders:
        return F.lit(0)
    m = math.isqrt(len(borders)) + 1
    groups = [borders[i : i + m] for i in range(0, len(borders), m)]
    reached = lambda bounds: F.size(F.filter(bounds, lambda b: b <= key))
    array = lambda rows: F.array(*(F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, kind.elementType.fields, strict=True))) for row in rows))
    full = reached(array([g[-1] for g in groups]))  # groups that lie wholly below
    inside = F.element_at(F.array(*(array(g) for g in [*groups, []] if g), F.array().cast(kind)), full + 1)
    return (full * m + reached(inside)).cast("int")
