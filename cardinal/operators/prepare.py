"""From raw columns to features and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.NumericType, T.BooleanType)


def target_column(columns: list[str]) -> str | None:
    """`class` if there is one, else the last column; None if there are fewer than two columns."""
    if len(columns) < 2:
        return None
    return "class" if "class" in columns else columns[-1]


def level_codes(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the 1-based place of the value among the column's sorted values; null stays null. Only the distinct values are ranked."""
    levels = df.select(F.col(column).alias("__level")).where("__level is not null").distinct()
    levels = levels.withColumn(name, F.row_number().over(Window.orderBy("__level")).cast("bigint"))
    return df.join(levels, F.col(column) == F.col("__level"), "left").drop("__level")


def numeric_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numbers and booleans as doubles, strings as level codes, other types dropped."""
    for c in columns:
        kind = df.schema[c].dataType
        if isinstance(kind, NUMERIC):
            df = df.withColumn(c, F.col(c).cast("double"))
        elif isinstance(kind, T.StringType):
            df = level_codes(df, c, f"__code_{c}").withColumn(c, F.col(f"__code_{c}").cast("double")).drop(f"__code_{c}")
        else:
            df = df.drop(c)
    return df


def column_variety(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_distinct): distinct values of each column; null counts as one."""
    found = df.agg(*(F.struct(F.count_distinct(c).alias("n"), F.max(F.col(c).isNull().cast("int")).alias("null")).alias(c) for c in columns))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), (F.col(f"{c}.n") + F.coalesce(F.col(f"{c}.null"), F.lit(0))).cast("bigint").alias("n_distinct")) for c in columns)))
    return found.select(rows.alias("r")).select("r.*")


def drop_constant(df: DataFrame, columns: list[str]) -> DataFrame | None:
    """df without the constant ones of the columns; None if none is left."""
    kept = {r["column"] for r in column_variety(df, columns).where("n_distinct > 1").collect()}
    return df.drop(*(c for c in columns if c not in kept)) if kept else None


def prepare(df: DataFrame, row_id: str, data_id: int = 0) -> DataFrame | None:
    """(data_id, row_id, x, y, y_code) of a raw table; None if it has no target or no feature that varies."""
    columns = [c for c in df.columns if c != row_id]
    target = target_column(columns)
    if target is None:
        return None
    features = [c for c in columns if c != target]
    numeric = numeric_features(df, features)
    left = [c for c in features if c in numeric.columns]
    numeric = drop_constant(numeric, left) if left else None
    if numeric is None:
        return None
    x = F.array(*(F.col(c) for c in left if c in numeric.columns))
    coded = level_codes(numeric.withColumn(target, F.col(target).cast("string")), target, "y_code")
    return coded.select(F.lit(data_id).cast("bigint").alias("data_id"), F.col(row_id).alias("row_id"), x.alias("x"), F.col(target).alias("y"), "y_code")


def class_sizes(df: DataFrame, label: str = "y") -> DataFrame:
    """(label, n) without nulls."""
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))


def eligible(sizes: list[int] | None, n: int) -> bool:
    """Whether required sizes can be met: two clusters or more, none unknown, and as many rows as they ask for."""
    return bool(sizes) and len(sizes) >= 2 and all(s is not None for s in sizes) and sum(sizes) == n


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
