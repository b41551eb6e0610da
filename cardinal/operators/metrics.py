"""Agreement of two labellings: ARI, NMI and AMI (normalised by the larger entropy), from their contingency table."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contingency(labels: DataFrame, a: str = "y", b: str = "cluster") -> DataFrame:
    """(a, b, n)."""
    return labels.groupBy(a, b).agg(F.count("*").alias("n"))


def _pairs(c):
    return c * (c - 1) / 2


def ari(labels: DataFrame, a: str = "y", b: str = "cluster") -> DataFrame:
    """One row: ari."""
    table = contingency(labels, a, b)
    cells = table.agg(F.sum(_pairs(F.col("n"))).alias("s"), F.sum("n").alias("n"))
    rows = table.groupBy(a).agg(F.sum("n").alias("m")).agg(F.sum(_pairs(F.col("m"))).alias("sa"))
    columns = table.groupBy(b).agg(F.sum("n").alias("m")).agg(F.sum(_pairs(F.col("m"))).alias("sb"))
    one = cells.join(rows, F.lit(True)).join(columns, F.lit(True))  # one row each
    expected = F.col("sa") * F.col("sb") / _pairs(F.col("n"))
    most = (F.col("sa") + F.col("sb")) / 2
    return one.select(F.when(most == expected, 1.0).otherwise((F.col("s") - expected) / (most - expected)).alias("ari"))


def information(labels: DataFrame, a: str = "y", b: str = "cluster") -> DataFrame:
    """One row: n, ha, hb, mi (natural logarithms)."""
    table = contingency(labels, a, b)
    rows = table.groupBy(a).agg(F.sum("n").alias("na"))
    columns = table.groupBy(b).agg(F.sum("n").alias("nb"))
    total = table.agg(F.sum("n").alias("total"))

    def entropy(m: DataFrame, c: str, name: str) -> DataFrame:
        p = F.col(c) / F.col("total")
        return m.join(total, F.lit(True)).agg((-F.sum(p * F.log(p))).alias(name))

    n = F.col("n")
    mi = table.join(rows, a).join(columns, b).join(total, F.lit(True)).agg(F.sum(n / F.col("total") * F.log(n * F.col("total") / (F.col("na") * F.col("nb")))).alias("mi"))
    return total.withColumnRenamed("total", "n").join(entropy(rows, "na", "ha"), F.lit(True)).join(entropy(columns, "nb", "hb"), F.lit(True)).join(mi, F.lit(True))


def nmi(labels: DataFrame, a: str = "y", b: str = "cluster") -> DataFrame:
    most = F.greatest("ha", "hb")
    return information(labels, a, b).select(F.when(most > 0, F.col("mi") / most).otherwise(1.0).alias("nmi"))


def ami(labels: DataFrame, a: str = "y", b: str = "cluster") -> DataFrame:
    """The expected information under fixed marginals is a sum over (row, column, overlap).

    Overlaps further than 9.5 standard deviations and 30 from their mean have less than exp(-45) of the weight (Bernstein's
    bound), below double precision, and are left out: a cell has some 19 deviations of entries, not as many as a class has rows.
    """
    table = contingency(labels, a, b)
    rows = table.groupBy(a).agg(F.sum("n").alias("na"))
    columns = table.groupBy(b).agg(F.sum("n").alias("nb"))
    total = table.agg(F.sum("n").alias("total"))
    grid = rows.join(columns, F.lit(True)).join(total, F.lit(True))  # classes x clusters
    p, q, t = (F.col(c).cast("double") for c in ("na", "nb", "total"))
    mean, reach = p * q / t, 9.5 * F.sqrt(p / t * q * ((t - p) / t) * ((t - q) / F.greatest(t - 1, F.lit(1.0)))) + 30
    low = F.greatest(F.lit(1).cast("bigint"), F.col("na") + F.col("nb") - F.col("total"), F.floor(mean - reach))
    overlap = F.sequence(low, F.greatest(low, F.least(F.col("na"), F.col("nb"), F.ceil(mean + reach))))
    grid = grid.select("na", "nb", "total", F.explode(overlap).alias("o"))
    na, nb, n, o = (F.col(c) for c in ("na", "nb", "total", "o"))
    chance = F.exp(sum((log_factorial(x) for x in (na, nb, n - na, n - nb)), F.lit(0.0)) - sum((log_factorial(x) for x in (n, o, na - o, nb - o, n - na - nb + o)), F.lit(0.0)))
    expected = grid.agg(F.sum(o / n * F.log(n * o / (na * nb)) * chance).alias("emi"))
    most = F.greatest("ha", "hb")
    one = information(labels, a, b).join(expected, F.lit(True))
    return one.select(F.when(most == F.col("emi"), 1.0).otherwise((F.col("mi") - F.col("emi")) / (most - F.col("emi"))).alias("ami"))


def log_factorial(x):
    """log(x!) as a column: exact sums below 20, Stirling's series beyond (error under 1e-14)."""
    small = F.array(*(F.lit(math.lgamma(i + 1)) for i in range(21)))
    v = x.cast("double")
    series = v * F.log(v) - v + 0.5 * F.log(2 * math.pi * v) + 1 / (12 * v) - 1 / (360 * F.pow(v, 3)) + 1 / (1260 * F.pow(v, 5)) - 1 / (1680 * F.pow(v, 7))
    return F.when(x <= 20, F.element_at(small, F.least(x, F.lit(20)).cast("int") + 1)).otherwise(series)


def scores(y: np.ndarray, c: np.ndarray) -> tuple[float, float, float]:
    """(ARI, AMI, NMI) of two label arrays, for grouped kernels."""
    y, c = np.unique(y, return_inverse=True)[1], np.unique(c, return_inverse=True)[1]
    t = np.zeros((y.max() + 1, c.max() + 1), np.int64)
    np.add.at(t, (y, c), 1)
    n, a, b = len(y), t.sum(1), t.sum(0)
    pairs = lambda v: (v * (v - 1) / 2).sum()
    expected, most = pairs(a) * pairs(b) / max(n * (n - 1) / 2, 1), (pairs(a) + pairs(b)) / 2
    rand = 1.0 if most == expected else (pairs(t) - expected) / (most - expected)
    entropy = lambda v: -(v / n * np.log(v / n)).sum()
    h = max(entropy(a), entropy(b))
    i, j = np.nonzero(t)
    mi = (t[i, j] / n * np.log(n * t[i, j] / (a[i] * b[j]))).sum()
    lf = np.append(0.0, np.cumsum(np.log(np.arange(1, n + 1))))
    emi = 0.0
    for p in a:
        for q in b:
            o = np.arange(max(1, p + q - n), min(p, q) + 1)
            emi += (o / n * np.log(n * o / (p * q)) * np.exp(lf[p] + lf[q] + lf[n - p] + lf[n - q] - lf[n] - lf[o] - lf[p - o] - lf[q - o] - lf[n - p - q + o])).sum()
    return float(rand), 1.0 if h == emi else float((mi - emi) / (h - emi)), float(mi / h) if h > 0 else 1.0
