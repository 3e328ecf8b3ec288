"""Column expressions over arrays and groups that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sqdist(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two numeric arrays, added up in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def project(matrix: Column, x: Column) -> Column:
    """Matrix (array of rows) times vector."""
    return F.transform(matrix, lambda row: dot(row, x))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def rounded(x: Column, digits: int) -> Column:
    """A double rounded as SQL engines round doubles: scaled, halves away from zero, the sign kept (-1e-9 gives -0.0).

    Spark's round goes through decimals, which have no -0.0.
    """
    scale = float(10**digits)
    y = F.abs(x) * scale
    whole = F.floor(y).cast("double")
    value = (whole + F.when(y - whole >= 0.5, 1.0).otherwise(0.0)) / scale
    return F.when(F.isnan(x) | (y >= float(2**52)), x).otherwise(F.signum(x) * value)


def upper_median_of(values: Column) -> Column:
    """v[n / 2] of the sorted array (the upper of the middle two), null if empty."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def upper_median(value: Column) -> Column:
    """Aggregate form of upper_median_of, for keys of a line's or a word's size; see upper_medians for others."""
    return upper_median_of(F.collect_list(value))


def upper_medians(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, name): upper_median for keys that may have any number of rows.

    Equal values are counted first, combined before the shuffle; the middle is found from running counts, so no key is
    gathered. Nulls don't count; a key without a value is left out.
    """
    n = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n_"))
    w = Window.partitionBy(*keys)
    n = n.withColumn("cum_", F.sum("n_").over(w.orderBy(value))).withColumn("half_", F.floor(F.sum("n_").over(w) / 2))
    return n.where((F.col("cum_") > F.col("half_")) & (F.col("cum_") - F.col("n_") <= F.col("half_"))).select(*keys, F.col(value).alias(name))


def resample(values: Column, n: int) -> Column:
    """Linear interpolation of an array at n evenly spaced places."""

    def at(i: Column) -> Column:
        place = i * (F.size(values) - 1) / F.lit(float(n - 1))
        low = F.floor(place).cast("int")
        a = F.get(values, low).cast("double")
        b = F.coalesce(F.get(values, low + 1), F.get(values, low)).cast("double")
        return a + (b - a) * (place - low)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)
