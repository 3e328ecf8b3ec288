"""Image statistics over cell and run rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlake.functions.arrays import upper_median_of
from scanlake.operators.layout import islands


def histogram(pixels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, v, n): counts by grey value, 256 rows a key at most."""
    return pixels.groupBy(*keys, F.col(value).cast("int").alias("v")).agg(F.count("*").alias("n"))


def otsu(hist: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, threshold): the first value with the greatest between-class variance, among those that leave something above; 128 without one."""
    w, all_ = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    n, s = F.sum("n").over(w).cast("double"), F.sum(F.col("n") * F.col("v")).over(w).cast("double")
    total, mass = F.sum("n").over(all_), F.sum(F.col("n") * F.col("v")).over(all_)
    d = hist.select(*keys, "v", n.alias("n_bg"), s.alias("s_bg"), total.alias("total"), mass.alias("mass")).withColumn("n_fg", F.col("total") - F.col("n_bg"))
    gap = F.col("s_bg") / F.col("n_bg") - (F.col("mass") - F.col("s_bg")) / F.nullif(F.col("n_fg"), F.lit(0.0))
    var = F.when(F.col("n_fg") > 0, F.col("n_bg") * F.col("n_fg") * gap * gap)
    return d.groupBy(*keys).agg(F.coalesce(F.min_by("v", F.when(var > 0, F.struct((-F.round(var, 6)).alias("a"), F.col("v").alias("b")))), F.lit(128)).alias("threshold"))


def border_mean(cells: DataFrame, keys: list[str], x: str, y: str, channels: list[str], border: int = 5) -> DataFrame:
    """Mean of each channel over the border ring, by integer division; white without cells there.

    The ring is ``border`` wide, but no wider than a quarter of either side, and 1 at least.
    """
    box = Window.partitionBy(*keys)
    d = cells.withColumn("mx_", F.max(x).over(box)).withColumn("my_", F.max(y).over(box))
    quarter = F.floor((F.least("mx_", "my_") + 1) / 4)
    d = d.withColumn("ring_", F.greatest(F.lit(1), F.least(F.lit(border), quarter)))
    ring = (F.col(x) < F.col("ring_")) | (F.col(y) < F.col("ring_")) | (F.col(x) > F.col("mx_") - F.col("ring_")) | (F.col(y) > F.col("my_") - F.col("ring_"))
    mean = lambda c: F.coalesce(F.floor(F.sum(F.when(ring, F.col(c))) / F.nullif(F.count_if(ring), F.lit(0))), F.lit(255)).cast("int")
    return d.groupBy(*keys).agg(*[mean(c).alias(c) for c in channels])


def has_content(cells: DataFrame, keys: list[str], value: str, least: float = 100.0) -> DataFrame:
    """Whether the population variance of a region's grey values is above ``least``."""
    return cells.groupBy(*keys).agg((F.var_pop(value) > least).alias("has_content"), F.count("*").alias("n"))


def contrast_percentiles(hist: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p1, p99): the first values with a hundredth and 99 hundredths of the pixels at or below; null if they don't differ.

    The hundredths are whole pixels, so below 100 pixels the first is none and p1 is 0.
    """
    w = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    d = hist.withColumn("cum", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    low = F.min(F.when(F.col("cum") >= F.floor(F.col("total") / 100), F.col("v")))
    found = d.groupBy(*keys).agg(F.when(F.max("total") < 100, 0).otherwise(low).alias("p1"), F.min(F.when(F.col("cum") >= F.floor(99 * F.col("total") / 100), F.col("v"))).alias("p99"))
    ok = F.col("p1") < F.col("p99")
    return found.select(*keys, F.when(ok, F.col("p1")).alias("p1"), F.when(ok, F.col("p99")).alias("p99"))


def runs(cells: DataFrame, keys: list[str], order: list[str], on: Column, least: int) -> DataFrame:
    """(keys, first, last, length): stretches of ``least`` cells or more where ``on`` holds."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = cells.withColumn("on_", on).withColumn("i_", F.row_number().over(w)).where("on_").withColumn("g_", F.col("i_") - F.row_number().over(w))
    return d.groupBy(*keys, "g_").agg(F.min("i_").alias("first"), F.max("i_").alias("last"), F.count("*").alias("length")).where(F.col("length") >= least).drop("g_")


def stroke_contrast(lengths: DataFrame, keys: list[str], value: str) -> DataFrame:
    """1 - p10 / p90 of a glyph's sorted run lengths (places n/10 and 9n/10, 1 at least); 1 for fewer than 4 runs."""
    r = F.sort_array(F.collect_list(value))
    d = lengths.groupBy(*keys).agg(r.alias("r"))
    at = lambda share: F.greatest(F.get("r", F.floor(share * F.size("r") / 10).cast("int")), F.lit(1))
    return d.select(*keys, F.when(F.size("r") < 4, 1.0).otherwise(1 - at(1) / at(9)).alias("contrast"), upper_median_of(F.col("r")).alias("median_run"))


def fill_cells(pixels: DataFrame, x: str, y: str, value: str, keys: list[str], side: int = 50, most: float = 60.0) -> DataFrame:
    """Cells of ``side`` x ``side`` pixels whose values vary less than ``most``, with their mean."""
    d = pixels.groupBy(*keys, F.floor(F.col(x) / side).alias("cx"), F.floor(F.col(y) / side).alias("cy")).agg(F.avg(value).alias("mean"), F.var_pop(value).alias("var"), F.count("*").alias("n"))
    return d.where(F.col("var") < most).drop("var")


def symmetry(cells: DataFrame, keys: list[str], place: str, ink: str, size: str) -> DataFrame:
    """Share of pixels equal to their mirror image, the middle left out; 0 for a side below 2."""
    mirror = cells.select(*keys, (F.col(size) - 1 - F.col(place)).alias(place), F.col(ink).alias("other_"))
    both = cells.join(mirror, [*keys, place]).where(2 * F.col(place) + 1 < F.col(size))
    share = both.groupBy(*keys).agg(F.avg((F.col(ink) == F.col("other_")).cast("double")).alias("symmetry"))
    return cells.select(*keys).distinct().join(share, keys, "left").withColumn("symmetry", F.coalesce("symmetry", F.lit(0.0)))


def quadrant_density(cells: DataFrame, keys: list[str], x: str, y: str, ink: str, width: str, height: str) -> DataFrame:
    """(keys, quadrant, density): share of ink of each quadrant, split at half the sides."""
    q = F.when(F.col(y) < F.floor(F.col(height) / 2), 0).otherwise(2) + F.when(F.col(x) < F.floor(F.col(width) / 2), 0).otherwise(1)
    return cells.groupBy(*keys, q.alias("quadrant")).agg(F.avg(F.col(ink).cast("double")).alias("density"))


def crossings(cells: DataFrame, keys: list[str], row: str, x: str, ink: str) -> DataFrame:
    """(keys, row, crossings): changes of ink along a row over 20, 1 at most."""
    w = Window.partitionBy(*keys, row).orderBy(x)
    d = cells.withColumn("c_", (F.lag(ink).over(w) != F.col(ink)).cast("int"))
    return d.groupBy(*keys, row).agg(F.least(F.lit(1.0), F.coalesce(F.sum("c_"), F.lit(0)) / 20).alias("crossings"))


def clean_runs(columns: DataFrame, keys: list[str], x: str, ink: str) -> DataFrame:
    """Number of inkless stretches strictly between inked columns."""
    w = Window.partitionBy(*keys).orderBy(x)
    d = islands(columns, keys, [x], F.lag(ink).over(w).isNull() | (F.lag(ink).over(w) != F.col(ink)), "g_")
    edge = Window.partitionBy(*keys)
    inside = (~F.col(ink)) & (F.col("g_") > F.min("g_").over(edge)) & (F.col("g_") < F.max("g_").over(edge))
    return d.withColumn("in_", F.when(inside, F.col("g_"))).groupBy(*keys).agg(F.count_distinct("in_").alias("clean_runs"))
