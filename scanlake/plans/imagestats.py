"""Queries of the image statistics; tables stand in for pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlake.functions import scores
from scanlake.operators import imagestats as I
from scanlake.queries import register
from scanlake.session import table

PX_SQL = "px AS (SELECT l_returnflag AS region, CAST(l_quantity AS INTEGER) * 5 AS v, l_orderkey, l_linenumber, l_partkey FROM lineitem), h AS (SELECT region, v, count(*) AS n FROM px GROUP BY region, v)"


def px(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("region"), (F.col("l_quantity").cast("int") * 5).alias("v"))


@register("histogram_256", f"WITH {PX_SQL} SELECT region, v, CAST(n AS BIGINT) AS n FROM h")
def histogram_256(spark, sf_dir):
    return I.histogram(px(spark, sf_dir), ["region"], "v")


@register(
    "otsu_threshold",
    f"""WITH {PX_SQL}, c AS (SELECT region, v, CAST(sum(n) OVER w AS DOUBLE) AS nb, CAST(sum(n * v) OVER w AS DOUBLE) AS sb, sum(n) OVER (PARTITION BY region) AS total, sum(n * v) OVER (PARTITION BY region) AS mass FROM h WINDOW w AS (PARTITION BY region ORDER BY v ROWS UNBOUNDED PRECEDING)),
    f AS (SELECT region, v, round(nb * (total - nb) * (sb / nb - (mass - sb) / (total - nb)) * (sb / nb - (mass - sb) / (total - nb)), 6) AS var FROM c WHERE total > nb)
    SELECT region, v AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY var DESC, v) AS k FROM f) WHERE k = 1""",
)
def otsu_threshold(spark, sf_dir):
    return I.otsu(I.histogram(px(spark, sf_dir), ["region"], "v"), ["region"])


@register("contrast_percentiles", f"WITH {PX_SQL}, c AS (SELECT region, v, sum(n) OVER (PARTITION BY region ORDER BY v) AS cum, sum(n) OVER (PARTITION BY region) AS total FROM h), p AS (SELECT region, CASE WHEN max(total) < 100 THEN 0 ELSE min(CASE WHEN cum >= total // 100 THEN v END) END AS p1, min(CASE WHEN cum >= 99 * total // 100 THEN v END) AS p99 FROM c GROUP BY region) SELECT region, CASE WHEN p1 < p99 THEN p1 END AS p1, CASE WHEN p1 < p99 THEN p99 END AS p99 FROM p")
def contrast_percentiles(spark, sf_dir):
    return I.contrast_percentiles(I.histogram(px(spark, sf_dir), ["region"], "v"), ["region"])


CELLS_SQL = "c AS (SELECT p_brand, CAST(p_partkey % 50 AS INTEGER) AS x, CAST(p_partkey // 50 % 40 AS INTEGER) AS y, p_size * 5 AS r, CAST(p_partkey % 256 AS INTEGER) AS g, CAST(floor(p_retailprice) AS INTEGER) % 256 AS b FROM part)"


def cells(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_brand", (F.col("p_partkey") % 50).cast("int").alias("x"), (F.floor(F.col("p_partkey") / 50) % 40).cast("int").alias("y"), (F.col("p_size") * 5).alias("r"), (F.col("p_partkey") % 256).cast("int").alias("g"), (F.floor("p_retailprice") % 256).cast("int").alias("b"))


@register("border_mean", f"WITH {CELLS_SQL}, m AS (SELECT *, max(x) OVER (PARTITION BY p_brand) AS mx, max(y) OVER (PARTITION BY p_brand) AS my FROM c), q AS (SELECT *, greatest(1, least(5, (mx + 1) // 4, (my + 1) // 4)) AS g5 FROM m), k AS (SELECT * FROM q WHERE x < g5 OR y < g5 OR mx - x < g5 OR my - y < g5) SELECT p_brand, CAST(sum(r) // count(*) AS INTEGER) AS r, CAST(sum(g) // count(*) AS INTEGER) AS g, CAST(sum(b) // count(*) AS INTEGER) AS b FROM k GROUP BY p_brand")
def border_mean(spark, sf_dir):
    return I.border_mean(cells(spark, sf_dir), ["p_brand"], "x", "y", ["r", "g", "b"])


@register("region_has_content", f"WITH {CELLS_SQL} SELECT x // 10 AS rx, y // 10 AS ry, var_pop(r) > 4000 AS has_content, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY x // 10, y // 10")
def region_has_content(spark, sf_dir):
    c = cells(spark, sf_dir).withColumn("rx", F.floor(F.col("x") / 10).cast("int")).withColumn("ry", F.floor(F.col("y") / 10).cast("int"))
    return I.has_content(c, ["rx", "ry"], "r", 4000.0)


@register("grey_of_colour", f"WITH {CELLS_SQL} SELECT p_brand, x, y, CAST((2126 * r + 7152 * g + 722 * b) // 10000 AS INTEGER) AS luma FROM c")
def grey_of_colour(spark, sf_dir):
    return cells(spark, sf_dir).select("p_brand", "x", "y", scores.luma(F.col("r"), F.col("g"), F.col("b")).alias("luma"))


RUNS_SQL = "o AS (SELECT user_id, event_type IN ('click', 'view') AS ink, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), g AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM o WHERE ink), runs AS (SELECT user_id, min(i) AS first, max(i) AS last, count(*) AS length FROM g GROUP BY user_id, g)"


@register("run_length_lines", f"WITH {RUNS_SQL} SELECT user_id, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last, CAST(length AS BIGINT) AS length FROM runs WHERE length >= 3")
def run_length_lines(spark, sf_dir):
    return I.runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type").isin("click", "view"), 3)


@register("stroke_contrast", f"WITH {RUNS_SQL}, l AS (SELECT user_id, list_sort(list(length)) AS r FROM runs GROUP BY user_id) SELECT user_id, round(CASE WHEN len(r) < 4 THEN 1.0 ELSE 1 - greatest(r[len(r) // 10 + 1], 1) / greatest(r[9 * len(r) // 10 + 1], 1) END, 6) AS contrast, CAST(r[len(r) // 2 + 1] AS BIGINT) AS median_run FROM l")
def stroke_contrast(spark, sf_dir):
    lengths = I.runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type").isin("click", "view"), 1)
    return I.stroke_contrast(lengths, ["user_id"], "length").withColumn("contrast", F.round("contrast", 6))


@register("clean_runs", f"WITH {RUNS_SQL}, b AS (SELECT user_id, count(*) AS n FROM runs GROUP BY user_id), u AS (SELECT DISTINCT user_id FROM events) SELECT u.user_id, CAST(greatest(coalesce(n, 0) - 1, 0) AS BIGINT) AS clean_runs FROM u LEFT JOIN b ON u.user_id = b.user_id")
def clean_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("x"), F.col("event_type").isin("click", "view").alias("ink"))
    return I.clean_runs(e, ["user_id"], "x", "ink")


@register("fill_cells", "SELECT user_id, event_id % 500 // 50 AS cx, event_id // 500 % 400 // 50 AS cy, round(avg(value), 6) AS mean, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY user_id, event_id % 500 // 50, event_id // 500 % 400 // 50 HAVING var_pop(value) < 60")
def fill_cells(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 500).alias("x"), (F.floor(F.col("event_id") / 500) % 400).alias("y"), "value")
    return I.fill_cells(e, "x", "y", "value", ["user_id"]).withColumn("mean", F.round("mean", 6))


INK_SQL = "k AS (SELECT p_brand, CAST(p_partkey % 50 AS INTEGER) AS x, CAST(p_partkey // 50 AS INTEGER) AS y, p_size > 25 AS ink FROM part)"


def ink(spark, sf_dir):
    return table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).cast("int").alias("x"), F.floor(F.col("p_partkey") / 50).cast("int").alias("y"), (F.col("p_size") > 25).alias("ink"), F.lit(50).alias("width"), F.lit(40).alias("height"))


@register("mirror_symmetry", f"WITH {INK_SQL}, s AS (SELECT a.y, avg(CASE WHEN a.ink = b.ink THEN 1.0 ELSE 0.0 END) AS s FROM k a JOIN k b ON a.y = b.y AND a.x = 49 - b.x WHERE 2 * a.x + 1 < 50 GROUP BY a.y) SELECT u.y, round(coalesce(s, 0), 6) AS symmetry FROM (SELECT DISTINCT y FROM k) u LEFT JOIN s ON u.y = s.y")
def mirror_symmetry(spark, sf_dir):
    return I.symmetry(ink(spark, sf_dir), ["y"], "x", "ink", "width").withColumn("symmetry", F.round("symmetry", 6))


@register("quadrant_density", f"WITH {INK_SQL} SELECT (CASE WHEN y < 20 THEN 0 ELSE 2 END) + (CASE WHEN x < 25 THEN 0 ELSE 1 END) AS quadrant, round(avg(CASE WHEN ink THEN 1.0 ELSE 0.0 END), 6) AS density FROM k GROUP BY quadrant")
def quadrant_density(spark, sf_dir):
    return I.quadrant_density(ink(spark, sf_dir), [], "x", "y", "ink", "width", "height").withColumn("density", F.round("density", 6))


@register("ink_crossings", f"WITH {INK_SQL}, c AS (SELECT y, CASE WHEN lag(ink) OVER (PARTITION BY y ORDER BY x) <> ink THEN 1 ELSE 0 END AS c FROM k) SELECT y, round(least(1.0, sum(c) / 20), 6) AS crossings FROM c GROUP BY y")
def ink_crossings(spark, sf_dir):
    return I.crossings(ink(spark, sf_dir), [], "y", "x", "ink").withColumn("crossings", F.round("crossings", 6))


@register("quantized_ll_errors", "SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN abs(l_quantity - 25.5) < 0.75 * (2.0 + l_tax * 100) THEN -0.5 * ((l_quantity - 25.5) / (2.0 + l_tax * 100) / 2) * ((l_quantity - 25.5) / (2.0 + l_tax * 100) / 2) ELSE -0.5 * ((l_quantity - 25.5) / (2.0 + l_tax * 100)) * ((l_quantity - 25.5) / (2.0 + l_tax * 100)) + 0.2109375 END, 4) AS ll FROM lineitem")
def quantized_ll_errors(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.round(scores.quantized_ll(F.col("l_quantity") - 25.5, 2.0 + F.col("l_tax") * 100), 4).alias("ll"))
