"""Queries of the evaluation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlake.functions.text import normalize_text
from scanlake.operators import evaluate as E
from scanlake.queries import register
from scanlake.session import table

BOX_SQL = "b AS (SELECT o_orderkey, o_custkey, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS x0, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) + 200 + o_orderkey % 90 AS DOUBLE) AS x1, CAST(o_orderkey % 5 AS DOUBLE) AS y0, CAST(o_orderkey % 5 + 3 AS DOUBLE) AS y1 FROM orders)"


@register(
    "span_overlap_best",
    f"""WITH {BOX_SQL}, j AS (SELECT q.o_orderkey AS box, s.o_orderkey AS span, round(CASE WHEN least(q.x1, s.x1) - greatest(q.x0, s.x0) > 0 THEN (least(q.x1, s.x1) - greatest(q.x0, s.x0)) * (least(q.y1, s.y1) - greatest(q.y0, s.y0)) ELSE 0.0 END, 3) AS area,
      abs((q.x0 + q.x1) / 2 - (s.x0 + s.x1) / 2) AS dx FROM b q JOIN b s ON q.o_custkey = s.o_custkey AND q.o_orderkey % 2 = 1 AND s.o_orderkey % 2 = 0 AND least(q.y1, s.y1) > greatest(q.y0, s.y0)),
    k AS (SELECT *, row_number() OVER (PARTITION BY box ORDER BY area DESC, dx, span) AS k FROM j)
    SELECT q.o_orderkey AS box, k.span AS span_ord, CASE WHEN k.area > 0 THEN 'overlap' WHEN k.area IS NOT NULL THEN 'row' END AS how FROM b q LEFT JOIN k ON q.o_orderkey = k.box AND k.k = 1 WHERE q.o_orderkey % 2 = 1""",
)
def span_overlap_best(spark, sf_dir):
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("box"), F.col("o_custkey").alias("page"), day.cast("double").alias("x0"), (day + 200 + F.col("o_orderkey") % 90).cast("double").alias("x1"), (F.col("o_orderkey") % 5).cast("double").alias("y0"), (F.col("o_orderkey") % 5 + 3).cast("double").alias("y1"))
    return E.lookup_span(o.where("box % 2 = 1"), o.where("box % 2 = 0").withColumnRenamed("box", "span_ord"), "page", "box")


NAMES_SQL = "n AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'NATION_' || s_nationkey WHEN 1 THEN 'raw_' || s_nationkey ELSE 'other_' || s_nationkey END AS name FROM supplier)"


@register(
    "canonicalize_cascade",
    """WITH n AS (SELECT s_suppkey, (CASE WHEN s_suppkey % 2 = 0 THEN 'ABCDEF+' ELSE '' END) || (CASE s_suppkey % 3 WHEN 0 THEN 'NATION_' WHEN 1 THEN 'raw_' ELSE 'other_' END) || s_nationkey AS name FROM supplier),
    r AS (SELECT *, CASE WHEN strpos(name, '+') > 0 THEN substr(name, strpos(name, '+') + 1) ELSE name END AS raw FROM n)
    SELECT s_suppkey, name, CASE WHEN EXISTS (SELECT 1 FROM nation WHERE n_name = raw OR 'ps_' || n_nationkey = raw) THEN raw ELSE coalesce((SELECT 'ps_' || min(n_nationkey) FROM nation WHERE 'raw_' || n_nationkey % 10 = raw), raw) END AS canonical FROM r""",
)
def canonicalize_cascade(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    kind = F.when(F.col("s_suppkey") % 3 == 0, "NATION_").when(F.col("s_suppkey") % 3 == 1, "raw_").otherwise("other_")
    named = s.select("s_suppkey", F.concat(F.when(F.col("s_suppkey") % 2 == 0, "ABCDEF+").otherwise(""), kind, F.col("s_nationkey").cast("string")).alias("name"))
    n = F.col("n_nationkey")
    catalog = table(spark, sf_dir, "nation").select(n.alias("ord"), F.concat(F.lit("ps_"), n.cast("string")).alias("postscript_name"), F.col("n_name").alias("font_key"), F.concat(F.lit("raw_"), (n % 10).cast("string")).alias("raw_name"))
    return E.canonical_names(named, catalog, "name")


@register("decision_matrix", "SELECT d.doc_id, CASE WHEN n_chars % 100 >= 30 AND trim(text) <> '' AND l.quality = 1 THEN 'vectorized' ELSE 'kept_raster' END AS decision FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def decision_matrix(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.select("doc_id", E.decision(F.col("n_chars") % 100, F.col("text"), F.when(F.col("quality") == 1, 1), 30).alias("decision"))


LINES_SQL = """l AS (SELECT o_orderkey, o_orderstatus, o_orderkey % 11 = 0 AS kept, CASE WHEN o_orderkey % 13 <> 0 THEN 'Family' || o_custkey % 4 || CASE WHEN o_custkey % 3 = 0 THEN '-Italic' ELSE '-' || o_custkey % 5 END END AS truth,
  'Family' || o_orderkey % 4 || CASE WHEN o_orderkey % 3 = 0 THEN '-Italic' ELSE '-' || o_orderkey % 5 END || CASE WHEN o_orderkey % 2 = 0 THEN '[opsz=9]' ELSE '' END AS matched FROM orders),
c AS (SELECT *, CASE WHEN kept THEN 'kept_raster' WHEN truth IS NULL THEN 'no_ground_truth' WHEN truth = split_part(matched, '[', 1) THEN 'hit' WHEN split_part(truth, '-', 1) = split_part(matched, '-', 1) AND contains(truth, 'Italic') = contains(matched, 'Italic') THEN 'minor_miss' ELSE 'major_miss' END AS class FROM l)"""


def classified(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    name = lambda k: F.concat(F.lit("Family"), (F.col(k) % 4).cast("string"), F.when(F.col(k) % 3 == 0, "-Italic").otherwise(F.concat(F.lit("-"), (F.col(k) % 5).cast("string"))))
    rows = o.select("o_orderkey", "o_orderstatus", (F.col("o_orderkey") % 11 == 0).alias("kept"), F.when(F.col("o_orderkey") % 13 != 0, name("o_custkey")).alias("truth"), F.concat(name("o_orderkey"), F.when(F.col("o_orderkey") % 2 == 0, "[opsz=9]").otherwise("")).alias("matched"))
    family, italic = lambda c: F.split_part(F.col(c), F.lit("-"), F.lit(1)), lambda c: F.col(c).contains("Italic")
    return rows.withColumn("class", E.miss_class(F.col("kept"), F.col("truth"), F.col("matched"), family("truth"), family("matched"), italic("truth"), italic("matched")))


@register("classify_entries", f"WITH {LINES_SQL} SELECT o_orderkey, class FROM c")
def classify_entries(spark, sf_dir):
    return classified(spark, sf_dir).select("o_orderkey", "class")


@register(
    "accuracy_rollup",
    f"""WITH {LINES_SQL}, n AS (SELECT o_orderstatus, count(*) FILTER (WHERE class = 'hit') AS hits, count(*) FILTER (WHERE class = 'minor_miss') AS minor_misses, count(*) FILTER (WHERE class = 'major_miss') AS major_misses, CAST(0 AS BIGINT) AS similarity_failures, count(*) FILTER (WHERE class = 'kept_raster') AS kept_raster, count(*) FILTER (WHERE class <> 'no_ground_truth') AS compared FROM c GROUP BY o_orderstatus)
    SELECT *, hits + minor_misses AS primary_hits, round(CASE WHEN compared = 0 THEN 100.0 ELSE 100.0 * (hits + minor_misses) / compared END, 6) AS pct FROM n""",
)
def accuracy_rollup(spark, sf_dir):
    return E.accuracy(classified(spark, sf_dir), "class", ("o_orderstatus",)).withColumn("pct", F.round("pct", 6))


@register(
    "interesting_obs_balanced",
    """WITH d AS (SELECT l_orderkey, l_linenumber * 1000000 + l_partkey AS idx, l_tax AS best, CASE WHEN l_orderkey % 7 <> 0 THEN round(round(l_discount - 0.05, 2) + round(l_quantity / 10000, 4) * (CASE WHEN l_discount < 0.05 THEN -1 ELSE 1 END), 6) END AS delta FROM lineitem),
    p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY delta DESC, idx) AS k FROM d WHERE delta > 0 UNION ALL SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY delta, idx) FROM d WHERE delta < 0),
    h AS (SELECT *, k <= 2 AS first FROM p), l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(delta) DESC, idx) AS m, 5 - (SELECT count(*) FROM h AS g WHERE g.first AND g.l_orderkey = h.l_orderkey) AS room FROM h WHERE NOT first),
    w AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY best, idx) AS m FROM d WHERE l_orderkey NOT IN (SELECT l_orderkey FROM d WHERE delta IS NOT NULL))
    SELECT l_orderkey, CAST(idx AS BIGINT) AS idx, delta FROM h WHERE first UNION ALL SELECT l_orderkey, idx, delta FROM l WHERE m <= room UNION ALL SELECT l_orderkey, idx, delta FROM w WHERE m <= 5""",
)
def interesting_obs_balanced(spark, sf_dir):
    sign = F.when(F.col("l_discount") < 0.05, -1).otherwise(1)
    delta = F.round(F.round(F.col("l_discount") - 0.05, 2) + F.round(F.col("l_quantity") / 10000, 4) * sign, 6)
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("idx"), F.col("l_tax").alias("best"), F.when(F.col("l_orderkey") % 7 != 0, delta).alias("delta"))
    return E.interesting(d, "l_orderkey", "idx", "delta", 5, "best").drop("best")


@register("report_order", f"WITH {LINES_SQL}, s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 'ocr_wrong' ELSE class END AS shown_in, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey * 37 % 1000 AS DOUBLE) END AS similarity FROM c) SELECT o_orderkey, shown_in, CAST(row_number() OVER (PARTITION BY shown_in ORDER BY similarity NULLS FIRST, o_orderkey) AS INTEGER) AS place FROM s")
def report_order(spark, sf_dir):
    rows = classified(spark, sf_dir).select(F.col("o_orderkey").alias("line"), "class", (F.col("o_orderkey") % 17 == 0).alias("wrong"), F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_orderkey") * 37 % 1000).cast("double")).alias("similarity"))
    return E.report_order(rows, "class", "similarity", "wrong").select(F.col("line").alias("o_orderkey"), "shown_in", "place")


@register("text_equality", r"SELECT a.conv_id, a.turn, lower(trim(regexp_replace(a.text, '\s+', ' ', 'g'))) = lower(trim(regexp_replace(b.text, '\s+', ' ', 'g'))) AS same FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn")
def text_equality(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", normalize_text(F.col("text")).alias("t"))
    return c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("u")), ["conv_id", "turn"]).select("conv_id", "turn", (F.col("t") == F.col("u")).alias("same"))
