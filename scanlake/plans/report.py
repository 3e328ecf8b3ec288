"""Queries of the audit and report operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scanlake.functions.scores import affine
from scanlake.operators import report as R, similarity as S
from scanlake.plans.similarity import E_SQL, vectors
from scanlake.queries import register
from scanlake.session import table


@register(
    "enrich_audit_entries",
    """WITH c AS (SELECT l_orderkey, list(CAST(l_partkey AS VARCHAR) ORDER BY l_discount DESC, l_partkey, l_suppkey) AS keys, list(l_discount ORDER BY l_discount DESC, l_partkey, l_suppkey) AS scores, CAST(max(l_partkey) AS VARCHAR) AS expected FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, CAST(list_position(keys, expected) AS INTEGER) AS gt_rank, scores[list_position(keys, expected)] AS gt_score, l_orderkey % 3 <> 0 AS ocr_correct FROM c""",
)
def enrich_audit_entries(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    c = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("l_discount")).alias("d"), "l_partkey", "l_suppkey"))), lambda x: F.struct(x["l_partkey"].cast("string").alias("key"), (-x["d"]).alias("score")))
    e = li.groupBy("l_orderkey").agg(c.alias("font_candidates"), F.max("l_partkey").cast("string").alias("expected_font"), F.lit(" Some  Text").alias("gt_text"))
    e = e.withColumn("ocr_text", F.when(F.col("l_orderkey") % 3 != 0, "some text ").otherwise("sometext"))
    return R.enrich(e).select("l_orderkey", "gt_rank", F.abs("gt_score").alias("gt_score"), "ocr_correct")


@register("text_colour", "WITH p AS (SELECT p_brand, p_size * 5 AS v, CAST(p_partkey % 256 AS INTEGER) AS r FROM part) SELECT p_brand, CAST(CASE WHEN 2 * count(*) FILTER (WHERE v <= 110) <= count(*) THEN sum(r) FILTER (WHERE v <= 110) // count(*) FILTER (WHERE v <= 110) ELSE sum(r) FILTER (WHERE v > 110) // count(*) FILTER (WHERE v > 110) END AS INTEGER) AS r FROM p GROUP BY p_brand")
def text_colour(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", (F.col("p_size") * 5).alias("v"), (F.col("p_partkey") % 256).alias("r"), F.lit(110).alias("t"))
    return R.text_colour(p, ["p_brand"], "v", "t", ["r"])


@register(
    "raster_fragments",
    """WITH RECURSIVE c AS (SELECT user_id % 20 AS page, CAST(event_id % 12 AS BIGINT) AS x, CAST(event_id // 12 % 12 AS BIGINT) AS y FROM events GROUP BY ALL HAVING var_pop(value) > 900),
    r AS (SELECT page, x, y, x * 100 + y AS home FROM c UNION SELECT c.page, c.x, c.y, r.home FROM r JOIN c ON c.page = r.page AND abs(c.x - r.x) + abs(c.y - r.y) = 1), h AS (SELECT page, x, y, min(home) AS home FROM r GROUP BY page, x, y)
    SELECT page, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, CAST(count(*) AS BIGINT) AS n_cells FROM h GROUP BY page, home""",
)
def raster_fragments(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("page"), (F.col("event_id") % 12).alias("x"), (F.floor(F.col("event_id") / 12) % 12).alias("y"), "value")
    return R.fragments(e, "page", "x", "y", "value", 900.0)


@register("used_characters", "WITH c AS (SELECT DISTINCT lang, unnest(string_split(text, '')) AS ch FROM documents) SELECT lang, CAST(count(*) AS BIGINT) AS n_chars, string_agg(ch, '' ORDER BY ch) AS chars, CAST(ceil(count(*) / 100) AS BIGINT) AS chunks FROM c WHERE ch <> '' GROUP BY lang")
def used_characters(spark, sf_dir):
    return R.used_characters(table(spark, sf_dir, "documents").select("lang", "text"), "lang", "text")


@register("placements", "SELECT o_orderkey, round(o_custkey % 2000 * 72.0 / 300, 6) AS x_pt, round((3300 - o_orderkey % 3000 - 40) * 72.0 / 300, 6) AS y_pt FROM orders")
def placements(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 2000).alias("x"), (F.col("o_orderkey") % 3000).alias("y"), F.lit(40).alias("height"), F.lit(3300).alias("page_height"))
    return R.placements(o, 300, "page_height").select("o_orderkey", F.round("x_pt", 6).alias("x_pt"), F.round("y_pt", 6).alias("y_pt"))


@register("affine_points", "SELECT event_id, round(2.0 * (event_id % 100) + 0.5 * value + 3.0, 6) AS x, round(-0.5 * (event_id % 100) + 2.0 * value + 4.0, 6) AS y FROM events")
def affine_points(spark, sf_dir):
    x, y = affine(F.col("event_id") % 100, F.col("value"), [F.lit(v) for v in (2.0, -0.5, 0.5, 2.0, 3.0, 4.0)])
    return table(spark, sf_dir, "events").select("event_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@register("erased_boxes", "SELECT user_id % 10 AS page, CAST(event_id % 50 AS BIGINT) AS x, CAST(event_id % 40 AS BIGINT) AS y, CAST(102 AS BIGINT) AS width, CAST(2 AS BIGINT) AS height FROM events WHERE event_type = 'view' UNION ALL SELECT user_id % 10, event_id % 60, event_id % 70, 50, 50 FROM events WHERE event_type = 'click'")
def erased_boxes(spark, sf_dir):
    e, n = table(spark, sf_dir, "events").withColumn("page", F.col("user_id") % 10), lambda v: F.lit(v).cast("long")
    lines = e.where("event_type = 'view'").select("page", (F.col("event_id") % 50 + 100).alias("x1"), (F.col("event_id") % 50).alias("x2"), (F.col("event_id") % 40).alias("y1"), (F.col("event_id") % 40).alias("y2"), n(2).alias("thickness"))
    fills = e.where("event_type = 'click'").select("page", (F.col("event_id") % 60).alias("x"), (F.col("event_id") % 70).alias("y"), n(50).alias("width"), n(50).alias("height"))
    return R.erased(lines, fills)


@register("resolve_cascade", "WITH n AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '/f/' || s_nationkey WHEN 1 THEN 'NATION_' || s_nationkey WHEN 2 THEN 'region' || s_nationkey % 5 ELSE 'none' END AS name FROM supplier), r AS (SELECT 'region' || n_regionkey AS ps, min(n_name) AS k FROM nation GROUP BY n_regionkey) SELECT s_suppkey, name, coalesce(a.n_name, b.n_name, r.k) AS resolved FROM n LEFT JOIN nation a ON name = '/f/' || a.n_nationkey LEFT JOIN nation b ON name = b.n_name LEFT JOIN r ON name = r.ps")
def resolve_cascade(spark, sf_dir):
    k, s = F.col("s_suppkey") % 4, F.col("s_nationkey").cast("string")
    names = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(k == 0, F.concat(F.lit("/f/"), s)).when(k == 1, F.concat(F.lit("NATION_"), s)).when(k == 2, F.concat(F.lit("region"), (F.col("s_nationkey") % 5).cast("string"))).otherwise("none").alias("name"))
    catalog = table(spark, sf_dir, "nation").select(F.concat(F.lit("/f/"), F.col("n_nationkey").cast("string")).alias("path"), F.col("n_name").alias("font_key"), F.concat(F.lit("region"), F.col("n_regionkey").cast("string")).alias("postscript_name"))
    return R.resolve(names, catalog, "name")


ERAS = [("early", 1985, "red"), ("middle", 1995, "Small Ring"), ("late", 2005, "widget")]


@register("shipped_with_era", f"WITH e(era, start, family) AS (VALUES {', '.join(map(str, ERAS))}), p AS (SELECT DISTINCT p_name, 1980 + p_size % 40 AS birth, lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) AS n FROM part) SELECT DISTINCT p_name, era FROM p JOIN e ON (contains(n, lower(regexp_replace(family, '[^A-Za-z0-9]', '', 'g'))) OR contains(lower(regexp_replace(family, '[^A-Za-z0-9]', '', 'g')), n)) AND birth <= start")
def shipped_with_era(spark, sf_dir):
    fonts = table(spark, sf_dir, "part").select("p_name", (1980 + F.col("p_size") % 40).alias("birth")).distinct()
    return R.shipped(fonts, spark.createDataFrame(ERAS, "era string, start int, family string"), "p_name")


@register("subsample_eval", "SELECT vec_id, label FROM embeddings ORDER BY md5('42:' || vec_id), vec_id LIMIT 100")
def subsample_eval(spark, sf_dir):
    return R.sampled(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", 42, 100)


@register(
    "zncc_softmax",
    f"""WITH {E_SQL}, m AS (SELECT e.vec_id, c.label AS id, avg(e.v * e.v) - avg(e.v) * avg(e.v) AS va, avg(c.m * c.m) - avg(c.m) * avg(c.m) AS vb, avg(e.v * c.m) - avg(e.v) * avg(c.m) AS cov FROM e JOIN c ON e.seq = c.seq AND e.pos = c.pos GROUP BY e.vec_id, c.label),
    z AS (SELECT vec_id, id, CASE WHEN sqrt(va * vb) < 1e-10 THEN 1.0 ELSE greatest(-1.0, least(1.0, cov / sqrt(va * vb))) END AS z FROM m), x AS (SELECT *, exp(10 * (z - max(z) OVER (PARTITION BY vec_id))) AS x FROM z)
    SELECT vec_id, id AS label, round(x / sum(x) OVER (PARTITION BY vec_id), 6) AS prob FROM x""",
)
def zncc_softmax(spark, sf_dir):
    v = vectors(spark, sf_dir)
    d = S.correlations(v, S.centroids(v, "label", "embedding"), "embedding")
    return S.each(R.similarity_softmax(d), "vec_id").select("vec_id", F.col("id").alias("label"), F.round("prob", 6).alias("prob"))


@register("ocr_correction", "WITH v AS (SELECT user_id * 100 + event_id % 100 AS k, CASE WHEN user_id % 2 = 0 THEN 'click' ELSE 'view' END AS own, event_type AS ch, count(*) / sum(count(*)) OVER (PARTITION BY user_id * 100 + event_id % 100, CASE WHEN user_id % 2 = 0 THEN 'click' ELSE 'view' END) AS prob FROM events GROUP BY 1, 2, 3), t AS (SELECT k, own, min_by(ch, struct_pack(a := -prob, b := ch)) AS top, max(prob) AS p, coalesce(max(CASE WHEN ch = own THEN prob END), 1e-30) AS own_p FROM v GROUP BY k, own) SELECT CAST(k AS BIGINT) AS k, CASE WHEN p > 0.235 AND p > 3 * own_p AND top <> own THEN top END AS correction FROM t")
def ocr_correction(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") * 100 + F.col("event_id") % 100).alias("k"), F.when(F.col("user_id") % 2 == 0, "click").otherwise("view").alias("own"), F.col("event_type").alias("ch"))
    v = e.groupBy("k", "own", "ch").count().withColumn("prob", F.col("count") / F.sum("count").over(Window.partitionBy("k", "own")))
    return R.ocr_correction(v, "k", "own", F.lit(0.235))
