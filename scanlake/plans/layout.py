"""Queries of the layout operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlake.operators import layout as L, lines
from scanlake.queries import register
from scanlake.session import table
from scanlake.sources.tsv import parse_tsv


@register(
    "assemble_lines",
    """WITH w AS (SELECT conv_id, turn, text, turn * 10 AS x, conv_id % 7 AS y, length(text) AS width, 10 + turn % 3 AS height, CAST(turn * 7 % 100 AS DOUBLE) AS confidence, 12.0::DOUBLE + turn AS font_size_pt FROM conversations WHERE trim(text) <> '')
    SELECT conv_id, string_agg(text, ' ' ORDER BY x, turn) AS text, CAST(min(x) AS BIGINT) AS x, CAST(min(y) AS BIGINT) AS y, CAST(max(x + width) - min(x) AS BIGINT) AS width, CAST(max(y + height) - min(y) AS BIGINT) AS height,
      round(avg(confidence), 6) AS confidence, min_by(font_size_pt, turn) AS font_size_pt, CAST(count(*) AS BIGINT) AS n_words FROM w GROUP BY conv_id""",
)
def assemble_lines(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    words = c.select("conv_id", "turn", "text", (F.col("turn") * 10).alias("x"), (F.col("conv_id") % 7).alias("y"), F.length("text").cast("long").alias("width"), (10 + F.col("turn") % 3).alias("height"), (F.col("turn") * 7 % 100).cast("double").alias("confidence"), (12.0 + F.col("turn")).alias("font_size_pt"))
    return L.assemble_lines(words, ["conv_id"], "x", "turn").withColumn("confidence", F.round("confidence", 6))


@register(
    "parse_tsv_words",
    r"""WITH f AS (SELECT l_orderkey AS page, [CASE WHEN l_linenumber % 5 = 0 THEN '4' ELSE '5' END, CAST(l_orderkey AS VARCHAR), '1', CAST(l_linenumber AS VARCHAR), CASE WHEN l_returnflag = 'A' THEN 'x' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END, CAST(l_suppkey AS VARCHAR), CASE WHEN l_linestatus = 'O' THEN ' ' || l_returnflag ELSE '  ' END] AS c FROM lineitem)
    SELECT page, CAST(1 AS BIGINT) AS block_num, CAST(c[4] AS BIGINT) AS word_num, coalesce(TRY_CAST(c[5] AS BIGINT), 0) AS height, CAST(CAST(c[6] AS BIGINT) AS DOUBLE) AS confidence, trim(c[7]) AS text, round(coalesce(TRY_CAST(c[5] AS BIGINT), 0) * 72.0 / 300, 6) AS font_size_pt
    FROM f WHERE c[1] = '5' AND trim(c[7]) <> ''""",
)
def parse_tsv_words(spark, sf_dir):
    """Lines of recogniser output made from lineitem, with bad numbers, other levels and blank words."""
    li = table(spark, sf_dir, "lineitem")
    zero = F.lit("0")
    cells = [F.when(F.col("l_linenumber") % 5 == 0, "4").otherwise("5"), F.col("l_orderkey").cast("string"), F.lit("1"), zero, zero, F.col("l_linenumber").cast("string"), zero, zero, zero, F.when(F.col("l_returnflag") == "A", "x").otherwise(F.col("l_quantity").cast("long").cast("string")), F.col("l_suppkey").cast("string"), F.when(F.col("l_linestatus") == "O", F.concat(F.lit(" "), "l_returnflag")).otherwise("  ")]
    words = parse_tsv(li.select(F.col("l_orderkey").alias("page"), F.concat_ws("\t", *cells).alias("value")), dpi=300)
    return words.select("page", "block_num", "word_num", "height", "confidence", "text", F.round("font_size_pt", 6).alias("font_size_pt"))


WORDS = "WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS h, l_discount * 1000 AS conf FROM lineitem)"


@register(
    "drop_outlier_words",
    f"""{WORDS}, m AS (SELECT l_orderkey, count(*) AS n, list_sort(list(h))[len(list(h)) // 2 + 1] AS med FROM w GROUP BY l_orderkey)
    SELECT w.l_orderkey, CAST(count(*) AS BIGINT) AS n_kept, sum(h) AS total_height FROM w JOIN m ON w.l_orderkey = m.l_orderkey WHERE NOT (n >= 2 AND med > 0 AND h >= 1.8 * med AND conf < 70) GROUP BY w.l_orderkey""",
)
def drop_outlier_words(spark, sf_dir):
    w = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("h"), (F.col("l_discount") * 1000).alias("conf"))
    return L.drop_outlier_words(w, ["l_orderkey"], "h", "conf").groupBy("l_orderkey").agg(F.count("*").alias("n_kept"), F.sum("h").alias("total_height"))


@register(
    "split_height_ratio",
    f"""{WORDS}, s AS (SELECT l_orderkey, list_sort(list(h)) AS hs FROM w GROUP BY l_orderkey), g AS (SELECT l_orderkey, hs, list_transform(range(1, len(hs)), lambda i: greatest(hs[i + 1], 1) / greatest(hs[i], 1)) AS jumps FROM s),
    b AS (SELECT *, list_position(jumps, list_max(jumps)) AS spot FROM g)
    SELECT l_orderkey, CAST(CASE WHEN len(jumps) > 0 AND list_max(jumps) >= 2 AND hs[spot] >= 10 THEN len(hs) - spot ELSE 0 END AS BIGINT) AS n_upper, CAST(len(hs) AS BIGINT) AS n FROM b""",
)
def split_height_ratio(spark, sf_dir):
    w = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey").alias("tie"), F.col("l_quantity").alias("h"))
    return L.split_by_height(w, ["l_orderkey"], "h", "tie").groupBy("l_orderkey").agg(F.count_if("upper").alias("n_upper"), F.count("*").alias("n"))


@register(
    "coverage_profile_valleys",
    """WITH b AS (SELECT user_id, CAST(event_id % 400 AS BIGINT) AS y0, CAST(event_id % 400 + 1 + event_id % 4 AS BIGINT) AS y1, value % 100 AS conf FROM events),
    r AS (SELECT user_id, unnest(range(y0, y1)) AS y, conf / 100 AS c FROM b), s AS (SELECT user_id, y, sum(c) AS cover FROM r GROUP BY user_id, y),
    sp AS (SELECT user_id, min(y0) AS lo, max(y1) - 1 AS hi FROM b GROUP BY user_id), e AS (SELECT user_id, lo, hi, unnest(range(lo, hi + 1)) AS y FROM sp),
    l AS (SELECT e.*, e.y - row_number() OVER (PARTITION BY e.user_id ORDER BY e.y) AS g FROM e LEFT JOIN s ON e.user_id = s.user_id AND e.y = s.y WHERE coalesce(cover, 0) < 0.5)
    SELECT user_id, CAST(min(y) AS BIGINT) AS valley_start, CAST(max(y) AS BIGINT) AS valley_end FROM l GROUP BY user_id, g, lo, hi HAVING min(y) > lo AND max(y) < hi AND max(y) - min(y) + 1 >= 2""",
)
def coverage_profile_valleys(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    b = e.select("user_id", "event_id", (F.col("event_id") % 400).alias("y0"), (F.col("event_id") % 400 + 1 + F.col("event_id") % 4).alias("y1"), (F.col("value") % 100).alias("conf"))
    return L.coverage_valleys(b, "user_id", "y0", "y1", "conf", order="event_id")


@register(
    "split_wide_gaps",
    """WITH c AS (SELECT user_id, event_id AS pos, event_id % 1000 AS l, event_id % 1000 + 2 + event_id % 9 AS r FROM events), g AS (SELECT *, CASE WHEN lag(r) OVER w IS NULL OR greatest(l - lag(r) OVER w, 0) >= 60 THEN 1 ELSE 0 END AS s FROM c WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
    p AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY pos) AS piece FROM g) SELECT user_id, CAST(piece AS BIGINT) AS piece, CAST(count(*) AS BIGINT) AS n_chars, CAST(min(pos) AS BIGINT) AS first_pos FROM p GROUP BY user_id, piece""",
)
def split_wide_gaps(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos"), (F.col("event_id") % 1000).alias("l"), (F.col("event_id") % 1000 + 2 + F.col("event_id") % 9).alias("r"))
    return L.split_wide_gaps(e, ["user_id"], "l", "r", F.lit(60)).groupBy("user_id", "piece").agg(F.count("*").alias("n_chars"), F.min("pos").alias("first_pos"))


@register(
    "smooth_runs",
    """WITH f AS (SELECT user_id, event_id, ts, value, CASE WHEN event_type = 'error' THEN NULL WHEN event_type IN ('click', 'view') THEN 'a' ELSE 'b' END AS font FROM events),
    c AS (SELECT *, CASE WHEN lag(font) OVER w IS NULL OR font IS NULL OR lag(font) OVER w <> font THEN 1 ELSE 0 END AS s FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c),
    n AS (SELECT *, abs(value - avg(value) OVER (PARTITION BY user_id, run)) <= 20 AS near FROM r)
    SELECT event_id, round(CASE WHEN near AND font IS NOT NULL THEN quantile_cont(CASE WHEN near THEN value END, 0.5) OVER (PARTITION BY user_id, run) ELSE value END, 6) AS smoothed FROM n""",
)
def smooth_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("font", F.when(F.col("event_type") == "error", None).when(F.col("event_type").isin("click", "view"), "a").otherwise("b"))
    return L.smooth_runs(e, ["user_id"], ["ts", "event_id"], "font", "value", 20.0).select("event_id", F.round("smoothed", 6).alias("smoothed"))


@register("pen_positions", "SELECT l_orderkey, l_linenumber, l_partkey, coalesce(sum(l_quantity + l_linenumber % 3 - 1) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS pen FROM lineitem")
def pen_positions(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("pos"), "l_quantity", (F.col("l_linenumber") % 3 - 1).alias("kern"))
    return L.pen_positions(g, ["l_orderkey"], "pos", "l_quantity", "kern").select("l_orderkey", "l_linenumber", "l_partkey", F.col("pen").cast("double").alias("pen"))


@register("pitch_errors", "SELECT event_id, round((value - lag(value) OVER w) - (event_id % 17 - lag(event_id % 17) OVER w), 6) AS pitch_error FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def pitch_errors(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("predicted", F.col("event_id") % 17)
    return L.pitch_errors(e, ["user_id"], "event_id", "value", "predicted").select("event_id", F.round("pitch_error", 6).alias("pitch_error"))


@register(
    "merge_overlapping_words",
    """WITH RECURSIVE w AS (SELECT l_orderkey, l_partkey AS word_num, CAST(l_linenumber * 20 AS BIGINT) AS x, CAST(l_quantity AS BIGINT) AS width, repeat(l_returnflag, 1 + l_suppkey % 3) AS text, l_discount * 1000 AS confidence FROM lineitem),
    o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY x, word_num, width, text, confidence) AS i FROM w),
    f AS (SELECT l_orderkey, i, 1 AS head, word_num, x, width, text, confidence FROM o WHERE i = 1
      UNION ALL SELECT l_orderkey, i, head, word_num, x, width, text, confidence FROM (SELECT o.l_orderkey, o.i, CASE WHEN j THEN f.head ELSE f.head + 1 END AS head, CASE WHEN j THEN f.word_num ELSE o.word_num END AS word_num, CASE WHEN j THEN f.x ELSE o.x END AS x,
        CASE WHEN j THEN greatest(f.x + f.width, o.x + o.width) - f.x ELSE o.width END AS width,
        CASE WHEN NOT j THEN o.text WHEN NOT c THEN f.text || o.text WHEN o.confidence > f.confidence AND strlen(o.text) >= strlen(f.text) THEN o.text ELSE f.text END AS text,
        CASE WHEN NOT j THEN o.confidence WHEN c THEN greatest(f.confidence, o.confidence) ELSE (f.confidence + o.confidence) / 2 END AS confidence
        FROM f JOIN o ON o.l_orderkey = f.l_orderkey AND o.i = f.i + 1, LATERAL (SELECT o.x - (f.x + f.width) <= 2 AS j, greatest(f.x + f.width - o.x, 0) > f.width // 2 OR greatest(f.x + f.width - o.x, 0) > o.width // 2 AS c) t))
    SELECT l_orderkey, x, word_num, CAST(0 AS BIGINT) AS y, width, CAST(10 AS BIGINT) AS height, text, round(confidence, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, head ORDER BY i DESC) AS last FROM f) WHERE last = 1""",
)
def merge_overlapping_words(spark, sf_dir):
    w = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("word_num"), (F.col("l_linenumber") * 20).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.col("l_quantity").cast("long").alias("width"), F.lit(10).cast("long").alias("height"), F.expr("repeat(l_returnflag, cast(1 + l_suppkey % 3 AS int))").alias("text"), (F.col("l_discount") * 1000).alias("confidence"))
    return L.merge_overlapping_words(w, ["l_orderkey"]).withColumn("confidence", F.round("confidence", 6))


def runs_sql(a, b):
    return f"""WITH RECURSIVE r AS (SELECT l_orderkey, CAST(l_linenumber // 4 AS BIGINT) AS {a}1, CAST(l_linenumber // 4 + 50 + l_linenumber % 2 * 2 AS BIGINT) AS {a}2, CAST(l_partkey % 12 AS BIGINT) AS {b}1, CAST(l_partkey % 12 + l_suppkey % 9 AS BIGINT) AS {b}2 FROM lineitem),
    o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {a}1, {b}1, {a}2, {b}2) AS i FROM r),
    f AS (SELECT l_orderkey, i, 1 AS head, {a}1, {a}2, {b}1, {b}2 FROM o WHERE i = 1
      UNION ALL SELECT l_orderkey, i, head, {a}1, {a}2, {b}1, {b}2 FROM (SELECT o.l_orderkey, o.i, CASE WHEN j THEN f.head ELSE f.head + 1 END AS head, CASE WHEN j THEN f.{a}1 ELSE o.{a}1 END AS {a}1, CASE WHEN j THEN f.{a}2 ELSE o.{a}2 END AS {a}2, CASE WHEN j THEN f.{b}1 ELSE o.{b}1 END AS {b}1, o.{b}2
        FROM f JOIN o ON o.l_orderkey = f.l_orderkey AND o.i = f.i + 1, LATERAL (SELECT o.{b}1 <= f.{b}2 + 2 AND abs(o.{a}1 - f.{a}1) <= 2 AND abs(o.{a}2 - f.{a}2) <= 2 AS j) t))
    SELECT l_orderkey, {a}1, {a}2, {b}1, {b}2, greatest({b}2 - {b}1 + 1, 1) AS thickness FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, head ORDER BY i DESC) AS last FROM f) WHERE last = 1"""


def runs(spark, sf_dir, a, b):
    n, long = F.col("l_linenumber"), lambda c: c.cast("long")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", long(F.floor(n / 4)).alias(f"{a}1"), long(F.floor(n / 4) + 50 + n % 2 * 2).alias(f"{a}2"), long(F.col("l_partkey") % 12).alias(f"{b}1"), long(F.col("l_partkey") % 12 + F.col("l_suppkey") % 9).alias(f"{b}2"))


@register("merge_runs", runs_sql("x", "y"))
def merge_runs(spark, sf_dir):
    return L.merge_runs(runs(spark, sf_dir, "x", "y"), ["l_orderkey"])


@register("merge_runs_vertical", runs_sql("y", "x"))
def merge_runs_vertical(spark, sf_dir):
    return L.merge_runs(runs(spark, sf_dir, "y", "x"), ["l_orderkey"], "y", "x")


WORD_BOXES = """w AS (SELECT l_orderkey, l_orderkey % 20 AS line, (l_linenumber * 1000000 + l_partkey) * 100000 + l_suppkey AS ord, repeat(l_returnflag, 1 + l_suppkey % 3) AS text, CAST(l_linenumber * 30 + l_partkey % 9 AS BIGINT) AS x, CAST(l_partkey % 60 AS BIGINT) AS y, CAST(l_quantity AS BIGINT) AS width, CAST(6 + l_suppkey % 40 AS BIGINT) AS height, CAST(l_partkey * 7 % 101 AS DOUBLE) AS confidence, CAST(8 + l_linenumber AS DOUBLE) AS font_size_pt FROM lineitem)"""


def boxes(spark, sf_dir):
    long = lambda c: c.cast("long")
    li, p, s = table(spark, sf_dir, "lineitem"), F.col("l_partkey"), F.col("l_suppkey")
    return li.select(
        "l_orderkey", (F.col("l_orderkey") % 20).alias("line"), ((F.col("l_linenumber") * 1000000 + p) * 100000 + s).alias("ord"), F.expr("repeat(l_returnflag, cast(1 + l_suppkey % 3 AS int))").alias("text"),
        long(F.col("l_linenumber") * 30 + p % 9).alias("x"), long(p % 60).alias("y"), long(F.col("l_quantity")).alias("width"), long(6 + s % 40).alias("height"), (p * 7 % 101).cast("double").alias("confidence"), (8 + F.col("l_linenumber")).cast("double").alias("font_size_pt"),
    )


LINE_SQL = "string_agg(text, ' ' ORDER BY ord) AS text, CAST(min(x) AS BIGINT) AS x, CAST(min(y) AS BIGINT) AS y, CAST(max(x + width) - min(x) AS BIGINT) AS width, CAST(max(y + height) - min(y) AS BIGINT) AS height, round(avg(confidence), 6) AS confidence, CAST(count(*) AS BIGINT) AS n_words"


@register(
    "lines_without_outliers",
    f"""WITH {WORD_BOXES}, m AS (SELECT l_orderkey, count(*) AS n, list_sort(list(height))[len(list(height)) // 2 + 1] AS med, arg_min(font_size_pt, ord) AS font_size_pt FROM w GROUP BY l_orderkey)
    SELECT w.l_orderkey, {LINE_SQL}, any_value(m.font_size_pt) AS font_size_pt FROM w JOIN m ON w.l_orderkey = m.l_orderkey WHERE n < 2 OR height < 1.8 * med OR confidence >= 70 GROUP BY w.l_orderkey""",
)
def lines_without_outliers(spark, sf_dir):
    return lines.lines_without_outliers(boxes(spark, sf_dir), ["l_orderkey"], "ord").withColumn("confidence", F.round("confidence", 6))


@register(
    "split_merged_lines",
    f"""WITH {WORD_BOXES}, s AS (SELECT l_orderkey, list_sort(list(height)) AS hs FROM w GROUP BY l_orderkey), g AS (SELECT l_orderkey, hs, list_transform(range(1, len(hs)), lambda i: hs[i + 1] / hs[i]) AS jumps FROM s),
    b AS (SELECT l_orderkey, CASE WHEN list_max(jumps) >= 2 AND hs[list_position(jumps, list_max(jumps))] >= 10 THEN hs[list_position(jumps, list_max(jumps)) + 1] END AS cut FROM g),
    p AS (SELECT w.*, CASE WHEN height >= cut THEN 1 ELSE 0 END AS part FROM w JOIN b ON w.l_orderkey = b.l_orderkey),
    e AS (SELECT l_orderkey, part, min(y) AS lo, max(y + height) AS hi FROM p GROUP BY ALL HAVING count(*) >= 3), r AS (SELECT l_orderkey, part, lo, hi, unnest(range(lo, hi)) AS y FROM e),
    c AS (SELECT r.l_orderkey, r.part, r.lo, r.hi, r.y, coalesce(sum(p.confidence / 100), 0) AS cover FROM r LEFT JOIN p ON p.l_orderkey = r.l_orderkey AND p.part = r.part AND r.y >= p.y AND r.y < p.y + p.height GROUP BY ALL),
    v AS (SELECT l_orderkey, part, min(y) AS a, max(y) + 1 AS z FROM (SELECT *, y - row_number() OVER (PARTITION BY l_orderkey, part ORDER BY y) AS g FROM c WHERE cover < 0.5) GROUP BY l_orderkey, part, g, lo, hi HAVING max(y) - min(y) >= 1 AND min(y) > lo AND max(y) + 1 < hi),
    d AS (SELECT p.*, (SELECT count(*) FROM v WHERE v.l_orderkey = p.l_orderkey AND v.part = p.part AND p.y + p.height // 2 >= v.z) AS band, confidence < 60 AND EXISTS (SELECT 1 FROM v WHERE v.l_orderkey = p.l_orderkey AND v.part = p.part AND p.y + p.height // 2 >= v.a AND p.y + p.height // 2 < v.z) AS gone FROM p),
    k AS (SELECT *, (SELECT count(DISTINCT d2.band) FROM d AS d2 WHERE NOT d2.gone AND d2.l_orderkey = d.l_orderkey AND d2.part = d.part) > 1 AS several FROM d)
    SELECT l_orderkey, CAST(part AS INTEGER) AS part, CAST(CASE WHEN several THEN band ELSE 0 END AS INTEGER) AS band, {LINE_SQL}, arg_min(font_size_pt, ord) AS font_size_pt FROM k WHERE NOT (several AND gone) GROUP BY 1, 2, 3""",
)
def split_merged_lines(spark, sf_dir):
    return lines.split_lines(boxes(spark, sf_dir), ["l_orderkey"], "ord").withColumn("confidence", F.round("confidence", 6))


@register(
    "merge_line_into",
    f"""WITH RECURSIVE {WORD_BOXES}, z AS (SELECT *, l_orderkey // 4 AS into_line, l_orderkey % 4 <> 0 AS taken FROM w), o AS (SELECT *, row_number() OVER (PARTITION BY into_line ORDER BY x, taken, ord) AS i FROM z),
    f AS (SELECT into_line, i, 1 AS head, x, y, x + width AS x2, y + height AS y2, text, confidence FROM o WHERE i = 1 UNION ALL
      SELECT into_line, i, head, x, y, x2, y2, text, confidence FROM (SELECT o.into_line, o.i, CASE WHEN j THEN f.head ELSE f.head + 1 END AS head, CASE WHEN j THEN f.x ELSE o.x END AS x, CASE WHEN j THEN least(f.y, o.y) ELSE o.y END AS y, CASE WHEN j THEN greatest(f.x2, o.x + o.width) ELSE o.x + o.width END AS x2, CASE WHEN j THEN greatest(f.y2, o.y + o.height) ELSE o.y + o.height END AS y2,
        CASE WHEN NOT j THEN o.text WHEN NOT c THEN f.text || o.text WHEN o.confidence > f.confidence AND strlen(o.text) >= strlen(f.text) THEN o.text ELSE f.text END AS text, CASE WHEN NOT j THEN o.confidence WHEN c THEN greatest(f.confidence, o.confidence) ELSE (f.confidence + o.confidence) / 2 END AS confidence
        FROM f JOIN o ON o.into_line = f.into_line AND o.i = f.i + 1, LATERAL (SELECT f.x2 + 2 >= o.x AS j, greatest(f.x2 - o.x, 0) > (f.x2 - f.x) // 2 OR greatest(f.x2 - o.x, 0) > o.width // 2 AS c) t)),
    m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY into_line, head ORDER BY i DESC) AS last FROM f) WHERE last = 1)
    SELECT CAST(m.into_line AS BIGINT) AS into_line, string_agg(m.text, ' ' ORDER BY head) AS text, CAST(min(m.x) AS BIGINT) AS x, CAST(min(m.y) AS BIGINT) AS y, CAST(max(m.x2) - min(m.x) AS BIGINT) AS width, CAST(max(m.y2) - min(m.y) AS BIGINT) AS height, round(avg(m.confidence), 6) AS confidence, CAST(count(*) AS BIGINT) AS n_words, (SELECT font_size_pt FROM o WHERE o.into_line = m.into_line AND o.i = 1) AS font_size_pt FROM m GROUP BY m.into_line""",
)
def merge_line_into(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumn("into_line", F.floor(F.col("l_orderkey") / 4))
    return lines.merged_lines(b, ["into_line"], F.col("l_orderkey") % 4 == 0, "ord").withColumn("confidence", F.round("confidence", 6))


@register("lines_overlap", f"WITH {WORD_BOXES}, l AS (SELECT l_orderkey, l_orderkey // 50 AS page, min(x) AS x, min(y) AS y, max(x + width) AS x2, max(y + height) AS y2 FROM w GROUP BY l_orderkey) SELECT a.l_orderkey AS a, b.l_orderkey AS b FROM l AS a JOIN l AS b ON a.page = b.page AND a.l_orderkey < b.l_orderkey WHERE least(a.y2, b.y2) - greatest(a.y, b.y) >= 0.5 * least(a.y2 - a.y, b.y2 - b.y) AND least(a.y2, b.y2) > greatest(a.y, b.y) AND a.x < b.x2 AND b.x < a.x2")
def lines_overlap(spark, sf_dir):
    l_ = lines.line_rows(boxes(spark, sf_dir), ["l_orderkey"], "ord").withColumn("page", F.floor(F.col("l_orderkey") / 50))
    both = l_.alias("a").join(l_.alias("b"), (F.col("a.page") == F.col("b.page")) & (F.col("a.l_orderkey") < F.col("b.l_orderkey")))
    return both.where(L.lines_overlap("a", "b")).select(F.col("a.l_orderkey").alias("a"), F.col("b.l_orderkey").alias("b"))
