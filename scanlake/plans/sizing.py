"""Queries of sizes, adjustments and character maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlake.operators import sizing as S
from scanlake.queries import register
from scanlake.session import table
from scanlake.sources import pdftext

WORDS_SQL = "w AS (SELECT l_orderkey AS line, list(l_quantity * 3.0 + l_linenumber * 10 ORDER BY l_linenumber, l_partkey, l_suppkey) AS centres, list(l_partkey % 40 * 1.0 + l_linenumber * 100 ORDER BY l_linenumber, l_partkey, l_suppkey) AS positions FROM lineitem GROUP BY l_orderkey), t AS (SELECT line, line % 4 AS font, centres, positions, CASE line % 3 WHEN 0 THEN repeat('a', len(centres)) WHEN 1 THEN repeat('1', len(centres)) ELSE repeat('b', len(centres) + line % 2) END AS text FROM w)"


def lines(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("line")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("c"))
    n = F.size("c")
    text = F.when(F.col("line") % 3 == 0, F.expr("repeat('a', size(c))")).when(F.col("line") % 3 == 1, F.expr("repeat('1', size(c))")).otherwise(F.expr("repeat('b', size(c) + cast(line % 2 as int))"))
    return li.select("line", (F.col("line") % 4).alias("font"), F.transform("c", lambda x: x["l_quantity"] * 3.0 + x["l_linenumber"] * 10).alias("centres"), F.transform("c", lambda x: (x["l_partkey"] % 40).cast("double") + x["l_linenumber"] * 100).alias("positions"), text.alias("text"), n.alias("n"))


SCALES_SQL = f"{WORDS_SQL}, s AS (SELECT line, font, (centres[len(centres)] - centres[1]) / (positions[len(positions)] - positions[1]) AS scale FROM t WHERE line % 3 <> 1 AND length(text) = len(centres) AND len(centres) >= 2 AND centres[len(centres)] - centres[1] >= 0.5 AND positions[len(positions)] - positions[1] >= 0.5)"


def scales(spark, sf_dir):
    d = lines(spark, sf_dir)
    return S.word_scales(d.select("line", "text", "centres"), d.select("line", "font", "positions"), ["line"], "font", "text")


@register("word_scales", f"WITH {SCALES_SQL} SELECT line, font, round(scale, 6) AS scale FROM s")
def word_scales(spark, sf_dir):
    return scales(spark, sf_dir).withColumn("scale", F.round("scale", 6))


@register("em_sizes", f"WITH {SCALES_SQL}, m AS (SELECT line // 8 AS block, font, list_sort(list(scale * (font * 1000))) AS e FROM s WHERE font > 0 GROUP BY ALL) SELECT CAST(block AS BIGINT) AS block, font, round(e[len(e) // 2 + 1], 6) AS em_px FROM m")
def em_sizes(spark, sf_dir):
    units = spark.createDataFrame([(k, 1000 * k) for k in range(4)], "font bigint, units int")
    s = scales(spark, sf_dir).withColumn("block", F.floor(F.col("line") / 8))
    return S.em_sizes(s, ["block"], "font", units).withColumn("em_px", F.round("em_px", 6))


MATCH_SQL = """d AS (SELECT c_custkey AS word, c_custkey % 3 AS font, c_name AS text, 20.0 + c_custkey % 300 AS width FROM customer), ch AS (SELECT word, font, width, text, unnest(range(1, length(text) + 1)) AS k FROM d),
a AS (SELECT word, font, width, CASE WHEN ord(substr(text, k, 1)) % 5 <> font THEN ord(substr(text, k, 1)) % 7 / 10.0 ELSE 0 END + CASE WHEN k > 1 AND ord(substr(text, k - 1, 1)) % 2 = 0 AND ord(substr(text, k, 1)) % 3 = 0 THEN -0.05 ELSE 0 END AS adv FROM ch),
e AS (SELECT word, font, greatest(4.0, least(500.0, width / sum(adv))) AS em_px FROM a GROUP BY word, font, width HAVING sum(adv) * 1000 >= 0.1)"""


def matched(spark, sf_dir):
    words = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("word"), (F.col("c_custkey") % 3).alias("font"), F.col("c_name").alias("text"), (20.0 + F.col("c_custkey") % 300).alias("width"))
    codes = spark.range(32, 127).select(F.col("id").cast("int").alias("code"), F.char("id").alias("char"))
    fonts = spark.range(3).select(F.col("id").alias("font"))
    each = codes.withColumn("font", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)])))
    advances = each.where(F.col("code") % 5 != F.col("font")).select("font", "char", (F.col("code") % 7 / 10.0).alias("advance"))
    left = each.where("code % 2 = 0").select("font", F.col("char").alias("left"))
    right = each.where("code % 3 = 0").select("font", F.col("char").alias("right"))
    pairs = left.join(right, "font").join(fonts, "font").withColumn("kern", F.lit(-0.05))
    return S.width_matched(words, advances, pairs, ["word"], "font", "text", "width")


@register("width_matched_sizes", f"WITH {MATCH_SQL} SELECT word, font, round(em_px, 6) AS em_px FROM e")
def width_matched_sizes(spark, sf_dir):
    return matched(spark, sf_dir).withColumn("em_px", F.round("em_px", 6))


@register("inferred_sizes", f"WITH {MATCH_SQL}, m AS (SELECT word // 10 AS line, list_sort(list(em_px)) AS s FROM e GROUP BY word // 10) SELECT CAST(line AS BIGINT) AS line, round(s[len(s) // 2 + 1] * 72.0 / 300, 6) AS median_pt, CAST(len(s) AS BIGINT) AS n_words FROM m")
def inferred_sizes(spark, sf_dir):
    d = matched(spark, sf_dir).withColumn("line", F.floor(F.col("word") / 10))
    return S.inferred_sizes(d, ["line"], 300).withColumn("median_pt", F.round("median_pt", 6))


@register("baselines", "SELECT event_id, round((value + 10 - 1.2 * (event_id % 50 + 10)) / 2 + 0.9 * (event_id % 50 + 10), 6) AS baseline FROM events")
def baselines(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(S.baseline(F.lit(0.9), F.lit(-0.3), F.col("event_id") % 50 + 10, F.col("value") + 10), 6).alias("baseline"))


@register(
    "single_adjustments",
    """WITH t AS (SELECT l_suppkey AS font, l_partkey % 30 AS glyph, l_linenumber AS lookup, min(l_orderkey) AS subtable FROM lineitem WHERE l_partkey % 30 < 20 GROUP BY ALL), v AS (SELECT font, glyph, sum(subtable % 11 - 5) AS x_place, sum(subtable % 7 - 3) AS y_place, sum(subtable % 5) AS x_advance, sum(0) AS y_advance FROM t GROUP BY font, glyph),
    g AS (SELECT DISTINCT l_suppkey AS font, l_partkey % 30 AS glyph FROM lineitem) SELECT g.font, g.glyph, CAST(coalesce(x_place, 0) AS BIGINT) AS x_place, CAST(coalesce(y_place, 0) AS BIGINT) AS y_place, CAST(coalesce(x_advance, 0) AS BIGINT) AS x_advance, CAST(coalesce(y_advance, 0) AS BIGINT) AS y_advance FROM g LEFT JOIN v ON v.font = g.font AND v.glyph = g.glyph""",
)
def single_adjustments(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem"), F.col("l_orderkey")
    g = li.select(F.col("l_suppkey").alias("font"), (F.col("l_partkey") % 30).alias("glyph"), F.col("l_linenumber").alias("lookup"), o.alias("subtable"), (o % 11 - 5).alias("x_place"), (o % 7 - 3).alias("y_place"), (o % 5).alias("x_advance"), F.lit(0).cast("long").alias("y_advance"))
    return S.single_adjustments(g.select("font", "glyph").distinct(), g.where("glyph < 20"), "font", "glyph")


@register("redundant_eras", "SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN true WHEN p_partkey % 5 = 0 THEN false WHEN p_partkey % 7 = 0 THEN true WHEN p_partkey % 3 = 0 THEN true ELSE p_partkey <= 300 END AS redundant FROM part")
def redundant_eras(spark, sf_dir):
    n = F.col("p_partkey")
    era = F.element_at(F.array(*map(F.lit, ("PostScript", "TrueType", "OpenType", "Variable"))), (F.col("p_size") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", S.is_redundant_era(era, n % 5 == 0, n % 7 == 0, F.when(n % 3 != 0, n)).alias("redundant"))


@register(
    "character_maps",
    f"""WITH e AS (SELECT p_size % 5 AS font, p_partkey AS code, 256 + p_partkey % 5000 AS ch, (row_number() OVER (PARTITION BY p_size % 5 ORDER BY p_partkey) - 1) // 100 AS block FROM part), b AS (SELECT font, block, count(*) || ' beginbfchar' || chr(10) || string_agg(printf('<%04X> <%04X>', code, ch) || chr(10), '' ORDER BY code) || 'endbfchar' || chr(10) AS t FROM e GROUP BY font, block)
    SELECT font, md5(replace('{pdftext.MAP_HEAD.replace(chr(10), "~")}', '~', chr(10)) || string_agg(t, '' ORDER BY block) || replace('{pdftext.MAP_TAIL.replace(chr(10), "~")}', '~', chr(10))) AS cmap FROM b GROUP BY font""",
)
def character_maps(spark, sf_dir):
    e = table(spark, sf_dir, "part").select((F.col("p_size") % 5).alias("font"), F.col("p_partkey").alias("code"), F.decode(F.unhex(F.lpad(F.hex(256 + F.col("p_partkey") % 5000), 4, "0")), "UTF-16BE").alias("ch"))
    return pdftext.character_maps(e, "font", "code", "ch").select("font", F.md5("cmap").alias("cmap"))
