"""Sizes and adjustments from measured words and glyph metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlake.functions.arrays import upper_median
from scanlake.functions.scores import center_span_scale, em_from_scale
from scanlake.functions.text import is_sizing_anchor

#: The limits of an em size in pixels, and the least advance that counts.
LEAST_EM, MOST_EM, LEAST_ADVANCE = 4.0, 500.0, 0.1


def word_scales(words: DataFrame, predicted: DataFrame, word: list[str], font: str, text: str) -> DataFrame:
    """(word, font, scale): pixels a font unit from the span of a word's first to last centre.

    words: word, text and centres, an array of measured ones; predicted: word, font and positions, an array in font units. Only
    words that can size a line count, with a centre for each of their two characters or more and two positions at least.
    """
    sized = words.where(is_sizing_anchor(F.col(text)) & (F.size("centres") == F.length(text)) & (F.size("centres") >= 2))
    d = sized.join(predicted, word).where(F.size("positions") >= 2)
    scale = center_span_scale(F.get("centres", F.lit(0)), F.element_at("centres", -1), F.get("positions", F.lit(0)), F.element_at("positions", -1))
    return d.select(*word, font, scale.alias("scale")).where("scale IS NOT NULL")


def em_sizes(scales: DataFrame, keys: list[str], font: str, units: DataFrame) -> DataFrame:
    """(keys, font, em_px): the upper median of a line's words' em sizes; fonts without units (font, units) are left out."""
    d = scales.join(units.where(F.col("units") > 0), font)
    return d.groupBy(*keys, font).agg(upper_median(em_from_scale(F.col("scale"), F.col("units"))).alias("em_px"))


def width_matched(words: DataFrame, advances: DataFrame, pairs: DataFrame, word: list[str], font: str, text: str, width: str) -> DataFrame:
    """(word, font, em_px): the em size at which a word's advances and kerning add up to its width, within LEAST_EM and MOST_EM.

    advances: font, char, advance; pairs: font, left, right, kern; both in ems. Unknown characters have no advance, unknown
    pairs no kerning; words that add up to less than a tenth of a thousandth of an em at 1000 pixels are left out.
    """
    chars = words.select(*word, font, width, F.posexplode(F.filter(F.split(text, ""), lambda c: c != "")).alias("at", "char"))
    chars = chars.withColumn("left", F.lag("char").over(Window.partitionBy(*word, font).orderBy("at")))
    d = chars.join(advances, [font, "char"], "left").join(pairs.withColumnRenamed("right", "char"), [font, "left", "char"], "left")
    total = d.groupBy(*word, font, width).agg(F.sum(F.coalesce("advance", F.lit(0.0)) + F.coalesce("kern", F.lit(0.0))).alias("total"))
    em = F.greatest(F.lit(LEAST_EM), F.least(F.lit(MOST_EM), F.col(width) / F.col("total")))
    return total.where(F.col("total") * 1000 >= LEAST_ADVANCE).select(*word, font, em.alias("em_px"))


def inferred_sizes(matched: DataFrame, keys: list[str], dpi: int) -> DataFrame:
    """(keys, median_pt, n_words): the upper median of a line's width-matched words, in points."""
    return matched.groupBy(*keys).agg((upper_median(F.col("em_px")) * 72.0 / dpi).alias("median_pt"), F.count("*").alias("n_words"))


def baseline(ascent: Column, descent: Column, em_px: Column, box_height: Column) -> Column:
    """Pixels from a box's top to the baseline that centres the ink of a font (ascent, descent below 0, in ems) in it."""
    return (box_height - (ascent - descent) * em_px) / 2 + ascent * em_px


def single_adjustments(glyphs: DataFrame, tables: DataFrame, font: str, glyph: str) -> DataFrame:
    """(font, glyph, x_place, y_place, x_advance, y_advance): of each lookup the first subtable that covers the glyph, added up over the lookups; zeros without any."""
    own = [font, glyph]
    values = ("x_place", "y_place", "x_advance", "y_advance")
    first = tables.groupBy(*own, "lookup").agg(F.min_by(F.struct(*values), "subtable").alias("v")).groupBy(*own).agg(*[F.sum(F.coalesce(F.col(f"v.{c}"), F.lit(0))).alias(c) for c in values])
    return glyphs.select(*own).join(first, own, "left").select(*own, *[F.coalesce(c, F.lit(0)).alias(c) for c in values])


#: Fixed value: pairs that the oldest era keeps.
KEPT_PAIRS = 300


def is_redundant_era(era: Column, has_feature: Column, kept_as_is: Column, pairs: Column) -> Column:
    """Whether an era's variant of a font is one that the catalog has anyway: all but PostScript ones are, and those that neither lose a kern feature nor pairs beyond KEPT_PAIRS."""
    return (era != "PostScript") | (~has_feature & (kept_as_is | F.coalesce(pairs <= KEPT_PAIRS, F.lit(True))))
