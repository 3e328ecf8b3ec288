"""Lines made anew from their words: after merges, dropped words and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlake.operators.layout import drop_outlier_words, merge_overlapping_words, split_by_height


def line_rows(words: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a line from its words in their order: text, box, mean confidence, the first word's size (12 where it has none), number of words."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t")))), lambda w: w["t"]), " ")
    return words.groupBy(*keys).agg(
        text.alias("text"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"), (F.max(F.col("y") + F.col("height")) - F.min("y")).alias("height"),
        F.avg("confidence").alias("confidence"), F.coalesce(F.min_by("font_size_pt", order), F.lit(12.0)).alias("font_size_pt"), F.count("*").alias("n_words"),
    )


def merged_lines(words: DataFrame, keys: list[str], target: Column, order: str) -> DataFrame:
    """Lines that take in the words of others: words go by x, those of the target first where they share it; overlapping and abutting ones are merged.

    words carry the keys of the line they end up in; target says which are that line's own.
    """
    w = words.withColumn("word_num", F.struct((~target).alias("taken"), F.col(order).alias("o")))
    sizes = w.groupBy(*keys).agg(F.min_by("font_size_pt", F.struct("x", "word_num")).alias("font_size_pt"))
    fields = ["x", "word_num", "y", "width", "height", "text", "confidence"]
    done = merge_overlapping_words(w.select(*keys, *fields), keys).withColumn("font_size_pt", F.lit(0.0)).withColumn("at", F.struct("x", "word_num"))
    return line_rows(done, keys, "at").drop("font_size_pt").join(sizes, keys)


def lines_without_outliers(words: DataFrame, keys: list[str], order: str, ratio: float = 1.8, least: float = 70.0) -> DataFrame:
    """The lines of the words that drop_outlier_words leaves; a line without any goes. The size stays that of the whole line."""
    size = words.groupBy(*keys).agg(F.min_by("font_size_pt", order).alias("font_size_pt"))
    return line_rows(drop_outlier_words(words, keys, "height", "confidence", ratio, least), keys, order).drop("font_size_pt").join(size, keys)


#: Digits of a coverage that count: what the order of a sum of doubles changes lies far below.
DIGITS = 9


def split_merged(words: DataFrame, keys: list[str], order: str, least: float = 0.5, surest: float = 60.0) -> DataFrame:
    """The words with part and band, the line of theirs that they belong to after both splits.

    First a line is split at the largest jump of its words' heights (see split_by_height); then each part of three words or more
    at its valleys: interior stretches of 2 rows or more that words cover by less than ``least`` (each by its confidence, to DIGITS digits).
    A word whose middle lies in a valley goes if its confidence is below ``surest``. A part whose words left all lie
    in one band stays whole, with all its words.
    """
    parts = split_by_height(words, keys, "height", order).withColumn("part", F.col("upper").cast("int")).drop("upper")
    own = [*keys, "part"]
    box = parts.groupBy(*own).agg(F.min("y").alias("lo"), F.max(F.col("y") + F.col("height")).alias("hi"), F.count("*").alias("n")).where((F.col("n") >= 3) & (F.col("hi") > F.col("lo")))
    each = parts.join(box, own)
    covered = each.where("height > 0").select(*own, F.explode(F.sequence("y", F.col("y") + F.col("height") - 1)).alias("row"), (F.col("confidence") / 100).alias("c")).groupBy(*own, "row").agg(F.round(F.sum("c"), DIGITS).alias("c"))
    rows = box.select(*own, "lo", "hi", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("row")).join(covered, [*own, "row"], "left")
    low = rows.where(F.coalesce("c", F.lit(0.0)) < least).withColumn("g", F.col("row") - F.row_number().over(Window.partitionBy(*own).orderBy("row")))
    found = low.groupBy(*own, "g", "lo", "hi").agg(F.min("row").alias("a"), (F.max("row") + 1).alias("b")).where((F.col("b") - F.col("a") >= 2) & (F.col("a") > F.col("lo")) & (F.col("b") < F.col("hi")))
    valleys = found.groupBy(*own).agg(F.collect_list(F.struct("a", "b")).alias("valleys"))
    middle = F.col("y") + F.floor(F.col("height") / 2)
    d = parts.join(valleys, own, "left").withColumn("middle", middle)
    d = d.withColumn("band", F.coalesce(F.size(F.filter("valleys", lambda v: F.col("middle") >= v["b"])), F.lit(0)))
    gone = F.coalesce(F.exists("valleys", lambda v: (F.col("middle") >= v["a"]) & (F.col("middle") < v["b"])), F.lit(False)) & (F.col("confidence") < surest)
    w = Window.partitionBy(*own)
    d = d.withColumn("gone", gone).withColumn("kept_band", F.when(~F.col("gone"), F.col("band")))
    d = d.withColumn("several", F.coalesce(F.min("kept_band").over(w) < F.max("kept_band").over(w), F.lit(False)))
    return d.where(~(F.col("several") & F.col("gone"))).withColumn("band", F.when(F.col("several"), F.col("band")).otherwise(0)).select(*words.columns, "part", "band")


def split_lines(words: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The lines after split_merged."""
    return line_rows(split_merged(words, keys, order), [*keys, "part", "band"], order)
