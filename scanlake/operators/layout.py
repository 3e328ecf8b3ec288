"""Words to lines: assembly, clean-up, splits, and ordered merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlake.functions.arrays import upper_median


def islands(df: DataFrame, keys: list[str], order: list, changed: Column, name: str = "island") -> DataFrame:
    """Numbers the stretches of each key's ordered rows; a new one starts where ``changed`` (over lag expressions) holds."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("starts_", F.coalesce(changed, F.lit(True)).cast("int")).withColumn(name, F.sum("starts_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("starts_")


def assemble_lines(words: DataFrame, keys: list[str], x: str, tie: str, text: str = "text") -> DataFrame:
    """One row per line: words sorted by x joined by spaces, box, mean confidence, the first word's size, number of words."""
    order = F.array_sort(F.collect_list(F.struct(F.col(x).alias("a"), F.col(tie).alias("b"), F.col(text).alias("t"))))
    return words.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").groupBy(*keys).agg(
        F.array_join(F.transform(order, lambda w: w["t"]), " ").alias("text"), F.min("x").alias("x"), F.min("y").alias("y"),
        (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"), (F.max(F.col("y") + F.col("height")) - F.min("y")).alias("height"),
        F.avg("confidence").alias("confidence"), F.min_by("font_size_pt", F.struct(x, tie)).alias("font_size_pt"), F.count("*").alias("n_words"),
    )


def drop_outlier_words(words: DataFrame, keys: list[str], height: str, confidence: str, ratio: float = 1.8, least: float = 70.0) -> DataFrame:
    """Words without those that are ``ratio`` times the line's upper-median height and below the least confidence; lines of one word are left alone."""
    line = words.groupBy(*keys).agg(F.count("*").alias("n_"), upper_median(F.col(height)).alias("median_"))
    out = (F.col("n_") >= 2) & (F.col("median_") > 0) & (F.col(height) >= ratio * F.col("median_")) & (F.col(confidence) < least)
    return words.join(line, keys).where(~out).drop("n_", "median_")


def split_by_height(words: DataFrame, keys: list[str], height: str, tie: str, ratio: float = 2.0, least: float = 10.0) -> DataFrame:
    """Marks the words above the largest jump of a line's sorted heights (1 at least each), where that is ``ratio`` or more: column ``upper``.

    The first of equal jumps counts. If the height below it is under ``least``, the line is not split, whatever its other jumps.
    """
    w = Window.partitionBy(*keys).orderBy(height, tie)
    line = Window.partitionBy(*keys)
    before = F.lag(height).over(w)
    d = words.withColumn("below_", before).withColumn("jump_", F.greatest(F.col(height), F.lit(1)) / F.greatest("below_", F.lit(1)))
    d = d.withColumn("jump_", F.when(F.col("below_").isNotNull() & (F.col("jump_") >= ratio), F.col("jump_")))
    best = F.min(F.when(F.col("jump_").isNotNull(), F.struct((-F.col("jump_")).alias("j"), F.col(height).alias("h"), F.col("below_").alias("b")))).over(line)
    d = d.withColumn("best_", best)
    return d.withColumn("upper", F.coalesce((F.col("best_.b") >= least) & (F.col(height) >= F.col("best_.h")), F.lit(False))).drop("below_", "jump_", "best_")


def coverage_valleys(boxes: DataFrame, key: str, y0: str, y1: str, confidence: str, least: float = 0.5, width: int = 2, order: str | None = None) -> DataFrame:
    """(key, valley_start, valley_end): interior stretches of ``width`` rows or more whose confidence-weighted coverage is below ``least``.

    A row's boxes are added up by ``order`` (else by their ends and confidence), not as tasks deliver them, so that a sum of
    doubles near ``least`` is the same whatever the partitions.
    """
    w = Window.partitionBy(key, "y").orderBy("at_")
    rows = boxes.select(key, F.explode(F.sequence(y0, F.col(y1) - 1)).alias("y"), (F.col(confidence) / 100).alias("c"), F.struct(*([order] if order else []), y0, y1, confidence).alias("at_"))
    rows = rows.withColumn("cover", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("last_", F.lead("at_").over(w).isNull()).where("last_").select(key, "y", "cover")
    span = boxes.groupBy(key).agg(F.min(y0).alias("lo"), (F.max(y1) - 1).alias("hi"))
    every = span.select(key, "lo", "hi", F.explode(F.sequence("lo", "hi")).alias("y")).join(rows, [key, "y"], "left")
    low = every.where(F.coalesce("cover", F.lit(0.0)) < least).withColumn("g", F.col("y") - F.row_number().over(Window.partitionBy(key).orderBy("y")))
    found = low.groupBy(key, "g", "lo", "hi").agg(F.min("y").alias("valley_start"), F.max("y").alias("valley_end"))
    return found.where((F.col("valley_start") > F.col("lo")) & (F.col("valley_end") < F.col("hi")) & (F.col("valley_end") - F.col("valley_start") + 1 >= width)).select(key, "valley_start", "valley_end")


def split_wide_gaps(chars: DataFrame, keys: list[str], left: str, right: str, threshold: Column) -> DataFrame:
    """Numbers the pieces of each word: a new one after a positive gap to the next character of ``threshold`` or more."""
    w = Window.partitionBy(*keys).orderBy("pos")
    gap = F.greatest(F.col(left) - F.lag(right).over(w), F.lit(0))
    return islands(chars, keys, ["pos"], F.lag(right).over(w).isNull() | (gap >= threshold), "piece")


def lines_overlap(a: str, b: str) -> Column:
    """Vertical overlap of half the shorter line and any horizontal overlap, for boxes aliased a and b."""
    c = lambda s, n: F.col(f"{s}.{n}")
    up = F.least(c(a, "y") + c(a, "height"), c(b, "y") + c(b, "height")) - F.greatest(c(a, "y"), c(b, "y"))
    across = F.least(c(a, "x") + c(a, "width"), c(b, "x") + c(b, "width")) - F.greatest(c(a, "x"), c(b, "x"))
    return (up >= 0.5 * F.least(c(a, "height"), c(b, "height"))) & (across > 0)


def merge_overlapping_words(words: DataFrame, keys: list[str]) -> DataFrame:
    """Ordered fold of each line's words by x: a gap of 2 px or less joins; an overlap of over half of either (whole pixels) keeps the other's text if that is surer and as long in bytes, else both texts follow each other.

    The result of a merge is what the next word is compared with, so it is no window but a fold over the line's sorted
    words, of which there are few.
    """
    fields = ["x", "word_num", "y", "width", "height", "text", "confidence"]
    kinds = dict(words.dtypes)
    kind = "array<struct<" + ", ".join(f"{f}: {kinds[f]}" for f in fields) + ">>"

    def step(done: Column, r: Column) -> Column:
        cur = F.element_at(done, -1)
        end, bottom = F.greatest(cur["x"] + cur["width"], r["x"] + r["width"]), F.greatest(cur["y"] + cur["height"], r["y"] + r["height"])
        covers = F.greatest(cur["x"] + cur["width"] - r["x"], F.lit(0)) > F.floor(F.least(cur["width"], r["width"]) / 2)
        better = (r["confidence"] > cur["confidence"]) & (F.octet_length(r["text"]) >= F.octet_length(cur["text"]))
        top = F.least(cur["y"], r["y"])
        joined = F.struct(
            cur["x"].alias("x"), cur["word_num"].alias("word_num"), top.alias("y"), (end - cur["x"]).alias("width"), (bottom - top).alias("height"),
            F.when(covers, F.when(better, r["text"]).otherwise(cur["text"])).otherwise(F.concat(cur["text"], r["text"])).alias("text"),
            F.when(covers, F.greatest(cur["confidence"], r["confidence"])).otherwise((cur["confidence"] + r["confidence"]) / 2).alias("confidence"),
        )
        apart = r["x"] - (cur["x"] + cur["width"]) > 2
        return F.when(F.size(done) == 0, F.array(r)).when(apart, F.concat(done, F.array(r))).otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).cast(kind)

    line = words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).cast(kind).alias("w"))
    return line.select(*keys, F.inline(F.aggregate("w", F.array().cast(kind), step)))


def merge_runs(runs: DataFrame, keys: list[str], across: str = "x", along: str = "y") -> DataFrame:
    """Greedy merge of runs (x1, x2, y1, y2) into lines: one joins the current head if it starts 2 px beyond its end or less and both its ends across are within 2 px of the head's; the head then ends where it ends.

    Horizontal runs go by x1, then y1; with across="y" and along="x" vertical ones by y1, then x1. Adds thickness, 1 at least.
    A fold over a key's sorted runs, of which there are as many as one region's lines have.
    """
    a1, a2, b1, b2 = f"{across}1", f"{across}2", f"{along}1", f"{along}2"
    kinds = dict(runs.dtypes)
    rest = [c for c in runs.columns if c not in keys and c not in (a1, b1)]
    fields = [a1, b1, *rest]
    kind = "array<struct<" + ", ".join(f"{f}: {kinds[f]}" for f in fields) + ">>"

    def step(done: Column, r: Column) -> Column:
        cur = F.element_at(done, -1)
        joins = (r[b1] <= cur[b2] + 2) & (F.abs(r[a1] - cur[a1]) <= 2) & (F.abs(r[a2] - cur[a2]) <= 2)
        joined = F.struct(*[(r if f == b2 else cur)[f].alias(f) for f in fields])
        return F.when((F.size(done) > 0) & joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(r))).cast(kind)

    one = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).cast(kind).alias("r"))
    done = one.select(*keys, F.inline(F.aggregate("r", F.array().cast(kind), step)))
    return done.select(*runs.columns, F.greatest(F.col(b2) - F.col(b1) + 1, F.lit(1)).cast("long").alias("thickness"))


def smooth_runs(rows: DataFrame, keys: list[str], order: list[str], font: str, value: str, band: float) -> DataFrame:
    """Adds ``smoothed``: within each stretch of one font, values within ``band`` of the mean become the (true) median of those; a null font breaks a stretch and stays."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = islands(rows, keys, order, F.lag(font).over(w).isNull() | (F.lag(font).over(w) != F.col(font)) | F.col(font).isNull(), "run_")
    run = Window.partitionBy(*keys, "run_")
    near = F.abs(F.col(value) - F.avg(value).over(run)) <= band
    d = d.withColumn("near_", near).withColumn("median_", F.percentile(F.when(F.col("near_"), F.col(value)), F.lit(0.5)).over(run))
    return d.withColumn("smoothed", F.when(F.col("near_") & F.col(font).isNotNull(), F.col("median_")).otherwise(F.col(value))).drop("near_", "median_", "run_")


def pen_positions(glyphs: DataFrame, keys: list[str], order: str, advance: str, kern: str) -> DataFrame:
    """Adds ``pen``: the sum of advances and kerning of the glyphs before."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return glyphs.withColumn("pen", F.coalesce(F.sum(F.col(advance) + F.coalesce(F.col(kern), F.lit(0))).over(w), F.lit(0)))


def pitch_errors(chars: DataFrame, keys: list[str], order: str, observed: str, predicted: str) -> DataFrame:
    """Adds ``pitch_error``: observed minus predicted step from the character before, null for the first."""
    w = Window.partitionBy(*keys).orderBy(order)
    return chars.withColumn("pitch_error", (F.col(observed) - F.lag(observed).over(w)) - (F.col(predicted) - F.lag(predicted).over(w)))
