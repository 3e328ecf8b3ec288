"""Audit rows, colours, fragments, placements, and font facts of a document run."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.functions.arrays import total
from scanlake.functions.text import normalize_text


def enrich(entries: DataFrame) -> DataFrame:
    """Adds gt_rank and gt_score, the place (from 1) and score of the expected key among the candidates, and ocr_correct, whether the texts are equal but for case and white space; null without truth."""
    place = F.array_position(F.transform("font_candidates", lambda c: c["key"]), F.col("expected_font"))
    d = entries.withColumn("gt_rank", F.when(place > 0, place).cast("int"))
    return d.withColumn("gt_score", F.get("font_candidates", F.col("gt_rank") - 1)["score"]).withColumn("ocr_correct", normalize_text(F.col("gt_text")) == normalize_text(F.col("ocr_text")))


def text_colour(pixels: DataFrame, keys: list[str], value: str, threshold: str, channels: list[str]) -> DataFrame:
    """Mean colour (integer division) of a region's text: its dark pixels if they are half or fewer, else its light ones."""
    dark = F.col(value) <= F.col(threshold)
    n, total = F.count_if(dark), F.count("*")
    mean = lambda c: F.when(2 * n <= total, F.floor(F.try_divide(F.sum(F.when(dark, F.col(c))), n))).otherwise(F.floor(F.try_divide(F.sum(F.when(~dark, F.col(c))), total - n)))
    return pixels.groupBy(*keys).agg(*[F.coalesce(mean(c), F.lit(0)).cast("int").alias(c) for c in channels])


def fragments(cells: DataFrame, page: str, x: str, y: str, value: str, least: float = 100.0) -> DataFrame:
    """(page, x0, y0, x1, y1, n_cells): boxes of the 4-connected groups of cells whose grey values vary by more than ``least``.

    The cells' variance is a plain aggregate; a page's cells are few (its pixels over the cell's area), so the groups are
    found per page.
    """
    busy = cells.groupBy(page, x, y).agg(F.var_pop(value).alias("v")).where(F.col("v") > least).select(page, F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y"))

    def groups(rows: pd.DataFrame) -> pd.DataFrame:
        left, out = set(zip(rows["x"], rows["y"], strict=True)), []
        while left:
            todo, own = [min(left)], []
            left.discard(todo[0])
            while todo:
                a, b = todo.pop()
                own.append((a, b))
                for c in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                    if c in left:
                        left.discard(c)
                        todo.append(c)
            xs, ys = [p for p, _ in own], [q for _, q in own]
            out.append((rows[page].iloc[0], min(xs), min(ys), max(xs), max(ys), len(own)))
        return pd.DataFrame(out, columns=[page, "x0", "y0", "x1", "y1", "n_cells"])

    return busy.groupBy(page).applyInPandas(groups, f"{page} {dict(cells.dtypes)[page]}, x0 bigint, y0 bigint, x1 bigint, y1 bigint, n_cells bigint")


def used_characters(placed: DataFrame, font: str, text: str) -> DataFrame:
    """(font, n_chars, chars, chunks): the distinct characters that a font has to keep, in order, and how many blocks of 100 list them."""
    each = placed.select(font, F.explode(F.split(text, "")).alias("ch")).where("ch <> ''").distinct()
    got = each.groupBy(font).agg(F.count("*").alias("n_chars"), F.array_join(F.array_sort(F.collect_list("ch")), "").alias("chars"))
    return got.withColumn("chunks", F.ceil(F.col("n_chars") / 100).cast("long"))


def placements(lines: DataFrame, dpi: int, page_height: str) -> DataFrame:
    """Adds x_pt, y_pt: a box's lower left corner in points from the page's lower left."""
    return lines.withColumn("x_pt", F.col("x") * 72.0 / dpi).withColumn("y_pt", (F.col(page_height) - F.col("y") - F.col("height")) * 72.0 / dpi)


def erased(lines: DataFrame, fills: DataFrame) -> DataFrame:
    """(page, x, y, width, height): rectangles of detected lines, wider and higher by their thickness, and of fills."""
    a = lines.select("page", F.least("x1", "x2").alias("x"), F.least("y1", "y2").alias("y"), (F.abs(F.col("x2") - F.col("x1")) + F.col("thickness")).alias("width"), (F.abs(F.col("y2") - F.col("y1")) + F.col("thickness")).alias("height"))
    return a.unionByName(fills.select("page", "x", "y", "width", "height"))


def resolve(names: DataFrame, catalog: DataFrame, name: str) -> DataFrame:
    """Adds resolved: the key of the entry whose path, else key, else postscript name is the name."""
    d = names
    for k, column in enumerate(("path", "font_key", "postscript_name")):
        one = catalog.groupBy(F.col(column).alias(f"n{k}_")).agg(F.min("font_key").alias(f"k{k}_"))
        d = d.join(one, d[name] == one[f"n{k}_"], "left")
    return d.select(*names.columns, F.coalesce("k0_", "k1_", "k2_").alias("resolved"))


def shipped(fonts: DataFrame, eras: DataFrame, family: str, bound: int = 10_000) -> DataFrame:
    """(family, era): eras, a fixed list of (era, start, family), with a family that holds the font's normalised name or is held by it, and that began no earlier than the font.

    The list may have ``bound`` rows, which is checked before it is sent to every task.
    """
    rows = eras.orderBy("era").limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"the list of eras has more than {bound} rows")
    plain = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    listed = F.array(*[F.struct(F.lit(r["era"]).alias("era"), F.lit(r["start"]).alias("start"), plain(F.lit(r["family"])).alias("m")) for r in rows])
    a = fonts.withColumn("n_", plain(F.col(family)))
    near = F.filter(listed, lambda e: (F.contains("n_", e["m"]) | F.contains(e["m"], F.col("n_"))) & (F.col("birth") <= e["start"]))
    return a.select(family, F.explode(F.transform(near, lambda e: e["era"])).alias("era")).distinct()


def sampled(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """The n rows that come first in a seeded order; the same whatever the partitions."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def similarity_softmax(rows: DataFrame, sharpness: float = 10.0) -> DataFrame:
    """Adds prob to the scores (id, d) of each row: the softmax of the correlations d."""
    d = rows.withColumn("top_", F.array_max(F.transform("scores", lambda x: x["d"])))
    d = d.withColumn("raw_", F.transform("scores", lambda x: F.exp(sharpness * (x["d"] - F.col("top_"))))).withColumn("sum_", total(F.col("raw_")))
    return d.withColumn("scores", F.transform("scores", lambda x, i: F.struct(x["id"].alias("id"), x["d"].alias("d"), (F.get("raw_", i) / F.col("sum_")).alias("prob")))).drop("top_", "raw_", "sum_")


def ocr_correction(votes: DataFrame, key: str, own: str, least: Column, ratio: float = 3.0) -> DataFrame:
    """(key, correction): the likeliest character where its probability is above ``least``, above ``ratio`` times that of the recognised one, and it differs."""
    top = votes.groupBy(key, own).agg(F.min(F.struct((-F.col("prob")).alias("p"), F.col("ch").alias("c"))).alias("t"), F.coalesce(F.max(F.when(F.col("ch") == F.col(own), F.col("prob"))), F.lit(1e-30)).alias("own_p"))
    return top.select(key, F.when((-F.col("t.p") > least) & (-F.col("t.p") > ratio * F.col("own_p")) & (F.col("t.c") != F.col(own)), F.col("t.c")).alias("correction"))
