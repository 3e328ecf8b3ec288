"""Queries of the image kernels, over rasters drawn for the embeddings; these have no SQL twin and are held against brute force in the tests."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from scanlake.operators import kernels as K, sequences, wordink
from scanlake.queries import register
from scanlake.session import table


def glyph(i: int, grey: np.ndarray) -> np.ndarray:
    """A glyph-like raster of the i-th vector: bars, bowls with holes, serifs and dots in a box of its own size, on uneven paper."""
    h, w = 18 + i % 15, 12 + i * 7 % 17
    img = np.full((h, w), 245.0)
    t, (y, x) = 1 + i % 3, np.mgrid[0:h, 0:w]
    if i % 2:
        img[2 : h - 2, 2 : 2 + t + 1] = 20
    if i % 3 != 1:
        r = np.hypot((y - h * 0.6) / (h * 0.3), (x - w * 0.55) / (w * 0.38))
        img[np.abs(r - 0.75) < 0.1 + 0.1 * t] = 35
    if i % 5 < 2:
        img[2 : 2 + t, 1 : w - 1 - i % 3] = 10
        img[h - 2 - t : h - 2, 1 : w - 2] = 10
    if i % 7 == 0:
        img[h // 2 : h // 2 + t, 2 : w - 2] = 60
    if i % 11 == 0:
        img[np.abs(y - x * h / w) < t] = 15
    noise = np.resize(grey, h * w).reshape(h, w)
    return np.clip(img + 14 * noise, 0, 255 if i % 13 else 200).astype(np.uint8)


def page(i: int, grey: np.ndarray) -> np.ndarray:
    """A page of text bands turned by up to 2 degrees."""
    rng = np.random.default_rng(i)
    img = np.full((160, 240), 255, np.uint8)
    for y in range(20, 140, 24 + i % 5):
        for x in range(20, 210, 9):
            img[y : y + 8, x : x + int(rng.integers(3, 8))] = 20
    return K.rotated(img, float(grey[0]) * 2)


def drawn(batches, draw, most: int = K.HELD):
    """Batches of rasters (id, width, height, px) drawn for batches of (id, embedding), each of about ``most`` bytes, as one of vectors makes far more."""

    def packed(ids, imgs, kind):
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array([x.shape[1] for x in imgs], pa.int32()), pa.array([x.shape[0] for x in imgs], pa.int32()), pa.array([x.tobytes() for x in imgs], pa.binary())], ["id", "width", "height", "px"])

    for batch in batches:
        kind, ids, imgs, held = batch.column("id").type, [], [], 0
        for i, v in zip(batch.column("id").to_pylist(), batch.column("embedding"), strict=True):
            ids.append(i)
            imgs.append(draw(i, np.asarray(v.as_py(), float)))
            held += imgs[-1].size
            if held >= most:
                yield packed(ids, imgs, kind)
                ids, imgs, held = [], [], 0
        if ids:
            yield packed(ids, imgs, kind)


def rasters(spark, sf_dir, draw=glyph):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return e.repartition(spark.sparkContext.defaultParallelism, "id").mapInArrow(lambda batches: drawn(batches, draw), f"id {dict(e.dtypes)['id']}, width int, height int, px binary")


@register("features_63")
def features_63(spark, sf_dir):
    return K.map_batches(rasters(spark, sf_dir), K.descriptors, "features")


@register("hog_128")
def hog_128(spark, sf_dir):
    return K.map_batches(rasters(spark, sf_dir), K.gradient_histograms, "hog")


@register("seam_split")
def seam_split(spark, sf_dir):
    return K.memoized(rasters(spark, sf_dir), lambda img: np.array(K.cuts(img, 4), dtype=np.int32), "array<int>", "cuts")


@register("skew_angle")
def skew_angle(spark, sf_dir):
    return K.map_rasters(rasters(spark, sf_dir, page), lambda img: K.skew_degrees(img, sure=False), "double", "skew")


@register("raster_similarity")
def raster_similarity(spark, sf_dir):
    """Each glyph against its blurred, lowered copy: trimmed similarity, greatest correlation and its shift, greatest windowed similarity and its shift."""

    def compare(imgs):
        low = [np.roll(K.blurred(x), 1, axis=0) for x in imgs]
        return np.array([[K.trimmed_ssim(a, b), *K.best_correlation(a, b), *K.best_shift(a, b)] for a, b in zip(imgs, low, strict=True)], np.float32), np.ones(len(imgs), bool)

    return K.map_batches(rasters(spark, sf_dir), compare, "values")


@register("refined_words")
def refined_words(spark, sf_dir):
    """Boxes of three words on each page of text bands, off by some pixels, refined by the ink."""
    pages = rasters(spark, sf_dir, page).withColumnRenamed("id", "page")
    # from the table, not from the pages, which would be drawn once more for that
    words = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("word"))
    words = words.select("page", F.lit(1).alias("line"), "word", (20 + 60 * F.col("word") + F.col("page") % 5).cast("int").alias("x"), (19 + F.col("page") % 3).cast("int").alias("y"), (54 + F.col("page") % 11).cast("int").alias("width"), F.lit(9).alias("height"))
    return wordink.refined(words, pages, "page", "line", "word")


@register(
    "obs_alignment",
    """WITH RECURSIVE o AS (SELECT l_orderkey, l_linenumber * 100000 + l_partkey AS pos, l_returnflag AS ch, l_discount AS prob FROM lineitem),
    x AS (SELECT l_orderkey, list(struct_pack(pos := pos, ch := ch, prob := prob) ORDER BY pos, ch, prob) AS xs FROM o WHERE pos % 5 <> 0 GROUP BY l_orderkey), y AS (SELECT l_orderkey, list(ch ORDER BY pos, ch, prob) AS yc, list(prob ORDER BY pos, ch, prob) AS yp FROM o WHERE pos % 7 <> 0 GROUP BY l_orderkey),
    b AS (SELECT x.l_orderkey, xs, coalesce(yc, []) AS yc, coalesce(yp, []) AS yp FROM x LEFT JOIN y ON x.l_orderkey = y.l_orderkey),
    f AS (SELECT l_orderkey, xs, yc, yp, 0 AS i, 0 AS spot, CAST(0 AS BIGINT) AS hit FROM b UNION ALL SELECT l_orderkey, xs, yc, yp, i + 1, CAST(spot + h AS INTEGER), h FROM (SELECT *, CASE WHEN len(xs) = len(yc) THEN 1 ELSE coalesce(list_position(yc[spot + 1 : spot + 6], xs[i + 1].ch), 0) END AS h FROM f WHERE i < len(xs)))
    SELECT l_orderkey, xs[i].pos AS pos, xs[i].ch AS ch, xs[i].prob AS prob, CASE WHEN hit > 0 THEN yp[spot] END AS other FROM f WHERE i > 0""",
)
def obs_alignment(spark, sf_dir):
    """Two character sequences of each order aligned in order with a bounded lookahead."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("pos"), F.col("l_returnflag").alias("ch"), F.col("l_discount").alias("prob"))
    return sequences.align(li.where("pos % 5 <> 0"), li.where("pos % 7 <> 0"), "l_orderkey")
