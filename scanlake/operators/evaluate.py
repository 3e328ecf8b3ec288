"""Ground-truth lookup, hit and miss classes, accuracy, and report row sets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlake.functions.text import strip_subset_prefix
from scanlake.session import dealt_by, parts


def lookup_span(boxes: DataFrame, spans: DataFrame, page: str, box: str) -> DataFrame:
    """(box, span_ord, how): the best ground-truth span of every box, or none.

    boxes and spans have x0, x1, y0, y1 (and spans span_ord); only those of one page meet, by an equality join with
    the overlap as its condition. Greatest intersection first, then the nearest centre, then the first span; where none
    intersects, one that overlaps in y with the least distance of centres.
    """
    b, s = boxes.alias("b"), spans.alias("s")
    both = b.join(s, (F.col(f"b.{page}") == F.col(f"s.{page}")) & (F.least("b.y1", "s.y1") > F.greatest("b.y0", "s.y0")))
    across, down = F.least("b.x1", "s.x1") - F.greatest("b.x0", "s.x0"), F.least("b.y1", "s.y1") - F.greatest("b.y0", "s.y0")
    area = F.when(across > 0, across * down).otherwise(F.lit(0.0))
    dx = F.abs((F.col("b.x0") + F.col("b.x1")) / 2 - (F.col("s.x0") + F.col("s.x1")) / 2)
    best = both.groupBy(F.col(f"b.{box}").alias(box)).agg(F.min(F.struct((-F.round(area, 3)).alias("a"), dx.alias("d"), F.col("s.span_ord").alias("o"))).alias("m"))
    found = best.select(box, F.col("m.o").alias("span_ord"), F.when(F.col("m.a") < 0, "overlap").otherwise("row").alias("how"))
    return boxes.select(box).join(found, box, "left")


def canonical_names(named: DataFrame, catalog: DataFrame, name: str) -> DataFrame:
    """Adds canonical: the name without its subset prefix where it is a catalog postscript name or key, else the postscript name of the first entry (by ``ord``) with that raw name, else the name without the prefix.

    The catalog has one row a name on either side of the joins, so names that several entries share multiply nothing.
    """
    d = named.withColumn("raw_", strip_subset_prefix(F.col(name)))
    known = catalog.select(F.explode(F.array("postscript_name", "font_key")).alias("raw_")).where("raw_ IS NOT NULL").distinct().withColumn("known_", F.lit(True))
    by_raw = catalog.groupBy(F.col("raw_name").alias("raw_")).agg(F.min_by("postscript_name", "ord").alias("canonical_"))
    d = d.join(known, "raw_", "left").join(by_raw, "raw_", "left")
    return d.select(*named.columns, F.when(F.col("known_"), F.col("raw_")).otherwise(F.coalesce("canonical_", "raw_")).alias("canonical"))


def is_hit(truth: Column, matched: Column) -> Column:
    """Without a truth everything counts as a hit."""
    return F.coalesce(truth == matched, F.lit(True))


def decision(confidence: Column, text: Column, font: Column, least: float) -> Column:
    return F.when((confidence >= least) & (F.trim(F.coalesce(text, F.lit(""))) != "") & font.isNotNull(), "vectorized").otherwise("kept_raster")


def miss_class(kept: Column, truth: Column, matched: Column, truth_family: Column, family: Column, truth_italic: Column, italic: Column, passed: Column | None = None) -> Column:
    """kept_raster, no_ground_truth, hit, minor_miss (same family and slope) or major_miss, in this order.

    With ``passed`` there is no ground truth at all: kept, similarity_failure where it is false, or hit.
    """
    if passed is not None:
        return F.when(kept, "kept_raster").when(passed.eqNullSafe(F.lit(False)), "similarity_failure").otherwise("hit")
    base = lambda c: F.split_part(c, F.lit("["), F.lit(1))
    same = truth_family.eqNullSafe(family) & truth_italic.eqNullSafe(italic)
    return F.when(kept, "kept_raster").when(truth.isNull(), "no_ground_truth").when(base(truth) == base(matched), "hit").when(same, "minor_miss").otherwise("major_miss")


def accuracy(classified: DataFrame, cls: str, keys: tuple = ()) -> DataFrame:
    """Counts by class; compared leaves out rows without truth; pct is 100 where nothing is compared."""
    n = lambda *c: F.count_if(F.col(cls).isin(*c))
    d = classified.groupBy(*keys).agg(n("hit").alias("hits"), n("minor_miss").alias("minor_misses"), n("major_miss").alias("major_misses"), n("similarity_failure").alias("similarity_failures"), n("kept_raster").alias("kept_raster"))
    d = d.withColumn("compared", F.col("hits") + F.col("minor_misses") + F.col("major_misses") + F.col("similarity_failures") + F.col("kept_raster"))
    d = d.withColumn("primary_hits", F.col("compared") - F.col("major_misses") - F.col("similarity_failures") - F.col("kept_raster"))
    return d.withColumn("pct", F.when(F.col("compared") == 0, 100.0).otherwise(100.0 * F.col("primary_hits") / F.col("compared")))


def interesting(rows: DataFrame, key: str, index: str, delta: str, n: int, best: str | None = None) -> DataFrame:
    """n rows a key at most, in order of index: the n / 2 greatest deltas (by size) of either sign, then the greatest of the rest.

    Deltas of 0 are never shown. Where a key has no delta at all (all null), the n rows with the least ``best`` are shown.
    Ties go by index. A task gets PART_BYTES of the rows' files, however large they are.
    """
    half = n // 2
    size, side = F.abs(F.col(delta)), F.col(delta) > 0
    d = dealt_by(rows, key).withColumn("none_", F.count(delta).over(Window.partitionBy(key)) == 0)
    d = d.where((F.col("none_") & F.lit(best is not None)) | (F.col(delta) != 0))
    least = F.col(best) if best else F.lit(0)
    d = d.withColumn("k_", F.row_number().over(Window.partitionBy(key, side).orderBy(size.desc(), F.col(index))))
    d = d.withColumn("late_", (F.col("k_") > half).cast("int"))
    order = [F.when(F.col("none_"), 0).otherwise(F.col("late_")), F.when(F.col("none_"), least), size.desc(), F.col(index)]
    d = d.withColumn("r_", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return d.where(F.col("r_") <= n).drop("none_", "k_", "late_", "r_")


#: Bounds between buckets of sorted rows are chosen among so many rows a bucket.
SAMPLED = 40


def buckets(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """Adds bucket_, 0 and up, which rises with the rows' order (nulls first): n ranges or fewer of about as many rows each.

    The bounds are rows themselves, picked by a hash in a run of its own, so they are the same wherever bucket_ is computed.
    They decide the ranges' sizes only; every row has its bucket.
    """
    key = F.struct(*order)
    some = rows.select(key.alias("key_")).orderBy(F.xxhash64("key_")).limit(SAMPLED * n)
    found = [r["key_"] for r in some.orderBy("key_").collect()][SAMPLED::SAMPLED]
    kinds = {f.name: f.dataType for f in rows.select(*order).schema.fields}
    fixed = lambda some: F.array(*[F.struct(*[F.lit(b[c]).cast(kinds[c]).alias(c) for c in order]) for b in some])
    if not found:
        return rows.withColumn("bucket_", F.lit(0))
    step = math.isqrt(len(found))
    reached = lambda bounds: F.size(F.filter(bounds, lambda b: b <= F.col("key_")))
    d = rows.withColumn("key_", key).withColumn("coarse_", reached(fixed(found[::step])))
    fine = (F.col("coarse_") - 1) * step
    return d.withColumn("bucket_", F.when(F.col("coarse_") == 0, 0).otherwise(fine + reached(F.slice(fixed(found), fine + 1, step)))).drop("key_", "coarse_")


def report_order(rows: DataFrame, section: str, similarity: str, wrong_text: str, n: int | None = None) -> DataFrame:
    """Adds shown_in and place: rows with wrongly recognised text form the last section; least similar first, unknown before all.

    There are few sections, so the rows of large files (or with n) are dealt in n ranges of their order; a row's place is that
    within its range after the rows of its section in the ranges before.
    """
    d = rows.withColumn("shown_in", F.when(F.col(wrong_text), "ocr_wrong").otherwise(F.col(section)))
    order = [similarity, *[c for c in ("page", "line") if c in rows.columns]]
    n = n or parts(rows)
    sorted_ = [F.col(c).asc_nulls_first() for c in order]
    if n == 1:
        return d.withColumn("place", F.row_number().over(Window.partitionBy("shown_in").orderBy(*sorted_)))
    d = buckets(d, ["shown_in", *order], n)
    counts = d.groupBy(F.col("shown_in").alias("of_"), F.col("bucket_").alias("at_")).count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("of_").orderBy("at_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = d.repartition(n, "bucket_").withColumn("own_", F.row_number().over(Window.partitionBy("bucket_", "shown_in").orderBy(*sorted_)))
    both = own.join(F.broadcast(counts.select("of_", "at_", before.alias("before_"))), F.col("shown_in").eqNullSafe(F.col("of_")) & (F.col("bucket_") == F.col("at_")))
    return both.select(*rows.columns, "shown_in", (F.col("before_") + F.col("own_")).cast("int").alias("place"))
