"""Operator 5: mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanlake.llm.common import Scratch, carried, words

BUCKETS = 4096


def fill(sources: DataFrame, weights=(5, 2, 1), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """Water-filling over one row per source: (skey, source, source_size) -> + target.

    Sources take the weights in turn, by code point, null last. Water rises in every source at the pace of its
    weight; a source stops at ``max_epochs`` times its size and what it can't hold goes on to the others, which in
    closed form is one level found from sums over the sources ordered by cap over weight. The table has a row per
    source, so its windows hold as many rows as there are sources, whatever the corpus.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1
    w = sources.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn))
    w = w.withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    rising = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, rest, all_ = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.lit(float(share)) * F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    w = w.withColumn("level", level)
    w = w.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(all_))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w")))
    return w.select("skey", "source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: str = "mix-0", keep: tuple = ()) -> DataFrame:
    """Words that a mix takes of each document.

    docs: doc_id, text, source; ``keep`` names further columns to carry. Returns doc_id, source, size, source_size, target,
    taken, copies. Every document of a source is taken floor(target / size) whole times; the fraction left is filled
    with further copies in the order of a seeded digest until the source's words are within half a document of the
    target. The place of a document in that order comes from sums per (source, digest bucket), so that a hot source
    is spread over all buckets and no task holds a whole one.

    Null text: size 0, never taken. Null source: a source of its own, last. Repeated rows are mixed like any others;
    rows of one doc_id and size go by the hash of what is carried, so that ties fall alike in every run. Very long texts
    are only counted. Empty table: no rows. A carried column that is called like a result: see ``carried``.
    """
    spark = docs.sparkSession
    held, given = carried(docs, keep, ("doc_id", "source", "size", "source_size", "target", "taken", "copies"))
    draw = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sized = docs.select("doc_id", held, "source", F.size(words(F.col("text"))).cast("long").alias("size"))
    sized = sized.withColumn("skey", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).withColumns({"draw": draw, "tie": F.xxhash64("carried_")})
    sized = sized.withColumn("bucket", F.pmod(F.conv(F.substring("draw", 1, 8), 16, 10).cast("long"), F.lit(BUCKETS)).cast("int"))
    sized = Scratch(spark).save(sized, "sizes")
    buckets = sized.groupBy("skey", "bucket").agg(F.sum("size").alias("in_bucket"), F.first("source", ignorenulls=True).alias("source"))
    sources = fill(buckets.groupBy("skey").agg(F.first("source", ignorenulls=True).alias("source"), F.sum("in_bucket").alias("source_size")), weights, share, max_epochs)
    sources = sources.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    sources = sources.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")).drop("source")
    earlier = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = buckets.withColumn("below", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0))).drop("in_bucket", "source").join(sources, "skey")
    own = Window.partitionBy("skey", "bucket").orderBy("draw", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(plan, ["skey", "bucket"]).withColumn("below", F.col("below") + F.coalesce(F.sum("size").over(own), F.lit(0)))
    copies = F.col("whole") + F.when(F.col("below") + F.col("size") / 2 <= F.col("need"), 1).otherwise(0)
    return placed.select("doc_id", *given, "source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.cast("long").alias("copies"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5('mix-0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS draw,
         CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size
  FROM documents),
placed AS (
  SELECT *, (CAST(concat('0x', substr(draw, 1, 8)) AS BIGINT)) % 4096 AS bucket FROM sized),
weighed AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM sized GROUP BY source),
levels AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         (1.5::DOUBLE * sum(source_size) OVER ()
          - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
         / sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM weighed),
level AS (SELECT max(lev) AS lev FROM levels WHERE lev <= cap / w),
targets AS (
  SELECT source, source_size, CASE WHEN level.lev IS NULL THEN cap ELSE least(cap, level.lev * w) END AS target
  FROM levels, level),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
ranked AS (
  SELECT doc_id, size, source_size, target, whole, target - whole * source_size AS need,
         coalesce(sum(size) OVER (PARTITION BY p.source ORDER BY bucket, draw, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM placed p JOIN plan s ON p.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN CAST(below AS DOUBLE) + size / 2.0::DOUBLE <= need THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ranked
"""
