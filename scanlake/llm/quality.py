"""Operator 7: quality rules and a hashed n-gram log-likelihood ratio (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.llm.common import carried, maybe_in, sealed, words

#: Buckets of the hashed word unigrams and bigrams.
BUCKETS = 1 << 14
SMOOTHING = 0.5
#: A document is kept at this mean log-likelihood ratio (nats per n-gram) or more. Where it comes from: the raw corpus holds the
#: target, so clean text lies near zero from below and other text well beneath. Of the labelled rows of the smaller test tables
#: all of quality 0 and 2 % of quality 1 lie below it.
THRESHOLD = -0.09
#: Bits of the set of target ids that documents are compared with before any text is shuffled.
ID_BITS = 1 << 22
WINDOW = 5
MEASURES = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")


def grams(w: Column) -> Column:
    """Buckets of the unigrams and bigrams of an array of words."""
    one = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int"))
    two = F.zip_with(w, F.slice(w, 2, F.size(w)), lambda x, y: F.when(y.isNotNull(), F.pmod(F.xxhash64(x, y), F.lit(BUCKETS)).cast("int")))
    return F.array_compact(F.concat(one, two))


def fit(docs: DataFrame, labels: DataFrame) -> list[float]:
    """Log-likelihood ratio of every bucket, target over raw corpus.

    The target is every document that a row of labels (doc_id, quality) gives quality 1; the raw corpus is every
    document. The counts are combined before the shuffle, and one number per bucket comes to the driver. Documents that
    surely are no target, by a set of ID_BITS bits of the target's hashed ids, are counted where they lie; only the
    others' texts go to the join with the target's ids. Null ids are no target; a null text has no n-gram; rows of one
    doc_id count each; empty tables give ratios of 0.
    """
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    maybe = maybe_in(good, "doc_id", ID_BITS)(F.col("doc_id"))
    d = docs.select("doc_id", "text", maybe.alias("maybe"))
    own = d.where("maybe").join(good.withColumn("good", F.lit(1)).hint("shuffle_merge"), "doc_id", "left")  # the labels grow with the corpus: never broadcast
    every = own.select(F.coalesce("good", F.lit(0)).alias("good"), "text").unionByName(d.where("NOT maybe").select(F.lit(0).alias("good"), "text"))
    each = every.select("good", words(F.col("text")).alias("w")).select("good", F.explode(grams(F.col("w"))).alias("bucket"))
    rows = each.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("target")).collect()
    raw, target = [SMOOTHING] * BUCKETS, [SMOOTHING] * BUCKETS
    for r in rows:
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    if not any(r["target"] for r in rows):
        return [0.0] * BUCKETS
    from math import log

    a, b = log(sum(target)), log(sum(raw))
    return [log(t) - a - log(r) + b for t, r in zip(target, raw, strict=True)]


def rules(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD, keep: tuple = ()) -> DataFrame:
    """The measures and verdict of every row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept.

    All of it is computed within the row. Repeated windows are found by sorting (hash, place) of a document's windows,
    only in documents where a hash repeats. Null text: no words, failed. Very long texts are read whole. Repeated
    rows are judged each; an empty table gives no rows. Without a target every ratio is 0 and the base rules decide.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    held, given = carried(docs, keep, MEASURES)
    d = docs.select("doc_id", held, body.alias("body")).withColumn("w", words(F.col("body")))
    d = d.withColumn("n_words", F.size("w").cast("long")).withColumn("lines", F.filter(F.split("body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    last = (F.col("n_words") - WINDOW).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(WINDOW)]))
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in ratios)), ",").cast("array<double>")
    d = d.withColumn("g", F.when(last >= 0, each)).withColumn("b", grams(F.col("w")))
    d = d.select(
        "doc_id", "carried_", "n_words",
        F.length(F.regexp_replace("body", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("g")) < F.size("g"), F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s"),
        F.when(F.size("b") > 0, F.aggregate("b", F.lit(0.0), lambda acc, x: acc + F.get(table, x)) / F.size("b")).otherwise(0.0).alias("llr"),
    )
    found = F.filter("s", lambda x, i: F.coalesce(F.get("s", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("s", i + 1)["h"] == x["h"], F.lit(False)))
    d = d.withColumn("p", F.sort_array(F.transform(found, lambda x: x["i"])))
    covered = F.aggregate(F.zip_with("p", F.slice("p", 2, F.size("p")), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))), F.lit(0), lambda acc, x: acc + x)
    d = d.withColumn("n_repeat_words", F.when(F.col("p").isNull(), 0).otherwise(covered).cast("long")).drop("s", "p")
    d = d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    d = sealed(d.withColumn("kept", ~F.col("base_failed") & (F.round("llr", 6) >= threshold)))
    return d.select("doc_id", *given, *MEASURES[1:])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return rules(docs, fit(docs, labels)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("llr", 6).alias("llr"))
