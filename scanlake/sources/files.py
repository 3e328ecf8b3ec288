"""Rasters and catalog files, audit records, and result sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most candidates that an audit record keeps.
KEPT_CANDIDATES = 10
AUDIT = (
    "page int, line_index int, text string, ocr_confidence double, font_key_matched string, similarity_score double, similarity_pass boolean, decision string, "
    "bbox struct<x: bigint, y: bigint, width: bigint, height: bigint>, font_candidates array<struct<key: string, score: double>>, "
    "obs_votes array<struct<ch: string, prob: double>>, gt_obs_votes array<struct<ch: string, prob: double>>, miss_type string, expected_font string, gt_rank int, fast_path boolean"
)


def read_files(spark: SparkSession, paths: list[str], glob: str) -> DataFrame:
    """path, modificationTime, length, content of the files below some folders, found recursively by name."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(paths)


def listing(files: DataFrame) -> DataFrame:
    """path, size, mtime and a fingerprint of both; contents are not read."""
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime")).withColumn("fingerprint", F.xxhash64("size", "mtime"))


def cache_key(path: str, dpi: int) -> Column:
    """Column: a safe name from a file's name, size, content hash and resolution."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"[^A-Za-z0-9._]", "_")
    return F.concat_ws("-", name, F.col("length").cast("string"), F.sha2("content", 256), F.lit(str(dpi)))


def write_audit(entries: DataFrame, path: str) -> None:
    """Writes audit records as compressed JSON lines: the first candidates only, and the second list of votes only where it differs."""
    slim = entries.withColumn("font_candidates", F.slice("font_candidates", 1, KEPT_CANDIDATES)).withColumn("gt_obs_votes", F.when(~F.col("gt_obs_votes").eqNullSafe(F.col("obs_votes")), F.col("gt_obs_votes")))
    slim.write.mode("overwrite").option("compression", "gzip").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit records as written, with the second list of votes put back and flags defaulted; unreadable lines are an error."""
    d = spark.read.schema(AUDIT).option("mode", "FAILFAST").json(path)
    return d.withColumn("gt_obs_votes", F.coalesce("gt_obs_votes", "obs_votes")).withColumn("fast_path", F.coalesce("fast_path", F.lit(False)))


def write_model(rows: DataFrame, path: str, key: str) -> None:
    """A model table partitioned by its key, of which only the keys at hand are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def write_snapshot(rows: DataFrame, path: str) -> None:
    """A whole snapshot, replaced when the write has succeeded."""
    rows.write.mode("overwrite").parquet(path)


#: Words of a page as its cache holds them.
CACHED_WORDS = "page int, words array<struct<text: string, x: bigint, y: bigint, width: bigint, height: bigint, font_size_pt: double, confidence: double, level: bigint, block_num: bigint, par_num: bigint, line_num: bigint, word_num: bigint>>"


def write_words(words: DataFrame, path: str) -> None:
    """Recognised words as JSON, a line a page, in their order (column ord); pages at hand replace what is there."""
    fields = [c for c in ("text", "x", "y", "width", "height", "font_size_pt", "confidence", "level", "block_num", "par_num", "line_num", "word_num")]
    packed = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*fields).alias("w")))), lambda x: x["w"])
    words.groupBy("page").agg(packed.alias("words")).write.mode("overwrite").json(path)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """The words that write_words wrote: page, ord, and their fields."""
    d = spark.read.schema(CACHED_WORDS).option("mode", "FAILFAST").json(path)
    return d.select("page", F.posexplode("words").alias("ord", "w")).select("page", "ord", "w.*")


def write_rasters(rasters: DataFrame, path: str) -> None:
    """Rasters (id, width, height, px) as compressed rows, replaced when the write has succeeded."""
    rasters.select("id", "width", "height", "px").write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_rasters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id bigint, width int, height int, px binary").parquet(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(origin, width, height, px): grey rasters of image files by Spark's own reader; files that are none are left out.

    Grey is the integer luma of the colours; alpha is left out.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            out = []
            for w, h, n, data in zip(*(batch.column(c).to_pylist() for c in ("width", "height", "nChannels", "data")), strict=True):
                a = np.frombuffer(data, np.uint8).reshape(h, w, n).astype(np.int64)
                out.append((a[:, :, 0] if n == 1 else (2126 * a[:, :, 2] + 7152 * a[:, :, 1] + 722 * a[:, :, 0]) // 10000).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("origin"), batch.column("width"), batch.column("height"), pa.array(out, pa.binary())], ["origin", "width", "height", "px"])

    return spark.read.format("image").option("dropInvalid", True).load(path).select("image.*").select("origin", "width", "height", "nChannels", "data").mapInArrow(run, "origin string, width int, height int, px binary")


def raw_boxes(words: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, raw_words): the words of each line as recognised, in their order, to be kept beside what later steps make of them."""
    fields = ["text", "x", "y", "width", "height", "confidence"]
    return words.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.struct(*fields).alias("w")))), lambda x: x["w"]).alias("raw_words"))
