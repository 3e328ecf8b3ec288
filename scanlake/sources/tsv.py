"""Recogniser output as tab-separated lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed order of the fields of a line.
FIELDS = ["level", "page_num", "block_num", "par_num", "line_num", "word_num", "x", "y", "width", "height", "confidence", "text"]


def parse_tsv(lines: DataFrame, dpi: int, value: str = "value") -> DataFrame:
    """Words (level 5, 12 fields or more, non-blank text) of lines; a number that can't be read is 0, not null."""
    c = F.split(value, "\t", -1)
    number = lambda k, kind: F.coalesce(F.trim(c[k]).try_cast(kind), F.lit(0).cast(kind))
    keep = [x for x in lines.columns if x != value]
    rows = lines.where(F.size(c) >= len(FIELDS)).where(F.trim(c[0]) == "5").withColumn("text_", F.trim(c[11])).where(F.col("text_") != "")
    words = rows.select(*keep, *[number(FIELDS.index(n), "double" if n == "confidence" else "bigint").alias(n) for n in FIELDS[2:11]], F.col("text_").alias("text"))
    return words.withColumn("font_size_pt", F.col("height") * 72.0 / dpi)


def read_tsv(spark: SparkSession, path: str, dpi: int) -> DataFrame:
    """Words of the TSV files under a path, with the file each came from; header lines fail the level test."""
    lines = spark.read.text(path).withColumn("path", F.input_file_name())
    return parse_tsv(lines, dpi)
