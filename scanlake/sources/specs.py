"""Row restrictions given as text: page lists, line lists, allowlists."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pages_of(spark: SparkSession, spec: str) -> DataFrame:
    """(page): the pages of ``1,3,5-7``, from 1 on; an error for 0, a turned range, or an empty part."""
    ranges = []
    for part in spec.split(","):
        a, _, b = part.strip().partition("-")
        if not a.isdigit() or (b and not b.isdigit()) or int(a) < 1 or ("-" in part and (not b or int(b) < int(a))):
            raise ValueError(f"bad page list: {spec!r}")
        ranges.append((int(a), int(b or a)))
    return spark.createDataFrame(ranges, "a bigint, b bigint").select(F.explode(F.sequence("a", "b")).alias("page")).distinct()


def lines_of(spark: SparkSession, spec: str) -> DataFrame:
    """(page, line): of ``p1:L2,p3:L52``, each once."""
    import re

    found = [re.fullmatch(r"\s*p(\d+):L(\d+)\s*", part) for part in spec.split(",")]
    if not all(found):
        raise ValueError(f"bad line list: {spec!r}")
    return spark.createDataFrame([(int(m[1]), int(m[2])) for m in found], "page bigint, line bigint").distinct()


def allowlist(spark: SparkSession, spec: str) -> DataFrame:
    """(key): of a comma list, or of a file (``@path`` or the path of one) with a key a line; # starts a comment."""
    path = spec[1:] if spec.startswith("@") else spec
    if spec.startswith("@") or os.path.isfile(path):
        lines = spark.read.text(path).select(F.regexp_replace("value", "#.*$", "").alias("v"))
    else:
        lines = spark.createDataFrame([(spec,)], "v string")
    return lines.select(F.explode(F.split("v", ",")).alias("key")).select(F.trim("key").alias("key")).where("key <> ''").distinct()
