"""Session defaults and table access shared by the queries."""

from __future__ import annotations

import math
import os

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("scanlake")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", os.environ.get("SPARK_LOCAL_IP", "127.0.0.1"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a dataset folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of input files that one task of a sort by keys gets, about.
PART_BYTES = 8 << 20


def parts(rows: DataFrame, most: int = PART_BYTES) -> int:
    """How many times ``most`` bytes the files hold that the rows are read from; 1 where that isn't known."""
    leaves = rows._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return max(1, math.ceil(sum(x for x in sizes if x < 1 << 60) / most))


def dealt_by(rows: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    """The rows dealt by their keys over as many tasks as their files' size asks for; left to the session where that deals them more widely."""
    n = n or parts(rows)
    return rows.repartition(n, *keys) if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows
