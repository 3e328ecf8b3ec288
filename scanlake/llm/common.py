"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators and words as the contracts define them; only these six characters part words.
SPACES = r"[\x20\x09-\x0D]+"
#: Bytes of a batch of rows for Python, about, and the option that bounds it.
BATCH_BYTES, BATCH_OPTION = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"


def words(text: Column) -> Column:
    """The words of a text; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def sealed(df: DataFrame) -> DataFrame:
    """The same rows behind a generator: a later filter stays above it, where the columns are computed already,
    instead of being rewritten in terms of their expressions and evaluated anew for each reference."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def carried(docs: DataFrame, keep: tuple, own: tuple) -> tuple[Column, list[Column]]:
    """One struct column of the columns to carry, and how to select them from it afterwards.

    Inside an operator no name of the caller's can meet one of its own. A carried column that is called like one of the
    operator's results comes back with ``_given`` after its name (again until it is free).
    """
    taken, names = {x.lower() for x in own} | {x.lower() for x in keep}, []
    for name in keep:
        new = name
        while new.lower() in {x.lower() for x in own} or (new != name and new.lower() in taken):
            new += "_given"
        taken.add(new.lower())
        names.append(new)
    # a struct without fields can't be written, so there is always one
    packed = F.struct(*[docs[f"`{x}`"].alias(f"c{k}") for k, x in enumerate(keep)], F.lit(0).alias("none")).alias("carried_")
    return packed, [F.col(f"carried_.c{k}").alias(x) for k, x in enumerate(names)]


def sample(rows: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """At most ``most`` rows, those first by a hash of the key, then of the whole row; the same whatever the partitions.

    Rows are counted first and those beyond a little more than the share wanted go before anything is sorted, so that the
    sort holds about ``most`` rows, however many there are. A key's repeated rows count as rows.
    """
    total = rows.count()
    if total > most:
        wide = 1 << 30
        rows = rows.where(F.pmod(F.xxhash64(key), F.lit(wide)) < min(wide, int(wide * (1.1 * most + 100) / total)))
    columns = [F.col(c) for c in rows.columns]
    return rows.orderBy(F.pmod(F.xxhash64(key), F.lit(1 << 30)), key, F.xxhash64(*columns)).limit(most)


def maybe_in(values: DataFrame, column: str, bits: int = 1 << 22):
    """A function from a column to a condition that holds for every value of ``values`` and, the more of them there are, for others.

    It is a set of hashed values of a bounded size, so rows can be left out before a shuffle whatever the values' number. Nulls
    never pass.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    packed = values.select(place(F.col(column)).alias("p")).groupBy(F.expr("p div 64").cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
    table = [0] * (bits // 64)
    for row in packed.collect():
        table[row["at"]] = row["bits"]
    literal = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")
    return lambda c: c.isNotNull() & (F.getbit(F.get(literal, F.floor(place(c) / 64).cast("int")), (place(c) % 64).cast("int")) == 1)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only a local session, where driver and executors are one process, may be without one; it gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = os.path.join(tempfile.gettempdir(), "scanlake-shared")
    return folder.rstrip("/")


class Scratch:
    """Intermediate tables in the shared folder: they cut the lineage and outlive a lost executor.

    A table is dropped by name when nothing reads it any more; the rest goes when the driver ends, since the returned
    DataFrames read it until then.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/scanlake-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.files.mkdirs(path)
        self.files.deleteOnExit(path)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes a table and returns what reads it. While it is written, batches for Python hold BATCH_BYTES at most."""
        path, before = f"{self.root}/{name}", self.spark.conf.get(BATCH_OPTION)
        self.spark.conf.set(BATCH_OPTION, BATCH_BYTES)
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(BATCH_OPTION, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more, and asks the driver to let go of finished plans, whose shuffle files Spark then removes."""
        for name in names:
            self.files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}"), True)
        gc.collect()
        self.spark._jvm.System.gc()

    def keep(self, *names: str) -> None:
        """Deletes all tables but these."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.drop(*({f.getPath().getName() for f in self.files.listStatus(path)} - set(names)))
