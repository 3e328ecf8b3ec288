"""A training-data pipeline over the documents table: quality, near-duplicates, personal data, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.llm import mixing, near_sets, packing, pii, quality
from scanlake.llm.common import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules.

    Null and empty texts fail (fewer than 10 words). Rows of one doc_id are judged each. An empty table gives no rows;
    without labels the base rules decide alone. Columns besides COLUMNS go.
    """
    ratios = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    judged = quality.rules(docs, ratios, keep=("text", *rest))
    return judged.where("kept").select(COLUMNS)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, a Jaccard similarity of 0.8.

    Found by SimHashes and anchors, the rest by keys of parts of the sets; each pair is checked by its sets.

    The smallest doc_id stays, null last, then the smallest hash of the text; of repeated rows one. Texts without words
    are one group. An empty table gives no rows.
    """
    return near_sets.keep_unlike(docs.select(COLUMNS))


def hide_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms in place of personal data; n_chars follows the text (null for a null text).

    All rows stay, repeated ones too; an empty table gives no rows.
    """
    return pii.pseudonymise(docs.select(COLUMNS), pii.QUERY_KEY).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it.

    Null source: one of its own. Null texts and those without words have size 0 and count as placed wherever there is
    need, so they add no words. Repeated rows are drawn each; an empty table gives no rows.
    """
    mixed = mixing.mix(docs, keep=("text", "lang", "n_chars")).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences; null and empty texts are one end token, repeated rows are packed each, an empty table gives no rows."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [("quality", keep_good), ("near_duplicates", keep_one), ("personal_data", hide_personal), ("mixing", mix_sources), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents, each one's rows written to the shared folder and read again; those of the stage before go."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet").select(COLUMNS), Scratch(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, f"{k}-{name}")
            scratch.keep(f"{k}-{name}")
    return docs
