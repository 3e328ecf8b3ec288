"""Ordered pairings of observation sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOOKAHEAD = 5


def align(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, pos, ch, prob, other): the probability that the other sequence gives each observation of a.

    Both hold key, pos, ch, prob. Sequences of one length pair by place; else in order, an observation taking the
    next of the other's that has its character, LOOKAHEAD ahead at most, or none. It is a fold over a key's sorted
    observations, as what is taken decides where the next search starts.
    """
    sorted_ = lambda df, name: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "ch", "prob"))).alias(name))
    both = sorted_(a, "x").join(sorted_(b, "y"), key, "left").withColumn("y", F.coalesce("y", F.slice("x", 1, 0)))

    def step(s: Column, one: Column) -> Column:
        ahead = F.slice(F.col("y"), s["at"] + 1, F.lit(LOOKAHEAD + 1))
        hit = F.array_position(F.transform(ahead, lambda o: o["ch"]), one["ch"])
        found = F.when(hit > 0, F.get(ahead, (hit - 1).cast("int"))["prob"])
        row = F.struct(one["pos"].alias("pos"), one["ch"].alias("ch"), one["prob"].alias("prob"), found.alias("other"))
        return F.struct((s["at"] + F.when(hit > 0, hit).otherwise(0)).cast("int").alias("at"), F.concat(s["out"], F.array(row)).alias("out"))

    kinds = dict(a.dtypes)
    kind = f"array<struct<pos: {kinds['pos']}, ch: string, prob: double, other: double>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    merged = F.aggregate("x", start, lambda s, one: step(s, one).cast(f"struct<at: int, out: {kind}>"))["out"]
    paired = F.zip_with("x", "y", lambda p, q: F.struct(p["pos"].alias("pos"), p["ch"].alias("ch"), p["prob"].alias("prob"), q["prob"].alias("other"))).cast(kind)
    return both.select(key, F.inline(F.when(F.size("x") == F.size("y"), paired).otherwise(merged)))
