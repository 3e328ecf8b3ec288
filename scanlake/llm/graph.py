"""Connected components of a table of links."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "links") -> DataFrame:
    """links (u, v) of longs -> (u, v): every linked node but the smallest of its component, and that smallest.

    Alternates large-star and small-star rounds, each a minimum per node (combined before the shuffle) joined back to
    the links; a round's links are written to the shared folder, so the lineage stays short. Ends when a round
    changes nothing, which takes some log2 of the longest chain rounds. A hub's links meet one row in the joins, so the
    adaptive skew join deals them out. Loops and repeated links are allowed; an empty table gives no rows.
    """
    now = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, seen = scratch.save(now, f"{name}0"), None
    for k in count(1):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if tuple(state) == seen or not state["n"]:
            return now
        seen = tuple(state)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = scratch.save(small, f"{name}{k}")
        if k > 1:
            scratch.drop(f"{name}{k - 2}")
