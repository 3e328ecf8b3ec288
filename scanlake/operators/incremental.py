"""Snapshots, differences, staleness, and carried state over pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlake.functions.arrays import upper_medians


def diff(old: DataFrame, new: DataFrame, key: str, stamp: str) -> DataFrame:
    """(key, change): added, removed or changed entries between two snapshots."""
    o, n = old.select(key, F.col(stamp).alias("old_"), F.lit(True).alias("in_old_")), new.select(key, F.col(stamp).alias("new_"), F.lit(True).alias("in_new_"))
    d = o.join(n, key, "full_outer")
    change = F.when(F.col("in_old_").isNull(), "added").when(F.col("in_new_").isNull(), "removed").when(~F.col("old_").eqNullSafe(F.col("new_")), "changed")
    return d.select(key, change.alias("change")).where("change IS NOT NULL")


def refreshed(old: DataFrame, new: DataFrame, key: str, stamp: str, build) -> DataFrame:
    """The new snapshot's derived rows, where ``build`` (DataFrame -> DataFrame with the same columns as old) runs only on added or changed entries."""
    changed = diff(old, new, key, stamp)
    kept = old.join(changed, key, "left_anti")
    fresh = build(new.join(changed.where("change <> 'removed'"), key, "left_semi"))
    return kept.unionByName(fresh.select(*kept.columns))


def is_stale(cached: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """(key, stale): whether a cached entry's size or modification time differs from its source's, or either is missing."""
    c = cached.select(key, F.col("size").alias("s_"), F.col("mtime").alias("m_"))
    d = source.join(c, key, "left")
    return d.select(key, (~(F.col("size").eqNullSafe(F.col("s_")) & F.col("mtime").eqNullSafe(F.col("m_")))).alias("stale"))


def catalog_hash(entries: DataFrame, columns: list[str]) -> DataFrame:
    """One row, hash: of the entries' set, whatever their order; sums of row hashes are combined before the shuffle."""
    row = F.xxhash64(*[F.col(c) for c in sorted(columns)]).cast("decimal(38,0)")
    return entries.agg(F.sha2(F.concat_ws(":", F.sum(row).cast("string"), F.count("*").cast("string")), 256).alias("hash"))


def dominant(rows: DataFrame, page: str, key: str, em: str, keys: tuple = ()) -> DataFrame:
    """The key on the most pages, then with the most rows, then the smallest, with its upper-median em.

    Rows are counted by key and page before the shuffle; only the winners' values are looked at for the median, which
    gathers no key.
    """
    some = rows.where(F.col(key).isNotNull())
    n = some.groupBy(*keys, key, page).agg(F.count("*").alias("n_")).groupBy(*keys, key).agg(F.count("*").alias("pages"), F.sum("n_").alias("total"))
    best = n.groupBy(*keys).agg(F.min(F.struct((-F.col("pages")).alias("p"), (-F.col("total")).alias("t"), F.col(key).alias("k"))).alias("b"))
    best = best.select(*keys, F.col("b.k").alias(key), (-F.col("b.p")).alias("pages"), (-F.col("b.t")).alias("total")).where(F.col(key).isNotNull())
    return best.join(upper_medians(some.join(best.select(*keys, key), [*keys, key], "left_semi"), [*keys, key], em, "em"), [*keys, key], "left").select(*keys, key, "pages", "total", "em")


def dominant_before(rows: DataFrame, page: str, key: str, keys: tuple = ()) -> DataFrame:
    """(keys, page, dominant): the dominant key of all the pages before each page; null for the first.

    Only pages and keys that occur together are rows. A key's counts of pages and rows never fall, so the best key so far is
    the best of all the counts reached so far: one running minimum over the best count of each page.
    """
    n = rows.where(F.col(key).isNotNull()).groupBy(*keys, page, key).agg(F.count("*").alias("n_"))
    w = Window.partitionBy(*keys, key).orderBy(page)
    state = F.struct((-F.row_number().over(w)).alias("p"), (-F.sum("n_").over(w)).alias("t"), F.col(key).alias("k"))
    reached = n.withColumn("s_", state).groupBy(*keys, page).agg(F.min("s_").alias("s_"))
    before = Window.partitionBy(*keys).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    pages = rows.select(*keys, page).distinct().join(reached, [*keys, page], "left")
    return pages.withColumn("b_", F.min("s_").over(before)).select(*keys, page, F.col("b_.k").alias("dominant"))


def pruned_or_all(scores: DataFrame, line: str, keep: Column) -> DataFrame:
    """The rows that pass, and all rows of the lines where none does (column fallback)."""
    passed = scores.where(keep)
    without = scores.join(passed.select(line).distinct(), line, "left_anti")
    return passed.withColumn("fallback", F.lit(False)).unionByName(without.withColumn("fallback", F.lit(True)))


def older_than_any(made: DataFrame, sources: DataFrame, key: str, stamp: str) -> DataFrame:
    """(key, older): whether something made is older than one of the sources it was made of; false without sources."""
    latest = sources.groupBy(key).agg(F.max(stamp).alias("latest_"))
    return made.join(latest, key, "left").select(key, F.coalesce(F.col(stamp) < F.col("latest_"), F.lit(False)).alias("older"))


def has_stale_header(headers: DataFrame, key: str, header: str, tag: str) -> DataFrame:
    """(key, stale): whether one of the headers lacks the tag among its words (an unreadable one, null, does)."""
    lacks = ~F.coalesce(F.array_contains(F.split(F.regexp_replace(F.trim(header), r"\s+", " "), " "), tag), F.lit(False))
    return headers.groupBy(key).agg(F.bool_or(lacks).alias("stale"))
