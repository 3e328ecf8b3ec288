"""Operator 3: URL rules as intervals of reversed-host keys, found by a sorted sweep (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlake.llm.common import carried

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Pages of a shard of the sweep, about.
SHARD = 1_000_000
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url; both empty for null or where there is no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def key(host: Column) -> Column:
    """``a.b.com`` -> ``com.b.a.``: a host and all its subdomains are the keys from this one up to the one ending in /."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def stacks(rules: DataFrame) -> DataFrame:
    """Per rule host where its interval starts and ends, and the rules active from there on, longest first.

    Intervals of host suffixes nest or are apart, so the active rules at a key are those of one host and its parents.
    """
    rules = rules.select("host", "path", "action")
    entry = F.struct((-F.length(F.concat("rule_host", "path"))).alias("order"), F.when(F.col("action") == "block", 0).otherwise(1).alias("tie"), F.concat("rule_host", "path").alias("rule"), "rule_host", "path", "action")
    labels = F.split("host", r"\.")
    parents = rules.select("host").distinct().select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("rule_host"))
    chain = parents.join(rules.withColumnRenamed("host", "rule_host"), "rule_host").groupBy("host").agg(F.array_sort(F.collect_list(entry)).alias("stack"))
    start = chain.select(key(F.col("host")).alias("key"), "stack")
    end = chain.select(F.regexp_replace(key(F.col("host")), r"\.$", "/").alias("key"), F.filter("stack", lambda r: r.rule_host != F.col("host")).alias("stack"))
    return start.unionByName(end)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", salts: int | None = None, keep: tuple = ()) -> DataFrame:
    """Verdict of every page: page_id, host, path, rule, verdict.

    Pages and interval ends are sorted together by key and swept once; each page takes the stack of the last end
    before it. The sweep runs in ``salts`` shards that each hold all interval ends (sent by shuffle, never broadcast)
    and a share of the pages, so no host, however hot, gathers in one task. By default the shards follow the number of
    pages, SHARD of them each.

    The longest fitting rule wins (then block, then code point order). Null url: empty host and path, the default. Urls are
    read whole. Repeated pages are judged like any others; empty tables give no rows; without rules all get the default.
    A carried column that is called like a result: see ``carried``.
    """
    if not salts:
        salts = max(4 * int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pages.count() // SHARD))
    held, given = carried(pages, keep, ("page_id", "host", "path", "rule", "verdict"))
    host, path = host_and_path(F.col("url"))
    page = pages.select("page_id", "url", held).withColumn("host", host).withColumn("path", path)
    page = page.select(F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).alias("salt"), key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "page_id", "carried_", "host", "path")
    ends = stacks(rules).select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("salt"), "key", F.lit(0).alias("kind"), "stack")
    sweep = Window.partitionBy("salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = page.unionByName(ends, allowMissingColumns=True).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    first = F.get(F.filter("stack", lambda r: F.col("path").startswith(r.path)), F.lit(0))
    swept = swept.withColumn("best", first)
    return swept.select("page_id", *given, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, spark.createDataFrame(RULES, "host string, path string, action string"))


SQL = r"""
WITH rules(host, path, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rests AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT row_number() OVER () AS n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
fits AS (
  SELECT p.n, r.host || r.path AS rule, r.action,
         row_number() OVER (PARTITION BY p.n ORDER BY length(r.host || r.path) DESC, r.action DESC, r.host || r.path) AS k
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM parts p LEFT JOIN (SELECT * FROM fits WHERE k = 1) f ON p.n = f.n
"""
