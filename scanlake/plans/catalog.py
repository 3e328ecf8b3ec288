"""Queries of the catalog, incremental and restriction operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlake.functions import scores, text as T
from scanlake.operators import catalog as C, incremental as N
from scanlake.queries import register
from scanlake.session import table
from scanlake.sources import specs

KEYS_SQL = """k AS (SELECT p_partkey, p_brand, p_size % 2 = 0 AS kern, replace(p_brand, '#', '') || (CASE p_size % 3 WHEN 0 THEN '-700' WHEN 1 THEN '-400' ELSE '' END) || (CASE WHEN p_size % 5 = 0 THEN 'Italic' ELSE '' END)
  || (CASE p_partkey % 3 WHEN 0 THEN '|kern' WHEN 1 THEN '|nokern' ELSE '' END) || (CASE p_partkey % 4 WHEN 0 THEN '|nolig' WHEN 1 THEN '|lig' ELSE '' END) || (CASE WHEN p_partkey % 7 = 0 THEN '|onum' WHEN p_partkey % 7 = 1 THEN '|ss07' ELSE '' END) || (CASE WHEN p_partkey % 11 = 0 THEN '|wght700[a|b]' ELSE '' END)
  || (CASE WHEN p_partkey % 13 <> 0 THEN '|version=' || (p_partkey // 100) || '.' || (p_partkey % 100) ELSE '' END) || (CASE WHEN p_partkey % 5 = 0 THEN '[wght=400,opsz=10]' ELSE '' END) AS key FROM part),
t AS (SELECT *, list_transform(string_split(key, '|')[2:], lambda s: string_split(s, '[')[1]) AS tags FROM k),
u AS (SELECT *, string_split(substr(list_filter(tags, lambda s: starts_with(s, 'version='))[1], 9), '.') AS ver FROM t),
v AS (SELECT *, CASE WHEN ver IS NULL THEN 0 ELSE 100 * CAST(ver[1] AS INTEGER) + CAST(substr(ver[2] || '0', 1, 2) AS INTEGER) END AS version, CASE WHEN kern <> (strpos(key, 'nokern') > 0) THEN 4 ELSE 0 END + CASE WHEN list_contains(tags, 'lig') THEN 2 ELSE 0 END + CASE WHEN strpos(key, 'opsz=10') > 0 THEN 1 ELSE 0 END
  - 10 * len(list_filter(tags, lambda s: s IN ('onum', 'lnum', 'smcp', 'c2sc', 'swsh', 'salt', 'titl', 'hist', 'allcaps') OR regexp_full_match(s, 'ss[0-9][0-9]') OR regexp_full_match(s, 'wght[0-9]+'))) AS score FROM u)"""


def keys(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    size, part = F.col("p_size"), F.col("p_partkey")
    key = F.concat(
        F.replace("p_brand", F.lit("#"), F.lit("")), F.when(size % 3 == 0, "-700").when(size % 3 == 1, "-400").otherwise(""), F.when(size % 5 == 0, "Italic").otherwise(""),
        F.when(part % 3 == 0, "|kern").when(part % 3 == 1, "|nokern").otherwise(""), F.when(part % 4 == 0, "|nolig").when(part % 4 == 1, "|lig").otherwise(""), F.when(part % 7 == 0, "|onum").when(part % 7 == 1, "|ss07").otherwise(""), F.when(part % 11 == 0, "|wght700[a|b]").otherwise(""),
        F.when(part % 13 != 0, F.concat(F.lit("|version="), F.floor(part / 100).cast("string"), F.lit("."), (part % 100).cast("string"))).otherwise(""), F.when(part % 5 == 0, "[wght=400,opsz=10]").otherwise(""),
    )
    return p.select("p_partkey", "p_brand", F.col("p_brand").alias("family"), (size % 2 == 0).alias("kern"), F.when(part % 5 == 0, 10.0).alias("opsz"), key.alias("key"))


@register("key_version", f"WITH {KEYS_SQL} SELECT p_partkey, key, version FROM v")
def key_version(spark, sf_dir):
    return keys(spark, sf_dir).select("p_partkey", "key", T.key_version(F.col("key")).alias("version"))


@register("preference_rank", f"WITH {KEYS_SQL} SELECT p_brand, key FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY version DESC, score DESC, key) AS k FROM v) WHERE k = 1")
def preference_rank(spark, sf_dir):
    return C.best_by_preference(keys(spark, sf_dir), ["p_brand"], "key", "kern")


CRITERIA = [("brand 7", 700, False, None, True, None), ("Brand#7", None, None, 10.0, None, True), ("BRAND 3", 400, True, None, False, None), ("brand 12", None, True, 9.0, None, False), ("brand", 400, None, None, None, None)]


@register(
    "select_by_criteria",
    f"""WITH {KEYS_SQL}, c(n, family, weight, italic, opsz, kern, lig) AS (VALUES {', '.join(str((n, f.lower().replace(' ', '').replace('#', ''), *rest)).replace('None', 'NULL') for n, (f, *rest) in enumerate(CRITERIA))}),
    f AS (SELECT v.*, regexp_extract(string_split(key, '|')[1], '-([0-9]+)(Italic)?$', 1) AS w, suffix(string_split(key, '|')[1], 'Italic') AS it FROM v),
    m AS (SELECT c.n, f.key, row_number() OVER (PARTITION BY c.n ORDER BY version DESC, score DESC, key) AS k FROM f JOIN c ON replace(lower(p_brand), '#', '') = c.family AND (c.weight IS NULL OR w = CAST(c.weight AS VARCHAR)) AND (c.italic IS NULL OR (w <> '' AND it = c.italic))
      AND (c.opsz IS NULL OR p_partkey % 5 <> 0 OR c.opsz = 10) AND (c.kern IS NULL OR list_contains(tags, CASE WHEN c.kern THEN 'kern' ELSE 'nokern' END)) AND (c.lig IS NULL OR list_contains(tags, CASE WHEN c.lig THEN 'lig' ELSE 'nolig' END)))
    SELECT CAST(n AS INTEGER) AS n, key FROM m WHERE k = 1""",
)
def select_by_criteria(spark, sf_dir):
    k, out = keys(spark, sf_dir), None
    for n, (family, weight, italic, opsz, kern, lig) in enumerate(CRITERIA):
        one = C.select_by_criteria(k, family, "key", "kern", weight, italic, opsz, kern, lig).select(F.lit(n).alias("n"), "key")
        out = one if out is None else out.unionByName(one)
    return out


@register("normalize_family", "SELECT p_partkey, lower(regexp_replace(p_name || ' ' || p_brand, '[^A-Za-z0-9]', '', 'g')) AS family FROM part")
def normalize_family(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.normalize_family(F.concat_ws(" ", "p_name", "p_brand")).alias("family"))


ALIASES = [(0, "red", "Crimson"), (1, "widget", "Wide"), (2, "small", "Small Caps"), (3, "red widget", "Redwood"), (4, "ring", "Round")]


@register("longest_alias_match", f"WITH a(ord, alias, canonical) AS (VALUES {', '.join(map(str, ALIASES))}) SELECT p_partkey, max_by(canonical, length(alias) * 100 - ord) AS canonical FROM part LEFT JOIN a ON contains(lower(p_name), alias) GROUP BY p_partkey")
def longest_alias_match(spark, sf_dir):
    return C.longest_match(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", spark.createDataFrame(ALIASES, "ord int, alias string, canonical string"), "alias", "canonical").drop("p_name")


@register("classify_family", "SELECT p_partkey, CASE WHEN contains(lower(p_name), 'ring') THEN 'mono' WHEN contains(lower(p_name), 'red') OR contains(lower(p_name), 'blue') THEN 'serif' WHEN contains(lower(p_name), 'small') THEN 'sans' ELSE 'unknown' END AS class FROM part")
def classify_family(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.classify_family(F.col("p_name"), [("mono", ["ring"]), ("serif", ["red", "blue"]), ("sans", ["small"])]).alias("class"))


@register("ligature_collapse", "SELECT doc_id, md5(replace(replace(replace(replace(replace(text, 'ffi', 'ﬃ'), 'ffl', 'ﬄ'), 'ff', 'ﬀ'), 'fi', 'ﬁ'), 'fl', 'ﬂ')) AS collapsed, text = replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, 'ffi', 'ﬃ'), 'ffl', 'ﬄ'), 'ff', 'ﬀ'), 'fi', 'ﬁ'), 'fl', 'ﬂ'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl') AS round_trip FROM documents")
def ligature_collapse(spark, sf_dir):
    c = T.collapse_ligatures(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(c).alias("collapsed"), (F.col("text") == T.expand_ligatures(c)).alias("round_trip"))


@register("glyph_dedup_groups", "WITH g AS (SELECT lang, sha256(text) AS hash, list_sort(list(DISTINCT doc_id)) AS keys, min(doc_id) AS f FROM documents GROUP BY lang, sha256(text)) SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY f, hash) - 1 AS INTEGER) AS glyph_id, hash, CAST(len(keys) AS INTEGER) AS n_keys, keys[1] AS first_key FROM g")
def glyph_dedup_groups(spark, sf_dir):
    g = C.content_groups(table(spark, sf_dir, "documents").select("lang", "doc_id", "text"), "lang", "doc_id", "text")
    return g.select("lang", "glyph_id", "hash", F.size("keys").alias("n_keys"), F.get("keys", F.lit(0)).alias("first_key"))


@register("prune_keys", "WITH g AS (SELECT source, count(DISTINCT doc_id) FILTER (WHERE doc_id % 3 <> 0 AND source <> 'src1') AS n_left, count(DISTINCT doc_id) AS n FROM documents GROUP BY source) SELECT source, CAST(n_left AS INTEGER) AS n_left, n_left = 0 AS emptied FROM g")
def prune_keys(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id")
    groups = d.groupBy("source").agg(F.collect_set("doc_id").alias("keys"))
    left = C.prune_keys(groups, d.where("doc_id % 3 = 0 OR source = 'src1'"), "doc_id")
    return left.select("source", F.size("keys").alias("n_left"), (F.size("keys") == 0).alias("emptied"))


@register("catalog_diff", "SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT doc_id, n_chars AS s FROM documents WHERE doc_id % 5 <> 0) o FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN n_chars + 1 ELSE n_chars END AS s FROM documents WHERE doc_id % 7 <> 0) n ON o.doc_id = n.doc_id WHERE o.s IS DISTINCT FROM n.s")
def catalog_diff(spark, sf_dir):
    """Two snapshots made of the documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("s"))
    return N.diff(d.where("doc_id % 5 <> 0"), d.where("doc_id % 7 <> 0").withColumn("s", F.when(F.col("doc_id") % 11 == 0, F.col("s") + 1).otherwise(F.col("s"))), "doc_id", "s")


@register("cache_staleness", "SELECT p.page_id, NOT (c.size IS NOT DISTINCT FROM length(p.html) AND c.mtime IS NOT DISTINCT FROM p.page_id % 10) AS stale FROM pages p LEFT JOIN (SELECT page_id, length(html) + CASE WHEN page_id % 6 = 0 THEN 1 ELSE 0 END AS size, page_id % 10 AS mtime FROM pages WHERE page_id % 4 <> 0) c ON p.page_id = c.page_id")
def cache_staleness(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.length("html").alias("size"), (F.col("page_id") % 10).alias("mtime"))
    return N.is_stale(p.where("page_id % 4 <> 0").withColumn("size", F.col("size") + F.when(F.col("page_id") % 6 == 0, 1).otherwise(0)), p, "page_id")


@register("page_spec_filter", "SELECT page_id, url FROM pages WHERE page_id IN (1, 3, 5, 6, 7, 100, 101, 102)")
def page_spec_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url").join(specs.pages_of(spark, "1,3,5-7,100-102"), F.col("page_id") == F.col("page"), "left_semi")


@register("line_spec_filter", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey, l_linenumber) IN ((1, 2), (3, 5), (7, 1))")
def line_spec_filter(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return li.join(specs.lines_of(spark, "p1:L2, p3:L5,p7:L1,p1:L2"), (F.col("l_orderkey") == F.col("page")) & (F.col("l_linenumber") == F.col("line")), "left_semi")


@register("allowlist_semi", "SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src3', 'src5')")
def allowlist_semi(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(specs.allowlist(spark, "src1, src3,src5,,src1"), F.col("source") == F.col("key"), "left_semi")


@register("truncate_pairs", "SELECT l_orderkey, l_partkey, l_suppkey, l_quantity AS kern FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(l_quantity - 25) DESC, l_partkey, l_suppkey) AS k FROM lineitem) WHERE k <= 2")
def truncate_pairs(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_quantity").alias("kern"), (F.col("l_quantity") - 25).alias("size"))
    return C.truncate_pairs(p, ["l_orderkey"], "size", ["l_partkey", "l_suppkey"], 2).drop("size")


@register(
    "kern_class_fallback",
    """WITH g AS (SELECT l_orderkey % 10 AS font, l_partkey % 40 AS g1, l_suppkey % 40 AS g2, CAST(max(l_quantity) AS BIGINT) AS value FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL),
    c AS (SELECT l_orderkey % 10 AS font, l_partkey % 5 AS c1, l_suppkey % 5 AS c2, -CAST(max(l_linenumber) AS BIGINT) AS value FROM lineitem WHERE l_partkey % 5 <> 0 GROUP BY ALL), w AS (SELECT DISTINCT l_orderkey % 10 AS font, l_partkey % 50 AS g1, l_suppkey % 50 AS g2 FROM lineitem WHERE l_linenumber = 2)
    SELECT w.font, w.g1, w.g2, coalesce(g.value, c.value, 0) AS kern FROM w LEFT JOIN g ON w.font = g.font AND w.g1 = g.g1 AND w.g2 = g.g2 LEFT JOIN c ON w.font = c.font AND w.g1 % 5 = c.c1 AND w.g2 % 5 = c.c2""",
)
def kern_class_fallback(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("font", F.col("l_orderkey") % 10)
    pair = lambda n, a, b: [(F.col("l_partkey") % n).alias(a), (F.col("l_suppkey") % n).alias(b)]
    own = li.where("l_linenumber = 1").groupBy("font", *pair(40, "g1", "g2")).agg(F.max("l_quantity").cast("long").alias("value"))
    cls = li.where("l_partkey % 5 <> 0").groupBy("font", *pair(5, "c1", "c2")).agg((-F.max("l_linenumber").cast("long")).alias("value"))
    wanted = li.where("l_linenumber = 2").select("font", *pair(50, "g1", "g2")).distinct()
    classes = spark.range(10).select(F.col("id").alias("font"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long"))).alias("glyph")).withColumn("class", F.col("glyph") % 5)
    return C.kern_lookup(wanted, own, cls, classes)


@register("support_mask", "SELECT user_id, CAST(coalesce(bit_or(CASE WHEN value > 50 THEN 1 << CAST(event_id % 7 AS INTEGER) END), 0) AS INTEGER) AS mask FROM events GROUP BY user_id")
def support_mask(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 7).alias("bit"), (F.col("value") > 50).alias("ok"))
    return C.support_mask(e, ["user_id"], "bit", "ok")


DOM_SQL = "e AS (SELECT CAST(ts AS DATE) AS page, event_type, value FROM events), n AS (SELECT event_type, count(DISTINCT page) AS pages, count(*) AS total, list_sort(list(value))[count(*) // 2 + 1] AS em FROM e GROUP BY event_type)"


@register("dominant_key", f"WITH {DOM_SQL} SELECT event_type, CAST(pages AS BIGINT) AS pages, CAST(total AS BIGINT) AS total, em FROM n ORDER BY pages DESC, total DESC, event_type LIMIT 1")
def dominant_key(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("page"), "event_type", "value")
    return N.dominant(e, "page", "event_type", "value")


@register(
    "dominant_key_running",
    """WITH e AS (SELECT user_id % 7 AS document, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS page, event_type, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY ALL), g AS (SELECT * FROM (SELECT DISTINCT document, page FROM e), (SELECT DISTINCT event_type FROM e)),
    c AS (SELECT g.document, g.page, g.event_type, count(n) OVER w AS pages, coalesce(sum(n) OVER w, 0) AS total FROM g LEFT JOIN e ON g.document = e.document AND g.page = e.page AND g.event_type = e.event_type WINDOW w AS (PARTITION BY g.document, g.event_type ORDER BY g.page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    r AS (SELECT *, row_number() OVER (PARTITION BY document, page ORDER BY pages DESC, total DESC, event_type) AS k FROM c) SELECT CAST(document AS BIGINT) AS document, CAST(page AS INTEGER) AS page, CASE WHEN pages > 0 THEN event_type END AS dominant FROM r WHERE k = 1""",
)
def dominant_key_running(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_id % 3 = 0").select((F.col("user_id") % 7).alias("document"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("page"), "event_type")
    return N.dominant_before(e, "page", "event_type", ("document",))


@register("midpoint_prune_fallback", "WITH s AS (SELECT l_orderkey, l_suppkey, l_quantity / 50 - 1 AS score FROM lineitem), p AS (SELECT * FROM s WHERE score >= -0.4) SELECT l_orderkey, l_suppkey, round(score, 6) AS score, false AS fallback FROM p UNION ALL SELECT l_orderkey, l_suppkey, round(score, 6), true FROM s WHERE l_orderkey NOT IN (SELECT l_orderkey FROM p)")
def midpoint_prune_fallback(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_quantity") / 50 - 1).alias("score"))
    return N.pruned_or_all(s, "l_orderkey", F.col("score") >= -0.4).withColumn("score", F.round("score", 6))


@register("coverage_gate", "WITH n AS (SELECT o.o_orderkey, count(l.l_orderkey) AS n, o.o_orderkey % 12 AS windows FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey) SELECT o_orderkey, n >= least(windows, greatest(3, ceil(0.4 * windows))) AS enough FROM n")
def coverage_gate(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    d = o.join(li, o["o_orderkey"] == li["l_orderkey"], "left")
    return d.select("o_orderkey", scores.coverage_gate(F.coalesce("n", F.lit(0)), F.col("o_orderkey") % 12).alias("enough"))


@register("page_summary", "SELECT source, CAST(count(*) FILTER (WHERE n_chars >= 1000) AS BIGINT) AS lines_vectorized, CAST(count(*) FILTER (WHERE n_chars < 1000) AS BIGINT) AS lines_kept_raster, CAST(max(n_chars) AS BIGINT) AS longest FROM documents GROUP BY source")
def page_summary(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(F.col("n_chars") >= 1000).alias("lines_vectorized"), F.count_if(F.col("n_chars") < 1000).alias("lines_kept_raster"), F.max("n_chars").alias("longest"))


@register("audit_nested_json", """SELECT l_orderkey, '{"order":' || l_orderkey || ',"candidates":[' || string_agg('{"part":' || l_partkey || ',"supp":' || l_suppkey || '}', ',' ORDER BY l_partkey, l_suppkey) || ']}' AS entry FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey) AS k FROM lineitem) WHERE k <= 10 GROUP BY l_orderkey""")
def audit_nested_json(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp")))), 1, 10).alias("candidates"))
    return li.select("l_orderkey", F.to_json(F.struct(F.col("l_orderkey").alias("order"), "candidates")).alias("entry"))
