"""Queries of lookups in groups and catalogs, and of the small measures of text, scores and hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlake.functions import arrays as A, identity as I, scores, text as T
from scanlake.operators import catalog as C, evaluate as E, fit, incremental as N, similarity as S
from scanlake.plans.catalog import KEYS_SQL, keys
from scanlake.plans.similarity import E_SQL, vectors
from scanlake.queries import register
from scanlake.session import table

GROUPS_SQL = "i AS (SELECT DISTINCT l_returnflag || l_linestatus AS seq, l_suppkey AS key, (l_partkey + l_suppkey) % 40 AS content FROM lineitem), c AS (SELECT seq, sha256(CAST(content AS VARCHAR)) AS hash, list_sort(list(DISTINCT key)) AS keys, min(key) AS f FROM i GROUP BY seq, content), g AS (SELECT seq, CAST(row_number() OVER (PARTITION BY seq ORDER BY f, hash) - 1 AS INTEGER) AS glyph_id, keys FROM c)"


def wanted(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.element_at(F.array(*map(F.lit, ("AF", "NO", "RF", "XX"))), (1 + F.col("s_suppkey") % 4).cast("int")).alias("seq"), F.col("s_suppkey").alias("key"))


def flag_groups(spark, sf_dir):
    content = ((F.col("l_partkey") + F.col("l_suppkey")) % 40).cast("string")
    items = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("seq"), F.col("l_suppkey").alias("key"), content.alias("content"))
    return C.content_groups(items, "seq", "key", "content")


WANTED_SQL = "q AS (SELECT (['AF', 'NO', 'RF', 'XX'])[1 + s_suppkey % 4] AS seq, s_suppkey AS key FROM supplier)"


@register("glyph_id_for_key", f"WITH {GROUPS_SQL}, {WANTED_SQL} SELECT q.seq, q.key, (SELECT min(glyph_id) FROM g WHERE g.seq = q.seq AND list_contains(g.keys, q.key)) AS glyph_id FROM q")
def glyph_id_for_key(spark, sf_dir):
    return C.glyphs_of_keys(wanted(spark, sf_dir), flag_groups(spark, sf_dir), "seq", "key")


@register("keys_for_glyph", f"WITH {GROUPS_SQL}, {WANTED_SQL} SELECT q.seq, CAST(q.key AS INTEGER) AS glyph_id, CAST(len(coalesce(g.keys, [])) AS INTEGER) AS n_keys, g.keys[1] AS first_key FROM q LEFT JOIN g ON g.seq = q.seq AND g.glyph_id = q.key")
def keys_for_glyph(spark, sf_dir):
    w = wanted(spark, sf_dir).select("seq", F.col("key").cast("int").alias("glyph_id"))
    return C.keys_of_glyphs(w, flag_groups(spark, sf_dir), "seq").select("seq", "glyph_id", F.size("keys").alias("n_keys"), F.get("keys", F.lit(0)).alias("first_key"))


@register("all_keys", f"WITH {GROUPS_SQL} SELECT seq, md5(array_to_string(flatten(list(keys ORDER BY glyph_id)), ',')) AS keys FROM g GROUP BY seq")
def all_keys(spark, sf_dir):
    return C.keys_of_sequences(flag_groups(spark, sf_dir), "seq").select("seq", F.md5(F.array_join(F.transform("keys", lambda k: k.cast("string")), ",")).alias("keys"))


@register("known_keys", "SELECT DISTINCT l_suppkey AS key FROM lineitem")
def known_keys(spark, sf_dir):
    return C.known_keys(flag_groups(spark, sf_dir), "seq")


@register("glyph_families", f"WITH {GROUPS_SQL} SELECT g.seq, g.glyph_id, coalesce(s_nationkey, 4294967295) AS family FROM g LEFT JOIN supplier ON s_suppkey = g.keys[1] AND s_suppkey % 3 <> 0")
def glyph_families(spark, sf_dir):
    f = table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("family"))
    return C.families_of_glyphs(flag_groups(spark, sf_dir), f, "seq", "key", "family")


@register(
    "find_in_catalog",
    f"""WITH {KEYS_SQL}, e AS (SELECT *, replace(p_brand, '#', '') AS ps FROM v), q AS (SELECT p_partkey, (CASE WHEN p_partkey % 2 = 0 THEN 'ABC+' ELSE '' END) || CASE p_partkey % 3 WHEN 0 THEN key WHEN 1 THEN replace(p_brand, '#', '') ELSE 'none' END AS name, CASE p_partkey % 3 WHEN 0 THEN key WHEN 1 THEN replace(p_brand, '#', '') ELSE 'none' END AS plain FROM k),
    b AS (SELECT ps, key FROM (SELECT *, row_number() OVER (PARTITION BY ps ORDER BY version DESC, score DESC, key) AS r FROM e) WHERE r = 1)
    SELECT q.p_partkey, q.name, CASE WHEN q.plain IN (SELECT key FROM e) THEN q.plain ELSE b.key END AS found FROM q LEFT JOIN b ON b.ps = q.plain""",
)
def find_in_catalog(spark, sf_dir):
    k = keys(spark, sf_dir)
    entries = k.withColumn("postscript_name", F.replace("p_brand", F.lit("#"), F.lit("")))
    n = F.col("p_partkey")
    name = F.concat(F.when(n % 2 == 0, "ABC+").otherwise(""), F.when(n % 3 == 0, F.col("key")).when(n % 3 == 1, F.replace("p_brand", F.lit("#"), F.lit(""))).otherwise("none"))
    return C.find_by_name(k.select("p_partkey", name.alias("name")), entries, "name", "key", "kern")


@register(
    "correct_candidates",
    """WITH c AS (SELECT l_orderkey, list(l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey)[1:3] AS cand, list(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey)[1:3] AS scores FROM lineitem GROUP BY l_orderkey),
    t AS (SELECT o_orderkey, o_custkey % 10 + 1 AS truth, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 50 + 11 END AS gt_rank, CASE WHEN o_orderkey % 3 <> 0 THEN 0.25 END AS gt_score, cand, scores FROM orders JOIN c ON l_orderkey = o_orderkey),
    r AS (SELECT *, list_position(cand, truth) AS place, truth IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 <> 0) AS known FROM t)
    SELECT o_orderkey, CASE WHEN known AND place > 0 THEN 'k' || truth WHEN known AND gt_rank IS NOT NULL AND gt_score IS NOT NULL THEN 'k' || truth END AS correct_key, CASE WHEN known AND place > 0 THEN scores[place] WHEN known AND gt_rank IS NOT NULL AND gt_score IS NOT NULL THEN gt_score END AS correct_score, CAST(CASE WHEN known AND place > 0 THEN place WHEN known AND gt_rank IS NOT NULL AND gt_score IS NOT NULL THEN gt_rank END AS INTEGER) AS correct_rank FROM r""",
)
def correct_candidates(spark, sf_dir):
    name = lambda c: F.concat(F.lit("k"), c.cast("string"))
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.slice(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))), 1, 3).alias("c"))
    o = F.col("o_orderkey")
    lines = table(spark, sf_dir, "orders").join(li, F.col("l_orderkey") == o).select("o_orderkey", F.concat(F.lit("ABC+"), name(F.col("o_custkey") % 10 + 1)).alias("truth"), F.when(o % 2 == 0, o % 50 + 11).alias("gt_rank"), F.when(o % 3 != 0, 0.25).alias("gt_score"), F.transform("c", lambda x: F.struct(name(x["l_suppkey"]).alias("key"), x["l_quantity"].alias("score"))).alias("font_candidates"))
    entries = table(spark, sf_dir, "supplier").where("s_suppkey % 4 <> 0").select(name(F.col("s_suppkey")).alias("font_key"))
    return C.correct_candidate(lines, entries, "truth", "font_key").select("o_orderkey", "correct_key", "correct_score", "correct_rank")


@register(
    "ligature_cases",
    """WITH d AS (SELECT l_orderkey, l_linenumber * 1000000 + l_partkey AS idx, l_returnflag = 'A' AND l_orderkey % 3 = 0 AS lig, l_tax AS best, round(l_discount - 0.05, 2) AS delta FROM lineitem),
    p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, delta > 0 ORDER BY abs(delta) DESC, idx) AS k FROM d WHERE delta <> 0), s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY k > 1, abs(delta) DESC, idx) AS r FROM p),
    a AS (SELECT d.l_orderkey, d.idx, s.idx IS NOT NULL AS shown FROM d LEFT JOIN (SELECT l_orderkey, idx FROM s WHERE r <= 2) s ON s.l_orderkey = d.l_orderkey AND s.idx = d.idx WHERE s.idx IS NOT NULL OR d.lig)
    SELECT l_orderkey, CAST(idx AS BIGINT) AS idx, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY NOT shown, idx) AS INTEGER) AS place FROM a""",
)
def ligature_cases(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem"), F.col("l_orderkey")
    d = li.select("l_orderkey", (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("idx"), F.when(F.col("l_returnflag") == "A", "ofﬁce").otherwise("office").alias("seq"), F.when(o % 3 == 0, "A|nolig").otherwise("A|lig").alias("chosen"), F.round(F.col("l_discount") - 0.05, 2).alias("delta"))
    shown = E.interesting(d, "l_orderkey", "idx", "delta", 2)
    return C.with_ligature_cases(shown, d, ["l_orderkey"], "idx", C.is_ligature_case(F.col("seq"), F.lit("A|kern|lig"), F.col("chosen"))).select("l_orderkey", "idx", "place")


@register("dedup_by_key", f"WITH {KEYS_SQL}, d AS (SELECT regexp_replace(key, '[|]version=[^|\\[]*', '') AS key, p_partkey FROM k) SELECT key, min(p_partkey) AS p_partkey FROM d GROUP BY key")
def dedup_by_key(spark, sf_dir):
    d = keys(spark, sf_dir).select(F.regexp_replace("key", r"[|]version=[^|\[]*", "").alias("key"), "p_partkey")
    return C.dedup_by_key(d, "key", ["p_partkey"])


@register("text_measures", r"SELECT doc_id, regexp_matches(text, '[gjpqyQ]') AS descends, length(text) >= 2 AND regexp_matches(text, '\p{L}') AS anchors, md5(regexp_replace(text, '[^\p{L}\p{N}]', '_', 'g')) AS slug FROM documents")
def text_measures(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.has_descenders(t).alias("descends"), T.is_sizing_anchor(t).alias("anchors"), F.md5(T.slug(t)).alias("slug"))


@register("hash_names", "SELECT event_id, printf('%016x', event_id * 7919) AS hash FROM events")
def hash_names(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.hash_hex(F.col("event_id") * 7919).alias("hash"))


@register("subset_prefixes", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name || '+' || p_brand END AS name FROM part")
def subset_prefixes(spark, sf_dir):
    n = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat(F.lit("ABCDEF+"), "p_name", F.lit("+"), "p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", T.strip_subset_prefix(n).alias("name"))


@register("utf16_texts", "SELECT conv_id, turn, md5(text) AS text FROM conversations")
def utf16_texts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.md5(T.utf16be_text(F.hex(F.encode("text", "UTF-16BE")))).alias("text"))


@register("expanded_ligatures", "SELECT doc_id, md5(replace(replace(text, 'ﬁ', 'fi'), 'ﬃ', 'ffi')) AS text FROM documents")
def expanded_ligatures(spark, sf_dir):
    some = F.replace(F.replace("text", F.lit("ffi"), F.lit("ﬃ")), F.lit("fi"), F.lit("ﬁ"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.expand_ligatures(some)).alias("text"))


@register(
    "geometry_scores",
    "WITH e AS (SELECT event_id, value, event_id % 5 / 4.0 AS a, event_id % 9 / 8.0 + 1 AS b, CASE WHEN event_id % 4 = 0 THEN value END AS c, CASE WHEN event_id % 3 <> 0 THEN -value END AS h, CASE WHEN event_id % 2 = 0 THEN 1.5 END AS v FROM events) SELECT event_id, round(CASE WHEN value / 50 >= 0.5 AND b - a >= 0.5 THEN value / 50 / (b - a) END, 6) AS span_scale, round(coalesce(c, h + v, h, v), 6) AS geo_ll, round(value * 72.0 / 300 / b, 6) AS size_pt, round(value * 0.001 * 2048, 6) AS em FROM e",
)
def geometry_scores(spark, sf_dir):
    e, n, v = table(spark, sf_dir, "events"), F.col("event_id"), F.col("value")
    a, b = n % 5 / 4.0, n % 9 / 8.0 + 1
    return e.select(
        "event_id", F.round(scores.center_span_scale(F.lit(0.0), v / 50, a, b), 6).alias("span_scale"), F.round(scores.combined_geo_ll(F.when(n % 4 == 0, v), F.when(n % 3 != 0, -v), F.when(n % 2 == 0, 1.5)), 6).alias("geo_ll"),
        F.round(scores.font_size_pt(v, F.lit(300), b), 6).alias("size_pt"), F.round(scores.em_from_scale(v * 0.001, F.lit(2048)), 6).alias("em"),
    )


@register("hits", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 5 <> 0 THEN 'F' || o_custkey % 3 END = 'F' || o_orderkey % 3, true) AS hit FROM orders")
def hits(spark, sf_dir):
    name = lambda c: F.concat(F.lit("F"), (F.col(c) % 3).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", E.is_hit(F.when(F.col("o_orderkey") % 5 != 0, name("o_custkey")), name("o_orderkey")).alias("hit"))


@register("resampled_profiles", "WITH e AS (SELECT vec_id, embedding AS v FROM embeddings), p AS (SELECT vec_id, v, unnest(range(0, 16)) AS i FROM e), q AS (SELECT vec_id, i, v, i * 63 / 15.0 AS spot FROM p) SELECT vec_id, CAST(i AS INTEGER) AS bin, round(CAST(v[CAST(floor(spot) AS INTEGER) + 1] AS DOUBLE) * (1 - (spot - floor(spot))) + CAST(v[least(CAST(floor(spot) AS INTEGER) + 2, 64)] AS DOUBLE) * (spot - floor(spot)), 6) AS value FROM q")
def resampled_profiles(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(A.resample(F.col("embedding"), 16)).alias("bin", "value"))
    return e.select("vec_id", "bin", F.round("value", 6).alias("value"))


@register("projected_vectors", "WITH e AS (SELECT vec_id, unnest(range(0, 3)) AS dim, embedding AS v FROM embeddings) SELECT vec_id, CAST(dim AS INTEGER) AS dim, round(list_sum(list_transform(range(1, 65), lambda i: CAST(v[i] AS DOUBLE) * ((i * (dim + 2)) % 5 - 2))), 6) AS value FROM e")
def projected_vectors(spark, sf_dir):
    rows = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda d: F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: ((i * (d + 2)) % 5 - 2).cast("double")))
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(A.project(rows, F.col("embedding"))).alias("dim", "value"))
    return e.select("vec_id", "dim", F.round("value", 6).alias("value"))


@register(
    "feature_weights",
    f"""WITH {E_SQL}, n AS (SELECT label, pos, count(*) AS n, avg(v) AS m, var_pop(v) AS var FROM e GROUP BY label, pos), g AS (SELECT pos, avg(v) AS m FROM e GROUP BY pos), f AS (SELECT n.pos, sum(n.n * (n.m - g.m) * (n.m - g.m)) / sum(n.n * n.var) AS score FROM n JOIN g ON n.pos = g.pos GROUP BY n.pos)
    SELECT CAST(pos - 1 AS INTEGER) AS dim, round(sqrt(score) / sum(sqrt(score)) OVER (), 6) AS weight FROM f""",
)
def feature_weights(spark, sf_dir):
    return fit.normalize_scores(fit.fisher(vectors(spark, sf_dir), "label", "embedding")).select("dim", F.round("weight", 6).alias("weight"))


@register("log_probabilities", "SELECT event_id, CASE WHEN value > 20 THEN printf('%.2f', round(ln((value - 20) / 100), 2)) ELSE '' END AS lp FROM events WHERE abs(ln(greatest(value - 20, 0.001) / 100) * 100 - round(ln(greatest(value - 20, 0.001) / 100) * 100)) < 0.499")
def log_probabilities(spark, sf_dir):
    lp = F.log(F.greatest(F.col("value") - 20, F.lit(0.001)) / 100) * 100
    e = table(spark, sf_dir, "events").where(F.abs(lp - F.round(lp)) < 0.499)
    return e.select("event_id", I.log_probability((F.col("value") - 20) / 100).alias("lp"))


@register(
    "overlap_masks",
    """WITH p AS (SELECT l_suppkey AS font, l_linenumber % 5 AS bit, max(CASE WHEN l_quantity - (l_partkey % 40 + l_orderkey % 7) > 0 THEN 1 ELSE 0 END) AS o FROM lineitem GROUP BY ALL), m AS (SELECT font, CAST(sum(o * (1 << CAST(bit AS INTEGER))) AS INTEGER) AS mask FROM p GROUP BY font),
    s AS (SELECT font, mask, CAST(font % 32 AS INTEGER) AS supported FROM m) SELECT font, mask, CASE WHEN font % 3 = 0 THEN 0 ELSE supported END | (supported & mask) AS fused FROM s""",
)
def overlap_masks(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("font"), (F.col("l_linenumber") % 5).alias("bit"), F.col("l_quantity").alias("x_max"), (F.col("l_partkey") % 40).alias("advance"), (F.col("l_orderkey") % 7).alias("x_min"))
    m, key = C.overlap_mask(p, ["font"], "bit"), F.when(F.col("font") % 3 == 0, "A|nolig").otherwise("A|lig")
    return m.select("font", "mask", C.fused_mask(key, (F.col("font") % 32).cast("int"), F.col("mask")).alias("fused"))


@register("old_style_figures", "SELECT event_id, value >= 1 AND 0 - (-(event_id % 40) / 10.0) > 0.15 * value AS old FROM events")
def old_style_figures(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", C.is_old_style(F.lit(0.0), F.col("value"), -(F.col("event_id") % 40) / 10.0).alias("old"))


@register("older_weights", "WITH l AS (SELECT user_id, max(event_id) AS latest FROM events WHERE event_id % 3 = 0 GROUP BY user_id), w AS (SELECT user_id, min(event_id) + 40000 AS made FROM events GROUP BY user_id) SELECT w.user_id, coalesce(made < latest, false) AS older FROM w LEFT JOIN l ON l.user_id = w.user_id")
def older_weights(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("at"))
    return N.older_than_any(e.groupBy("user_id").agg((F.min("at") + 40000).alias("at")), e.where("at % 3 = 0"), "user_id", "at")


@register("stale_headers", "SELECT s_nationkey, max(CASE WHEN s_suppkey % 17 = 0 THEN 1 ELSE 0 END) = 1 AS stale FROM supplier GROUP BY s_nationkey")
def stale_headers(spark, sf_dir):
    header = F.when(F.col("s_suppkey") % 34 == 0, F.lit(None)).when(F.col("s_suppkey") % 17 == 0, "seqs=5 th=2400").otherwise(" seqs=5\tth=240 ")
    return N.has_stale_header(table(spark, sf_dir, "supplier").select("s_nationkey", header.alias("h")), "s_nationkey", "h", "th=240")


@register(
    "nearest_with_distances",
    f"""WITH {E_SQL}, x AS (SELECT vec_id, label, pos % 8 AS dim, sum(v * (pos % 3 - 1)) AS v FROM e GROUP BY ALL), k AS (SELECT label % 2 AS seq, label, dim, avg(v) AS m FROM x GROUP BY ALL),
    q AS (SELECT a.seq, sum((a.m - b.m) * (a.m - b.m)) AS d FROM k AS a JOIN k AS b ON a.seq = b.seq AND a.dim = b.dim AND a.label < b.label GROUP BY a.seq, a.label, b.label), g AS (SELECT seq, list_sort(list(d))[len(list(d)) // 2 + 1] AS s FROM q GROUP BY seq),
    t AS (SELECT x.vec_id, k.label, k.seq, sum((x.v - k.m) * (x.v - k.m)) AS d FROM x JOIN k ON x.label % 2 = k.seq AND x.dim = k.dim GROUP BY ALL), r AS (SELECT t.*, exp(-(d - min(d) OVER (PARTITION BY vec_id)) / (2 * s)) AS y FROM t JOIN g ON t.seq = g.seq),
    z AS (SELECT vec_id, label, d, y / sum(y) OVER (PARTITION BY vec_id) AS prob, row_number() OVER (PARTITION BY vec_id ORDER BY d, label) AS rank FROM r) SELECT vec_id, label, round(prob, 5) AS prob, round(d, 5) AS d, CAST(rank AS INTEGER) AS rank FROM z WHERE rank <= 2""",
)
def nearest_with_distances(spark, sf_dir):
    v = vectors(spark, sf_dir)
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda d: F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.when(i % 8 == d, i % 3 - 1).otherwise(0).cast("double")))
    p = S.projected(v, v.select("seq").distinct().withColumn("weights", rows), "embedding")
    c = S.centroids(p, "label", "embedding")
    cents = S.with_glyphs(c.where("id > 3"), c.where("id <= 3"))
    found = S.nearest_with_distances(S.calibrated(S.distances(p, cents, "embedding"), S.sigma_sq(cents)), "vec_id", 2)
    return found.select("vec_id", F.col("id").alias("label"), F.round("prob", 5).alias("prob"), F.round("d", 5).alias("d"), "rank")


@register("class_moments", f"WITH {E_SQL}, moments AS (SELECT a.label, count(*) AS n, a.pos AS i, b.pos AS j, sum(a.v * b.v) - sum(a.v) * sum(b.v) / count(*) AS s FROM e AS a JOIN e AS b ON a.vec_id = b.vec_id AND a.pos <= b.pos WHERE b.pos <= 6 GROUP BY ALL) SELECT label, CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, round(s, 5) AS s FROM moments")
def class_moments(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("label", F.slice("embedding", 1, 6).alias("v"))
    return fit.scatter_moments(v, "label", "v").withColumn("s", F.round("s", 5))


@register("discriminants")
def discriminants(spark, sf_dir):
    """Discriminant directions of the even and the odd labels; held against numpy in the tests."""
    return fit.lda(vectors(spark, sf_dir), "seq", "label", "embedding", 4).withColumn("weights", F.transform("weights", lambda x: F.round(x, 4)))


@register("whitening_metric")
def whitening_metric(spark, sf_dir):
    """Rows of the inverse within-class scatter; held against numpy in the tests."""
    return fit.mahalanobis(vectors(spark, sf_dir), "seq", "label", "embedding").withColumn("inverse", F.transform("inverse", lambda x: F.round(x, 4)))
