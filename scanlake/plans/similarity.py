"""Queries of the similarity operators on the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlake.functions.arrays import sqdist, upper_median_of
from scanlake.operators import fit, similarity as S
from scanlake.queries import register
from scanlake.session import table

E_SQL = """
e AS (SELECT vec_id, label, label % 2 AS seq, CAST(v AS DOUBLE) AS v, pos FROM (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)),
c AS (SELECT seq, label, pos, avg(v) AS m FROM e GROUP BY seq, label, pos),
cp AS (SELECT a.seq, a.label AS id_a, b.label AS id_b, sum((a.m - b.m) * (a.m - b.m)) AS d FROM c a JOIN c b ON a.seq = b.seq AND a.pos = b.pos AND a.label < b.label GROUP BY a.seq, a.label, b.label),
s AS (SELECT seq, list_sort(list(d))[len(list(d)) // 2 + 1] AS sigma_sq FROM cp GROUP BY seq),
dist AS (SELECT e.seq, e.vec_id, any_value(e.label) AS own, c.label AS id, sum((e.v - c.m) * (e.v - c.m)) AS d FROM e JOIN c ON e.seq = c.seq AND e.pos = c.pos GROUP BY e.seq, e.vec_id, c.label),
raw AS (SELECT dist.*, exp(-(d - min(d) OVER (PARTITION BY vec_id)) / (2 * s.sigma_sq)) AS x FROM dist JOIN s ON dist.seq = s.seq),
p AS (SELECT *, x / sum(x) OVER (PARTITION BY vec_id) AS prob FROM raw)
"""


def vectors(spark, sf_dir):
    """The embeddings in two sequences, that of the odd labels and that of the even ones."""
    return table(spark, sf_dir, "embeddings").select((F.col("label") % 2).alias("seq"), "vec_id", "label", "embedding")


def posteriors(spark, sf_dir):
    v = vectors(spark, sf_dir)
    c = S.centroids(v, "label", "embedding")
    return S.calibrated(S.distances(v, c, "embedding"), S.sigma_sq(c))


@register("knn_softmax_topk", f"WITH {E_SQL} SELECT vec_id, id AS label, round(prob, 6) AS prob, k AS rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY round(prob, 12) DESC, id) AS INTEGER) AS k FROM p) WHERE k <= 3")
def knn_softmax_topk(spark, sf_dir):
    return S.top_k(posteriors(spark, sf_dir), "vec_id", 3).select("vec_id", F.col("id").alias("label"), F.round("prob", 6).alias("prob"), "rank")


@register("raw_logits_rank", f"WITH {E_SQL} SELECT vec_id, id AS label, round(-d / (2 * sigma_sq), 6) AS logit, CAST(rank() OVER (PARTITION BY vec_id ORDER BY round(d, 9)) AS INTEGER) AS rank FROM dist JOIN s ON dist.seq = s.seq")
def raw_logits_rank(spark, sf_dir):
    rows = posteriors(spark, sf_dir)
    scale = rows.select("vec_id", "sigma_sq", "scores")
    return S.ranked(scale.withColumn("vec_id", F.struct("vec_id", "sigma_sq")), "vec_id").select("vec_id.vec_id", F.col("id").alias("label"), F.round(-F.col("d") / (2 * F.col("vec_id.sigma_sq")), 6).alias("logit"), "rank")


@register("sigma_sq_pairwise", f"WITH {E_SQL} SELECT CAST(seq AS BIGINT) AS seq, round(sigma_sq, 6) AS sigma_sq, CAST((SELECT count(*) FROM cp WHERE cp.seq = s.seq) AS INTEGER) AS n_pairs FROM s")
def sigma_sq_pairwise(spark, sf_dir):
    p = S.pair_distances(S.centroids(vectors(spark, sf_dir), "label", "embedding"))
    return p.select(F.col("seq").cast("long").alias("seq"), F.round(upper_median_of(F.transform("pairs", lambda x: x["d"])), 6).alias("sigma_sq"), F.size("pairs").alias("n_pairs"))


@register("med_nn", f"WITH {E_SQL}, nn AS (SELECT seq, id, min(d) AS d FROM (SELECT seq, id_a AS id, d FROM cp UNION ALL SELECT seq, id_b, d FROM cp) GROUP BY seq, id) SELECT CAST(seq AS BIGINT) AS seq, round(list_sort(list(d))[len(list(d)) // 2 + 1], 6) AS med_nn FROM nn GROUP BY seq")
def med_nn(spark, sf_dir):
    return S.med_nn(S.centroids(vectors(spark, sf_dir), "label", "embedding")).select(F.col("seq").cast("long").alias("seq"), F.round("med_nn", 6).alias("med_nn"))


@register("obs_entropy", f"WITH {E_SQL}, l AS (SELECT *, min(d) OVER (PARTITION BY vec_id) AS low FROM p) SELECT vec_id, round(min(d), 6) AS min_d, round(min(CASE WHEN d > low THEN d END), 6) AS second_d, round(-sum(CASE WHEN prob > 1e-30 THEN prob * ln(prob) ELSE 0 END), 6) AS entropy, round(max(prob), 6) AS best_prob FROM l GROUP BY vec_id")
def obs_entropy(spark, sf_dir):
    return S.observation_stats(posteriors(spark, sf_dir), "vec_id").select("vec_id", *[F.round(x, 6).alias(x) for x in ("min_d", "second_d", "entropy", "best_prob")])


@register(
    "fusion_geometric_mean",
    f"""WITH {E_SQL},
    q AS (SELECT e.vec_id, c.label AS id, sum(abs(e.v - c.m)) AS d1 FROM e JOIN c ON e.seq = c.seq AND e.pos = c.pos GROUP BY e.vec_id, c.label),
    q2 AS (SELECT *, exp(-(d1 - min(d1) OVER (PARTITION BY vec_id)) / 2) AS y FROM q),
    q3 AS (SELECT vec_id, id, y / sum(y) OVER (PARTITION BY vec_id) AS prob FROM q2),
    f AS (SELECT p.vec_id, p.id, 0.7 * ln(greatest(p.prob, 1e-30)) + 0.3 * ln(greatest(q3.prob, 1e-30)) AS lp FROM p JOIN q3 ON p.vec_id = q3.vec_id AND p.id = q3.id),
    g AS (SELECT *, exp(lp - max(lp) OVER (PARTITION BY vec_id)) AS z FROM f)
    SELECT vec_id, id AS label, round(z / sum(z) OVER (PARTITION BY vec_id), 6) AS prob FROM g""",
)
def fusion_geometric_mean(spark, sf_dir):
    """Fuses the squared distance's posterior with that of the absolute distance."""
    v = vectors(spark, sf_dir)
    c = S.centroids(v, "label", "embedding")
    by_abs = S.distances(v, c, "embedding", metric=lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)), F.lit(0.0), lambda acc, x: acc + x))
    one = S.calibrated(by_abs, S.sigma_sq(c).withColumn("sigma_sq", F.lit(1.0)))
    return S.each(S.fuse([(posteriors(spark, sf_dir), 0.7), (one, 0.3)], "vec_id"), "vec_id").select("vec_id", F.col("id").alias("label"), F.round("prob", 6).alias("prob"))


@register(
    "eval_mrr_topk",
    f"""WITH {E_SQL}, r AS (SELECT vec_id, max(own) AS own, 1 + count(*) FILTER (WHERE d < own_d) AS strict, 1 + count(*) FILTER (WHERE d < family_d) AS family
      FROM (SELECT *, max(CASE WHEN id = own THEN d END) OVER (PARTITION BY vec_id) AS own_d, min(CASE WHEN id % 3 = own % 3 THEN d END) OVER (PARTITION BY vec_id) AS family_d FROM dist) GROUP BY vec_id)
    SELECT CAST(count(*) AS BIGINT) AS n, round(avg(1.0 / strict), 6) AS strict_mrr, round(avg(1.0 / family), 6) AS family_mrr,
      round(avg(CASE WHEN strict = 1 THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(CASE WHEN strict <= 5 THEN 1.0 ELSE 0.0 END), 6) AS top5 FROM r""",
)
def eval_mrr_topk(spark, sf_dir):
    return fit.rank_metrics(posteriors(spark, sf_dir), "label", lambda i: i % 3 == F.col("label") % 3)


@register(
    "fisher_scores",
    f"""WITH {E_SQL}, n AS (SELECT label, pos, count(*) AS n, avg(v) AS m, var_pop(v) AS var FROM e GROUP BY label, pos), g AS (SELECT pos, avg(v) AS m FROM e GROUP BY pos)
    SELECT CAST(n.pos - 1 AS INTEGER) AS dim, round(sum(n.n * (n.m - g.m) * (n.m - g.m)) / sum(n.n * n.var), 6) AS score FROM n JOIN g ON n.pos = g.pos GROUP BY n.pos""",
)
def fisher_scores(spark, sf_dir):
    return fit.fisher(vectors(spark, sf_dir), "label", "embedding").select("dim", F.round("score", 6).alias("score"))


@register(
    "class_mean_scatter",
    f"WITH {E_SQL}, n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), w AS (SELECT e.label, sum((e.v - c.m) * (e.v - c.m)) AS within_ss FROM e JOIN c ON e.label = c.label AND e.pos = c.pos GROUP BY e.label) SELECT w.label, CAST(n.n AS BIGINT) AS n, round(w.within_ss / n.n, 6) AS scatter FROM w JOIN n ON w.label = n.label",
)
def class_mean_scatter(spark, sf_dir):
    v = vectors(spark, sf_dir)
    own = v.join(S.centroids(v, "label", "embedding").withColumnRenamed("id", "label"), ["seq", "label"])
    return own.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(sqdist(F.col("embedding"), F.col("vec"))), 6).alias("scatter"))


PAIR_SQL = f"WITH {E_SQL}, m AS (SELECT e.vec_id, count(*) AS n, avg(e.v) AS ma, avg(c.m) AS mb, avg(e.v * e.v) - avg(e.v) * avg(e.v) AS va, avg(c.m * c.m) - avg(c.m) * avg(c.m) AS vb, avg(e.v * c.m) - avg(e.v) * avg(c.m) AS cov FROM e JOIN c ON e.label = c.label AND e.pos = c.pos GROUP BY e.vec_id)"


@register("zncc_pairs", f"{PAIR_SQL} SELECT vec_id, round(CASE WHEN sqrt(greatest(va, 0) * greatest(vb, 0)) < 1e-10 THEN 1.0 ELSE greatest(-1.0, least(1.0, cov / sqrt(greatest(va, 0) * greatest(vb, 0)))) END, 6) AS zncc FROM m")
def zncc_pairs(spark, sf_dir):
    v = vectors(spark, sf_dir)
    own = v.join(S.centroids(v, "label", "embedding").withColumnRenamed("id", "label"), ["seq", "label"])
    return own.select("vec_id", F.round(S.zncc(F.col("embedding"), F.col("vec")), 6).alias("zncc"))


@register("ssim_global_pairs", f"{PAIR_SQL} SELECT vec_id, round(greatest(0.0, least(1.0, (2 * ma * mb + 6.5025) * (2 * cov + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225)))), 6) AS ssim FROM m")
def ssim_global_pairs(spark, sf_dir):
    v = vectors(spark, sf_dir)
    own = v.join(S.centroids(v, "label", "embedding").withColumnRenamed("id", "label"), ["seq", "label"])
    return own.select("vec_id", F.round(S.ssim_global(F.col("embedding"), F.col("vec")), 6).alias("ssim"))


@register(
    "weighted_vote",
    """WITH o AS (SELECT l_orderkey, l_suppkey, l_quantity AS area, CASE WHEN l_discount < 0.01 THEN NULL ELSE -l_discount * 10 END AS logit, -l_tax AS h_ll, CASE WHEN l_linenumber % 2 = 0 THEN -0.5 END AS v_ll FROM lineitem),
    m AS (SELECT l_orderkey, list_sort(list(area))[len(list(area)) // 2 + 1] AS med FROM o GROUP BY l_orderkey)
    SELECT o.l_orderkey, o.l_suppkey, round(sum((logit + 0.237123456 * (coalesce(h_ll, 0) + coalesce(v_ll, 0))) * area / med), 6) AS score, CAST(count(*) AS BIGINT) AS n
    FROM o JOIN m ON o.l_orderkey = m.l_orderkey GROUP BY o.l_orderkey, o.l_suppkey HAVING NOT bool_or(logit IS NULL)""",
)
def weighted_vote(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_quantity").alias("area"), F.when(F.col("l_discount") >= 0.01, -F.col("l_discount") * 10).alias("logit"), (-F.col("l_tax")).alias("h_ll"), F.when(F.col("l_linenumber") % 2 == 0, -0.5).alias("v_ll"))
    return S.weighted_vote(o, "l_orderkey", "l_suppkey", 0.237123456).select("l_orderkey", "l_suppkey", F.round("score", 6).alias("score"), "n")
