"""Nearest centroids, calibrated probabilities, ensembles and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.functions.arrays import dot, project, sqdist, total, upper_median, upper_median_of


def centroids(samples: DataFrame, key: str, vector: str, seq: str = "seq") -> DataFrame:
    """(seq, id, vec): the mean vector of each class; sums are combined before the shuffle, one row per class and dimension."""
    long = samples.select(seq, F.col(key).alias("id"), F.posexplode(vector).alias("pos", "v"))
    mean = long.groupBy(seq, "id", "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return mean.groupBy(seq, "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("vec"))


#: Most classes of one sequence, which travel together in one row; that there are no more is checked.
MOST_CLASSES = 2_000


def classes(cents: DataFrame, seq: str = "seq", most: int = MOST_CLASSES) -> DataFrame:
    """(seq, classes): the centroids of each sequence as one array of (id, vec), by id; an error beyond ``most`` of them."""
    both = F.array_sort(F.collect_list(F.struct("id", "vec")))
    return cents.groupBy(seq).agg(F.when(F.count("*") > most, F.raise_error(F.lit(f"a sequence has more than {most} classes"))).otherwise(both).alias("classes"))


def pair_distances(cents: DataFrame, seq: str = "seq") -> DataFrame:
    """(seq, classes, pairs): the squared distances (a, b, d) of the unordered pairs of a sequence's centroids, within its row."""
    later = lambda a, i: F.transform(F.slice("classes", i + 2, F.greatest(F.size("classes") - i - 1, F.lit(0))), lambda b: F.struct(a["id"].alias("a"), b["id"].alias("b"), sqdist(a["vec"], b["vec"]).alias("d")))
    return classes(cents, seq).withColumn("pairs", F.flatten(F.transform("classes", later)))


def sigma_sq(cents: DataFrame, seq: str = "seq") -> DataFrame:
    """(seq, sigma_sq): the upper median of the pairs' distances; null for a single class."""
    return pair_distances(cents, seq).select(seq, upper_median_of(F.transform("pairs", lambda p: p["d"])).alias("sigma_sq"))


def med_nn(cents: DataFrame, seq: str = "seq") -> DataFrame:
    """(seq, med_nn): the upper median of each centroid's distance to the nearest other."""
    d = pair_distances(cents, seq)
    near = F.transform("classes", lambda c: F.array_min(F.transform(F.filter("pairs", lambda p: (p["a"] == c["id"]) | (p["b"] == c["id"])), lambda p: p["d"])))
    return d.select(seq, upper_median_of(F.array_compact(near)).alias("med_nn"))


def dealt(queries: DataFrame) -> DataFrame:
    """The queries over all cores: a small file can hold many, and each takes as much work as its sequence has classes."""
    return queries.repartition(queries.sparkSession.sparkContext.defaultParallelism)


def distances(queries: DataFrame, cents: DataFrame, vector: str, seq: str = "seq", metric=sqdist) -> DataFrame:
    """Adds scores, the distance (id, d) of every query to each class of its sequence, by id.

    A query stays one row: its sequence's classes come with one row of an equality join on seq, whose size is bounded, and
    all that follows is computed within the row.
    """
    q = dealt(queries).join(classes(cents, seq), seq)
    return q.withColumn("scores", F.transform("classes", lambda c: F.struct(c["id"].alias("id"), metric(F.col(vector), c["vec"]).alias("d")))).drop("classes")


def calibrated(rows: DataFrame, scale: DataFrame, seq: str = "seq") -> DataFrame:
    """Adds prob to the scores: the softmax of the distances, exp(-(d - min) / 2s) over its sum; uniform where the scale or the sum vanishes. scale has sigma_sq, a row a sequence."""
    d = rows.join(scale.select(seq, "sigma_sq"), seq).withColumn("low_", F.array_min(F.transform("scores", lambda x: x["d"])))
    d = d.withColumn("raw_", F.transform("scores", lambda x: F.exp(-F.try_divide(x["d"] - F.col("low_"), 2 * F.col("sigma_sq"))))).withColumn("sum_", total(F.col("raw_")))
    prob = lambda i: F.when(F.col("sigma_sq") <= 1e-30, 1.0 / F.size("scores")).otherwise(F.try_divide(F.get("raw_", i), F.col("sum_")))
    return d.withColumn("scores", F.transform("scores", lambda x, i: F.struct(x["id"].alias("id"), x["d"].alias("d"), prob(i).alias("prob")))).drop("low_", "raw_", "sum_")


def each(rows: DataFrame, query: str) -> DataFrame:
    """The scores as a row each: query, then the scores' fields.

    Sliced whole, since for a bare column Spark would infer a filter on its size, and evaluate what it is made of once more
    for that, below all the projections and within each of their lambdas.
    """
    return rows.select(query, F.inline(F.slice("scores", 1, F.size("scores"))))


def top_k(rows: DataFrame, query: str, k: int, digits: int = 12) -> DataFrame:
    """(query, id, prob, rank): the k best classes of each query by probability, then id, chosen within its row."""
    order = F.array_sort(F.transform("scores", lambda x: F.struct((-F.round(x["prob"], digits)).alias("s"), x["id"].alias("id"), x["prob"].alias("prob"))))
    best = F.transform(F.slice(order, 1, k), lambda x, i: F.struct(x["id"].alias("id"), x["prob"].alias("prob"), (i + 1).alias("rank")))
    return rows.select(query, F.inline(best))


def ranked(rows: DataFrame, query: str, digits: int = 9) -> DataFrame:
    """(query, id, d, rank): all classes of each query; equal distances share a rank, one more than the number of closer ones."""
    near = lambda x: F.round(x["d"], digits)
    rank = lambda x: 1 + F.size(F.filter("scores", lambda y: near(y) < near(x)))
    return rows.select(query, F.inline(F.transform("scores", lambda x: F.struct(x["id"].alias("id"), x["d"].alias("d"), rank(x).alias("rank")))))


def observation_stats(rows: DataFrame, query: str) -> DataFrame:
    """Least distance, least distance above it, entropy and greatest probability of each query."""
    d, p = F.transform("scores", lambda x: x["d"]), F.transform("scores", lambda x: x["prob"])
    low = F.array_min(d)
    above = F.array_min(F.filter(d, lambda x: x > low))
    return rows.select(query, low.alias("min_d"), above.alias("second_d"), (-total(F.transform(p, lambda x: F.when(x > 1e-30, x * F.log(x)).otherwise(0.0)))).alias("entropy"), F.array_max(p).alias("best_prob"))


def fuse(parts: list[tuple[DataFrame, float]], query: str, floor: float = 1e-30) -> DataFrame:
    """(query, scores): weighted geometric mean of posteriors (scores of id, prob) over the union of their ids; a missing one counts as ``floor``."""
    rows = None
    for k, (probs, weight) in enumerate(parts):
        one = probs.select(query, F.map_from_entries(F.transform("scores", lambda x: F.struct(x["id"], x["prob"]))).alias(f"m{k}_"))
        rows = one if rows is None else rows.join(one, query, "full_outer")
    maps = [F.col(f"m{k}_") for k in range(len(parts))]
    ids = F.array_sort(F.array_distinct(F.flatten(F.array_compact(F.array(*[F.map_keys(m) for m in maps])))))
    logs = lambda i: sum((F.lit(w) * F.log(F.greatest(F.coalesce(F.try_element_at(m, i), F.lit(floor)), F.lit(floor))) for m, (_, w) in zip(maps, parts, strict=True)), F.lit(0.0))
    d = rows.withColumn("scores", F.transform(ids, lambda i: F.struct(i.alias("id"), logs(i).alias("lp"))))
    d = d.withColumn("top_", F.array_max(F.transform("scores", lambda x: x["lp"]))).withColumn("sum_", total(F.transform("scores", lambda x: F.exp(x["lp"] - F.col("top_")))))
    return d.select(query, F.transform("scores", lambda x: F.struct(x["id"].alias("id"), (F.exp(x["lp"] - F.col("top_")) / F.col("sum_")).alias("prob"))).alias("scores"))


def projected(queries: DataFrame, matrices: DataFrame, vector: str, seq: str = "seq") -> DataFrame:
    """The queries with their vector times their sequence's matrix (seq, weights: an array of rows, one row a sequence)."""
    return queries.join(matrices.select(seq, "weights"), seq).withColumn(vector, project(F.col("weights"), F.col(vector))).drop("weights")


def with_glyphs(cents: DataFrame, added: DataFrame) -> DataFrame:
    """Centroids (seq, id, vec) with further ones; one that is there already is replaced. The scales are those of sigma_sq and med_nn of the result."""
    return cents.join(added.select("seq", "id").distinct(), ["seq", "id"], "left_anti").unionByName(added.select("seq", "id", "vec"))


def nearest_with_distances(rows: DataFrame, query: str, k: int) -> DataFrame:
    """(query, id, prob, d, rank): the k nearest classes of calibrated queries, nearest first, then by id."""
    order = F.array_sort(F.transform("scores", lambda x: F.struct(x["d"].alias("d"), x["id"].alias("id"), x["prob"].alias("prob"))))
    return rows.select(query, F.inline(F.transform(F.slice(order, 1, k), lambda x, i: F.struct(x["id"].alias("id"), x["prob"].alias("prob"), x["d"].alias("d"), (i + 1).alias("rank")))))


def moments(a: Column) -> Column:
    """Mean m and population variance v of an array."""
    n = F.size(a)
    sums = F.array(F.struct((total(a) / n).alias("m"), (dot(a, a) / n).alias("s")))
    return F.get(F.transform(sums, lambda x: F.struct(x["m"].alias("m"), (x["s"] - x["m"] * x["m"]).alias("v"))), F.lit(0))


def correlation_of(mean_product: Column, a: Column, b: Column) -> Column:
    """Correlation from the mean product of two arrays and their moments, 1 where either is flat, within -1 and 1."""
    den = F.sqrt(F.greatest(a["v"], F.lit(0.0)) * F.greatest(b["v"], F.lit(0.0)))
    return F.when(den < 1e-10, 1.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (mean_product - a["m"] * b["m"]) / den)))


def zncc(a: Column, b: Column) -> Column:
    """Population correlation of two equally long arrays, 1 where either is flat, within -1 and 1; each sum is taken once."""
    sums = F.array(F.struct((dot(a, b) / F.size(a)).alias("p"), moments(a).alias("a"), moments(b).alias("b")))
    return F.get(F.transform(sums, lambda x: correlation_of(x["p"], x["a"], x["b"])), F.lit(0))


def correlations(queries: DataFrame, cents: DataFrame, vector: str, seq: str = "seq") -> DataFrame:
    """As distances with zncc, but the moments are taken once a query and once a class, so that a pair takes one product sum."""
    own = dealt(queries).withColumn("own_", moments(F.col(vector)))
    sums = classes(cents, seq).select(seq, F.transform("classes", lambda c: F.struct(c["id"].alias("id"), c["vec"].alias("vec"), moments(c["vec"]).alias("mom"))).alias("classes"))
    score = lambda c: correlation_of(dot(F.col(vector), c["vec"]) / F.size(vector), F.col("own_"), c["mom"])
    return own.join(sums, seq).withColumn("scores", F.transform("classes", lambda c: F.struct(c["id"].alias("id"), score(c).alias("d")))).drop("classes", "own_")


#: The two stabilising constants of the similarity index over values of 0 to 255.
SSIM_C1, SSIM_C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2


def ssim_global(a: Column, b: Column) -> Column:
    """Structural similarity of two equally long arrays from their five sums, within 0 and 1."""
    n = F.size(a)
    ma, mb = total(a) / n, total(b) / n
    va, vb, cov = dot(a, a) / n - ma * ma, dot(b, b) / n - mb * mb, dot(a, b) / n - ma * mb
    den = (ma * ma + mb * mb + SSIM_C1) * (va + vb + SSIM_C2)
    value = (2 * ma * mb + SSIM_C1) * (2 * cov + SSIM_C2) / den
    return F.when(den < 1e-10, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def weighted_vote(observations: DataFrame, line: str, key: str, geo_weight: float) -> DataFrame:
    """Score of each candidate of a line: sum of (logit + geo_weight * geometry) * area over the line's upper-median area.

    A candidate with an observation without a logit is rejected. The median is taken once a line and joined back.
    """
    median = observations.groupBy(line).agg(upper_median(F.col("area")).alias("median_area"))
    score = (F.col("logit") + geo_weight * (F.coalesce("h_ll", F.lit(0.0)) + F.coalesce("v_ll", F.lit(0.0)))) * F.col("area") / F.col("median_area")
    found = observations.join(median, line).groupBy(line, key).agg(F.sum(score).alias("score"), F.count("*").alias("n"), F.max(F.col("logit").isNull()).alias("rejected"))
    return found.where("NOT rejected").drop("rejected")
