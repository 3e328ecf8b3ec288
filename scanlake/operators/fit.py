"""Model fitting from grouped statistics, and rank metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_metrics(rows: DataFrame, own: str, in_family) -> DataFrame:
    """Mean reciprocal and top-1/5 ranks of scored queries; a rank is one more than the number of strictly closer classes, so ties favour the truth.

    in_family says of a class id whether it belongs to the family of the query's own class, whose nearest member counts.
    """
    d = lambda a: F.transform(a, lambda x: x["d"])
    closer = lambda limit: 1 + F.size(F.filter("scores", lambda x: x["d"] < limit))
    r = rows.withColumn("own_d", F.array_max(d(F.filter("scores", lambda x: x["id"] == F.col(own))))).withColumn("family_d", F.array_min(d(F.filter("scores", lambda x: in_family(x["id"])))))
    r = r.select(closer(F.col("own_d")).alias("strict"), closer(F.col("family_d")).alias("family"))
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return r.agg(F.count("*").alias("n"), F.round(F.avg(1 / F.col("strict")), 6).alias("strict_mrr"), F.round(F.avg(1 / F.col("family")), 6).alias("family_mrr"), share(F.col("strict") == 1).alias("top1"), share(F.col("strict") <= 5).alias("top5"))


def fisher(samples: DataFrame, key: str, vector: str, floor: float = 1e-12) -> DataFrame:
    """(dim, score): between-class over within-class variance of each dimension; a flat within-class one scores the most, or 0 if all is flat."""
    long = samples.select(key, F.posexplode(vector).alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
    per = long.groupBy("dim", key).agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("var"))
    per = per.withColumn("g", F.sum(F.col("n") * F.col("m")).over(Window.partitionBy("dim")) / F.sum("n").over(Window.partitionBy("dim")))
    both = per.groupBy("dim").agg(F.sum(F.col("n") * (F.col("m") - F.col("g")) ** 2).alias("between"), F.sum(F.col("n") * F.col("var")).alias("within"))
    score = F.when(F.col("within") > floor, F.col("between") / F.col("within")).when(F.col("between") > floor, F.lit(1.7976931348623157e308)).otherwise(0.0)
    return both.select("dim", score.alias("score"))


def normalize_scores(scores: DataFrame) -> DataFrame:
    """Fisher scores as weights: capped at the greatest finite one, square-rooted, adding up to 1 (a row per dimension)."""
    w = Window.partitionBy()
    finite = F.max(F.when(F.col("score") < 1e300, F.col("score"))).over(w)
    root = F.sqrt(F.least("score", F.coalesce(finite, F.lit(1.0))))
    return scores.withColumn("root", root).withColumn("weight", F.col("root") / F.sum("root").over(w)).drop("root")


def class_moments(samples: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, n, mean, scatter): of each class its size, mean vector and the sums of products of deviations (all of a matrix, by rows).

    Each Arrow batch adds up its own products, so (d + 1)(d + 2) / 2 numbers leave a batch and class, and a class is never
    gathered; its row holds d + d * d numbers.
    """
    kinds = dict(samples.dtypes)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack(batch.column("x_").to_numpy(zero_copy_only=False)).astype(float)
            x = np.c_[x, np.ones(len(x))]
            names = list(zip(*(batch.column(c).to_pylist() for c in keys), strict=True))
            known: dict = {}
            of = np.array([known.setdefault(n, len(known)) for n in names])
            i, j = np.triu_indices(x.shape[1])
            for k in range(len(known)):
                own = np.flatnonzero(of == k)
                first = pa.array(np.full(len(i), own[0]))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(first) for c in keys], pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array((x[own].T @ x[own])[i, j])], [*keys, "i", "j", "s"])

    rows = samples.select(*keys, F.transform(vector, lambda v: v.cast("double")).alias("x_"))
    sums = rows.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", i int, j int, s double").groupBy(*keys, "i", "j").agg(F.sum("s").alias("s"))
    one = sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("i", "j"), "s"))).alias("m"), F.max("j").alias("d"))
    at = lambda i, j: F.element_at("m", F.struct(F.least(i, j).alias("i"), F.greatest(i, j).alias("j")))
    one = one.withColumn("n", at(F.col("d"), F.col("d"))).withColumn("mean", F.transform(F.sequence(F.lit(0), F.col("d") - 1), lambda i: at(i, F.col("d")) / F.col("n")))
    product = lambda c: at(F.floor(c / F.col("d")).cast("int"), c % F.col("d")) - F.col("n") * F.get("mean", F.floor(c / F.col("d")).cast("int")) * F.get("mean", c % F.col("d"))
    return one.select(*keys, F.col("n").cast("long").alias("n"), "mean", F.transform(F.sequence(F.lit(0), F.col("d") * F.col("d") - 1), product).alias("scatter"))


def scatter_moments(samples: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, i, j, s): sums of products of deviations within each class, by dimension pair (i <= j)."""
    cells = class_moments(samples, [key], vector).select(key, F.size("mean").alias("d"), F.posexplode("scatter").alias("c", "s"))
    return cells.select(key, F.floor(F.col("c") / F.col("d")).cast("int").alias("i"), (F.col("c") % F.col("d")).alias("j"), "s").where("i <= j")


def within(rows: pd.DataFrame) -> np.ndarray:
    """The mean scatter within the classes whose moments the rows are."""
    d = len(rows["mean"].iloc[0])
    return sum(np.asarray(s) for s in rows["scatter"]).reshape(d, d) / rows["n"].sum()


def lda(samples: DataFrame, seq: str, key: str, vector: str, dims: int = 8, ridge: float = 1e-3) -> DataFrame:
    """(seq, dim, weights): discriminant directions of each sequence from whitened class means.

    Fitted on the classes' moments, a row each. Directions are signed so that their largest weight is positive.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key)
        means = np.stack(rows["mean"].to_numpy())
        whiten = np.linalg.inv(np.linalg.cholesky(within(rows) + ridge * np.eye(means.shape[1])))
        m = (means - means.mean(axis=0)) @ whiten.T
        values, vectors = np.linalg.eigh(m.T @ m)
        top = vectors[:, np.argsort(-values)[:dims]].T @ whiten
        top *= np.sign(top[np.arange(len(top)), np.abs(top).argmax(axis=1)])[:, None]
        return pd.DataFrame({"seq": rows[seq].iloc[0], "dim": range(len(top)), "weights": list(top)})

    return class_moments(samples, [seq, key], vector).groupBy(seq).applyInPandas(one, f"seq {dict(samples.dtypes)[seq]}, dim int, weights array<double>")


def mahalanobis(samples: DataFrame, seq: str, key: str, vector: str, shrink: float = 0.9) -> DataFrame:
    """(seq, row, inverse): rows of the inverse of the shrunk within-class scatter, from the classes' moments; a sequence whose scatter can't be inverted is left out."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        s = within(rows)
        s = (1 - shrink) * s + shrink * np.trace(s) / len(s) * np.eye(len(s))
        try:
            inverse = np.linalg.inv(np.linalg.cholesky(s))
        except np.linalg.LinAlgError:
            return pd.DataFrame({"seq": [], "row": [], "inverse": []})
        return pd.DataFrame({"seq": rows[seq].iloc[0], "row": range(len(s)), "inverse": list(inverse.T @ inverse)})

    return class_moments(samples, [seq, key], vector).groupBy(seq).applyInPandas(one, f"seq {dict(samples.dtypes)[seq]}, row int, inverse array<double>")


#: Most samples of a sequence that a network or an embedding is trained on.
MOST_SAMPLES = 1_000_000


def bounded(samples: DataFrame, seq: str) -> DataFrame:
    """The samples, or an error where a sequence has more than MOST_SAMPLES; they are counted before any is gathered."""
    if samples.groupBy(seq).count().where(F.col("count") > MOST_SAMPLES).limit(1).count():
        raise ValueError(f"a sequence has more than {MOST_SAMPLES} samples")
    return samples


def mlp(samples: DataFrame, seq: str, key: str, vector: str, hidden: int = 32, epochs: int = 40, rate: float = 0.01, seed: int = 7) -> DataFrame:
    """(seq, layer, weights, bias, classes): a seeded one-hidden-layer network for each sequence, by Adam over full batches.

    A sequence's samples are trained on together; that they are MOST_SAMPLES at most is checked.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        x, ids = np.stack(rows[vector].to_numpy()).astype(float), np.unique(rows[key].to_numpy())
        y = np.searchsorted(ids, rows[key].to_numpy())
        rng = np.random.default_rng(seed)
        w = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, len(ids))), np.zeros(len(ids))]
        m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
        for t in range(1, epochs + 1):
            h = np.maximum(x @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            back = (p @ w[2].T) * (h > 0)
            for k, g in enumerate((x.T @ back, back.sum(axis=0), h.T @ p, p.sum(axis=0))):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                w[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        name = rows[seq].iloc[0]
        return pd.DataFrame({"seq": [name] * 2, "layer": [0, 1], "weights": [w[0].ravel(), w[2].ravel()], "bias": [w[1], w[3]], "classes": [ids.astype("int64")] * 2})

    return bounded(samples, seq).groupBy(seq).applyInPandas(one, "seq string, layer int, weights array<double>, bias array<double>, classes array<bigint>")


def triplet(samples: DataFrame, seq: str, key: str, vector: str, dims: int = 16, epochs: int = 30, margin: float = 0.2, rate: float = 0.05, seed: int = 7) -> DataFrame:
    """(seq, dim, weights): a seeded linear embedding of each sequence trained on triplets, one drawn for every row and epoch.

    A sequence's samples are trained on together; that they are MOST_SAMPLES at most is checked.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = np.stack(rows[vector].to_numpy()).astype(float), rows[key].to_numpy()
        rng = np.random.default_rng(seed)
        w = rng.normal(0, 1 / np.sqrt(x.shape[1]), (dims, x.shape[1]))
        members = {k: np.flatnonzero(y == k) for k in np.unique(y)}
        others = {k: np.flatnonzero(y != k) for k in members}
        if len(members) > 1:
            for _ in range(epochs):
                pos = np.array([rng.choice(members[k]) for k in y])
                neg = np.array([rng.choice(others[k]) for k in y])
                dp, dn = x - x[pos], x - x[neg]
                ep, en = dp @ w.T, dn @ w.T
                active = ((ep**2).sum(axis=1) - (en**2).sum(axis=1) + margin > 0)[:, None]
                w -= rate * 2 * ((ep * active).T @ dp - (en * active).T @ dn) / len(x)
        return pd.DataFrame({"seq": rows[seq].iloc[0], "dim": range(dims), "weights": list(w)})

    return bounded(samples, seq).groupBy(seq).applyInPandas(one, "seq string, dim int, weights array<double>")
