"""Operator 4: toxicity by a chain of linear classifiers."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.llm.common import Scratch, sample

#: Most labelled rows the chain is fitted on, chosen by hash, and most features of a category, those with the greatest chi-square.
MAX_TRAIN, MAX_FEATURES = 8_000, 384
FOLDS = 4
PREFIXES = (4, 5, 6)
#: A feature must be in this share of a category's rows, in two of them at least, and its chi-square so high (one in a thousand by chance).
LEAST_SHARE, LEAST_CHI2 = 0.002, 10.83
WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None, known: dict[str, int] | None = None) -> tuple[Counter, int]:
    """Counts of a text's words and of their first letters (``=`` marks a whole word), and its number of words."""
    words = WORD.findall((text or "").lower())
    found: Counter = Counter()
    for word, n in Counter(words).items():
        for x in ("=" + word, *(word[:k] for k in PREFIXES if len(word) >= k)):
            if known is None or x in known:
                found[x] += n
    return found, len(words)


@dataclass
class Linear:
    """Ridge-penalised logistic regression on standardised columns."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    w: np.ndarray = field(default_factory=lambda: np.zeros(1))

    @classmethod
    def fitted(cls, x: np.ndarray, y: np.ndarray, ridge: float = 3.0, steps: int = 12) -> Linear:
        mean, scale = (x.mean(axis=0), x.std(axis=0)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        scale = np.where(scale > 1e-9, scale, 1.0)
        own = cls(mean, scale, np.zeros(x.shape[1] + 1))
        if not len(y) or y.min() == y.max():
            own.w[-1] = 20.0 if len(y) and y.max() else -20.0
            return own
        z = np.c_[(x - mean) / scale, np.ones(len(x))]
        penalty = np.r_[np.full(x.shape[1], ridge), 1e-3]
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ own.w, -30, 30)))
            v = np.maximum(p * (1 - p), 1e-4)
            step = np.linalg.solve((z * v[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * own.w)
            own.w += step
            if np.abs(step).max() < 1e-5:
                break
        return own

    def p(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1], -30, 30)))


@dataclass
class Chain:
    categories: list[str]
    known: dict[str, int]
    models: list[Linear]

    def matrix(self, rows: list[tuple[Counter, int]]) -> np.ndarray:
        """log(1 + occurrences in 100 words) of each feature."""
        x = np.zeros((len(rows), len(self.known)))
        for k, (found, n) in enumerate(rows):
            for name, count in found.items():
                x[k, self.known[name]] = np.log1p(100 * count / max(n, 20))
        return x

    def p(self, x: np.ndarray) -> np.ndarray:
        """A column a category; each model sees the probabilities of the categories before it."""
        for model in self.models:
            x = np.c_[x, model.p(x)]
        return x[:, len(self.known) :]


def fit(labelled: DataFrame, categories: list[str], max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES) -> Chain:
    """Fits the chain on at most ``max_train`` rows of doc_id, text and a 0/1 column for each category (null: 0).

    The sample is written once. Its features are counted on the executors, combined before the shuffle; the driver
    gets the chosen ones (``max_features`` a category at most) and their counts in the sample, which both parameters
    bound. Within the training rows an earlier category's probability is out of fold: from a model that hasn't seen
    the row's fold; rows of one doc_id share a fold. Rows without doc_id or text can be sampled like others; a text
    has one row in memory at a time. Without rows, or without positive ones, the chain finds none.
    """
    scratch = Scratch(labelled.sparkSession)
    y = F.array(*[F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in categories])
    rows = labelled.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text", y.alias("y"))
    rows = scratch.save(sample(rows, max_train, "id"), "sample")

    def seen(batches):
        for batch in batches:
            n: dict[str, np.ndarray] = {}
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                one = np.array([1, *y])
                for name in features(text)[0]:
                    n[name] = n[name] + one if name in n else one
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([x.tolist() for x in n.values()], pa.list_(pa.int64()))], ["name", "n"])

    size = rows.agg(F.count("*").alias("n"), *[F.sum(F.col("y")[k]).alias(f"y{k}") for k in range(len(categories))]).first()
    total = float(size["n"])
    sums = rows.select("text", "y").mapInArrow(seen, "name string, n array<bigint>").groupBy("name").agg(F.sum(F.col("n")[0]).alias("n"), *[F.sum(F.col("n")[k + 1]).alias(f"n{k}") for k in range(len(categories))])
    sums = scratch.save(sums.where("n > 1"), "features")
    known: dict[str, int] = {}
    for k in range(len(categories)):
        pos = float(size[f"y{k}"] or 0)
        if 0 < pos < total:
            a, b = F.col(f"n{k}").cast("double"), (F.col("n") - F.col(f"n{k}")).cast("double")
            c, d = pos - a, (total - pos) - b
            chi2 = total * (a * d - b * c) * (a * d - b * c) / ((a + b) * (c + d) * pos * (total - pos))
            often = sums.where((a >= max(2.0, LEAST_SHARE * pos)) & (c + d > 0)).withColumn("chi2", chi2).where(F.col("chi2") >= LEAST_CHI2)
            for row in often.orderBy(F.desc("chi2"), "name").limit(max_features).select("name").collect():
                known.setdefault(row["name"], len(known))
    chain = Chain(categories, known, [])
    data = []
    if total:
        shared = rows.sparkSession.sparkContext.broadcast(known)

        def counted(batches):
            for batch in batches:
                found = [features(x, shared.value) for x in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y").cast(pa.list_(pa.int64())), pa.array([list(f.items()) for f, _ in found], pa.map_(pa.string(), pa.int64())), pa.array([n for _, n in found], pa.int64())], ["id", "y", "found", "n"])

        data = sorted(rows.mapInArrow(counted, "id string, y array<bigint>, found map<string,bigint>, n bigint").collect(), key=lambda r: (r["id"], r["n"], sorted(r["found"].items())))
    x = chain.matrix([(r["found"], r["n"]) for r in data])
    y = np.array([r["y"] for r in data], dtype=float).reshape(len(data), len(categories))
    fit_chain(chain, x, y, [r["id"] for r in data])
    return chain


def fit_chain(chain: Chain, x: np.ndarray, y: np.ndarray, ids: list[str]) -> None:
    """Fits one model a category on the features x, each with the out-of-fold probabilities of those before it as further columns."""
    fold = np.array([zlib.crc32(i.encode()) % FOLDS for i in ids], dtype=int)
    for k in range(y.shape[1]):
        chain.models.append(Linear.fitted(x, y[:, k]))
        out = np.zeros(len(x))
        for f in range(FOLDS):
            out[fold == f] = Linear.fitted(x[fold != f], y[fold != f, k]).p(x[fold == f])
        x = np.c_[x, out]


def judge(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """doc_id, p_<category> of each, and flagged (the last category at the threshold or above) for every row of doc_id, text.

    The first category of the query, "junk" (quality 0), is no toxicity; its probability is an input of the toxic model.
    Texts are read whole, one in memory besides its batch. Null or empty text has no feature and gets what the chain says of that. A chain fitted
    without positive rows finds none. Repeated rows are judged each; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]

    def run(batches):
        for batch in batches:
            own = shared.value
            p = own.p(own.matrix([features(x, own.known) for x in batch.column("text").to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(np.ascontiguousarray(p[:, k])) for k in range(len(names))], pa.array(p[:, -1] >= threshold)], ["doc_id", *names, "flagged"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, " + ", ".join(f"{x} double" for x in names) + ", flagged boolean")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # labels are sampled first, MAX_TRAIN of them, which bounds what is sent to every task
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    labels = labels.select("doc_id", (F.col("quality") == 0).cast("int").alias("junk"), "toxic").where("doc_id IS NOT NULL")
    chosen = sample(labels, MAX_TRAIN)
    chain = fit(docs.join(F.broadcast(chosen), "doc_id"), ["junk", "toxic"])
    return judge(docs, chain).withColumnRenamed("flagged", "toxic")
