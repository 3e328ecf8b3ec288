"""Operator 6: language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.llm.common import Scratch, carried, sample

#: Buckets of the hashed n-grams (a power of two) and the orders of the n-grams.
BITS, ORDERS = 15, (1, 2, 3)
#: Most labelled documents the model is fitted on, chosen by hash.
MAX_TRAIN = 20_000
#: Most languages, and so the size of what is sent to every task: MAX_LANGS * 2**BITS numbers.
MAX_LANGS = 256
#: Code points counted at a time, and numbers of the table taken at a time.
STEP, CELLS = 1 << 18, 1 << 22
LETTER = re.compile(r"[^\W\d_]")


def codes(text: str) -> np.ndarray:
    """Lower-cased code points, ended by zeros so that no n-gram reaches into another text."""
    return np.frombuffer((text.lower().replace("\0", " ") + "\0\0\0").encode("utf-32-le", "replace"), dtype="<u4")


def grams(c: np.ndarray, n: int) -> np.ndarray:
    """For each order the bucket of the n-gram that starts at each of the first n code points; 2**BITS at the ends of texts."""
    c64, out = c.astype(np.uint64), np.empty((len(ORDERS), n), dtype=np.int32)
    h = np.zeros(n, dtype=np.uint64)
    for order in range(1, max(ORDERS) + 1):
        h = (h ^ c64[order - 1 : order - 1 + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if order in ORDERS:
            out[ORDERS.index(order)] = ((h + np.uint64(order)) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)
    out[:, c[:n] == 0] = 1 << BITS
    return out


def steps(texts: list[str]):
    """(first text, starts of texts in the step, code points with a margin, number of starting points) over all texts, a bounded number of code points at a time."""
    held, size, first = [], 0, 0
    for k, text in enumerate(texts):
        c = codes(text)
        if size and size + len(c) > STEP:
            yield first, held
            held, size, first = [], 0, k
        held.append(c)
        size += len(c)
    if held:
        yield first, held


def counts(texts: list[str]):
    """(text, bucket, n) of the n-grams of each text, a bounded number of code points at a time, as arrays sorted by text and bucket."""
    for first, held in steps(texts):
        c = np.concatenate([*held, np.zeros(max(ORDERS), dtype="<u4")])
        ends = np.cumsum([len(x) for x in held])
        n = int(ends[-1])
        for a in range(0, n, STEP):
            b = min(n, a + STEP)
            which = np.searchsorted(ends, np.arange(a, b), side="right")
            key, times = np.unique(((first + which) << (BITS + 1) | grams(c[a : b + max(ORDERS)], b - a)).ravel(), return_counts=True)
            bucket = key & ((2 << BITS) - 1)
            real = bucket < 1 << BITS
            yield key[real] >> (BITS + 1), bucket[real], times[real]


def totals(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Sparse counts of each text times the table: the rows are taken CELLS numbers at a time, whatever the number of languages."""
    out = np.zeros((len(texts), table.shape[1]))
    step = max(1, CELLS // max(1, table.shape[1]))
    for text, bucket, n in counts(texts):
        for a in range(0, len(text), step):
            own = text[a : a + step]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            out[own[starts]] += np.add.reduceat(table[bucket[a : a + step]] * n[a : a + step, None], starts, axis=0)
    return out


def counted(batches):
    """lang, bucket, n of each batch of (lang, text)."""
    for batch in batches:
        langs, texts = np.array(batch.column("lang").to_pylist(), dtype=object), batch.column("text").to_pylist()
        for lang in sorted(set(langs)):
            n = np.zeros((1 << BITS) + 1, dtype=np.int64)
            for _, held in steps([texts[k] for k in np.flatnonzero(langs == lang)]):
                c = np.concatenate([*held, np.zeros(max(ORDERS), dtype="<u4")])
                for a in range(0, len(c) - max(ORDERS), STEP):
                    b = min(len(c) - max(ORDERS), a + STEP)
                    n += np.bincount(grams(c[a : b + max(ORDERS)], b - a).ravel(), minlength=len(n))
            at = np.flatnonzero(n[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])


def fit(labelled: DataFrame, max_train: int = MAX_TRAIN, smoothing: float = 0.1, max_langs: int = MAX_LANGS) -> tuple[list[str], np.ndarray]:
    """Languages and a table: the log-probability of every bucket in each, and in the last row the log of its prior.

    Learned from at most ``max_train`` rows of doc_id, lang, text, where none is null. The prior is a language's share of
    those rows. What comes to the driver, and later goes to every task, is one number per language and bucket; that there
    are ``max_langs`` languages at most is checked.
    """
    rows = labelled.select("doc_id", "lang", "text").where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    rows = Scratch(labelled.sparkSession).save(sample(rows, max_train), "sample")
    shares = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(max_langs + 1).collect()}
    if len(shares) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    n = rows.select("lang", "text").mapInArrow(counted, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(shares)
    table = np.full(((1 << BITS) + 1, len(langs)), smoothing)
    table[n["bucket"], n["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(dtype=int)] += n["n"]
    if langs:
        table = np.log(table / table[:-1].sum(axis=0))
        table[-1] = np.log([shares[x] / sum(shares.values()) for x in langs])
    return langs, table


def identify(docs: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """lang_pred and score (the posterior) of every row of docs, with its other columns but text.

    A column that is called like one of these two comes back as ``carried`` names it. Null text, or one without a letter: ``und``, 0. The same where no language was learned. Repeated rows are judged
    each; an empty table gives no rows. A text is scored whole, in steps of bounded size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)
    held, given = carried(docs, tuple(x for x in docs.columns if x != "text"), ("lang_pred", "score"))

    def score(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            own = [k for k, x in enumerate(texts) if x and langs and LETTER.search(x)]
            pred, p = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
            if own:
                ll = totals([texts[k] for k in own], shared.value) + shared.value[-1]
                post = np.exp(ll - ll.max(axis=1, keepdims=True))
                post /= post.sum(axis=1, keepdims=True)
                best = post.argmax(axis=1)
                pred[own], p[own] = np.array(langs, dtype=object)[best], post[np.arange(len(own)), best]
            yield pa.RecordBatch.from_arrays([batch.column("carried_"), pa.array(pred, pa.string()), pa.array(p)], ["carried_", "lang_pred", "score"])

    rows = docs.select(held, "text")
    return rows.mapInArrow(score, f"carried_ {dict(rows.dtypes)['carried_']}, lang_pred string, score double").select(*given, "lang_pred", "score")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))
    langs, table = fit(docs.where("NOT held_out AND text IS NOT NULL AND lang IS NOT NULL"))
    return identify(docs.select("doc_id", "held_out", "text"), langs, table)
