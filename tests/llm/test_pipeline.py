"""The pipeline's stages in turn, each against what it was given."""

import random

import __spark_entry__
import corpus_pipeline
from pyspark.sql import functions as F
from scanlake.llm import near_sets, packing, simhash
from scanlake.llm.common import Scratch

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    first, scratch = docs, Scratch(spark)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.save(stage(spark, docs, SMALL), name)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS and docs.count() > 0
    assert seen["quality"].count() < first.count() and seen["near_duplicates"].select("doc_id").distinct().count() == seen["near_duplicates"].count() < seen["quality"].count()
    assert seen["personal_data"].count() == seen["near_duplicates"].count()
    assert seen["personal_data"].where(F.col("n_chars") != F.length("text")).count() == 0
    tokens = packing.pieces(seen["mixing"], packing.default_tokenizer()).agg(F.sum("length")).first()[0]
    packed = seen["packing"].toPandas()
    assert packed.length.sum() == tokens and packed.groupby("sequence_id").length.sum().max() <= 2048
    assert packed.sequence_id.nunique() <= -(-tokens // 2048) * 1.02 + 1


def test_whole_run_matches_stages(spark):
    assert "pipeline" in __spark_entry__.queries()
    assert corpus_pipeline.run(spark, SMALL).count() > 0


def test_near_duplicates_go_by_simhash_and_anchors(spark, monkeypatch):
    """Without the pairs that keys of parts find: near copies within three bits go, texts within three bits that aren't alike stay."""
    rng, given, apart = random.Random(4), [], []
    sets = lambda t: set(simhash.shingles(t, 5))
    bits = lambda a, b: (simhash.simhash(list(sets(a))) ^ simhash.simhash(list(sets(b)))).bit_count()
    likeness = lambda a, b: len(sets(a) & sets(b)) / len(sets(a) | sets(b))
    while len(given) < 12:  # each with the last words changed
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        a, b = " ".join(words), " ".join([*words[:-2], "other", f"end{len(given)}"])
        if 0 < bits(a, b) <= simhash.THRESHOLD:
            given += [a, b]
    while len(apart) < 4:
        words = [f"w{rng.randrange(5000)}" for _ in range(11)]
        a, b = " ".join(words), " ".join([*words[:-1], "end", "of", "it"])
        if bits(a, b) <= simhash.THRESHOLD and likeness(a, b) < 0.8:
            apart += [a, b]
    assert all(likeness(a, b) >= 0.8 for a, b in zip(given[::2], given[1::2], strict=True))
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(given + apart)], "doc_id long, text string, lang string, source string, n_chars long")
    whole = near_sets.neighbours
    monkeypatch.setattr(near_sets, "neighbours", lambda tokens: whole(tokens).where("false"))
    kept = {r.doc_id for r in corpus_pipeline.keep_one(spark, docs, SMALL).collect()}
    assert kept == {*range(0, len(given), 2), *range(len(given), len(given + apart))}


def test_simhash_step_has_every_set_within_three_bits(spark):
    rng = random.Random(2)
    prints = [rng.getrandbits(63) for _ in range(30)]
    prints += [x ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for x in prints] + prints[:10]
    sketches = spark.createDataFrame(list(enumerate(prints)), "fp long, simhash long")
    found = {(r.u, r.v) for r in near_sets.by_simhash(sketches, Scratch(spark)).collect()}
    first = [prints.index(x) for x in prints]
    want = {(first[k], k) for k in range(len(prints)) if first[k] != k}
    want |= {(i, j) for j in set(first) for i in set(first) if i < j and (prints[i] ^ prints[j]).bit_count() <= 3}
    assert found == want and len(want) >= 40
