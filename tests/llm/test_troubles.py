"""Every operator on clashing names, very long texts, empty tables and missing parts."""

import random
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scanlake.llm import common, imatch, language, mixing, near_sets, packing, pii, quality, simhash, suffix_dedup, toxicity, url_filter
from test_llm_operators import brute_simhash, measures, plain_signatures, removal

#: Names that operators use for their own columns, within or in their results.
CLASHES = ("fp kept_id kept_row kept_text row_ same_ text_ nth_ root u v n_found found stands new size taken copies draw tie bucket carried_ skey w g b s p llr kept "
           "salt key kind stack rule verdict host path best lang_pred score held_out sig id_ tie_ range_ to_ r_ piece start length ids grp block data flags p_toxic flagged id y n name maybe good").split()  # fmt: skip


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    text = lambda: " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randint(12, 40)))
    rows = [(k, text(), ["en", "de"][k % 2], f"s{k % 3}", 5, int(k % 3 == 0), int(k % 5 == 0)) for k in range(40)]
    rows += [rows[3], (3, rows[4][1], "en", None, 5, 0, 0), (None, None, None, None, None, None, None), (None, "", "en", "s1", 0, 0, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, junk int, toxic int")
    return d.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce("text", F.lit("-"))).alias(c) for c in CLASHES])


def whole(frame, columns):
    """The carried columns still belong to their rows."""
    rows = frame.collect()
    assert all(r[new] == f"{old}:{'-' if r['text'] is None else r['text']}" for r in rows for old, new in columns)
    return rows


def same(columns):
    return [(c, c) for c in columns]


def test_near_duplicates_among_clashing_names(spark, docs):
    for kept in (simhash.keep_one(docs), near_sets.keep_unlike(docs)):
        assert kept.columns == docs.columns and 38 <= len(whole(kept, same(CLASHES))) <= 42
    assert simhash.near_duplicates(docs).columns == ["doc_id", "fp", "component_id"] and simhash.near_duplicates(docs).count() == docs.count()


def test_kept_rows_of_shared_ids(spark):
    d = spark.createDataFrame([(5, "a b c d e f g h"), (5, "q r s t u v w x"), (6, "q r s t u v w x")], "doc_id long, text string")
    assert sorted(r.text for r in simhash.keep_one(d).collect()) == sorted(r.text for r in near_sets.keep_unlike(d).collect()) == ["a b c d e f g h", "q r s t u v w x"]


def test_mixing_and_quality_among_clashing_names(spark, docs):
    own = ("doc_id", "source", "size", "source_size", "target", "taken", "copies")
    mixed = mixing.mix(docs, keep=("text", *CLASHES))
    assert len(whole(mixed, [(c, c + "_given" if c in own else c) for c in CLASHES])) == docs.count()
    ratios = quality.fit(docs.withColumn("quality", F.lit(1)), docs.select("doc_id", F.lit(1).alias("quality")))
    judged = quality.rules(docs, ratios, keep=("text", *CLASHES))
    assert len(whole(judged, [(c, c + "_given" if c in quality.MEASURES else c) for c in CLASHES])) == docs.count()
    assert judged.where("kept").count() == sum(r.kept for r in judged.collect())


def test_pages_among_clashing_names(spark, docs):
    pages = docs.withColumn("page_id", F.col("doc_id")).withColumn("url", F.concat(F.lit("http://a.com/"), F.col("doc_id").cast("string")))
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, action string")
    got = url_filter.judge(pages, rules, keep=("text", *CLASHES))
    own = ("page_id", "host", "path", "rule", "verdict")
    assert len(whole(got, [(c, c + "_given" if c in own else c) for c in CLASHES])) == docs.count()


def test_personal_data_and_languages_among_clashing_names(spark, docs):
    hidden = pii.pseudonymise(docs, "key")
    assert [c for c in hidden.columns if c not in ("n_found",)] == [c + "_given" if c == "n_found" else c for c in docs.columns]
    assert len(whole(hidden, [(c, c + "_given" if c == "n_found" else c) for c in CLASHES])) == docs.count()
    langs, table = language.fit(docs)
    got = language.identify(docs, langs, table)
    assert "lang_pred_given" in got.columns and got.count() == docs.count() and got.where("lang_pred = 'und'").count() == 2


def test_others_among_clashing_names(spark, docs):
    chain = toxicity.fit(docs, ["junk", "toxic"])
    assert toxicity.judge(docs, chain).columns == ["doc_id", "p_junk", "p_toxic", "flagged"] and toxicity.judge(docs, chain).count() == docs.count()
    assert imatch.compare_edited(docs).count() == docs.count() and suffix_dedup.dedup(docs).count() == docs.count()
    assert packing.pack(docs, packing.default_tokenizer()).agg(F.count_if(F.col("piece") == 0)).first()[0] == docs.count()


def test_very_long_texts(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    long = " ".join(rng.choice(words) for _ in range(130_000))
    assert len(long) > 1 << 19
    texts = [long, long[300_000:420_000] + " end", "4111111111111111 " + long[:200_000] + " a@b.example.com"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffix_dedup.dedup(d).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == removal(list(enumerate(texts)))
    prints = {r.doc_id: r.fp % (1 << 64) for r in simhash.fingerprints(d).collect()}
    assert all(prints[i] == brute_simhash(t) for i, t in enumerate(texts) if i < 2)
    judged = quality.rules(d, [0.0] * quality.BUCKETS).collect()
    assert {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in judged} == {(i, *measures(t)) for i, t in enumerate(texts)}
    signed = {r.doc_id: r.sig for r in imatch.fingerprint(d, []).collect()}
    assert all(signed[i] == plain_signatures(t, set()) for i, t in enumerate(texts))
    hidden = pii.pseudonymise(d, "key").orderBy("doc_id").collect()
    assert [r.n_found for r in hidden] == [0, 0, 2] and hidden[0].text == long and hidden[2].text[17:200_000] == texts[2][17:200_000]
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    ids = [len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) + 1 for t in texts]
    placed = packing.pack(d, path).toPandas()
    assert placed.groupby("doc_id").length.sum().tolist() == ids and placed.groupby("sequence_id").length.sum().max() <= 2048
    assert placed.groupby("doc_id").piece.max().tolist() == [-(-n // 2048) - 1 for n in ids]
    langs, table = language.fit(spark.createDataFrame([(k, t, "ab"[k % 2]) for k, t in enumerate(texts)], "doc_id long, text string, lang string"))
    assert language.identify(d, langs, table).count() == 3
    assert toxicity.judge(d, toxicity.fit(d.withColumn("toxic", F.lit(0)), ["toxic"])).where("NOT flagged").count() == 3
    assert sorted(r.doc_id for r in near_sets.keep_unlike(d).collect()) == [0, 1, 2]


def test_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert suffix_dedup.dedup(empty).count() == simhash.near_duplicates(empty).count() == simhash.keep_one(empty).count() == near_sets.keep_unlike(empty).count() == 0
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, empty, str(tmp_path))
        assert done.count() == 0 and (name == "packing" or done.columns == corpus_pipeline.COLUMNS)


def test_stages_on_troubled_rows(spark, tmp_path):
    rng = random.Random(5)
    text = lambda: " ".join(f"w{rng.randrange(400)}" for _ in range(30))
    a, b = text(), text() + " mail x@y.example.com"
    rows = [(1, a, "en", "s", 1), (2, a, "en", None, 1), (2, b, None, "s", 1), (2, b, None, "s", 1), (None, None, None, None, None), (None, "", "en", "s", 0), (4, "short", "en", "s", 5), (None, text(), "de", None, 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit("mine"))
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (4, 1, 0), (None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    run = {name: stage(spark, d, str(tmp_path)).collect() for name, stage in corpus_pipeline.STAGES}
    assert all(r.text and len(r.text.split()) >= 10 for r in run["quality"]) and any(r.text == a for r in run["quality"])
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in run["near_duplicates"]) == sorted([(False, 1, a), (False, 2, b), (True, 0, ""), (False, 4, "short"), (True, 0, rows[-1][1])])
    assert len(run["personal_data"]) == len(rows) and not any("x@y" in (r.text or "") for r in run["personal_data"]) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in run["personal_data"])
    assert sum(r.piece == 0 for r in run["packing"]) == len(rows)
    words = Counter()
    for r in run["mixing"]:
        words[r.source] += len((r.text or "").split())
    assert sum(words.values()) > 0 and set(words) <= {"s", None}


def test_chain_against_its_formulas(spark):
    """Each model is the optimum of the penalised likelihood, later ones see earlier probabilities, out of fold while training."""
    import zlib

    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 3))
    y = np.c_[(x[:, 0] + rng.normal(size=120) > 0), (x[:, 1] + x[:, 0] + rng.normal(size=120) > 0)].astype(float)
    ids = [str(k) for k in range(120)]
    chain = toxicity.Chain(["a", "b"], {"f0": 0, "f1": 1, "f2": 2}, [])
    toxicity.fit_chain(chain, x, y, ids)
    fold = np.array([zlib.crc32(i.encode()) % toxicity.FOLDS for i in ids])
    earlier = np.zeros(120)
    for f in range(toxicity.FOLDS):
        earlier[fold == f] = toxicity.Linear.fitted(x[fold != f], y[fold != f, 0]).p(x[fold == f])
    assert np.allclose(chain.models[1].w, toxicity.Linear.fitted(np.c_[x, earlier], y[:, 1]).w)
    for model, inputs, k in ((chain.models[0], x, 0), (chain.models[1], np.c_[x, earlier], 1)):
        z = np.c_[(inputs - inputs.mean(0)) / inputs.std(0), np.ones(120)]
        p = 1 / (1 + np.exp(-(z @ model.w)))
        slope = z.T @ (y[:, k] - p) - np.r_[np.full(inputs.shape[1], 3.0), 1e-3] * model.w
        assert np.abs(slope).max() < 1e-4
    first = chain.models[0].p(x)
    assert np.allclose(chain.p(x), np.c_[first, chain.models[1].p(np.c_[x, first])])


def test_shared_folder_is_the_configured_one():
    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        master = "spark://there:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_folder(Session())
    Context.master = "local[2]"
    assert common.shared_folder(Session())
    Conf.get = lambda self, name, default=None: "hdfs://x/y/"
    assert common.shared_folder(Session()) == "hdfs://x/y"


def test_scratch_tables_go(spark):
    s = common.Scratch(spark)
    kept = s.save(spark.range(3), "a")
    assert kept.count() == 3
    s.drop("a")
    assert not s.files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{s.root}/a"))


def test_entry_without_a_dependency():
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; from scanlake import queries; assert set(e.queries()) == set(queries.queries()) and set(e.oracle_sql()) == set(queries.oracle_sql())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__import__("os").path.dirname(corpus_pipeline.__file__))
