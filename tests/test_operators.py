"""Edge cases of the operators on hand-made rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanlake.functions import arrays, scores, text
from scanlake.operators import catalog, evaluate, fit, imagestats, incremental, kernels, layout, sequences, similarity
from scanlake.sources import files, specs, tsv


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_medians(spark):
    v = spark.createDataFrame([(1,), (2,), (3,), (4,)], "v int")
    assert v.agg(arrays.upper_median(F.col("v")).alias("m")).first()["m"] == 3
    assert v.limit(1).agg(arrays.upper_median(F.col("v")).alias("m")).first()["m"] == 1
    assert v.limit(0).agg(arrays.upper_median(F.col("v")).alias("m")).first()["m"] is None


def test_resample_and_project(spark):
    assert one(spark, arrays.resample(F.array(*map(F.lit, (0.0, 10.0, 20.0))), 5)) == [0.0, 5.0, 10.0, 15.0, 20.0]
    assert one(spark, arrays.project(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(0.0), F.lit(3.0))), F.array(F.lit(4.0), F.lit(5.0)))) == [14.0, 15.0]


@pytest.mark.parametrize("sigma", [0.0, 1.0])
def test_softmax(spark, sigma):
    q = spark.createDataFrame([("s", 1, [(i, x) for i, x in enumerate([2.0, 2.0, 5.0])], sigma)], "seq string, q int, scores array<struct<id: int, d: double>>, s double")
    p = similarity.calibrated(q, q.select("seq", F.col("s").alias("sigma_sq")))
    top = similarity.top_k(p, "q", 2).orderBy("rank").collect()
    assert abs(similarity.each(p, "q").agg(F.sum("prob")).first()[0] - 1) < 1e-12 and [r["id"] for r in top] == [0, 1]


def test_more_classes_than_the_bound_fail(spark):
    c = spark.createDataFrame([("s", k, [1.0]) for k in range(4)], "seq string, id int, vec array<double>")
    assert similarity.classes(c, most=4).count() == 1
    with pytest.raises(Exception, match="more than 3 classes"):
        similarity.classes(c, most=3).collect()


def test_medians_of_any_number_of_rows(spark):
    v = spark.createDataFrame([("a", x) for x in (5, 1, 1, 1, 9, 7)] + [("b", 2), ("b", 4), ("c", None)], "k string, v int")
    assert {r["k"]: r["m"] for r in arrays.upper_medians(v, ["k"], "v", "m").collect()} == {"a": 5, "b": 4}


def test_flat_rasters(spark):
    flat, other = F.array(*[F.lit(7.0)] * 4), F.array(*map(F.lit, (1.0, 2.0, 3.0, 4.0)))
    assert one(spark, similarity.zncc(flat, flat)) == 1.0 and one(spark, similarity.zncc(other, other)) == pytest.approx(1.0)
    assert one(spark, similarity.ssim_global(other, other)) == pytest.approx(1.0)


def test_fuse_fills_missing(spark):
    a = spark.createDataFrame([(1, [(0, 1.0)])], "q int, scores array<struct<id: int, prob: double>>")
    b = spark.createDataFrame([(1, [(1, 1.0)])], "q int, scores array<struct<id: int, prob: double>>")
    got = {r["id"]: r["prob"] for r in similarity.each(similarity.fuse([(a, 0.5), (b, 0.5)], "q"), "q").collect()}
    assert got[0] == pytest.approx(0.5) and got[1] == pytest.approx(0.5)


def test_tsv(spark):
    lines = ["level\tpage\tblock\tpar\tline\tword\tleft\ttop\twidth\theight\tconf\ttext", "5\t1\t1\t1\t1\t1\tx\t2\t3\t40\t-1\t a b ", "4\t1\t1\t1\t1\t1\t1\t2\t3\t4\t90\tno", "5\t1\t1", "5\t1\t1\t1\t1\t2\t1\t2\t3\t4\t90\t  "]
    got = tsv.parse_tsv(spark.createDataFrame([(x,) for x in lines], "value string"), 300).collect()
    assert len(got) == 1 and got[0]["x"] == 0 and got[0]["confidence"] == -1.0 and got[0]["text"] == "a b" and got[0]["font_size_pt"] == pytest.approx(9.6)


@pytest.mark.parametrize("bad", ["0", "7-5", "", "a", "1,,2", "3-"])
def test_bad_page_lists(spark, bad):
    with pytest.raises(ValueError):
        specs.pages_of(spark, bad)


def test_lists(spark, tmp_path):
    assert sorted(r["page"] for r in specs.pages_of(spark, "1,3,5-7,6").collect()) == [1, 3, 5, 6, 7]
    assert specs.lines_of(spark, "p1:L2,p1:L2").count() == 1
    with pytest.raises(ValueError):
        specs.lines_of(spark, "1:2")
    (tmp_path / "keys").write_text("a # first\n\nb,c\n")
    assert sorted(r["key"] for r in specs.allowlist(spark, f"@{tmp_path}/keys").collect()) == ["a", "b", "c"]


def test_otsu_edges(spark):
    h = spark.createDataFrame([("flat", 9, 5), ("two", 10, 3), ("two", 200, 3)], "k string, v int, n bigint")
    assert {r["k"]: r["threshold"] for r in imagestats.otsu(h, ["k"]).collect()} == {"flat": 128, "two": 10}


def test_lookup_prefers_area_then_centre_then_first(spark):
    boxes = spark.createDataFrame([(1, 1, 0.0, 10.0, 0.0, 10.0), (2, 1, 100.0, 110.0, 0.0, 10.0), (3, 2, 0.0, 1.0, 0.0, 1.0)], "box int, page int, x0 double, x1 double, y0 double, y1 double")
    spans = spark.createDataFrame([(7, 1, 0.0, 10.0, 0.0, 5.0), (8, 1, 0.0, 10.0, 5.0, 10.0), (9, 1, 50.0, 60.0, 8.0, 9.0)], "span_ord int, page int, x0 double, x1 double, y0 double, y1 double")
    got = {r["box"]: (r["span_ord"], r["how"]) for r in evaluate.lookup_span(boxes, spans, "page", "box").collect()}
    assert got == {1: (7, "overlap"), 2: (9, "row"), 3: (None, None)}


def test_accuracy_without_rows_is_full(spark):
    d = spark.createDataFrame([("no_ground_truth",)], "c string")
    assert evaluate.accuracy(d, "c").first()["pct"] == 100.0
    assert one(spark, evaluate.is_hit(F.lit(None).cast("string"), F.lit("x")))


def test_prune_keeps_emptied_groups_and_registering_twice_changes_nothing(spark):
    items = spark.createDataFrame([("a", "k1", "X"), ("a", "k2", "X"), ("a", "k3", "Y"), ("a", "k3", "Y")], "seq string, key string, content string")
    groups = catalog.content_groups(items, "seq", "key", "content")
    left = {r["glyph_id"]: r["keys"] for r in catalog.prune_keys(groups, items.where("key = 'k3'"), "key").collect()}
    assert left == {0: ["k1", "k2"], 1: []}


def test_incremental_equals_full_rebuild(spark):
    build = lambda df: df.withColumn("out", F.col("v") * 10)
    old = build(spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "k int, v int"))
    new = spark.createDataFrame([(1, 1), (2, 5), (4, 4)], "k int, v int")
    assert sorted(incremental.refreshed(old, new, "k", "v", build).collect()) == sorted(build(new).collect())
    a = incremental.catalog_hash(new, ["k", "v"]).first()["hash"]
    assert a == incremental.catalog_hash(new.repartition(3), ["v", "k"]).first()["hash"] != incremental.catalog_hash(old, ["k", "v"]).first()["hash"]


def test_merge_runs_compare_with_the_head(spark):
    r = spark.createDataFrame([(1, 0, 50, 0, 0), (1, 1, 50, 2, 2), (1, 3, 50, 4, 4)], "p int, x1 bigint, x2 bigint, y1 bigint, y2 bigint")
    got = layout.merge_runs(r, ["p"]).orderBy("x1").collect()
    assert [(x["x1"], x["y2"], x["thickness"]) for x in got] == [(0, 2, 3), (3, 4, 1)]


def test_word_merge(spark):
    rows = [(1, 0, 1, 0, 10, 10, "ab", 50.0), (1, 4, 2, 0, 6, 12, "xy", 90.0), (1, 11, 3, 0, 5, 10, "cd", 30.0), (1, 40, 4, 0, 5, 10, "z", 10.0)]
    d = spark.createDataFrame(rows, "line int, x bigint, word_num bigint, y bigint, width bigint, height bigint, text string, confidence double")
    got = [(r["text"], r["width"], r["confidence"]) for r in layout.merge_overlapping_words(d, ["line"]).orderBy("x").collect()]
    assert got == [("xycd", 16, 60.0), ("z", 5, 10.0)]


def test_alignment(spark):
    mk = lambda s: spark.createDataFrame([(1, i, c, i / 10) for i, c in enumerate(s)], "k int, pos int, ch string, prob double")
    got = {r["pos"]: r["other"] for r in sequences.align(mk("abcx"), mk("azbc-y"), "k").collect()}
    assert got == {0: 0.0, 1: 0.2, 2: 0.3, 3: None}
    assert all(r["prob"] == r["other"] for r in sequences.align(mk("ab"), mk("zz"), "k").collect())


def test_text_functions(spark):
    assert one(spark, text.key_version(F.lit("A|version=1.2"))) == 120 and one(spark, text.key_version(F.lit("A"))) == 0
    w = one(spark, text.key_weight_italic(F.lit("Foo-700Italic|x")))
    assert (w["weight"], w["italic"]) == (700, True) and one(spark, text.key_weight_italic(F.lit("Foo"))) is None
    assert one(spark, text.strip_subset_prefix(F.lit("ABC+Foo+Bar"))) == "Foo+Bar"
    assert one(spark, text.expand_ligatures(text.collapse_ligatures(F.lit("office fluff")))) == "office fluff"
    assert one(spark, text.collapse_ligatures(F.lit("office"), 0)) == "office"
    assert one(spark, text.utf16be_text(F.lit("00410042"))) == "AB" and one(spark, text.hash_hex(F.lit(255))) == "00000000000000ff"
    assert one(spark, scores.center_span_scale(F.lit(0.0), F.lit(0.1), F.lit(0.0), F.lit(9.0))) is None
    assert one(spark, scores.combined_geo_ll(F.lit(None).cast("double"), F.lit(1.0), F.lit(None).cast("double"))) == 1.0


def test_kernels():
    ring = np.full((24, 24), 255, np.uint8)
    ring[4:20, 6:18] = 0
    ring[8:16, 9:15] = 255
    f = kernels.descriptor(ring)
    assert f.shape == (63,) and f[22] == pytest.approx(8 * 6 / (16 * 12)) and f[52] == pytest.approx(0.25) and f[53] == 1.0 and f[54] == 1.0
    assert kernels.descriptor(np.full((5, 5), 255, np.uint8)) is None
    h = kernels.gradient_histogram(ring)
    assert h.shape == (128,) and np.linalg.norm(h) == pytest.approx(1.0, abs=1e-5) and kernels.gradient_histogram(ring[:2]) is None
    word = np.full((10, 30), 255, np.uint8)
    word[2:8, 2:8] = word[2:8, 12:18] = word[2:8, 22:28] = 0
    assert kernels.cuts(word, 3) == [10, 20]
    assert kernels.seam(np.array([[1, 0, 1], [1, 0, 1], [0, 5, 1]])).tolist() == [1, 1, 0]
    assert kernels.windowed_ssim(ring, ring) == pytest.approx(1.0) and kernels.best_shift(ring, np.roll(ring, 1, axis=0))[1] == -1
    assert (kernels.rotated(ring, 0) == ring).all()


def test_models(spark):
    rng = np.random.default_rng(0)
    rows = [("s", k, [float(x) for x in rng.normal(3 * k, 1, 4)]) for k in range(3) for _ in range(30)]
    d = spark.createDataFrame(rows, "seq string, id int, v array<double>")
    assert fit.lda(d, "seq", "id", "v", 2).count() == 2 and fit.mahalanobis(d, "seq", "id", "v").count() == 4
    assert fit.mlp(d, "seq", "id", "v", epochs=3).count() == 2 and fit.triplet(d, "seq", "id", "v", 2, 2).count() == 2
    weights = fit.normalize_scores(fit.fisher(d, "id", "v"))
    assert weights.agg(F.sum("weight")).first()[0] == pytest.approx(1.0)
    m = {(r["i"], r["j"]): r["s"] for r in fit.scatter_moments(d, "id", "v").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}
    x, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    z = np.concatenate([x[y == k] - x[y == k].mean(axis=0) for k in range(3)])
    assert m[0, 1] == pytest.approx((z.T @ z)[0, 1])


def test_models_from_moments(spark):
    """Discriminants and metrics against the samples themselves; a class in many batches counts once."""
    rng = np.random.default_rng(4)
    rows = [(s, k, [float(x) for x in rng.normal(k, 1 + k % 2, 3)]) for s in ("a", "b") for k in range(4) for _ in range(40)]
    d = spark.createDataFrame(rows, "seq string, id int, v array<float>").repartition(7)
    x, y = np.array([r[2] for r in rows if r[0] == "b"], np.float32).astype(float), np.array([r[1] for r in rows if r[0] == "b"])
    means = np.stack([x[y == k].mean(axis=0) for k in range(4)])
    z = x - means[y]
    got = {r["id"]: r for r in fit.class_moments(d.where("seq = 'b'"), ["id"], "v").collect()}
    assert all(got[k]["n"] == 40 and np.allclose(got[k]["mean"], means[k]) and np.allclose(np.reshape(got[k]["scatter"], (3, 3)), z[y == k].T @ z[y == k]) for k in range(4))
    within = z.T @ z / len(z)
    whiten = np.linalg.inv(np.linalg.cholesky(within + 1e-3 * np.eye(3)))
    m = (means - means.mean(axis=0)) @ whiten.T
    values, vectors = np.linalg.eigh(m.T @ m)
    top = vectors[:, np.argsort(-values)[:2]].T @ whiten
    top *= np.sign(top[np.arange(2), np.abs(top).argmax(axis=1)])[:, None]
    assert np.allclose([r["weights"] for r in fit.lda(d, "seq", "id", "v", 2).where("seq = 'b'").orderBy("dim").collect()], top)
    shrunk = 0.1 * within + 0.9 * np.trace(within) / 3 * np.eye(3)
    assert np.allclose([r["inverse"] for r in fit.mahalanobis(d, "seq", "id", "v").where("seq = 'b'").orderBy("row").collect()], np.linalg.inv(shrunk))


def test_training_sets_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(fit, "MOST_SAMPLES", 3)
    d = spark.createDataFrame([("s", k, [1.0 * k]) for k in range(4)], "seq string, id int, v array<double>")
    with pytest.raises(ValueError):
        fit.mlp(d, "seq", "id", "v")


def test_audit_round_trip(spark, tmp_path):
    votes = [("a", 0.5)]
    rows = [(1, 1, "t", 90.0, "k", 0.9, True, "vectorized", (1, 2, 3, 4), [("k", float(i)) for i in range(12)], votes, votes, None, None, None, None)]
    files.write_audit(spark.createDataFrame(rows, files.AUDIT), f"{tmp_path}/a")
    got = files.read_audit(spark, f"{tmp_path}/a").first()
    assert len(got["font_candidates"]) == 10 and got["gt_obs_votes"] == got["obs_votes"] and got["fast_path"] is False


def test_file_listing(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a b.ttf").write_bytes(b"x")
    (tmp_path / "n.txt").write_text("n")
    f = files.read_files(spark, [str(tmp_path)], "*.ttf")
    assert files.listing(f).count() == 1 and f.select(files.cache_key("path", 300).alias("k")).first()["k"].endswith("-300")


def test_stream_tracker(spark, tmp_path):
    from scanlake.streaming import dominant

    rows = [("d", 1, "x"), ("d", 1, "y"), ("d", 1, "y"), ("d", 2, "x"), ("d", 3, "y"), ("d", 3, "x")]
    spark.createDataFrame(rows, "document string, page bigint, key string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("document string, page bigint, key string").parquet(f"{tmp_path}/in")
    q = dominant.track(stream).writeStream.format("memory").queryName("tracked").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["page"]: r["dominant"] for r in spark.sql("SELECT * FROM tracked").collect()} == {1: "y", 2: "x", 3: "x"}


def test_stream_resumes(spark, tmp_path):
    from scanlake.streaming import dominant

    schema = "path string, v int"
    for n in range(2):
        spark.createDataFrame([(f"p{n}", n)], schema).write.mode("append").parquet(f"{tmp_path}/in")
        q = dominant.resumable(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), lambda df: df.withColumn("w", F.col("v") + 1), f"{tmp_path}/out", f"{tmp_path}/c")
        q.awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out").count() == n + 1


@pytest.mark.parametrize("parts", [1, 8])
def test_partition_count_changes_nothing(spark, parts):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").repartition(parts).withColumn("seq", F.lit("s"))
    assert round(similarity.sigma_sq(similarity.centroids(e, "label", "embedding")).first()["sigma_sq"], 9) == round(similarity.sigma_sq(similarity.centroids(e.coalesce(1), "label", "embedding")).first()["sigma_sq"], 9)


def test_height_split_gives_up_where_the_largest_jump_starts_low(spark):
    d = spark.createDataFrame([(1, h, k) for k, h in enumerate((2, 12, 30))] + [(2, h, k) for k, h in enumerate((12, 30, 31))], "line int, h int, k int")
    got = layout.split_by_height(d, ["line"], "h", "k").orderBy("line", "k").collect()
    assert [r["upper"] for r in got] == [False, False, False, False, True, True]


def test_overlapping_words_keep_the_longer_text(spark):
    d = spark.createDataFrame([(1, 0, 0, 0, 100, 10, "longword", 50.0), (1, 1, 5, 0, 90, 10, "x", 90.0)], "line int, word_num int, x int, y int, width int, height int, text string, confidence double")
    assert [(r["text"], r["confidence"]) for r in layout.merge_overlapping_words(d, ["line"]).collect()] == [("longword", 90.0)]


def test_merged_run_ends_where_the_last_one_ends(spark):
    r = spark.createDataFrame([(1, 0, 50, 0, 30), (1, 0, 50, 5, 10)], "p int, x1 int, x2 int, y1 int, y2 int")
    assert [(x["y2"], x["thickness"]) for x in layout.merge_runs(r, ["p"]).collect()] == [(10, 11)]


def test_preference_points(spark):
    keys = [("A-400|kern", True), ("A-400|nokern|lig", False), ("A-400|nokern", True), ("A-400|kern|onum", True), ("A-400|kern|wght700[x]", True), ("A-400|kern|ss01", True), ("A-400[opsz=10]|kern|nolig", True), ("A-400|vintage", True)]
    d = spark.createDataFrame(list(enumerate(keys)), "n int, k struct<key: string, has_kern: boolean>")
    got = d.select(catalog.preference(F.col("k.key"), F.col("k.has_kern")).alias("p"), "n").orderBy("n").collect()
    assert [r["p"]["score"] for r in got] == [4, 6, 0, -6, -6, -6, 5, 4]


def test_criteria_are_never_relaxed(spark):
    keys = ["A", "A-400", "A-700|kern|lig", "A-400Italic|nokern|nolig"]
    d = spark.createDataFrame([(k, "A b", True, o) for k, o in zip(keys, (None, 10.0, 12.0, None))], "key string, family string, has_kern boolean, opsz double")
    pick = lambda **c: [r["key"] for r in catalog.select_by_criteria(d, "a-B", "key", "has_kern", **c).collect()]
    assert pick(weight=500) == [] and pick(weight=400, italic=False) == ["A-400"] and pick(italic=True) == ["A-400Italic|nokern|nolig"]
    assert pick(kern=True) == ["A-700|kern|lig"] and pick(lig=False) == ["A-400Italic|nokern|nolig"] and pick(opsz=12.0) == ["A-700|kern|lig"]


def test_small_images(spark):
    cells = spark.createDataFrame([(1, x, y, 10 if 3 <= x < 9 and 3 <= y < 9 else 200) for x in range(12) for y in range(12)], "p int, x int, y int, v int")
    assert imagestats.border_mean(cells, ["p"], "x", "y", ["v"]).first()["v"] == 200
    hist = imagestats.histogram(spark.createDataFrame([(1, 40 + k) for k in range(50)], "p int, v int"), ["p"], "v")
    assert tuple(imagestats.contrast_percentiles(hist, ["p"]).first())[1:] == (0, 88)


def test_interesting_rows_fill_up_and_fall_back(spark):
    d = spark.createDataFrame([(1, k, x, 0.0) for k, x in enumerate((3.0, 2.0, 1.0, 0.0, -5.0))] + [(2, k, None, b) for k, b in enumerate((0.9, 0.1, 0.5, 0.2))] + [(3, 0, 0.0, 0.1)], "k int, i int, d double, best double")
    got = evaluate.interesting(d, "k", "i", "d", 3, "best").orderBy("k", "i").collect()
    assert [(r["k"], r["i"]) for r in got] == [(1, 0), (1, 1), (1, 4), (2, 1), (2, 2), (2, 3)]


def test_names_that_entries_share_multiply_nothing(spark):
    names = spark.createDataFrame([("ABC+raw",), ("ps1",), ("key2",), ("none",)], "name string")
    entries = spark.createDataFrame([(0, "ps1", "key1", "raw"), (1, "ps1", "key2", "raw"), (2, "ps0", "key3", "raw")], "ord int, postscript_name string, font_key string, raw_name string")
    got = {r["name"]: r["canonical"] for r in evaluate.canonical_names(names, entries, "name").collect()}
    assert got == {"ABC+raw": "ps1", "ps1": "ps1", "key2": "key2", "none": "none"} and evaluate.canonical_names(names, entries, "name").count() == 4
