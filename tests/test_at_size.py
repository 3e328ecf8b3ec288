"""What large tables showed: work done once, sums that don't depend on order, signs of zeros, bounded batches and ranks over many tasks."""

from __future__ import annotations

from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa

from scanlake import queries
from scanlake.operators import evaluate, kernels, layout, lines
from scanlake.plans import kernels as drawing

SMALL = "/root/testdata/sf0.001"


def test_correlations_are_computed_once(spark):
    plan = queries.queries()["zncc_softmax"](spark, SMALL)._jdf.queryExecution().optimizedPlan()
    text = plan.toString()
    # one product sum a pair, and one each for the variances of queries and classes
    assert text.count("zip_with") == 3
    assert "Repartition" in text


def delivered(spark, rows, schema):
    """The rows in one partition, in this order."""
    return spark.createDataFrame(rows, schema).coalesce(1)


def test_coverage_adds_up_by_order_not_as_rows_come(spark):
    # 0.15 + 0.06 + 0.29 is 0.5; 0.15 + 0.29 + 0.06 is a little less
    assert (0.15 + 0.06) + 0.29 == 0.5 > (0.15 + 0.29) + 0.06
    ends = [(0, "p", 0, 2, 99.0), (9, "p", 5, 6, 99.0)]
    for own, want in (([15.0, 6.0, 29.0], []), ([15.0, 29.0, 6.0], [("p", 2, 4)])):
        boxes = [(i + 1, "p", 2, 5, c) for i, c in enumerate(own)]
        for some in permutations(boxes):
            found = layout.coverage_valleys(delivered(spark, [*ends, *some], "id int, page string, y0 long, y1 long, conf double"), "page", "y0", "y1", "conf", order="id")
            assert [tuple(r) for r in found.collect()] == want


def test_a_line_covered_by_exactly_half_is_not_split_whatever_the_order(spark):
    ends = [(0, 1, 0, 2, 99.0), (9, 1, 5, 2, 99.0)]
    for some in permutations([(1, 1, 2, 3, 15.0), (2, 1, 2, 3, 29.0), (3, 1, 2, 3, 6.0)]):
        words = delivered(spark, [*ends, *some], "ord int, line int, y long, height long, confidence double")
        assert {r["band"] for r in lines.split_merged(words, ["line"], "ord").collect()} == {0}


def test_gradients_keep_the_sign_of_zeros_as_in_sql(spark, tmp_path):
    rows = [(0, [0.6, 0.8, 0.0, 0.0]), (1, [1.0, 1e-8, 0.0, 3e-8]), (2, [-1e-8, 0.0, 1.0, -2.5e-7]), (3, [0.1, 0.2, -0.3, 0.4])]
    spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.queries()["norm_gradients"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {i: str(g) for i, g in con.sql(queries.oracle_sql()["norm_gradients"]).fetchall()}
    assert "-0.0" in "".join(want.values())
    assert {r["vec_id"]: str(r["gradient"]) for r in found.collect()} == want


def test_pages_are_drawn_and_read_a_few_at_a_time():
    vectors = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array([[0.1, 0.2]] * 400, pa.list_(pa.float32()))], ["id", "embedding"])
    page = lambda i, grey: np.full((160, 240), i % 256, np.uint8)
    found = list(drawing.drawn(iter([vectors]), page))
    assert [i for b in found for i in b.column("id").to_pylist()] == list(range(400))
    assert len(found) > 1 and max(b.nbytes for b in found) < 2 * kernels.HELD
    whole = pa.Table.from_batches(found).combine_chunks().to_batches()[0]
    some = list(kernels.slices(whole))
    assert pa.Table.from_batches(some).equals(pa.Table.from_batches([whole]))
    assert len(some) > 1 and max(b.num_rows for b in some) * 160 * 240 < 2 * kernels.HELD
    gaps = pa.RecordBatch.from_arrays([pa.array([None, b"", b"x" * 9, b"y", None], pa.binary())], ["px"])
    assert [b.num_rows for b in kernels.slices(gaps, most=4)] == [2, 3] and not list(kernels.slices(gaps.slice(0, 0)))


def test_words_do_not_draw_their_pages_again(spark):
    plan = queries.queries()["refined_words"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_rows_of_large_files_are_dealt_by_their_size(spark, tmp_path, monkeypatch):
    from scanlake import session

    rows = [(line, k, float((line * 7 + k * 3) % 11 - 5)) for line in range(300) for k in range(8)]
    spark.createDataFrame(rows, "line long, k int, delta double").write.parquet(f"{tmp_path}/rows.parquet")
    made = spark.read.parquet(f"{tmp_path}/rows.parquet")
    small = sorted(map(tuple, evaluate.interesting(made, "line", "k", "delta", 5).collect()))
    assert session.parts(made) == 1 and session.parts(spark.createDataFrame(rows, "line long, k int, delta double")) == 1
    monkeypatch.setattr(session.parts, "__defaults__", (64,))
    large = evaluate.interesting(made, "line", "k", "delta", 5)
    assert session.parts(made) > 4 and "hashpartitioning(line" in large._jdf.queryExecution().executedPlan().toString()
    assert f", {session.parts(made)})" in large._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, large.collect())) == small


def test_places_in_ranges_are_those_of_one_sort(spark):
    like = [None, float("nan"), -0.5, 0.25, 0.25, 0.75, 1.0]
    rows = [(k, [None, "a", "b"][k % 3], k % 11 == 0, like[k * k % 7]) for k in range(600)] + [(k, "a", False, 0.25) for k in range(600, 900)]
    given = spark.createDataFrame(rows, "line long, class string, wrong boolean, similarity double").repartition(7)
    one = evaluate.report_order(given, "class", "similarity", "wrong", 1)
    many = evaluate.report_order(given, "class", "similarity", "wrong", 40)
    assert one.dtypes == many.dtypes
    found = lambda d: sorted(map(repr, d.collect()))
    assert found(many) == found(one)
    sizes = sorted(r["count"] for r in evaluate.buckets(given, ["class", "similarity", "line"], 20).groupBy("bucket_").count().collect())
    assert len(sizes) > 10 and sizes[-1] < 200
    assert evaluate.report_order(given.limit(0), "class", "similarity", "wrong", 5).count() == 0
