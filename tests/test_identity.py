"""Names, keys and encodings against plain Python that follows their rules step by step."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from scanlake.functions import identity as I


def values(spark, items, make, kind="string"):
    d = spark.createDataFrame(list(enumerate(items)), f"n int, x {kind}")
    return [r["y"] for r in d.select("n", make(F.col("x")).alias("y")).orderBy("n").collect()]


def plain_strip(name):
    while True:
        low = name.lower()
        for w in I.WEIGHT_WORDS:
            if low.endswith(("-" + w.lower(), "_" + w.lower())):
                name = name[: -len(w) - 1]
                break
            if low.endswith(w.lower()) and len(name) > len(w):
                name = name[: -len(w)]
                break
        else:
            for w in I.WEIGHT_NUMBERS:
                if low.endswith(("-" + w, "_" + w)):
                    name = name[: -len(w) - 1]
                    break
            else:
                return name


def plain_explicit(name, weight):
    if not name:
        return name
    if name == "Arial-Black":
        return f"ArialBlack-{weight}"
    low = name.lower()
    italic = "italic" in low or "oblique" in low or name.endswith("It") or low.endswith("-it")
    base = name
    while True:
        low = base.lower()
        found = next((x for x in ("-italic-italic", "_italic_italic", "-italic", "_italic", "italic", "-oblique", "_oblique", "oblique") if low.endswith(x)), None)
        if found:
            base = base[: -len(found)]
        elif base.endswith("It") and len(base) > 2:
            base = base[:-2]
        elif low.endswith("-it"):
            base = base[:-3]
        else:
            break
    core = plain_strip(base.rstrip("-_")).rstrip("-_")
    own = f"{weight}Italic" if italic else str(weight)
    return f"{core}-{own}" if core else own


NAMES = ["", "Arial-Black", "It", "XIt", "-it", "Italic", "Bold", "-Bold", "Git", "Foo4Italic-Italic"] + [
    a + b + c + d for a, b, c, d in itertools.product(("Foo", "Foo4", "A-B"), ("", "-Bold", "Bold", "_ExtraLight", "-SemiBold", "UltraBlack", "-400", "_Light-700", "Roman"), ("", "-", "_"), ("", "It", "Italic", "-it", "-It", "Oblique", "-Italic-Italic", "Italic-It", "-OBLIQUE"))
]


def test_weights(spark):
    assert values(spark, NAMES, I.strip_weight) == [plain_strip(x) for x in NAMES]
    assert values(spark, NAMES, lambda x: I.explicit_weight(x, F.lit(700))) == [plain_explicit(x, 700) for x in NAMES]


def test_keys(spark):
    given = [("A|salt", "salt", None, None, "2.50"), ("A", "wght700|kern|", "w98", [("wght", 700.0), ("opsz", 9.5)], "1.00"), ("A|kern", "nolig|kern", None, [], ""), ("A", "", "w11", None, None)]
    want = ["A|version=2.50|salt", "A|version=1.00|wght700|kern[wght=700,opsz=9.5]|vintage=w98", "A|kern|nolig|kern", "A|vintage=w11"]
    d = spark.createDataFrame([(k, *g) for k, g in enumerate(given)], "n int, name string, tags string, era string, axes array<struct<tag: string, value: double>>, version string")
    assert [r["k"] for r in d.select("n", I.full_key(*map(F.col, ("name", "tags", "era", "axes", "version"))).alias("k")).orderBy("n").collect()] == want


def test_optical_sizes(spark):
    got = values(spark, ["A|opsz12", "A|opsz9.5|opsz7", "A|opszx", "A", "A|opsz", "A|opsz.5"], I.optical_size)
    assert [tuple(x) for x in got] == [("A", 12.0), ("A|opsz9.5", 7.0), ("A|opszx", None), ("A", None), ("A|opsz", None), ("A", 0.5)]
    assert values(spark, [9.5, 12.0], lambda x: I.sized_key(F.lit("A"), x), "double") == ["A|opsz10", "A|opsz12"]
    assert values(spark, ["Source Serif 4 SmText", "A Display Caption", "Display"], I.root_family) == ["Source Serif 4", "A Display", "Display"]


def test_encodings(spark):
    texts = ["he", "A", "€é", "\U0001f600x", ""]
    assert values(spark, texts, I.sequence_key) == ["_".join(f"{ord(c):04X}" for c in t) for t in texts]
    assert [bytes(x) for x in values(spark, ["aé€’Ā\u0085", ""], I.windows_bytes)] == [b"a\xe9\x80\x92??", b""]
    for most in range(7):
        assert values(spark, ["aé€b", "abc"], lambda x, most=most: I.cut_bytes(x, most)) == [t.encode()[:most].decode(errors="ignore") for t in ("aé€b", "abc")]
    assert values(spark, ["a.", "a", "x;", ".a", ""], I.ends_narrow) == [True, False, True, False, False]
    assert values(spark, list("aZ0~`{ ") + ["ﬁ", "é", "ab"], I.is_indexed) == [c in I.INDEXED and len(c) == 1 for c in [*"aZ0~`{ ", "ﬁ", "é", "ab"]]
    assert values(spark, [0.5, 0.0, None], I.log_probability, "double") == [f"{math.log(0.5):.2f}", "", ""]


def test_manifests(spark):
    headers = ["seqs=106 th=240", "th=240 seqs=106", "v2 seqs=106", "fonts=9 seqs=106 th=240", "fonts=9 seqs=105 th=240", "seqs=106", " th=240 fonts=1\tseqs=106 "]
    assert values(spark, headers, lambda x: I.manifest_sequences(x, 240, 106)) == [None, 106, None, 106, None, None, 106]


def test_matrices_and_gradients(spark):
    a, b = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [0.5, 0.0, 0.0, 2.0, 1.0, -1.0]
    got = spark.range(1).select(F.array(*I.concatenated([F.lit(x) for x in a], [F.lit(x) for x in b])).alias("m"), I.norm_gradient(F.array(F.lit(3.0), F.lit(4.0)), F.lit(5.0), F.array(F.lit(1.0), F.lit(0.0))).alias("g")).first()
    assert got["m"] == [0.5, 4.0, 1.5, 8.0, 3.5, 11.0] and got["g"] == pytest.approx([0.128, -0.096])


def test_runs_and_paths(spark):
    d = spark.createDataFrame([(0, True, None, None, None), (1, False, None, "o", None), (2, False, "i", None, None), (3, False, "i", None, "t"), (4, False, "i", "o", None)], "n int, u boolean, i string, o string, t string")
    assert [r["e"] for r in d.select("n", I.run_error(F.col("u"), F.col("i"), F.col("o"), F.col("t")).alias("e")).orderBy("n").collect()] == [None, "Input file required", "Output path required (use -o / --output)", None, None]
    p = spark.createDataFrame([(0, "/a/", None), (1, None, "/x/y.tar.pdf"), (2, None, "plain")], "n int, f string, o string")
    assert [r["p"] for r in p.select("n", I.audit_path(F.col("f"), F.col("o")).alias("p")).orderBy("n").collect()] == ["/a/audit.json", "/x/y.tar.audit.json", "plain.audit.json"]
