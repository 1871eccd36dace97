import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicketry.functions import fingerprints, keys, scores
from thicketry.functions import vectors as V
from thicketry.plans import catalogue


def one(spark, *cols, **values):
    df = spark.createDataFrame([tuple(values.values())] or [(0,)], list(values) or ["z"])
    return df.select(*cols).first()


def test_normalize_and_cosine(spark):
    r = one(spark, V.l2_normalize("a").alias("u"), V.cosine("a", "b").alias("c"), V.l2_normalize("z").alias("z"), V.cosine("a", "z").alias("n"), a=[3.0, 4.0], b=[4.0, 3.0], z=[0.0, 0.0])
    assert r.u == pytest.approx([0.6, 0.8]) and r.c == pytest.approx(0.96) and r.z == [0, 0] and r.n is None


def test_non_finite(spark):
    vals = [float("nan"), float("inf"), float("-inf"), 0.25, 3.0]
    r = one(spark, F.transform("a", V.unit_interval).alias("a"), F.transform("a", V.finite_or_zero).alias("b"), a=vals)
    assert r.a == [0, 1, 0, 0.25, 1] and r.b == [0, 0, 0, 0.25, 3]


def test_probabilities(spark):
    r = one(spark, V.normalize_probabilities("a").alias("p"), V.normalize_probabilities("z").alias("z"), V.js_divergence("p", "p").alias("same"), V.js_divergence("p", "q").alias("far"), V.entropy("e").alias("h"), a=[1.0, 3.0], z=[0.0, 0.0], p=[1.0, 0.0], q=[0.0, 1.0], e=[0.5, 0.5])
    assert r.p == [0.25, 0.75] and r.z == [0, 0] and r.same == pytest.approx(0) and r.far == pytest.approx(1, abs=1e-4) and r.h == pytest.approx(1)


def test_softmax_mixture(spark):
    r = one(spark, V.softmax("a", 2.0).alias("s"), a=[1.0, 3.0])
    e = math.exp(-1)
    assert r.s == pytest.approx([e / (1 + e), 1 / (1 + e)])


def test_sobel_of_constant_is_zero_and_step_is_not(spark):
    flat, step = [0.37] * 16, [0.0, 0.0, 1.0, 1.0] * 4
    r = one(spark, V.sobel("a", 4, 4).alias("a"), V.sobel("b", 4, 4).alias("b"), V.sobel("b", 4, 4, 1.0, True).alias("c"), a=flat, b=step)
    assert r.a == [0] * 16
    assert np.array(r.b).reshape(4, 4)[1].tolist() == pytest.approx([0, 0.5, 0.5, 0])
    assert np.array(r.c).reshape(4, 4)[0].tolist() == [0] * 4 and np.array(r.c).reshape(4, 4)[1, 1] == pytest.approx(4)


def test_grids(spark):
    a = [float(i) for i in range(16)]
    r = one(spark, V.dilate("a", 4, 4).alias("d"), V.erode("a", 4, 4).alias("e"), V.box_average("a", 4, 4, 1).alias("b"), V.flip_rows("a", 4, 4).alias("f"), V.resize_area("a", 4, 4, 2, 2).alias("s"), V.resize_nearest("a", 4, 4, 2, 2).alias("n"), a=a)
    m = np.array(a).reshape(4, 4)
    p = np.pad(m, 1)
    assert r.d[0] == 5 and r.e[15] == 10
    assert r.b[5] == pytest.approx(m[:3, :3].sum() / 9) and r.b[0] == pytest.approx(p[:3, :3].sum() / 9)
    assert r.f[:4] == [3, 2, 1, 0] and r.s == [2.5, 4.5, 10.5, 12.5] and r.n == [0, 2, 8, 10]


def test_keys(spark):
    rows = [("D:\\x\\TR\\im\\a.JPG",), ("/r/TR/b.png",), ("./TR/../c.jpeg",), ("a/b.txt",), (None,)]
    df = spark.createDataFrame(rows, "p string").select(keys.ending("p").alias("e"), keys.stem("p").alias("s"), keys.subset_of_path("p").alias("u"), keys.is_image("p").alias("i"), keys.is_safe_path("p").alias("f"))
    got = [tuple(r) for r in df.collect()]
    assert got[0] == ("jpg", "a", "TR", True, False) and got[1] == ("png", "b", "TR", True, False)
    assert got[2][4] is False and got[3][3:] == (False, True) and got[4] == (None, None, None, None, None)


def test_normalized_key(spark):
    df = spark.createDataFrame([(" a\\\\b/./c ",), ("TR/e\u0301",), ("  ",), (None,)], "k string").select(keys.normalize_key("k").alias("k"))
    assert [r.k for r in df.collect()] == ["a/b/c", "TR/\u00e9", None, None]


@pytest.mark.parametrize("variant,expected", [("v1", 0.3 * 0.5 * 0.25), ("v2a", 0.2 * 0.5 * 0.25), ("v2b", 0.0), ("v2", 0.2 * 0.5 * 1.25)])
def test_formula_table(spark, variant, expected):
    mode, kind = scores.VARIANTS[variant]
    b, w = (0.8, 0.5) if variant == "v1" else (0.2, 0.5)
    r = one(spark, scores.utility(scores.value("b", "w", mode), scores.novelty("s"), kind).alias("u"), b=b, w=w, s=0.75)
    assert r.u == pytest.approx(0.3 * 0.5 * 0.25 if variant == "v1" else expected)


def test_confidence_and_margin(spark):
    df = spark.createDataFrame([(None,), (0.0,), (10.0,)], "m double").select(scores.margin_confidence("m").alias("c"))
    assert [r.c for r in df.collect()] == pytest.approx([0.1, 0.5, 1.0])


def test_fingerprints(spark):
    a = spark.createDataFrame([("b",), ("a",), ("a",), (None,)], "k string")
    b = spark.createDataFrame([("a",), ("b",)], "k string").repartition(3)
    assert fingerprints.key_fingerprint(a, "k").collect() == fingerprints.key_fingerprint(b, "k").collect()
    assert fingerprints.ordered_fingerprint(a, "k") == fingerprints.value_fingerprint({"sample_keys": ["a", "b"]})
    with pytest.raises(ValueError):
        fingerprints.canonical_json({"x": float("nan")})
    empty = fingerprints.key_fingerprint(a.limit(0), "k").first()
    assert empty.n_keys == 0


def test_list_fingerprints_hold_every_key(spark, tmp_path):
    lists = {(1, 1): ["a/x", "a\\x", 'a/"q"'], (1, 2): ["a/x", "a\\y", 'a/"q"'], (2, 1): ["\\"], (2, 2): ['\\"', "b"], (3, 1): ["b", "a"]}
    rows = [(*k, x) for k, v in lists.items() for x in [*v, v[0], None]]
    spark.createDataFrame(rows, "run_id bigint, split_level int, sample_key string").write.parquet(f"{tmp_path}/split_rows.parquet")
    got = {(r.run_id, r.split_level): (r.n_keys, r.fingerprint) for r in catalogue.queries()["split_fingerprints"](spark, str(tmp_path)).collect()}
    assert got == {k: (len(v), fingerprints.value_fingerprint({"sample_keys": sorted(v)})) for k, v in lists.items()}
