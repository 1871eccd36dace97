"""Identities, modes, manifests, protocols, banks and evaluation pairs: what must be refused."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicketry.functions import fingerprints
from thicketry.operators import banks, evaluation, selection
from thicketry.sources import artifacts as A

IDENTITY = {"catalog": "abc", "size": 3}


def table(spark, n=3):
    return spark.createDataFrame([(i, f"k{i}") for i in range(n)], "i int, k string")


def test_artifacts_are_read_only_by_their_identity(spark, tmp_path):
    p = str(tmp_path / "a")
    A.save_artifact(table(spark), p, "scores", 2, IDENTITY)
    assert A.load_artifact(spark, p, "scores", 2, IDENTITY).count() == 3
    with pytest.raises(ValueError, match="catalog.*kind.*size"):
        A.load_artifact(spark, p, "features", 2, {"catalog": "x", "size": 4})
    with pytest.raises(FileExistsError):
        A.save_artifact(table(spark), p, "scores", 2, IDENTITY)
    assert A.mismatches({"a": 1, "b": 2}, {"a": 1, "c": 3}) == ["b: 2 in place of nothing", "c: nothing in place of 3"]


def test_modes(spark, tmp_path):
    p = str(tmp_path / "a")
    get = lambda mode, n=3: A.cached(spark, p, lambda: table(spark, n), "scores", 1, IDENTITY, mode).count()
    with pytest.raises(FileNotFoundError):
        get("reuse")
    assert get("build") == 3 and get("reuse") == 3 and get("verify") == 3
    with pytest.raises(FileExistsError):
        get("build")
    with pytest.raises(ValueError, match="other rows"):
        get("verify", 4)
    assert get("rebuild", 4) == 4 and get("reuse") == 4
    (tmp_path / "a" / "meta" / "_SUCCESS").unlink()
    for mode in ("reuse", "verify", "build"):
        with pytest.raises(RuntimeError, match="in part"):
            get(mode)
    assert get("rebuild", 5) == 5
    with pytest.raises(ValueError, match="mode"):
        get("other")


def test_manifests(tmp_path):
    p = str(tmp_path / "m.json")
    old, new = {"a": 1}, {"a": 1, "b": [2]}
    assert A.save_manifest(old, p) == "written" and A.save_manifest(old, p) == "same"
    with pytest.raises(FileExistsError):
        A.save_manifest(new, p)
    with pytest.raises(ValueError, match="fingerprint"):
        A.save_manifest(new, p, older={"a": 2})
    assert A.save_manifest(new, p, older=old) == "upgraded" and A.save_manifest({"c": 1}, p, rebuild=True) == "rebuilt"
    saved = json.loads((tmp_path / "m.json").read_text())
    A.check_replay(saved, {"c": 1}, "fingerprint", "m")
    for bad, why in ((None, "no mapping"), ({**saved, "d": 1}, "fields"), ({**saved, "c": 2}, "content")):
        with pytest.raises(ValueError, match=why):
            A.check_replay(bad, {"c": 1}, "fingerprint", "m")
    assert A.read_metadata(p, ("c",))["c"] == 1
    with pytest.raises(ValueError, match="x, y"):
        A.read_metadata(p, ("c", "x", "y"))


def test_protocols_and_profiles():
    named = {"one": (41, 202, 404), "two": (40, 200, 400)}
    assert A.protocol([41, 202, 404], named) == {"name": "one", "budgets": (41, 202, 404), "seeds": 41, "formal": True}
    assert A.protocol([1, 2, 3], named, custom=True)["name"] == "custom_0001_0002_0003"
    for bad in ([1, 2, 3], [41, 200, 404], [3, 2, 1], [1, 2], [0, 1, 2], [1, 1, 2]):
        with pytest.raises(ValueError):
            A.protocol(bad, named)
    for bad in ("123", 5, [1.0, 2, 3], [True, 2, 3]):
        with pytest.raises(TypeError):
            A.protocol(bad, named)
    assert A.profile_name(" Full-V2 ", {"full_v2": "v2"}, ["v2"]) == "v2"
    with pytest.raises(ValueError):
        A.profile_name("v9", {}, ["v2"])


def test_banks(spark, tmp_path):
    a = spark.createDataFrame([(0, 1), (1, -1)], "i bigint, child bigint")
    none = a.limit(0)
    assert [tuple(r) for r in banks.appended([a, none, a], "i", ["child"]).collect()] == [(0, 1), (1, -1), (2, 3), (3, -1)]
    rules = {"bad": F.col("child") >= 0}
    assert tuple(banks.violations(a.withColumn("g", F.lit("x")), ["g"], rules).first()) == ("x", 2, 1)
    root = str(tmp_path / "bank")
    assert banks.rebuilt(a, root, "i", 1).endswith("version=1")
    with pytest.raises(FileExistsError):
        banks.rebuilt(a, root, "i", 1)
    with pytest.raises(ValueError, match="repeated"):
        banks.rebuilt(a.unionByName(a), root, "i", 2)
    a.write.parquet(f"{root}.tables/parents")
    assert banks.load_bank(spark, f"{root}.tables", {"parents": "i bigint, child bigint"})["parents"].count() == 2
    with pytest.raises(ValueError, match="parents.child: bigint in place of string; parents.z: missing in place of int; no table children"):
        banks.load_bank(spark, f"{root}.tables", {"parents": "child string, z int", "children": "i bigint"})


def test_pairs_without_mask_or_of_another_shape_fail(spark):
    maps = "name string, h int, w int, {} array<double>"
    pred = spark.createDataFrame([("a", 1, 2, [0.1, 0.9]), ("b", 1, 2, [0.1, 0.9])], maps.format("pred"))
    gt = spark.createDataFrame([("a", 1, 2, [0.0, 1.0]), ("c", 1, 2, [0.0, 1.0])], maps.format("gt"))
    with pytest.raises(Exception, match="no mask for b"):
        evaluation.paired_maps(pred, gt, ["name"]).collect()
    other = gt.where("name = 'a'").unionByName(spark.createDataFrame([("b", 2, 1, [0.0, 1.0])], maps.format("gt")))
    with pytest.raises(Exception, match="another shape for b"):
        evaluation.paired_maps(pred, other, ["name"]).collect()
    assert evaluation.paired_maps(pred.where("name = 'a'"), gt, ["name"]).count() == 1


def test_report_of_constant_and_perfect_maps(spark):
    g = np.zeros(36)
    g[8:20] = 1
    rows = [("right", g.tolist(), g.tolist()), ("flat", [0.37] * 36, g.tolist()), ("none", [0.2] * 36, [0.0] * 36)]
    df = spark.createDataFrame(rows, "d string, pred array<double>, gt array<double>")
    r = {x.d: x for x in evaluation.report(df, "d", shape=(6, 6)).collect()}
    assert r["right"].mae == 0 and r["right"].f_adaptive == pytest.approx(1) and r["right"].e_adaptive == pytest.approx(36 / 35) and r["right"].s_measure == pytest.approx(1, abs=1e-3)
    assert r["flat"].mae == pytest.approx((12 * 0.63 + 24 * 0.37) / 36) and r["none"].f_max == 0 and r["none"].n == 1


def test_chained_fingerprints(spark):
    df = spark.createDataFrame([("b", b"2"), ("a", b"1")], "sample_key string, content binary")
    assert fingerprints.content_chain(df) == fingerprints.content_chain(df.repartition(3)) != fingerprints.content_chain(df.limit(1))
    assert fingerprints.chained_fingerprint(df.limit(0), "sample_key", ["sample_key"]) == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_key_fingerprint_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "k string")
    assert tuple(fingerprints.key_fingerprint(df, "k").first()) == (0, "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")


def test_equal_shards(spark):
    got = selection.equal_shards(spark.createDataFrame([(f"k{i:02d}",) for i in range(11)], "k string"), "k", 3).collect()
    assert len(got) == 9 and {(r.k, r.shard) for r in got} == {(f"k{i:02d}", i % 3) for i in range(9)}
