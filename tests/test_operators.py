import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from thicketry.operators import clusters, maps, metrics
from thicketry.operators import relations as R
from thicketry.operators import retrieval as T
from thicketry.operators import selection as S


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_quotas_of_known_cases(spark):
    for sizes, budget, want in [({0: 4, 1: 9}, 5, {0: 2, 1: 3}), ({0: 4, 1: 4}, 1, {0: 1, 1: 0}), ({0: 1, 1: 100}, 101, {0: 1, 1: 100}), ({0: 3}, 0, {0: 0})]:
        q = S.largest_remainder(frame(spark, list(sizes.items()), "c int, n bigint"), "c", "n", budget)
        assert {r.c: r.quota for r in q.collect()} == want
        assert S.remainder_quotas(sizes, budget) == want


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(0, 9), st.integers(1, 30), min_size=1, max_size=6), st.integers(0, 60))
def test_quotas_are_exact_and_bounded(sizes, budget):
    q = S.remainder_quotas(sizes, budget)
    assert sum(q.values()) == min(budget, sum(sizes.values())) and all(0 <= q[k] <= sizes[k] for k in sizes)


def test_round_robin(spark):
    rows = [("a", 1, 0.1, False), ("b", 1, 0.2, False), ("c", 2, 0.1, False), ("d", 2, 0.2, False), ("s", 1, 0.0, True), ("t", 2, 0.05, True)]
    for df in (frame(spark, rows, "k string, c int, d double, s boolean"), frame(spark, rows[::-1], "k string, c int, d double, s boolean").repartition(3)):
        got = S.round_robin(df, "k", "c", "d", "s").orderBy("step").collect()
        assert [r.k for r in got] == ["a", "c", "b", "d"]


def test_greedy_trace(spark):
    e = np.eye(3)
    rows = [("r", "boot", e[0].tolist(), 1.0, True, True), ("r", "orthogonal", e[1].tolist(), 0.8, True, False), ("r", "repeat", e[0].tolist(), 0.9, True, False), ("r", "repeat_second", e[0].tolist(), 0.7, True, False), ("r", "bad", e[2].tolist(), 9.0, False, False)]
    df = frame(spark, rows, "run string, k string, v array<double>, val double, ok boolean, seed boolean")
    got = S.greedy_acquisition(df, ["run"], "k", "v", "val", "ok", "seed", 3, "v2").orderBy("step").collect()
    assert [r.k for r in got] == ["orthogonal", "repeat", "repeat_second"]
    assert [r.utility for r in got] == pytest.approx([1.6, 0.9, 0.7])


def test_greedy_negative_cosine_is_novel(spark):
    rows = [("r", "a", [1.0, 0.0], 0.5, True, True), ("r", "b", [-1.0, 0.0], 0.5, True, False)]
    got = S.greedy_acquisition(frame(spark, rows, "run string, k string, v array<double>, val double, ok boolean, seed boolean"), ["run"], "k", "v", "val", "ok", "seed", 1, "v1").first()
    assert got.novelty == 1.0


def test_nested_selection_stages(spark):
    same, other = [1.0, 0.0, 0.0, 0.0, 0.0, 0.0], np.eye(6)
    rows = [(0, f"a{i}", 0, same, 1 - i / 10, False) for i in range(5)] + [(0, f"b{i}", 1, other[i + 1].tolist(), 0.5 - i / 10, False) for i in range(5)]
    df = frame(spark, rows, "run int, k string, c int, v array<double>, s double, seed boolean")
    got = S.nested_selection(df, ["run"], "k", "c", "v", "s", "seed", [3, 6, 9], 0.9).collect()
    by = {b: {r.k for r in got if r.budget == b} for b in (3, 6, 9)}
    assert [len(by[b]) for b in (3, 6, 9)] == [3, 6, 9] and by[3] < by[6] < by[9]
    assert sum(r.stage == "relaxed" for r in got if r.budget == 9) == 3
    off = S.nested_selection(df, ["run"], "k", "c", "v", "s", "seed", [4], -1.0).collect()
    assert {r.stage for r in off} == {"quota"}


def test_stratified_and_bounded(spark):
    df = frame(spark, [(i, i % 3) for i in range(90)], "k int, g int")
    s = S.stratified_sample(df, "k", "g", 0.1, 5)
    assert s.groupBy("g").count().where("count <> 5").isEmpty()
    assert {r.k for r in s.collect()} == {r.k for r in S.stratified_sample(df.repartition(7), "k", "g", 0.1, 5).collect()}
    top = S.bounded_top(df, "g", F.col("k"), "k", 0.5, 4, 10)
    assert top.groupBy("g").count().where("count <> 10").isEmpty()
    few = S.bounded_top(df, "g", F.col("k"), "k", 0.0, 4, 10)
    assert few.count() == 12


def test_lookups(spark):
    left = frame(spark, [("a", "x"), ("b", "y"), ("c", None)], "k string, s string")
    right = frame(spark, [("a", 1), ("y", 2)], "k string, v int")
    got = {r.k: r.v for r in R.coalesced_lookup(left, ["k", "s"], right, "k", "v", "v").collect()}
    assert got == {"a": 1, "b": 2, "c": None}
    with pytest.raises(Exception, match="no match for"):
        R.strict_lookup(left, right, "k").collect()
    assert R.strict_lookup(left.where("k = 'a'"), right, "k").count() == 1
    with pytest.raises(ValueError, match="repeated keys"):
        R.require_unique(left.unionByName(left), "k")
    either = R.semi_by_either(left, "k", "s", frame(spark, [("a",), ("y",), (None,)], "w string"), "w")
    assert sorted(r.k for r in either.collect()) == ["a", "b"]


def test_resolve_names(spark):
    cat = frame(spark, [("A/x",), ("B/x",), ("A/y",)], "sample_key string")
    names = frame(spark, [("A/x",), ("A/y.png",), ("y",), ("x",), ("q",), (None,)], "n string")
    got = {r.name: (r.resolved, r.kind) for r in R.resolve_names(names, "n", cat, "sample_key").collect()}
    assert got == {"A/x": ("A/x", "exact"), "A/y.png": ("A/y", "ending"), "y": ("A/y", "stem"), "x": (None, "ambiguous"), "q": (None, "unknown")}


def test_numbering_and_zip(spark):
    df = frame(spark, [(i * 7 % 101,) for i in range(101)], "k int").repartition(5)
    assert [tuple(r) for r in R.numbered(df, "k").orderBy("k").collect()] == [(i, i) for i in range(101)]
    z = R.cyclic_zip(df, "k", frame(spark, [("a",), ("b",)], "b string"), "b").orderBy("k").collect()
    assert [r.b for r in z[:3]] == ["a", "b", "a"] and len(z) == 101
    assert R.cyclic_zip(df, "k", frame(spark, [], "b string"), "b").count() == 0


def test_nesting_and_difference(spark):
    rows = [(1, 1, "a"), (1, 2, "a"), (1, 2, "b"), (1, 3, "b")]
    got = {(r.run, r.level): (r.n_keys, r.lost) for r in R.nesting_report(frame(spark, rows, "run int, level int, k string"), "run", "level", "k").collect()}
    assert got == {(1, 1): (1, 0), (1, 2): (2, 1), (1, 3): (1, None)}
    d = R.difference(frame(spark, [("a",), ("b",)], "k string"), frame(spark, [("b",), ("c",)], "k string"), "k").first()
    assert tuple(d) == (1, 1, "a", "c")
    empty = R.difference(frame(spark, [], "k string"), frame(spark, [], "k string"), "k").first()
    assert tuple(empty) == (0, 0, "", "")


@pytest.mark.parametrize("blocks", [80, 1 << 20])
def test_top_k_against_brute_force(spark, blocks):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5))
    x[7] = x[3]
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "k int, v array<double>")
    got = {(r.q, r.rank): r.k for r in T.top_k(df.select(F.col("k").alias("q"), "v").where("q < 10"), "q", df.repartition(3), "k", "v", 4, block_bytes=blocks, step=3).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(10):
        s = np.round(u @ u[q], 9)
        s[q] = -9
        want = np.lexsort((np.arange(60), -s))[:4]
        assert [got[q, r + 1] for r in range(4)] == want.tolist()


def test_softmax_votes_and_margin(spark):
    hits = frame(spark, [(1, 10, 0.9, 1, True), (1, 11, 0.5, 2, False), (2, 12, 0.4, 1, False)], "q int, p int, s double, rank int, ok boolean")
    w = {r.p: r.weight for r in T.masked_softmax(hits, "q", "s", 1.0, F.col("ok")).collect()}
    assert w == {10: 1.0, 11: 0.0, 12: 0.0}
    m = {r.q: r.margin for r in T.margins(hits, "q", "s", "rank").collect()}
    assert m[1] == pytest.approx(0.4) and m[2] is None


def test_routing_isolation(spark):
    v = "array<double>"
    q = frame(spark, [(100, [1.0, 0.0]), (101, [1.0, 0.0])], f"q int, v {v}")
    parents = frame(spark, [("i", 1, [1.0, 0.0]), ("j", 2, [1.0, 0.1])], f"image string, p int, v {v}")
    routes = frame(spark, [(100, "i"), (101, "j")], "q int, image string")
    got = {(r.q, r.p) for r in T.routed_top_k(q, "q", routes, "image", parents, "p", "v", 3).collect()}
    assert got == {(100, 1), (101, 2)}


def test_centroids_and_ties(spark):
    rows = [("b", 0, [1.0, 0.0]), ("a", 0, [1.0, 0.0]), ("c", 0, [0.0, 1.0]), ("z", None, [9.0, 9.0])]
    got = clusters.nearest_to_centroid(frame(spark, rows, "k string, c int, v array<double>"), "k", "c", "v").collect()
    assert [r.k for r in got] == ["a"]


def test_prototype(spark):
    rows = [("a", [2.0, 0.0], 1.0), ("a", [0.0, 5.0], 1.0), ("b", [1.0, 0.0], 0.0)]
    got = {r.k: (r.prototype, r.valid) for r in maps.weighted_prototype(frame(spark, rows, "k string, v array<double>, w double"), "k", "v", "w").collect()}
    assert got["a"][0] == pytest.approx([2**-0.5] * 2) and got["a"][1] and got["b"] == ([0, 0], False)


def test_regions_are_exclusive(spark):
    m = np.zeros((6, 6), int)
    m[1:5, 1:5] = 1
    r = np.array(frame(spark, [(m.ravel().tolist(),)], "m array<int>").select(maps.regions("m", 6, 6).alias("r")).first().r).reshape(6, 6)
    assert r[2, 2] == 0 and r[1, 1] == 2 and r[0, 0] == 3 and set(r.ravel()) <= {0, 1, 2, 3}


def test_distance_against_brute_force():
    rng = np.random.default_rng(0)
    g = rng.random((7, 9)) > 0.8
    d, near = maps.distance_to(g)
    pts = np.argwhere(g)
    want = np.sqrt(((np.argwhere(np.ones_like(g))[:, None] - pts[None]) ** 2).sum(-1)).min(1).reshape(g.shape)
    assert np.allclose(d, want) and g.ravel()[near].all()
    assert np.isinf(maps.distance_to(np.zeros((2, 2), bool))[0]).all()


def test_auc(spark):
    rng = np.random.default_rng(1)
    s, y = rng.random(200), rng.random(200) > 0.6
    df = frame(spark, [(i, float(a), bool(b)) for i, (a, b) in enumerate(zip(s, y))], "k int, s double, y boolean").repartition(4)
    got = metrics.binary_auc(df, "s", F.col("y"), "k").first().auc
    assert got == pytest.approx((s[y][:, None] > s[~y][None]).mean())
    assert metrics.binary_auc(df.where("y"), "s", F.col("y"), "k").first().auc == 0.5


def test_map_measures_of_perfect_and_inverted():
    g = np.zeros((8, 8))
    g[2:6, 2:6] = 1
    assert metrics.structure_measure(g, g) == pytest.approx(1, abs=1e-3) and metrics.weighted_f(g, g) == pytest.approx(1, abs=1e-6)
    assert metrics.structure_measure(1 - g, g) < 0.3 and metrics.weighted_f(1 - g, g) < 0.1
    assert metrics.weighted_f(g, np.zeros((8, 8))) == 0


def test_alarm_and_average(spark):
    df = frame(spark, [("s", i, float(v)) for i, v in enumerate([1, 5, 6, 7, 2])], "s string, t int, v double")
    assert [r.alarm for r in metrics.persistent(df, ["s"], "t", F.col("v") > 4).orderBy("t").collect()] == [False, False, False, True, False]
    t = 1.0
    for v in (5, 6, 7, 2):
        t = 0.9 * t + 0.1 * v
    assert metrics.moving_average_fold(df, ["s"], "t", "v", 0.9).first().ema == pytest.approx(t)


def test_cosine_moments(spark):
    x = np.random.default_rng(2).normal(size=(30, 4))
    m = metrics.pairwise_cosine_moments(frame(spark, [(v.tolist(),) for v in x], "v array<double>").repartition(3), "v", 4).first()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = (u @ u.T)[np.triu_indices(30, 1)]
    assert m.mean == pytest.approx(c.mean()) and m.std == pytest.approx(c.std())


def test_kmeans_representatives(spark):
    rng = np.random.default_rng(8)
    rows = [(f"k{g}{i}", (np.eye(3)[g] + 0.05 * rng.normal(size=3)).tolist()) for g in range(3) for i in range(20)] + [("none", None)]
    model, out = clusters.kmeans(frame(spark, rows, "k string, v array<double>"), "k", "v", 3, seed=1)
    by = {r.k: r.cluster for r in out.collect()}
    assert len(model) == 3 and all(by[f"k{g}{i}"] == g for g in range(3) for i in range(20))
    reps = clusters.unique_representatives(out, model, "k", "v").collect()
    assert sorted(r.cluster for r in reps) == [0, 1, 2] and len({r.k for r in reps}) == 3
    same = frame(spark, [("a", [1.0, 0.0]), ("b", [1.0, 0.0])], "k string, v array<double>").withColumn("_x", F.col("v"))
    assert {r.k for r in clusters.unique_representatives(same, [[1.0, 0.0], [1.0, 0.0]], "k", "v").collect()} == {"a", "b"}
    with pytest.raises(ValueError, match="distinct"):
        clusters.kmeans(same.drop("_x"), "k", "v", 2, seed=1)


def test_resize_and_warp(spark):
    a = np.arange(16.0)
    df = frame(spark, [(1, a.tolist(), [0.0] * 16, [0.5] * 16)], "k int, a array<double>, dy array<double>, dx array<double>")
    assert maps.resize_bilinear(df, "k", "a", 4, 4, 4, 4).first().a == a.tolist()
    assert maps.resize_bilinear(df, "k", "a", 4, 4, 2, 2).first().a == [2.5, 4.5, 10.5, 12.5]
    assert maps.warp(df, "k", "a", "dy", "dx", 4, 4).first().a[:4] == [0.5, 1.5, 2.5, 3.0]


def test_numbering_is_a_permutation_at_any_size(spark):
    """A million rows in many ranges, with a payload and repeated orders, adaptive plans on."""
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        df = spark.range(1_000_000, numPartitions=9).select("id", F.expr("pmod(xxhash64(id), 5000)").alias("o"), F.expr("repeat('x', 20)").alias("payload"))
        n = R.numbered(df, "o", "id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("position").alias("d"), F.min("position").alias("a"), F.max("position").alias("b")).first()
        assert tuple(n) == (1_000_000, 1_000_000, 0, 999_999)
        got = R.numbered(df, "o", "id").where("position % 100000 = 7").orderBy("position").select("o", "id").collect()
        want = sorted((r.o, r.id) for r in df.select("o", "id").collect())[7::100000]
        assert [tuple(r) for r in got] == want
        scored = df.select("id", (F.col("o") % 1000).cast("double").alias("s"), (F.pmod(F.hash("id"), F.lit(10)) < 3 + (F.col("o") % 1000) / 500).alias("y"))
        auc = metrics.binary_auc(scored, "s", F.col("y"), "id").first().auc
        t = scored.toPandas().sort_values(["s", "id"])
        rank = np.arange(1, len(t) + 1)[t["y"].to_numpy()]
        p = len(rank)
        assert auc == pytest.approx((rank.sum() - p * (p + 1) / 2) / (p * (len(t) - p)), abs=1e-12)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(5)
    x = [("a", float(v)) for v in rng.normal(size=999).round(2)] + [("b", 1.0), ("c", None)]
    got = {r.g: r for r in metrics.distribution(frame(spark, x, "g string, v double").repartition(5), "v", ["g"], (0.0, 0.3, 0.9, 1.0)).collect()}
    a = np.array([v for g, v in x if g == "a"])
    assert [got["a"][q] for q in ("q0000", "q0300", "q0900", "q1000")] == pytest.approx(np.quantile(a, [0, 0.3, 0.9, 1]).tolist()) and got["b"].q0300 == 1.0 and set(got) == {"a", "b"}
    nulls = metrics.distribution(frame(spark, [(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, v double"), "v", ["g"], (0.5,)).collect()
    assert {(r.g, r.n, r.q0500) for r in nulls} == {(None, 2, 2.0), ("a", 1, 5.0)}
    assert metrics.distribution(frame(spark, [], "g string, v double"), "v", ["g"]).count() == 0
    one = metrics.distribution(frame(spark, x, "g string, v double"), "v", None, (0.5,)).first()
    assert one.n == 1000 and one.q0500 == pytest.approx(np.quantile([*a, 1.0], 0.5))


def test_contrastive_loss_and_its_positive(spark):
    x = np.random.default_rng(6).normal(size=(20, 4))
    bank = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "k int, v array<double>")
    q = bank.where("k < 5").select((F.col("k") + 100).alias("q"), F.col("k").alias("i"), "v")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for block in (64, 1 << 20):
        got = {r.q: r.loss for r in T.contrastive_loss(q, "q", "i", bank.repartition(3), "k", "v", 0.1, block_bytes=block).collect()}
        want = {100 + i: float(np.log(np.exp(u @ u[i] / 0.1).sum()) - 10) for i in range(5)}
        assert got == pytest.approx(want)
    for bad in (bank.where("k <> 3"), bank.unionByName(bank.where("k = 3"))):
        with pytest.raises(Exception, match="not one row"):
            T.positive_rows(q, "q", "i", bad, "k").collect()


def test_center_order():
    assert clusters.center_order([[2.0, 0.0], [1.0, 5.0], [2.0, 0.0], [0.0, 0.0]])[:1] == [3] and sorted(clusters.center_order([[1.0], [1.0]])) == [0, 1]


def test_ranks_and_lags_of_null_groups(spark):
    df = frame(spark, [(None, 2, 10), (None, 1, 11), ("a", 5, 12), ("a", 4, 13)], "g string, t int, v int").repartition(3)
    assert {(r.g, r.t, r["rank"]) for r in S.ranked(df, ["g"], ["t"]).collect()} == {(None, 1, 1), (None, 2, 2), ("a", 4, 1), ("a", 5, 2)}
    assert {(r.g, r.t, r.w) for r in R.lagged(df, ["g"], ["t"], "v", "w").collect()} == {(None, 1, None), (None, 2, 11), ("a", 4, None), ("a", 5, 13)}
