"""Problems 3, 5 and 6."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicketry.llm import grouping, neighbours, variety
from thicketry.llm.vectors import one_per_key, unit, usable

D = 16


def groups(sizes, seed=0, spread=0.05, d=D):
    rng = np.random.default_rng(seed)
    out = []
    for g, n in enumerate(sizes):
        c = unit(rng.normal(size=(1, d)))
        out += [(f"g{g:03d}/{i:04d}", unit(c + spread * rng.normal(size=(1, d)))[0].tolist()) for i in range(n)]
    return out


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "k string, v array<float>")
    return df.withColumns({"key": F.lit(1), "rep": F.lit("x"), "vec": F.lit(2.0), "root": F.lit(3)}) if extra else df


DIRT = [("null", None), ("zero", [0.0] * D), ("short", [1.0] * (D - 1)), ("nan", [float("nan")] * D), ("inf", [float("inf")] + [0.0] * (D - 1)), ("hole", [None] + [1.0] * (D - 1)), (None, [1.0] * D)]


def test_usable(spark):
    df = frame(spark, [*DIRT, ("ok", [2.0] * D)])
    assert [r.k for r in df.where(usable("v", D)).collect()] == [None, "ok"]
    assert one_per_key(df.unionByName(df), "k", "v", D).count() == 1
    assert np.allclose(np.linalg.norm(unit(np.array([[3e38, 3e38], [1e-30, 0]], np.float32)), axis=1), 1)


def brute(rows, k, least=None):
    keys = [r[0] for r in rows]
    order = np.argsort(keys)
    x = unit(np.array([rows[i][1] for i in order], np.float32)).astype(np.float64)
    keys = [keys[i] for i in order]
    s = x @ x.T
    np.fill_diagonal(s, -9)
    out = set()
    for i in range(len(keys)):
        for j in np.lexsort((np.arange(len(keys)), -np.round(s[i], 6)))[:k]:
            if least is None or s[i, j] >= least:
                out.add((keys[i], keys[j]))
    return out


@pytest.mark.parametrize("least", [None, 0.9])
def test_exact_with_factor_one(spark, least):
    rows = groups([1] * 300 + [4] * 40 + [30])
    got = neighbours.nearest_vectors(frame(spark, rows + DIRT[:-1]).repartition(5), "k", "v", D, k=3, min_similarity=least, relax=1.0, shard_rows=64).collect()
    want = brute(rows, 3, least)
    assert len({(r.key, r.other) for r in got} & want) >= 0.999 * len(want) and len(got) == len(want)


def test_recall_when_relaxed(spark):
    rows = groups([1] * 600 + [5] * 100, d=D)
    got = {(r.key, r.other) for r in neighbours.nearest_vectors(frame(spark, rows), "k", "v", D, k=3, min_similarity=0.9, relax=6.0, shard_rows=64).collect()}
    want = brute(rows, 3, 0.9)
    assert len(got & want) >= 0.9 * len(want)


def test_k_come_out_without_a_floor(spark):
    """However relaxed the search and small the shards, every key has k neighbours, most of them right."""
    rows = groups([1] * 400 + [3] * 60)
    got = neighbours.nearest_vectors(frame(spark, rows).repartition(4), "k", "v", D, k=5, shard_rows=8, relax=6.0).collect()
    assert len(got) == 5 * len(rows) and len({(r.key, r["rank"]) for r in got}) == len(got)
    want = brute(rows, 5)
    assert len({(r.key, r.other) for r in got} & want) >= 0.9 * len(want)
    few = neighbours.nearest_vectors(frame(spark, rows[:4]), "k", "v", D, k=5, shard_rows=1).collect()
    assert len(few) == 12


def test_the_sample_of_the_top_tree_is_bounded_by_its_threshold(spark):
    rows = groups([1] * 500)
    some = neighbours.nearest_vectors(frame(spark, rows), "k", "v", D, k=2, shard_rows=32, sample_rows=100, relax=1.0).collect()
    assert {(r.key, r.other) for r in some} == brute(rows, 2)


def test_a_search_in_passes_finds_the_same(spark, monkeypatch):
    """Where vectors go to many shards, the queries run in passes whose shuffle files are given back."""
    turns = []
    monkeypatch.setattr(neighbours, "give_back", turns.append)
    df = frame(spark, groups([4] * 40 + [30]))
    want, got = ({(r.key, r.other, r["rank"]) for r in neighbours.nearest_vectors(df, "k", "v", D, k=3, min_similarity=0.5, relax=1, shard_rows=20, most_copies=m).collect()} for m in (1e9, 1.0))
    assert got == want and len(turns) > 1


def test_copies_ties_and_repeats(spark):
    same = [(f"c{i:03d}", [1.0] + [0.0] * (D - 1)) for i in range(40)]
    rows = same + [("near", [1.0, 0.1] + [0.0] * (D - 2))]
    got = neighbours.nearest_vectors(frame(spark, rows + same), "k", "v", D, k=3, min_similarity=0.9).collect()
    by = {}
    for r in got:
        by.setdefault(r.key, []).append((r.rank, r.other, round(r.similarity, 5)))
    assert [x[1] for x in sorted(by["c000"])] == ["c001", "c002", "c003"] and [x[1] for x in sorted(by["c039"])] == ["c000", "c001", "c002"]
    assert [x[1] for x in sorted(by["near"])] == ["c000", "c001", "c002"] and len(by) == 41
    few = neighbours.nearest_vectors(frame(spark, rows), "k", "v", D, k=2, queries=spark.createDataFrame([("near",)], "q string")).collect()
    assert {r.key for r in few} == {"near"} and len(few) == 2


def test_no_rows(spark):
    df = frame(spark, DIRT[:-1])
    assert neighbours.nearest_vectors(df, "k", "v", D).count() == 0
    assert grouping.similarity_clusters(df, "k", "v", D).count() == 0
    assert variety.varied_subset(df.withColumn("s", F.lit("a")), "k", "s", "v", D, 5).count() == 0


def test_one_row(spark):
    df = frame(spark, [("a", [1.0] * D)])
    assert neighbours.nearest_vectors(df, "k", "v", D).count() == 0
    assert [(r.key, r.root) for r in grouping.similarity_clusters(df, "k", "v", D).collect()] == [("a", "a")]
    assert [r.key for r in variety.varied_subset(df.withColumn("s", F.lit(None).cast("string")), "k", "s", "v", D, 5).collect()] == ["a"]


def test_clusters(spark):
    rows = groups([1] * 60 + [2] * 10 + [3] * 20 + [400])
    want = {}
    for k, _ in rows:
        want.setdefault(k[:4], []).append(k)
    want = {(k, min(v)) for v in want.values() if len(v) >= 3 for k in v}
    for parts, block in ((1, 16_384), (7, 50)):
        c = grouping.similarity_clusters(frame(spark, rows + rows[:30] + DIRT).repartition(parts), "k", "v", D, block_rows=block, cell_rows=32)
        assert {tuple(r) for r in grouping.cluster_members(c).collect()} == want
    d = grouping.describe_clusters(c, D).collect()
    big = max(d, key=lambda r: r["size"])
    assert big["size"] == 400 and big.medoid == big.typical[0] and len(big.typical) == 3 and len(d) == 31


def test_chain_is_cut_into_similar_groups(spark):
    """A chain of records, each like the next only: every member must resemble its pivot."""
    a = np.linspace(0, 3.0, 60)
    rows = [(f"p{i:02d}", [float(np.cos(t)), float(np.sin(t))] + [0.0] * (D - 2)) for i, t in enumerate(a)]
    for parts in (1, 4):
        c = grouping.similarity_clusters(frame(spark, rows).repartition(parts), "k", "v", D, least=0.95, block_rows=10).collect()
        assert len(c) == 60 and min(r.sim for r in c) >= 0.95 - 1e-4
        assert all(r.sim == pytest.approx(1, abs=1e-5) for r in c if r.key == r.root)


def closest_pivot(rows):
    """Whether no member has a pivot closer than its own."""
    x, names = np.array([r.vec for r in rows]), [r.key for r in rows]
    at = [i for i, r in enumerate(rows) if r.key == r.root]
    s = x @ x[at].T
    own = np.array([s[i, at.index(names.index(r.root))] for i, r in enumerate(rows)])
    return (s.max(1) <= own + 1e-5).all()


def test_members_go_to_their_closest_pivot_and_medoids_are_true(spark):
    """Records spread evenly over a low sphere: clusters touch, and many members have several pivots like them."""
    x = unit(np.random.default_rng(9).normal(size=(400, 3)))
    rows = [(f"e{i:03d}", [*map(float, v), *[0.0] * (D - 3)]) for i, v in enumerate(x)]
    c = grouping.similarity_clusters(frame(spark, rows).repartition(3), "k", "v", D, least=0.9, block_rows=60, cell_rows=16)
    got = c.collect()
    assert len(got) == 400 and min(r.sim for r in got) >= 0.9 - 1e-4 and closest_pivot(got)
    members = {}
    for r in got:
        members.setdefault(r.root, []).append(r)
    for d in grouping.describe_clusters(c, D).collect():
        own = next(v for v in members.values() if any(r.key == d.medoid for r in v))
        v = np.array([r.vec for r in own])
        total = (v @ v.T).sum(1)
        assert len(own) == d["size"] and total[[r.key for r in own].index(d.medoid)] >= total.max() - 1e-3


def test_hot_roots_are_joined_with_salt(spark):
    rows = spark.createDataFrame([(f"k{i}", "a" if i < 80 else f"k{i}") for i in range(100)], "key string, root string")
    one = spark.createDataFrame([("a", 1), ("k90", 2)], "root string, v int")
    for most in (0, 1 << 20):
        got = {r.key: r.v for r in grouping._by_root(rows, one, most_bytes=most).collect()}
        assert len(got) == 100 and sum(v == 1 for v in got.values()) == 80 and got["k90"] == 2 and got["k91"] is None


def test_only_hot_roots_are_salted_and_large_sides_are_not_broadcast(spark):
    rows = spark.createDataFrame([(f"k{i}", "a" if i < 80 else f"k{i}") for i in range(100)], "key string, root string")
    one = spark.createDataFrame([("a", 1), ("k90", 2)], "root string, v int")
    got = grouping._by_root(rows, one, most_bytes=0, hot=50)
    assert sorted((r.key, r.v) for r in got.collect() if r.v) == sorted([(f"k{i}", 1) for i in range(80)] + [("k90", 2)]) and got.count() == 100
    # 20 MB of vectors: a driver of 750 MB holds no such table several times over
    wide = spark.range(70_000).select(F.col("id").cast("string").alias("root"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda x: x.cast("float")).alias("pivot"))
    plan = grouping._by_root(rows, wide)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan


def test_pivots_are_apart_however_few_the_rounds(spark):
    """With no or few rounds over anchors, and chains, no two pivots are similar and no member is unlike its pivot."""
    a = np.linspace(0, 3.0, 60)
    chain = [(f"p{i:02d}", [float(np.cos(t)), float(np.sin(t))] + [0.0] * (D - 2)) for i, t in enumerate(a)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")  # a block is at least one batch
    try:
        for rows, least, most in ((groups([3] * 60 + [1] * 40, spread=0.02), 0.835, 0), (chain, 0.95, 1)):
            c = grouping.similarity_clusters(frame(spark, rows), "k", "v", D, least=least, block_rows=10, cell_rows=8, margin=0.0, quiet=1, most=most).collect()
            assert len(c) == len(rows) and min(r.sim for r in c) >= least - 1e-4
            x = np.array([r.vec for r in c if r.key == r.root])
            assert (x @ x.T - 2 * np.eye(len(x))).max() < least + 1e-5
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pivots_against_the_plain_loop():
    x = unit(np.random.default_rng(3).normal(size=(300, 3)))
    own, sim = grouping.pivots_in_order(x, 0.8, chunk=37)
    pivots = []
    for i in range(300):
        if all(x[i] @ x[p] < 0.8 for p in pivots):
            pivots.append(i)
    assert sorted(set(own.tolist())) == pivots
    assert all(sim[i] >= 0.8 - 1e-6 for i in range(300))


def varied(df, budget, **k):
    got = variety.varied_subset(df, "k", "s", "v", D, budget, **k).orderBy("selection_order").collect()
    assert [r.selection_order for r in got] == list(range(len(got))) and len({r.key for r in got}) == len(got)
    return got


def test_variety(spark):
    rows = [(k, v, "A" if k < "g060" else "B") for k, v in groups([1] * 40 + [300] * 5 + [2] * 20 + [150] * 3)]
    df = spark.createDataFrame(rows, "k string, v array<float>, s string").withColumn("key", F.lit(0))
    got = varied(df, 50)
    assert len(got) == 50 and {r.stratum for r in got} == {"A", "B"}
    per = {}
    for r in got:
        per[r.key[:4]] = per.get(r.key[:4], 0) + 1
    assert max(per.values()) <= 2 and len(per) >= 45
    big = {r.key[:4] for r in got[:8]}
    assert len(big) == 8 and sum(g in {"g040", "g041", "g042", "g043", "g044", "g065", "g066", "g067"} for g in big) >= 5
    assert len(varied(df.limit(3), 10)) == 3


def test_variety_has_the_size_asked_whatever_it_is(spark):
    rows = [(k, v, "A" if k < "g006" else "B") for k, v in groups([1] * 10 + [150])] + [("x", [1.0] * D, None)]
    df = spark.createDataFrame(rows, "k string, v array<float>, s string").repartition(3)
    for budget in (1, 2, 60, 160, 161, 1000):
        got = varied(df, budget)
        assert len(got) == min(budget, 161)
        if budget >= 60:
            assert len({r.key[:4] for r in got[:12]}) == 12 and {r.stratum for r in got} == {"A", "B", ""}


def test_variety_is_the_same_for_every_partitioning(spark):
    rows = [(k, v, k[3]) for k, v in groups([1] * 200 + [40] * 5 + [5] * 20, spread=0.1)]
    df = spark.createDataFrame(rows, "k string, v array<float>, s string")
    for how in ({"bucket_rows": 100, "fan": 2}, {"most_entries": 48, "bucket_rows": 90, "block_bytes": 5_000}):
        one = [(r.key, r.selection_order) for r in varied(df.repartition(1), 130, **how)]
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
        try:
            assert one == [(r.key, r.selection_order) for r in varied(df.orderBy(F.desc("k")).repartition(8), 130, **how)]
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(one) == 130


def test_a_budget_beyond_one_tree_is_divided_over_cells(spark):
    rows = [(k, v, "A") for k, v in groups([1] * 300 + [30] * 10 + [200])]
    got = varied(spark.createDataFrame(rows, "k string, v array<float>, s string"), 200, most_entries=64, bucket_rows=200)
    assert len(got) == 200 and len({r.key[:4] for r in got}) >= 150


def test_feature_tree_keeps_sums():
    x = np.random.default_rng(4).normal(size=(500, 4))
    t = variety.CFTree(4, most=40, branch=8, threshold=0.05)
    t.add(np.ones(500), x, (x * x).sum(1))
    assert len(t.n) <= 40 and t.n.sum() == pytest.approx(500) and np.allclose(t.ls.sum(0), x.sum(0)) and t.ss.sum() == pytest.approx((x * x).sum())


def test_ward_of_apart_groups():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(10, 3)) * 0.01 + c for c in ((0, 0, 0), (5, 0, 0), (0, 5, 0))])
    g, turn = variety.ward(np.ones(30), x, 3)
    assert sorted(turn) == [0, 1, 2]
    assert [len(set(g[i : i + 10])) for i in (0, 10, 20)] == [1, 1, 1] and len(set(g)) == 3
    assert len(set(variety.ward(np.ones(4), np.zeros((4, 2)), 2)[0])) == 2
    n = np.array([1.0, 50, 2, 9])
    g, turn = variety.ward(n, np.array([[0.0, 0], [10, 0], [0, 1], [0, 9]]), 3)
    assert g[0] == g[2] and turn[g[1]] == 0 and sorted(turn) == [0, 1, 2]


def test_quotas():
    assert variety.quotas({"a": 100, "b": 1, "c": 25}, 18) == {"a": 11, "b": 1, "c": 6} or sum(variety.quotas({"a": 100, "b": 1, "c": 25}, 18).values()) == 18
    assert variety.quotas({"a": 2, "b": 2}, 9) == {"a": 2, "b": 2}
