"""Quotas, orders, nested budgets, bounded top-k, greedy acquisition."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thicketry.functions import scores


def largest_remainder(sizes: DataFrame, cluster: str, size: str, budget: int) -> DataFrame:
    """(cluster, quota): shares by the square root of sizes, none beyond its size, the rest by largest remainders.

    The units beyond the whole shares are ranked over all clusters pass by pass; one row per cluster
    and unit still open, so the work is bounded by the budget and the number of clusters.
    """
    s = sizes.where(F.col(size) > 0).select(F.col(cluster).alias("c"), F.col(size).cast("bigint").alias("n"))
    tot = s.agg(F.sum(F.sqrt("n")).alias("w"), F.sum("n").alias("all"))
    raw = F.lit(float(budget)) * F.sqrt("n") / F.col("w")
    s = s.crossJoin(F.broadcast(tot)).withColumn("raw", raw).withColumn("q0", F.least("n", F.floor("raw")).cast("bigint"))
    todo = s.agg((F.least(F.lit(budget).cast("bigint"), F.max("all")) - F.sum("q0")).alias("todo"))
    s = s.crossJoin(F.broadcast(todo)).withColumn("frac", F.round(F.col("raw") - F.floor("raw"), 12))
    units = s.where("n > q0").select("c", "frac", "todo", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.col("n") - F.col("q0"), F.greatest(F.lit(1).cast("bigint"), F.col("todo"))))).alias("t"))
    given = units.withColumn("r", F.row_number().over(Window.orderBy("t", F.desc("frac"), "c"))).where("r <= todo").groupBy("c").agg(F.count(F.lit(1)).alias("more"))
    out = s.join(given, "c", "left").select(F.col("c").alias(cluster), F.col("n").alias(size), (F.col("q0") + F.coalesce("more", F.lit(0))).alias("quota"))
    return out


def round_robin(df: DataFrame, key: str, cluster: str, dist: str, seed: str) -> DataFrame:
    """Adds ``step``: clusters take turns in the order of their nearest member's key, seeds left out.

    A cluster's place is named by its nearest member of all, seeds included; within a cluster rows
    go by distance, then key. Turns and steps are numbers over ranges: neither a cluster nor the
    whole is ranked in one task.
    """
    from thicketry.operators.relations import join_groups, numbered

    named = df.groupBy(cluster).agg(F.min_by(key, F.struct(dist, key)).alias("_who"))
    rest = ranked(join_groups(df.where(~F.col(seed)), named, [cluster]), [cluster], [dist, key])
    out = numbered(rest, "rank", "_who").withColumn("step", (F.col("position") + 1).cast("int"))
    return out.drop("_who", "rank", seed, "position")


def nested_budgets(order: DataFrame, seeds: DataFrame, key: str, budgets: list[int], n_seeds: int) -> DataFrame:
    """(budget, key): the seeds and as many acquired rows as each budget has left."""
    b = F.explode(F.array(*(F.lit(x) for x in budgets))).alias("budget")
    return order.select(key, "step", b).where(F.col("step") <= F.col("budget") - n_seeds).select("budget", key).unionByName(seeds.select(b, key))


def quota_top(df: DataFrame, key: str, cluster: str, score: str, quotas: DataFrame, most: int) -> DataFrame:
    """The rows of each cluster up to its quota by score, ties by key.

    ``most`` bounds every quota (the budget does); tasks drop what ranks beyond it before the
    shuffle (window group limit), so a hot cluster ships at most ``most`` rows a task.
    """
    w = Window.partitionBy(cluster).orderBy(F.desc(score), key)
    ranked = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return ranked.join(quotas.select(cluster, "quota"), cluster).where("rank <= quota").select(key, cluster, score, "rank")


def md5_order(key: str, seed: str) -> Column:
    """An order that is random, seeded, and the same in any engine."""
    return F.md5(F.concat(F.lit(seed + "|"), F.col(key).cast("string")))


def stratified_sample(df: DataFrame, key: str, stratum: str, fraction: float, least: int, seed: str = "0", digits: int = 3) -> DataFrame:
    """From each stratum ``max(least, ceil(fraction x size))`` rows in md5 order, at most all.

    A stratum is split by the first ``digits`` of the md5: only counts are summed over it, parts
    below the cut come whole, and only the part at the cut is ranked. A hot stratum is no hot task.
    """
    rows = df.withColumn("_o", md5_order(key, seed)).withColumn("_b", F.substring("_o", 1, digits))
    counts = rows.groupBy(stratum, "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(stratum)
    counts = counts.withColumn("_n", F.sum("_c").over(w)).withColumn("_before", F.sum("_c").over(w.orderBy("_b")) - F.col("_c"))
    want = F.least(F.col("_n"), F.greatest(F.lit(least), F.ceil(F.round(F.col("_n") * fraction, 9))))
    parts = counts.withColumn("_left", want - F.col("_before")).where("_left > 0").withColumn("_whole", F.col("_left") >= F.col("_c")).select(stratum, "_b", "_left", "_whole")
    near = rows.join(parts, [stratum, "_b"])
    cut = near.where("not _whole").withColumn("_r", F.row_number().over(Window.partitionBy(stratum, "_b").orderBy("_o", key))).where("_r <= _left").drop("_r")
    return near.where("_whole").unionByName(cut).select(*df.columns)


def seeded_subset(df: DataFrame, key: str, n: int, seed: str = "0") -> DataFrame:
    """``n`` rows in md5 order: a top-k, not a sort of all."""
    return df.orderBy(md5_order(key, seed), key).limit(n)


def bounded_top(df: DataFrame, group: str, score: Column, tie: str, ratio: float, least: int, most: int, up: bool = False) -> DataFrame:
    """Rows of each group up to clip(round(size x ratio), least, most); half to even, or upward with ``up``."""
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    want = F.ceil(F.round(n * ratio, 9)) if up else F.bround(n * ratio)
    w = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return df.withColumn("_w", F.least(F.greatest(want.cast("bigint"), F.lit(least)), F.lit(most), n)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col("_w")).drop("_w")


def threshold_top(df: DataFrame, group: str, score: str, tie: str, threshold: float, ratio: float, least: int, most: int) -> DataFrame:
    """Rows of each group with a score from ``threshold`` up, the best ``most`` of them; where fewer than ``least``, those of ``bounded_top``."""
    by = Window.partitionBy(group)
    n, over = F.count(F.lit(1)).over(by), F.count(F.when(F.col(score) >= threshold, 1)).over(by)
    fall_back = F.least(F.greatest(F.lit(least), F.bround(n * ratio).cast("bigint")), F.lit(most), n)
    want = F.when(over < least, fall_back).otherwise(F.least(over, F.lit(most)))
    w = by.orderBy(F.desc(score), tie)
    return df.withColumn("_w", want).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col("_w")).drop("_w")


def ranked(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds ``rank`` from 1 within each group, from numbers over ranges: a group however large is not ranked in one task."""
    from thicketry.operators.relations import join_groups, numbered

    n = numbered(df, *group, *order)
    first = n.groupBy(*group).agg(F.min("position").alias("_first"))
    return join_groups(n, first, group).withColumn("rank", F.col("position") - F.col("_first") + 1).drop("position", "_first")


def equal_shards(df: DataFrame, key: str, shards: int) -> DataFrame:
    """(key, shard): keys dealt out in order; the last keys that do not fill a round are left out."""
    from thicketry.operators.relations import numbered

    n = df.agg(F.count(F.lit(1)).alias("_n"))  # one row
    rows = numbered(df.select(key), key).crossJoin(F.broadcast(n)).where(F.col("position") < F.col("_n") - F.pmod("_n", F.lit(shards)))
    return rows.select(key, F.pmod("position", F.lit(shards)).cast("int").alias("shard"))


def region_sample(df: DataFrame, group: list[str], score: str, place: str, ratio: float, least: int, most: int) -> DataFrame:
    """From each region min(size, most, max(least, round(size x ratio))) rows by score, ties by place."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    want = F.least(n, F.lit(most), F.greatest(F.lit(least), F.bround(n * ratio).cast("bigint")))
    w = Window.partitionBy(*group).orderBy(F.desc(score), place)
    return df.withColumn("_w", want).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col("_w")).drop("_w")


def _greedy(keys, x, v, valid, seeds, steps, reward):
    """Steps of (row, utility, novelty, max similarity); ties by value, novelty, key. Rows stand in key order."""
    x = np.where(valid[:, None], x, 0.0)
    n = np.sqrt((x * x).sum(1))
    x = x / np.where(n > 0, n, 1)[:, None]
    top = np.zeros(len(keys))
    for s in np.nonzero(seeds)[0]:
        top = np.maximum(top, np.clip(x @ x[s], 0, 1))
    free = valid & ~seeds
    out = []
    for _ in range(min(steps, int(free.sum()))):
        nov = 1 - top
        u = v * (1 + nov) if reward else v * nov
        order = np.lexsort((-np.round(nov, 9), -v, -np.round(u, 9), ~free))
        i = int(order[0])
        out.append((i, u[i], nov[i], top[i]))
        free[i] = False
        top = np.maximum(top, np.clip(x @ x[i], 0, 1))
    return out


def greedy_acquisition(df: DataFrame, run: list[str], key: str, vector: str, value: str, valid: str, seed: str, steps: int, variant: str) -> DataFrame:
    """(run, step, key, utility, value, novelty, max_similarity): the best next record given those before it.

    One run is one sequential task over its (bounded) candidate pool; runs, variants and seeds are
    the parallel dimension. Invalid rows have a zero vector and are never taken; with fewer eligible
    rows than ``steps`` the run is shorter. Ties go by value, novelty, then key.
    """
    reward = scores.VARIANTS[variant][1] == "reward"
    fields = [*(df.schema[c] for c in run), T.StructField("step", T.IntegerType()), T.StructField(key, df.schema[key].dataType), *(T.StructField(c, T.DoubleType()) for c in ("utility", "value", "novelty", "max_similarity"))]

    def pick(pdf):
        import pandas as pd

        pdf = pdf.sort_values(key).reset_index(drop=True)
        x = np.stack(pdf[vector].to_numpy()).astype(np.float64)
        v = pdf[value].to_numpy(np.float64)
        got = _greedy(pdf[key].to_numpy(), x, v, pdf[valid].to_numpy(bool), pdf[seed].to_numpy(bool), steps, reward)
        return pd.DataFrame([(*(pdf[c][0] for c in run), s, pdf[key][i], u, v[i], n, m) for s, (i, u, n, m) in enumerate(got)], columns=[f.name for f in fields])

    return df.select(*run, key, vector, value, valid, seed).groupBy(*run).applyInPandas(pick, T.StructType(fields))


def nested_selection(df: DataFrame, run: list[str], key: str, cluster: str, vector: str, score: str, seed: str, budgets: list[int], threshold: float) -> DataFrame:
    """(run, budget, key, rank, stage): nested budgets by quotas per cluster without look-alikes.

    For each budget: quotas by largest remainder over what clusters have left; clusters in turn by
    score, leaving out a record more similar than ``threshold`` to a chosen one of its cluster; then
    over all clusters with the same rule; then whatever is best. A negative threshold switches the
    rule off. Seeds come first and count. One run is one task; runs are parallel.
    """
    fields = [*(df.schema[c] for c in run), T.StructField("budget", T.IntegerType()), T.StructField(key, df.schema[key].dataType), T.StructField("rank", T.IntegerType()), T.StructField("stage", T.StringType())]

    def pick(pdf):
        import pandas as pd

        pdf = pdf.sort_values(key).reset_index(drop=True)
        x = np.stack(pdf[vector].to_numpy()).astype(np.float64)
        n = np.sqrt((x * x).sum(1))
        x = x / np.where(n > 0, n, 1)[:, None]
        c = pdf[cluster].to_numpy()
        order = np.lexsort((np.arange(len(pdf)), -pdf[score].to_numpy(np.float64)))
        taken: dict[int, str] = {int(i): "seed" for i in np.nonzero(pdf[seed].to_numpy(bool))[0]}
        rows = []

        def alike(i):
            mates = [j for j in taken if c[j] == c[i]]
            return threshold >= 0 and bool(mates) and float((x[mates] @ x[i]).max()) > threshold

        for b in budgets:
            left = {k: int(((c == k) & ~np.isin(np.arange(len(c)), list(taken))).sum()) for k in sorted(set(c.tolist()))}
            quota = remainder_quotas(left, max(0, b - len(taken)))
            for k in sorted(left):
                got = 0
                for i in order:
                    if got >= quota[k] or len(taken) >= b:
                        break
                    if c[i] == k and i not in taken and not alike(i):
                        taken[int(i)] = "quota"
                        got += 1
            for stage, rule in (("backfill", True), ("relaxed", False)):
                for i in order:
                    if len(taken) >= b:
                        break
                    if i not in taken and not (rule and alike(i)):
                        taken[int(i)] = stage
            rows += [(*(pdf[r][0] for r in run), b, pdf[key][i], r + 1, s) for r, (i, s) in enumerate(taken.items())]
        return pd.DataFrame(rows, columns=[f.name for f in fields])

    return df.select(*run, key, cluster, vector, score, seed).groupBy(*run).applyInPandas(pick, T.StructType(fields))


def remainder_quotas(sizes: dict, budget: int) -> dict:
    """The rule of ``largest_remainder`` for a handful of clusters in one task.

    A cluster's t-th unit beyond its whole share ranks by (t, remainder, name); the first ``todo``
    units of that ranking are given.
    """
    total = sum(map(float.__pow__, map(float, sizes.values()), (0.5,) * len(sizes)))
    if not total or budget <= 0:
        return dict.fromkeys(sizes, 0)
    share = {k: budget * n**0.5 / total for k, n in sizes.items()}
    quota = {k: min(n, int(share[k])) for k, n in sizes.items()}
    todo = max(0, min(budget, sum(sizes.values())) - sum(quota.values()))
    units = [(t, -round(share[k] - int(share[k]), 12), k) for k, n in sizes.items() for t in range(1, min(n - quota[k], todo) + 1)]
    for _, _, k in sorted(units)[:todo]:
        quota[k] += 1
    return quota
