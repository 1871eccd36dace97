"""Statistics, ranking measures, measures of predicted maps, alarms over epochs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicketry.functions import vectors as V

EPS = 1e-12


def distribution(df: DataFrame, value: str, group: list[str] | None = None, points: tuple[float, ...] = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)) -> DataFrame:
    """Count, mean, population deviation, extremes, share of zeros, and linearly interpolated quantiles.

    Quantiles are exact: values are numbered over ranges, so a group however large is never in one
    task or buffer, and only the two values beside each quantile are picked by their place. Null
    values are left out; a group with none gives no row; a null is a group.
    """
    from thicketry.operators.relations import join_groups, numbered

    group = group or []
    rows = df.select(*group, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    placed = numbered(rows, *group, "_v")
    v = F.col("_v")
    sums = placed.groupBy(*group).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg((v == 0).cast("double")).alias("zero_share"), F.min("position").alias("_first"),
    )
    at = [F.lit(p) * (F.col("n") - 1) for p in points]
    edges = sums.select(*group, "n", "_first", *(F.floor(x).alias(f"_l{i}") for i, x in enumerate(at)), *(F.ceil(x).alias(f"_h{i}") for i, x in enumerate(at)))
    near = join_groups(placed, edges, group)
    near = near.withColumn("_r", F.col("position") - F.col("_first"))
    near = near.where(F.col("_r").isin(*(F.col(f"_{e}{i}") for e in "lh" for i in range(len(points)))))
    pick = [F.max(F.when(F.col("_r") == F.col(f"_{e}{i}"), v)).alias(f"_{e}{i}") for e in "lh" for i in range(len(points))]
    near = near.groupBy(*group).agg(*pick)
    out = join_groups(sums, near, group)
    lean = lambda i, x: F.col(f"_l{i}") + (x - F.floor(x)) * (F.col(f"_h{i}") - F.col(f"_l{i}"))
    return out.select(*group, "n", "mean", "std", "min", "max", "zero_share", *(lean(i, x).alias(f"q{int(round(p * 1000)):04d}") for i, (p, x) in enumerate(zip(points, at))))


def pairwise_cosine_moments(df: DataFrame, vector: str, size: int) -> DataFrame:
    """(n, mean, std): of the cosines of all pairs of different rows, in one pass without making a pair.

    The sum over pairs comes from the sum of the unit vectors, the sum of squares from their moment
    matrix, both of which are added up per task: |sum u|^2 and ||sum u u'||^2.
    """

    def part(batches):
        import pandas as pd

        n, s, m = 0, np.zeros(size), np.zeros((size, size))
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[vector].to_numpy()).astype(np.float64)
                x /= np.sqrt((x * x).sum(1, keepdims=True))
                n, s, m = n + len(x), s + x.sum(0), m + x.T @ x
        yield pd.DataFrame({"n": [n], "flat": [np.concatenate([s, m.ravel()])]})

    parts = df.where((F.size(vector) == size) & (V.norm(vector) > 0)).select(vector).mapInPandas(part, "n bigint, flat array<double>")
    long = parts.select("n", F.posexplode("flat").alias("i", "x")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    t = long.agg(F.max("n").alias("n"), F.sum(F.when(F.col("i") < size, F.col("x") * F.col("x"))).alias("s"), F.sum(F.when(F.col("i") >= size, F.col("x") * F.col("x"))).alias("m"))
    pairs = F.col("n") * (F.col("n") - 1)
    mean = (F.col("s") - F.col("n")) / pairs
    return t.select("n", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), (F.col("m") - F.col("n")) / pairs - mean * mean)).alias("std"))


def binary_auc(df: DataFrame, score: str, positive: Column, tie: str) -> DataFrame:
    """(auc, n_positive, n_negative) by the rank sum; ties go by ``tie``; 0.5 if a class is empty.

    Ranks are numbers over ranges, so no task ranks the whole table.
    """
    from thicketry.operators.relations import numbered

    r = numbered(df.where(F.col(score).isNotNull()).select(score, tie, positive.cast("int").alias("_y")), score, tie)
    t = r.agg(F.coalesce(F.sum("_y"), F.lit(0)).alias("n_positive"), F.count(F.lit(1)).alias("_n"), F.sum(F.when(F.col("_y") == 1, F.col("position") + 1)).alias("_s"))
    neg = F.col("_n") - F.col("n_positive")
    auc = (F.col("_s") - F.col("n_positive") * (F.col("n_positive") + 1) / 2) / (F.col("n_positive") * neg)
    return t.select(F.when((F.col("n_positive") > 0) & (neg > 0), auc).otherwise(0.5).alias("auc"), "n_positive", neg.alias("n_negative"))


def level_histogram(maps: DataFrame, key: str, pred: str, gt: str) -> DataFrame:
    """(key, level, n_fg, n_bg): how many cells of each class have each of the levels 0..255."""
    cells = maps.select(key, F.explode(F.arrays_zip(F.col(pred).alias("p"), F.col(gt).alias("g"))).alias("c"))
    level = F.floor(F.col("c.p") * 255).cast("int")
    return cells.groupBy(key, level.alias("level")).agg(F.count(F.when(F.col("c.g") > 0, 1)).alias("n_fg"), F.count(F.when(F.col("c.g") <= 0, 1)).alias("n_bg"))


def threshold_curves(maps: DataFrame, key: str, pred: str, gt: str, levels: int = 256, beta2: float = 0.3) -> DataFrame:
    """(level, precision, recall, f, e): means over maps at each threshold, prediction >= level.

    One histogram a map and sums from above give all thresholds at once; every task adds its maps
    up, so what is shuffled is one row a level and task. E is the enhanced alignment in closed form
    over the four cells of the confusion table.
    """

    def run(batches):
        import pandas as pd

        total, n_maps = np.zeros((4, levels)), 0
        for pdf in batches:
            for p, g in zip(pdf[pred], pdf[gt]):
                level = np.clip(np.floor(np.asarray(p, float) * 255).astype(int), 0, levels - 1)
                real = np.asarray(g) > 0
                tp = np.bincount(level[real], minlength=levels)[::-1].cumsum()[::-1].astype(float)
                fp = np.bincount(level[~real], minlength=levels)[::-1].cumsum()[::-1].astype(float)
                total += _curves(tp, fp, float(real.sum()), float(real.size), beta2)
                n_maps += 1
        if n_maps:
            yield pd.DataFrame({"level": np.arange(levels), "p": total[0], "r": total[1], "f": total[2], "e": total[3], "n": n_maps})

    parts = maps.select(pred, gt).mapInPandas(run, "level int, p double, r double, f double, e double, n bigint")
    mean = lambda c: F.sum(c) / F.sum("n")
    return parts.groupBy("level").agg(mean("p").alias("precision"), mean("r").alias("recall"), mean("f").alias("f"), mean("e").alias("e"))


def _curves(tp, fp, fg, n, beta2):
    """Precision, recall, F and E at every level of one map."""
    hits = tp + fp
    pre = np.divide(tp, hits, out=np.zeros_like(tp), where=hits > 0)
    rec = tp / fg if fg else np.zeros_like(tp)
    low = beta2 * pre + rec
    f = np.divide((1 + beta2) * pre * rec, low, out=np.zeros_like(tp), where=low > 0)
    mp, mg = hits / n, fg / n
    if fg == 0 or fg == n:
        return np.stack([pre, rec, f, 1 - mp if fg == 0 else mp])

    def aligned(p, g):
        a, b = p - mp, g - mg
        return (2 * a * b / (a * a + b * b + EPS) + 1) ** 2 / 4

    e = (tp * aligned(1, 1) + fp * aligned(1, 0) + (fg - tp) * aligned(0, 1) + (n - fg - fp) * aligned(0, 0)) / n
    return np.stack([pre, rec, f, e])


def mae(pred: Column | str, gt: Column | str) -> Column:
    return V.total(F.zip_with(V.col(pred), V.col(gt), lambda p, g: F.abs(p.cast("double") - g))) / F.size(V.col(pred))


def _ssim(p, g):
    n = p.size
    if n < 2:
        return float(n and p.mean() == g.mean())
    x, y = p.mean(), g.mean()
    sx, sy, sxy = ((p - x) ** 2).sum() / (n - 1), ((g - y) ** 2).sum() / (n - 1), ((p - x) * (g - y)).sum() / (n - 1)
    a, b = 4 * x * y * sxy, (x * x + y * y) * (sx + sy)
    return a / (b + EPS) if a else (1.0 if b == 0 else 0.0)


def structure_measure(p: np.ndarray, g: np.ndarray, alpha: float = 0.5) -> float:
    """Published S-measure: object part by class, region part by quadrants at the centroid of the target."""
    y = g.mean()
    if y in (0, 1):
        return float(1 - p.mean() if y == 0 else p.mean())

    def obj(v):
        return 2 * v.mean() / (v.mean() ** 2 + 1 + (v.std(ddof=1) if v.size > 1 else 0) + EPS)

    so = y * obj(p[g > 0]) + (1 - y) * obj(1 - p[g <= 0])
    rows, cols = np.nonzero(g > 0)
    cy, cx = int(np.round(rows.mean())) + 1, int(np.round(cols.mean())) + 1
    sr = sum(_ssim(p[a, b], g[a, b]) * g[a, b].size for a in (slice(0, cy), slice(cy, None)) for b in (slice(0, cx), slice(cx, None)) if g[a, b].size) / g.size
    return float(max(0.0, alpha * so + (1 - alpha) * sr))


def weighted_f(p: np.ndarray, g: np.ndarray, beta2: float = 1.0, sigma: float = 5.0, size: int = 7) -> float:
    """Published weighted F: errors smoothed by a Gaussian of dependency, and weighted by the distance from the target."""
    from thicketry.operators.maps import distance_to

    fg = g > 0
    if not fg.any():
        return 0.0
    d, near = distance_to(fg)
    e = np.abs(p - g)
    et = e.copy()
    et[~fg] = e.ravel()[near[~fg]]
    r = size // 2
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    k = np.outer(k, k)
    k /= k.sum()
    pad = np.pad(et, r)
    ea = sum(k[i, j] * pad[i : i + g.shape[0], j : j + g.shape[1]] for i in range(size) for j in range(size))
    low = np.where(fg & (ea < e), ea, e)
    b = np.where(fg, 1.0, 2.0 - np.exp(np.log(0.5) / 5 * d))
    ew = low * b
    tpw = fg.sum() - ew[fg].sum()
    fpw = ew[~fg].sum()
    rec, pre = 1 - ew[fg].mean(), tpw / (tpw + fpw + EPS)
    return float((1 + beta2) * rec * pre / (rec + beta2 * pre + EPS))


def map_measures(maps: DataFrame, key: str, pred: str, gt: str, h: int, w: int) -> DataFrame:
    """(key, mae, s_measure, weighted_f) of each map, Arrow batches of maps at a time."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for k, p, g in zip(pdf[key], pdf[pred], pdf[gt]):
                p, g = np.asarray(p, float).reshape(h, w), (np.asarray(g, float).reshape(h, w) > 0).astype(float)
                rows.append((k, float(np.abs(p - g).mean()), structure_measure(p, g), weighted_f(p, g)))
            yield pd.DataFrame(rows, columns=[key, "mae", "s_measure", "weighted_f"])

    return maps.select(key, pred, gt).mapInPandas(run, f"{key} {maps.schema[key].dataType.simpleString()}, mae double, s_measure double, weighted_f double")


def persistent(df: DataFrame, series: list[str], order: str, condition: Column, length: int = 3) -> DataFrame:
    """Adds ``alarm``: the condition holds in each of the last ``length`` rows of its series, and there are so many."""
    w = Window.partitionBy(*series).orderBy(order).rowsBetween(-(length - 1), 0)
    c = F.coalesce(condition, F.lit(False)).cast("int")
    return df.withColumn("alarm", (F.min(c).over(w) == 1) & (F.count(F.lit(1)).over(w) == length))


def trend(df: DataFrame, series: list[str], order: str, value: str, length: int = 3) -> DataFrame:
    """Adds ``trend``: last less first value of the last ``length`` rows; null until there are so many."""
    w = Window.partitionBy(*series).orderBy(order).rowsBetween(-(length - 1), 0)
    return df.withColumn("trend", F.when(F.count(F.lit(1)).over(w) == length, F.col(value) - F.first(value).over(w)))


def moving_average_fold(df: DataFrame, series: list[str], order: str, value: str, keep: float) -> DataFrame:
    """(series, ema): t = keep t + (1 - keep) v in order, starting at the first value, in closed form.

    The weight of a row depends only on its place from the end, so the fold is a weighted sum.
    """
    back = Window.partitionBy(*series).orderBy(F.desc(order))
    n = Window.partitionBy(*series)
    r = df.withColumn("_k", F.row_number().over(back) - 1).withColumn("_n", F.count(F.lit(1)).over(n))
    first = F.col("_k") == F.col("_n") - 1
    weight = F.pow(F.lit(keep), F.col("_k").cast("double")) * F.when(first, 1.0).otherwise(1 - keep)
    return r.groupBy(*series).agg(F.sum(weight * F.col(value)).alias("ema"), F.count(F.lit(1)).alias("n"))


def guarded_mean(value: Column, weight: Column, least: float = 1.0) -> Column:
    """Weighted mean whose denominator is at least ``least``."""
    return F.sum(value * weight) / F.greatest(F.sum(weight), F.lit(least))


def conditional_mean(value: Column, condition: Column) -> Column:
    """Mean where the condition holds, 0 if nowhere."""
    return F.coalesce(F.avg(F.when(condition, value)), F.lit(0.0))


def masked_statistics(value: Column, mask: Column) -> list[Column]:
    v = F.when(mask, value)
    return [F.coalesce(F.max(v), F.lit(0.0)).alias("max"), F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias("std"), F.count(v).alias("n")]


def masked_best(value: Column, index: Column, mask: Column) -> list[Column]:
    """Largest value, its index (smallest on ties), and whether there is any."""
    s = F.min(F.when(mask, F.struct((-value).alias("v"), index.alias("i"))))
    return [(-s["v"]).alias("best"), s["i"].alias("best_index"), s.isNotNull().alias("present")]
