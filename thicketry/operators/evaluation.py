"""Predicted maps against real masks: pairs that must match, and one row of measures a dataset."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TINY = 2.0**-52


def paired_maps(pred: DataFrame, gt: DataFrame, keys: list[str], h: str = "h", w: str = "w") -> DataFrame:
    """Every prediction with its mask, as ``gt``; the query fails on one without a mask or of another shape.

    ``pred`` has the keys, height, width and ``pred``, ``gt`` the keys, height, width and ``gt``. Masks
    without a prediction are left out.
    """
    g = gt.select(*keys, F.col(h).alias("_h"), F.col(w).alias("_w"), "gt", F.lit(True).alias("_there"))
    both = pred.join(g, keys, "left")
    name = F.concat_ws("/", *(F.col(k).cast("string") for k in keys))
    no = F.raise_error(F.concat(F.lit("no mask for "), name)).cast("boolean")
    other = F.raise_error(F.concat(F.lit("mask of another shape for "), name)).cast("boolean")
    right = F.when(F.col("_there").isNull(), no).when((F.col(h) != F.col("_h")) | (F.col(w) != F.col("_w")), other).otherwise(F.lit(True))
    return both.where(right).drop("_h", "_w", "_there")


def curves(p: np.ndarray, g: np.ndarray, levels: int = 256, beta2: float = 0.3) -> np.ndarray:
    """Rows F and E at the thresholds 0 to 255 of 255, and last at twice the mean value; predictions are stretched to 0..1."""
    if p.max() > p.min():
        p = (p - p.min()) / (p.max() - p.min())
    fg, n = float(g.sum()), float(g.size)
    level = np.clip(np.floor(p * 255).astype(int), 0, levels - 1)
    above = lambda x: np.bincount(x, minlength=levels)[::-1].cumsum()[::-1]
    hit = p >= min(2 * p.mean(), 1.0)
    tp = np.append(above(level[g]), (hit & g).sum()).astype(float)
    fp = np.append(above(level[~g]), (hit & ~g).sum()).astype(float)
    pre, rec = tp / np.maximum(1, tp + fp), tp / max(1.0, fg)
    low = beta2 * pre + rec
    f = np.divide((1 + beta2) * pre * rec, low, out=np.zeros_like(low), where=low > 0)
    taken = tp + fp
    if fg in (0, n):
        return np.stack([f, (taken if fg else n - taken) / (n - 1 + TINY)])
    mp, mg = taken / n, fg / n

    def aligned(a: float, b: float) -> np.ndarray:
        x, y = a - mp, b - mg
        return (2 * x * y / (x * x + y * y + TINY) + 1) ** 2 / 4

    e = tp * aligned(1, 1) + fp * aligned(1, 0) + (fg - tp) * aligned(0, 1) + (n - fg - fp) * aligned(0, 0)
    return np.stack([f, e / (n - 1 + TINY)])


def report(pairs: DataFrame, dataset: str, pred: str = "pred", gt: str = "gt", above: float = 0.5, shape: tuple[int, int] | None = None) -> DataFrame:
    """One row a dataset: n, mae, F and E at the adaptive threshold, as mean and as largest of the mean curve; with ``shape`` also S and weighted F.

    Every task adds its maps up, so one row a dataset, task and figure is shuffled. A mask's cell is
    real where its value is beyond ``above``.
    """
    from thicketry.operators.metrics import structure_measure, weighted_f

    kind = pairs.schema[dataset].dataType.simpleString()
    levels = 256

    def run(batches):
        import pandas as pd

        total: dict = {}
        for pdf in batches:
            for d, p, g in zip(pdf[dataset], pdf[pred], pdf[gt]):
                p, g = np.asarray(p, float).ravel(), np.asarray(g, float).ravel() > above
                f, e = curves(p, g, levels)
                q = (p - p.min()) / (p.max() - p.min()) if p.max() > p.min() else p
                more = (structure_measure(q.reshape(shape), g.reshape(shape).astype(float)), weighted_f(q.reshape(shape), g.reshape(shape).astype(float))) if shape else (0.0, 0.0)
                row = np.concatenate([[1.0, np.abs(q - g).mean(), *more, f[-1], e[-1]], f[:-1], e[:-1]])
                total[d] = total[d] + row if d in total else row
        for d, row in total.items():
            yield pd.DataFrame({dataset: [d] * len(row), "i": np.arange(len(row), dtype=np.int32), "s": row})

    sums = pairs.select(dataset, pred, gt).mapInPandas(run, f"{dataset} {kind}, i int, s double").groupBy(dataset, "i").agg(F.sum("s").alias("s"))
    one = lambda i: F.max(F.when(F.col("i") == i, F.col("s")))
    part = lambda agg, k: agg(F.when((F.col("i") >= 6 + k * levels) & (F.col("i") < 6 + (k + 1) * levels), F.col("s")))
    figures = {"mae": one(1), "f_adaptive": one(4), "f_mean": part(F.avg, 0), "f_max": part(F.max, 0), "e_adaptive": one(5), "e_mean": part(F.avg, 1), "e_max": part(F.max, 1)}
    if shape:
        figures |= {"s_measure": one(2), "weighted_f": one(3)}
    return sums.groupBy(dataset).agg(one(0).cast("bigint").alias("n"), *((x / one(0)).alias(n) for n, x in figures.items()))
