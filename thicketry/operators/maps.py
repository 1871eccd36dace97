"""Scores, prototypes, regions and geometry of small row-major maps; one row a map, no shuffle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicketry.functions import vectors as V


def boundary_scores(p: Column | str, view: Column | str, h: int, w: int, scale: float = 1 / 8, clear_border: bool = False, add_eps: bool = False) -> Column:
    """A struct (boundary, whole, mass): disagreement at the boundary and over all, and the boundary mass.

    The boundary weight is the gradient of the mean view; the denominator is the mass, at least
    eps, or the mass plus eps with ``add_eps``.
    """

    def scored(a: Column, b: Column, g: Column) -> Column:
        d = F.zip_with(a, b, lambda x, y: F.abs(x - y))
        mass = V.total(g)
        low = mass + V.EPS if add_eps else F.greatest(mass, F.lit(V.EPS))
        at_edge = V.total(F.zip_with(g, d, lambda x, y: x * y))
        return F.struct((at_edge / low).alias("boundary"), (V.total(d) / (h * w)).alias("whole"), mass.alias("mass"))

    clean = lambda x: F.transform(V.col(x), V.unit_interval)
    return V.let(clean(p), lambda a: V.let(clean(view), lambda b: V.let(V.sobel(V.mean_of(a, b), h, w, scale, clear_border), lambda g: scored(a, b, g))))


def weighted_prototype(points: DataFrame, key: str, vector: str, weight: str) -> DataFrame:
    """(key, prototype, valid): unit point vectors, their weighted mean, made unit; zeros where no weight is positive."""
    p = points.select(key, F.col(weight).alias("_w"), V.l2_normalize(vector).alias("_v"))
    long = p.select(key, "_w", F.posexplode("_v").alias("_p", "_x"))
    by = long.groupBy(key, "_p").agg(F.sum(F.col("_w") * F.col("_x")).alias("_s"), F.sum("_w").alias("_m"))
    rows = by.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_s"))), lambda s: s["_s"]).alias("_s"), F.max("_m").alias("_m"))
    ok = (F.col("_m") > V.EPS) & (V.norm("_s") > 0)
    return rows.select(key, F.when(ok, V.l2_normalize("_s")).otherwise(F.transform("_s", lambda x: F.lit(0.0))).alias("prototype"), ok.alias("valid"))


def regions(mask: Column | str, h: int, w: int, r: int = 1) -> Column:
    """Exclusive regions of a 0/1 mask: 0 inner foreground, 1 outer background, 2 foreground edge, 3 background edge."""

    def label(m: Column) -> Column:
        inner = F.zip_with(m, V.erode(m, h, w, r), lambda a, s: F.when(a > 0, F.when(s > 0, 0).otherwise(2)).otherwise(9))
        return F.zip_with(inner, V.dilate(m, h, w, r), lambda a, g: F.when(a < 9, a).when(g > 0, 3).otherwise(1))

    return V.let(F.transform(V.col(mask), lambda x: (x > 0).cast("double")), label)


def geometry(p: Column | str, h: int, w: int) -> dict[str, Column]:
    """Distance proxy 2p - 1, normals from forward differences, offset, reliability |2p - 1|, as arrays."""
    dx = V.grid_map(p, h, w, lambda at, y, x: at(0, 1) - at(0, 0))
    dy = V.grid_map(p, h, w, lambda at, y, x: at(1, 0) - at(0, 0))
    size = F.zip_with(dx, dy, lambda a, b: F.greatest(F.hypot(a, b), F.lit(V.EPS)))
    sdf = F.transform(V.col(p), lambda x: 2 * x.cast("double") - 1)
    return {
        "sdf": sdf, "nx": F.zip_with(dx, size, lambda a, s: a / s), "ny": F.zip_with(dy, size, lambda a, s: a / s),
        "offset": F.transform(sdf, lambda s: -s / 2), "reliability": F.transform(sdf, F.abs),
    }


def gather(cells: DataFrame, image: str, cell: str, maps: DataFrame, array: str) -> DataFrame:
    """Adds ``value``: the map's value at each (image, flat cell); null beyond the map."""
    m = maps.select(F.col(image), F.col(array).alias("_a"))
    return cells.join(m, image).withColumn("value", F.get("_a", F.col(cell))).drop("_a")


def window_cells(cells: DataFrame, cell: str, h: int, w: int, r: int = 1) -> DataFrame:
    """Explodes each cell to its (2r + 1) squared window, with ``dy``, ``dx``, ``near`` and ``inside``."""
    offsets = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-r, r + 1) for dx in range(-r, r + 1)))
    out = cells.withColumn("_o", F.explode(offsets)).select("*", "_o.dy", "_o.dx").drop("_o")
    y, x = F.floor(F.col(cell) / w).cast("int") + F.col("dy"), F.pmod(F.col(cell), F.lit(w)).cast("int") + F.col("dx")
    inside = (y >= 0) & (y < h) & (x >= 0) & (x < w)
    return out.withColumn("inside", inside).withColumn("near", F.when(inside, y * w + x))


def scatter(cells: DataFrame, image: str, cell: str, value: str, how: str = "mean", order: str | None = None) -> DataFrame:
    """(image, cell, value): repeated cells averaged, added, or replaced by the last in ``order``."""
    agg = {"mean": F.avg(value), "add": F.sum(value)}.get(how)
    if agg is None:
        agg = F.max_by(value, order)
    return cells.groupBy(image, cell).agg(agg.alias(value))


def distance_to(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Euclidean distance of each cell to the nearest true cell, and that cell's flat index; two separable passes."""
    h, w = mask.shape
    big = float((h + w) * 4)
    ys, xs = np.arange(h), np.arange(w)
    d = np.where(mask[None], np.abs(ys[:, None, None] - ys[None, :, None]), big)  # [to y, from y, x]
    near_y = d.argmin(1)
    col = d.min(1)
    cost = col[:, None, :] ** 2 + (xs[None, :, None] - xs[None, None, :]) ** 2  # [y, to x, from x]
    nx = cost.argmin(2)
    dist = np.sqrt(cost.min(2))
    ny = np.take_along_axis(near_y, nx, 1)
    return (dist, ny * w + nx) if mask.any() else (np.full((h, w), np.inf), np.zeros((h, w), int))


def signed_distance(maps: DataFrame, key: str, mask: str, h: int, w: int) -> DataFrame:
    """(key, sdf): distance to the other side, positive inside; an Arrow batch at a time."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for m in pdf[mask]:
                g = np.asarray(m, float).reshape(h, w) > 0
                inside, outside = distance_to(~g)[0], distance_to(g)[0]
                s = np.where(g, inside, -outside)
                out.append(np.nan_to_num(s, posinf=h + w, neginf=-(h + w)).ravel().tolist())
            yield pd.DataFrame({key: pdf[key], "sdf": out})

    return maps.select(key, mask).mapInPandas(run, f"{key} {maps.schema[key].dataType.simpleString()}, sdf array<double>")


def mask_geometry(maps: DataFrame, key: str, mask: str, h: int, w: int, scale: float) -> DataFrame:
    """(key, sdf, nx, ny, ox, oy, reliability) of each mask, as arrays, an Arrow batch at a time.

    The distance is over the longer side and within -1 and 1; normals are its central differences
    (one-sided at the border) made unit; an offset leads to the edge; reliability falls by ``scale``.
    """
    names = ("sdf", "nx", "ny", "ox", "oy", "reliability")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for k, m in zip(pdf[key], pdf[mask]):
                g = np.asarray(m, float).reshape(h, w) > 0
                inside, outside = distance_to(~g)[0], distance_to(g)[0]
                f = np.clip(np.nan_to_num(np.where(g, inside, -outside), posinf=h + w, neginf=-(h + w)) / max(h, w), -1, 1)
                dy, dx = np.gradient(f)
                n = np.sqrt(dx * dx + dy * dy + 1e-6)
                rows.append((k, *(x.ravel().tolist() for x in (f, dx / n, dy / n, -f * dx / n, -f * dy / n, np.exp(-np.abs(f) / scale)))))
            yield pd.DataFrame(rows, columns=[key, *names])

    return maps.select(key, mask).mapInPandas(run, f"{key} {maps.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} array<double>" for n in names))


def total_variation(a: Column | str, h: int, w: int) -> Column:
    """Mean absolute value plus mean differences to the next cell."""
    n = float(h * w)
    return V.total(F.transform(V.col(a), lambda x: F.abs(x.cast("double")))) / n + V.total(V.forward_difference(a, h, w)) / n


def structure_loss(p: Column | str, g: Column | str, h: int, w: int, r: int = 15) -> Column:
    """Cross-entropy and 1 - IoU, weighted by 1 + 5 |box average of the target - target|."""

    def loss(pp: Column, gg: Column, weight: Column) -> Column:
        bce = F.zip_with(pp, gg, lambda q, t: -(t * F.log(q) + (1 - t) * F.log(1 - q)))
        inter = V.total(F.zip_with(weight, F.zip_with(pp, gg, lambda q, t: q * t), lambda a, b: a * b))
        union = V.total(F.zip_with(weight, F.zip_with(pp, gg, lambda q, t: q + t), lambda a, b: a * b))
        return V.total(F.zip_with(weight, bce, lambda a, b: a * b)) / V.total(weight) + 1 - (inter + 1) / (union - inter + 1)

    clean = F.transform(V.col(p), lambda x: F.greatest(F.lit(V.EPS), F.least(F.lit(1 - V.EPS), x.cast("double"))))
    weighted = lambda t: F.zip_with(V.box_average(t, h, w, r), t, lambda m, x: 1 + 5 * F.abs(m - x))
    return V.let(clean, lambda q: V.let(F.transform(V.col(g), lambda x: x.cast("double")), lambda t: V.let(weighted(t), lambda k: loss(q, t, k))))


def lead_difference(pixels: DataFrame, image: str, y: str, x: str, value: str) -> DataFrame:
    """The long form of forward differences: ``dx`` and ``dy`` by window, zero at the end."""
    v = F.col(value)
    wx, wy = Window.partitionBy(image, y).orderBy(x), Window.partitionBy(image, x).orderBy(y)
    return pixels.withColumn("dx", F.coalesce(F.lead(v).over(wx) - v, F.lit(0.0))).withColumn("dy", F.coalesce(F.lead(v).over(wy) - v, F.lit(0.0)))


def bilinear(a: np.ndarray, to_h: int, to_w: int) -> np.ndarray:
    """Maps (n, h, w) in another size: bilinear, half-pixel centres, edges replicated."""

    def axis(n, m):
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        lo = np.floor(at).astype(int)
        return lo, np.minimum(lo + 1, n - 1), at - lo

    (y0, y1, fy), (x0, x1, fx) = axis(a.shape[1], to_h), axis(a.shape[2], to_w)
    rows = a[:, y0] * (1 - fy)[None, :, None] + a[:, y1] * fy[None, :, None]
    return rows[:, :, x0] * (1 - fx) + rows[:, :, x1] * fx


def resize_bilinear(maps: DataFrame, key: str, array: str, h: int, w: int, to_h: int, to_w: int) -> DataFrame:
    """(key, array) of maps of one size in another; an Arrow batch of maps at a time."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            if not len(pdf):
                continue
            a = np.stack(pdf[array].to_numpy()).astype(float).reshape(-1, h, w)
            yield pd.DataFrame({key: pdf[key].to_numpy(), array: list(bilinear(a, to_h, to_w).reshape(len(a), -1))})

    return maps.select(key, array).mapInPandas(run, f"{key} {maps.schema[key].dataType.simpleString()}, {array} array<double>")


def warp(maps: DataFrame, key: str, array: str, dy: str, dx: str, h: int, w: int) -> DataFrame:
    """(key, array): each cell read at its own place moved by (dy, dx) cells, bilinear, edges replicated."""

    def run(batches):
        import pandas as pd

        ys, xs = np.mgrid[0:h, 0:w]
        for pdf in batches:
            out = []
            for a, oy, ox in zip(pdf[array], pdf[dy], pdf[dx]):
                a = np.asarray(a, float).reshape(h, w)
                y, x = np.clip(ys + np.reshape(oy, (h, w)), 0, h - 1), np.clip(xs + np.reshape(ox, (h, w)), 0, w - 1)
                y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
                y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
                fy, fx = y - y0, x - x0
                v = (a[y0, x0] * (1 - fx) + a[y0, x1] * fx) * (1 - fy) + (a[y1, x0] * (1 - fx) + a[y1, x1] * fx) * fy
                out.append(v.ravel())
            yield pd.DataFrame({key: pdf[key].to_numpy(), array: out})

    return maps.select(key, array, dy, dx).mapInPandas(run, f"{key} {maps.schema[key].dataType.simpleString()}, {array} array<double>")
