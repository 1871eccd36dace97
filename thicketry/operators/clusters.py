"""Centroids, nearest members and orders over a given cluster assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def centroids(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """Mean vector of each cluster, as (cluster, centroid).

    Sums are taken per (cluster, position), so a hot cluster is pre-aggregated map-side and at most
    one double per position and task is shuffled. Null clusters and null vectors are left out.
    """
    long = df.where(F.col(cluster).isNotNull()).select(cluster, F.posexplode(vector).alias("pos", "x"))
    means = long.groupBy(cluster, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x)


def nearest_to_centroid(df: DataFrame, key: str, cluster: str, vector: str, digits: int = 9) -> DataFrame:
    """One row per cluster: the member nearest to the centroid, ties by key."""
    joined = df.join(centroids(df, cluster, vector), cluster)
    dist = F.sqrt(squared_distance(vector, "centroid"))
    ranked = joined.select(cluster, key, F.round(dist, digits).alias("dist"))
    best = ranked.groupBy(cluster).agg(F.min(F.struct("dist", key)).alias("m"))
    return best.select(cluster, F.col(f"m.{key}").alias(key), F.round("m.dist", 6).alias("dist"))


def kmeans(df: DataFrame, key: str, vector: str, k: int, seed: int, normalize: bool = True, steps: int = 50) -> tuple[list, DataFrame]:
    """(centres, rows with ``cluster`` and ``dist``) of Lloyd's k-means, seeded; on unit vectors by default.

    Rows with null or empty vectors are left out. Raises if there are fewer distinct vectors than
    clusters. The assignment is renumbered so that clusters stand in the order of their smallest key.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from thicketry.functions import vectors as V

    x = df.where(F.size(vector) > 0).select(key, vector, (V.l2_normalize(vector) if normalize else F.transform(vector, lambda v: v.cast("double"))).alias("_x"))
    if x.select("_x").distinct().limit(k).count() < k:
        raise ValueError(f"fewer than {k} distinct vectors")
    ready = x.withColumn("_v", array_to_vector("_x"))
    model = KMeans(k=k, seed=seed, maxIter=steps, featuresCol="_v", predictionCol="_c").fit(ready)
    out = model.transform(ready)
    order = [r[0] for r in out.groupBy("_c").agg(F.min(key).alias("m")).orderBy("m").collect()]
    centres = [[float(v) for v in model.clusterCenters()[c]] for c in order]
    place = F.array_position(F.array(*map(F.lit, order)), F.col("_c")) - 1
    rows = out.select(key, vector, "_x", place.cast("int").alias("cluster"))
    own = F.get(F.array(*(F.array(*map(F.lit, c)) for c in centres)), F.col("cluster"))
    return centres, rows.withColumn("dist", F.sqrt(squared_distance("_x", own)))


def center_order(centres: list) -> list[int]:
    """The places of the centres in the order of their raw bytes as 64-bit floats, ties by place."""
    import numpy as np

    return sorted(range(len(centres)), key=lambda i: (np.asarray(centres[i], np.float64).tobytes(), i))


def unique_representatives(rows: DataFrame, centres: list, key: str, vector: str) -> DataFrame:
    """(cluster, key): the row nearest to each centre, no row twice; later centres take their next nearest.

    A task compares its rows with all centres by matrix products and keeps the ``len(centres)``
    nearest of each, which is enough; these, the square of the number of centres a task at most, are
    merged by rank before they meet.
    """
    import numpy as np
    from pyspark.sql import Window

    k = len(centres)
    shared = rows.sparkSession.sparkContext.broadcast(np.asarray(centres, np.float64))
    kind = rows.schema[key].dataType.simpleString()

    def part(batches):
        import pandas as pd

        c = shared.value
        best = None
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["_x"].to_numpy()).astype(np.float64)
            d = np.round(np.sqrt(np.maximum(0, (c * c).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * c @ x.T)), 9)
            own = pd.DataFrame({"cluster": np.repeat(np.arange(k), len(x)), key: np.tile(pdf[key].to_numpy(), k), "d": d.ravel()})
            best = own if best is None else pd.concat([best, own])
            best = best.sort_values(["cluster", "d", key]).groupby("cluster").head(k)
        if best is not None:
            yield best.astype({"cluster": "int32"})

    near = rows.select(key, "_x").mapInPandas(part, f"cluster int, {key} {kind}, d double")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy("d", key))).where(F.col("r") <= k)

    def pick(pdf):
        import pandas as pd

        taken, out = set(), []
        for i, part in pdf.sort_values(["cluster", "r"]).groupby("cluster"):
            mine = next((x for x in part[key] if x not in taken), None)
            if mine is not None:
                taken.add(mine)
                out.append((i, mine))
        return pd.DataFrame(out, columns=["cluster", key])

    return near.groupBy(F.lit(0).alias("all")).applyInPandas(pick, f"cluster int, {key} {kind}")
