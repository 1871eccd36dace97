"""Two-stage retrieval over a memory of parents and children: top-k, routing, votes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thicketry.functions import vectors as V


def _query_blocks(queries: DataFrame, query: str, vector: str, block_bytes: int):
    """Names and unit vectors of the queries in blocks of at most ``block_bytes``, by their counted number."""
    q = queries.where(F.col(vector).isNotNull()).select(F.col(query).alias("q"), F.col(vector).alias("v"))
    n, size = q.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    blocks = max(1, -(-n * (size or 1) * 8 // block_bytes))
    for i in range(blocks):
        part = q if blocks == 1 else q.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i)
        t = part.toArrow()
        v = t.column("v").combine_chunks()
        names = np.empty(len(v), object)
        names[:] = t.column("q").to_pylist()
        yield names, _unit(v.flatten().to_numpy().astype(np.float64).reshape(len(v), -1) if len(v) else np.zeros((0, 1)))


def top_k(queries: DataFrame, query: str, bank: DataFrame, key: str, vector: str, k: int, block_bytes: int = 64 << 20, step: int = 4096) -> DataFrame:
    """(query, key, score, rank): the k most similar bank rows of each query by cosine, itself left out.

    Exact: the queries go to the bank as a broadcast of at most ``block_bytes``, of as many as that
    holds (some 130,000 of 64 values), a scan of the bank each; every task keeps the best k of its
    whole part by matrix products, and these are merged. The bank is neither shuffled nor
    broadcast. Ties go to the smaller key; rows with null vectors are left out; vectors of length
    zero have similarity 0.
    """
    from functools import reduce

    qt, kt = queries.schema[query].dataType, bank.schema[key].dataType
    shape = T.StructType([T.StructField(query, qt), T.StructField(key, kt), T.StructField("score", T.DoubleType())])
    b = bank.where(F.col(vector).isNotNull()).select(key, vector)

    def part(names, x):
        shared = queries.sparkSession.sparkContext.broadcast((names, x))

        def run(batches):
            import pandas as pd

            names, x = shared.value
            if not len(names):
                return
            best, held = np.full((len(names), k), -9.0), np.empty((len(names), k), object)
            for pdf in batches:
                if not len(pdf):
                    continue
                own = pdf[key].to_numpy()
                order = np.argsort(own, kind="stable")
                own = own[order]
                y = _unit(np.stack(pdf[vector].to_numpy()[order]).astype(np.float64)).T
                for s in range(0, len(names), step):
                    e = min(s + step, len(names))
                    sim = np.round(x[s:e] @ y, 9)
                    sim[names[s:e].astype(own.dtype)[:, None] == own[None, :]] = -9
                    top = np.argsort(-sim, axis=1, kind="stable")[:, :k]
                    val = np.concatenate([best[s:e], np.take_along_axis(sim, top, 1)], axis=1)
                    who = np.concatenate([held[s:e], own[top]], axis=1)
                    who[val == -9] = own[0]
                    place = np.unique(who.ravel(), return_inverse=True)[1].reshape(who.shape)
                    order = np.lexsort((place, -val), axis=1)[:, :k]  # ties by key
                    best[s:e], held[s:e] = np.take_along_axis(val, order, 1), np.take_along_axis(who, order, 1)
            i, j = np.nonzero(best > -9)
            if len(i):
                yield pd.DataFrame({query: names[i], key: held[i, j], "score": best[i, j]})

        return b.mapInPandas(run, shape)

    found = reduce(DataFrame.unionByName, [part(*q) for q in _query_blocks(queries, query, vector, block_bytes)])
    w = Window.partitionBy(query).orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def contrastive_loss(queries: DataFrame, query: str, image: str, bank: DataFrame, key: str, vector: str, temperature: float, block_bytes: int = 64 << 20, step: int = 4096) -> DataFrame:
    """(query, loss): cross-entropy of the logits of all bank rows, the row of the query's own image being right.

    The logit is the cosine over the temperature. A task adds exp(logit - 1 / temperature) up over
    its part of the bank, so one number a query and task is shuffled, not a row a logit. A query
    whose image the bank holds not once fails.
    """
    from functools import reduce

    qt = queries.schema[query].dataType
    shape = T.StructType([T.StructField(query, qt), T.StructField("mass", T.DoubleType()), T.StructField("own", T.DoubleType()), T.StructField("n_own", T.LongType())])
    of = positive_rows(queries, query, image, bank, key)
    b = bank.where(F.col(vector).isNotNull()).select(key, vector)
    named = queries.select(F.struct(F.col(query).alias("q"), F.col(image).alias("i")).alias("q"), F.col(vector).alias("v"))

    def part(names, x):
        shared = queries.sparkSession.sparkContext.broadcast((names, x))

        def run(batches):
            import pandas as pd

            names, x = shared.value
            mass, own = np.zeros(len(names)), np.zeros(len(names))
            images: dict = {}
            for p, n in enumerate(names):
                images.setdefault(n["i"], []).append(p)
            for pdf in batches:
                if not len(pdf):
                    continue
                y = _unit(np.stack(pdf[vector].to_numpy()).astype(np.float64))
                for s in range(0, len(names), step):
                    mass[s : s + step] += np.exp((x[s : s + step] @ y.T - 1) / temperature).sum(1)
                for r, i in enumerate(pdf[key].tolist()):
                    for p in images.get(i, ()):
                        own[p] += x[p] @ y[r] / temperature
            if len(names):
                yield pd.DataFrame({query: [n["q"] for n in names], "mass": mass, "own": own, "n_own": 0})

        return b.mapInPandas(run, shape)

    parts = reduce(DataFrame.unionByName, [part(*q) for q in _query_blocks(named, "q", "v", block_bytes)])
    out = parts.groupBy(query).agg((F.log(F.sum("mass")) + 1 / temperature - F.sum("own")).alias("loss"))
    return out.join(of.select(query), query)


def positive_rows(queries: DataFrame, query: str, image: str, bank: DataFrame, key: str) -> DataFrame:
    """(query, key): the one bank row of each query's own image; a query with none or several fails."""
    rows = bank.groupBy(F.col(key).alias("_i")).agg(F.count(F.lit(1)).alias("_n"))
    out = queries.select(F.col(query), F.col(image).alias(key)).join(rows, F.col(key) == F.col("_i"), "left")
    right = F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not one row of image "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean"))
    return out.where(right).select(query, key)


def _unit(x: np.ndarray) -> np.ndarray:
    if not x.size:
        return x
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(n > 0, n, 1)


def masked_softmax(hits: DataFrame, query: str, score: str, temperature: float, valid: Column | None = None) -> DataFrame:
    """Adds ``weight``: softmax over the valid hits of each query, 0 elsewhere and where none is valid."""
    w = Window.partitionBy(query)
    ok = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    s = F.when(ok, F.col(score) / temperature)
    e = F.when(s.isNotNull(), F.exp(s - F.max(s).over(w))).otherwise(0.0)
    return hits.withColumn("weight", F.coalesce(e / F.nullif(F.sum(e).over(w), F.lit(0.0)), F.lit(0.0)))


def margins(hits: DataFrame, query: str, score: str, rank: str) -> DataFrame:
    """(query, margin): score of the first hit less the second; null with fewer than two."""
    one = F.max(F.when(F.col(rank) == 1, F.col(score)))
    two = F.max(F.when(F.col(rank) == 2, F.col(score)))
    return hits.where(F.col(rank) <= 2).groupBy(query).agg((one - two).alias("margin"))


def hit_entropy(hits: DataFrame, query: str, weight: str) -> DataFrame:
    """(query, n_hits, entropy): normalized by the logarithm of the number of hits; 0 for one."""
    h = -F.sum(F.col(weight) * F.log(F.greatest(F.col(weight), F.lit(V.EPS))))
    n = F.count(F.lit(1))
    return hits.groupBy(query).agg(n.alias("n_hits"), F.when(n > 1, h / F.log(n.cast("double"))).otherwise(0.0).alias("entropy"))


def routed_top_k(queries: DataFrame, query: str, routes: DataFrame, image: str, parents: DataFrame, parent: str, vector: str, k: int) -> DataFrame:
    """(query, parent, score, rank): each query sees only the parents of its own routed images.

    An equi-join on the image; a parent of the query's own name is left out; the rank is cut to k
    before its shuffle (window group limit).
    """
    q = queries.select(F.col(query).alias("_q"), F.col(vector).alias("_v"))
    p = parents.select(image, F.col(parent), F.col(vector).alias("_w"))
    pairs = routes.select(F.col(query).alias("_q"), image).join(p, image).join(q, "_q").where(F.col("_q") != F.col(parent))
    scored = pairs.select(F.col("_q").alias(query), parent, F.round(V.cosine("_v", "_w"), 9).alias("score"))
    w = Window.partitionBy(query).orderBy(F.desc("score"), parent)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def region_vote(hits: DataFrame, query: str, region: str, weight: str, regions: int = 4) -> DataFrame:
    """One row a query: weight per region, support of foreground (0, 2) and background (1, 3), and their margin."""
    sums = [F.sum(F.when(F.col(region) == r, F.col(weight)).otherwise(0.0)).alias(f"p{r}") for r in range(regions)]
    out = hits.groupBy(query).agg(*sums)
    fg, bg = F.col("p0") + F.col("p2"), F.col("p1") + F.col("p3")
    return out.withColumn("fg", fg).withColumn("bg", bg).withColumn("margin", F.abs(fg - bg))


def standardized(hits: DataFrame, query: str, score: str) -> DataFrame:
    """Adds ``z``: sigmoid of the score's deviation from the query's mean in population deviations."""
    w = Window.partitionBy(query)
    z = (F.col(score) - F.avg(score).over(w)) / F.greatest(F.stddev_pop(score).over(w), F.lit(V.EPS))
    return hits.withColumn("z", 1 / (1 + F.exp(-z)))


def top_accuracy(hits: DataFrame, query: str, rank: str, match: Column, k: int) -> DataFrame:
    """One row: share of queries whose first, and any of the first k hits match."""
    per = hits.groupBy(query).agg(F.bool_or(match & (F.col(rank) == 1)).alias("a"), F.bool_or(match & (F.col(rank) <= k)).alias("b"))
    return per.agg(F.avg(F.col("a").cast("double")).alias("top1"), F.avg(F.col("b").cast("double")).alias("topk"), F.count(F.lit(1)).alias("n_queries"))
