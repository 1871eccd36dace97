"""Problem 6: dividing records into clusters of mutually similar vectors.

Method: parallel pivot correlation clustering. Records stand in hash order. Blocks of a partition
are clustered first (a record that no earlier pivot of its block resembles is a pivot and absorbs
similar later ones), so that a group with a third of all rows shrinks to one pivot a block before
anything is shuffled. Then the pivots meet in rounds: those near the same anchors share a cell,
within which a pivot with no similar pivot before it in hash order (a local minimum) absorbs the
similar ones, each going to its closest. Each round draws other anchors; when one absorbs nothing,
rounds follow in which every pivot meets every other, until one of these absorbs nothing. Then
every member is held against its pivot, and those that are not similar enough (absorbed over a
chain) meet the pivots again until there are none. At last each member goes to its closest pivot: by
the triangle inequality only a pivot within twice the angle of the farthest member of its own can be
closer, so that this is exact. Medoids are computed from the sums of the clusters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thicketry.llm.vectors import lists, matrix, one_per_key, unit
from thicketry.session import cut, store


def pivots_in_order(x: np.ndarray, least: float, chunk: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(pivot row, similarity) of each row; rows are taken in order, a pivot has itself and 1."""
    n = len(x)
    own, sim = np.full(n, -1, np.int64), np.zeros(n, np.float32)
    held = np.empty((max(16, n // 8), x.shape[1]), np.float32)
    rows: list[int] = []
    for s in range(0, n, chunk):
        y = x[s : s + chunk]
        if rows:
            t = y @ held[: len(rows)].T
            best = t.argmax(axis=1)
            val = t[np.arange(len(y)), best]
            got = np.nonzero(val >= least)[0]
            own[s + got], sim[s + got] = np.array(rows)[best[got]], val[got]
        left = np.nonzero(own[s : s + len(y)] < 0)[0]
        if len(left):
            t = y[left] @ y[left].T
            for i in range(len(left)):
                a = s + left[i]
                if own[a] >= 0 and own[a] != a:
                    continue
                own[a], sim[a] = a, 1
                if len(rows) == len(held):
                    held = np.concatenate([held, np.empty_like(held)])
                held[len(rows)] = x[a]
                rows.append(int(a))
                later = left[i + 1 :][(t[i, i + 1 :] >= least) & (t[i, i + 1 :] > sim[s + left[i + 1 :]])]
                own[s + later], sim[s + later] = a, t[i, i + 1 :][np.searchsorted(left[i + 1 :], later)]
    return own, sim


def _local(batches: Iterator, least: float, block_rows: int, size: int) -> Iterator:
    """(key, root, sim, hash, vec): the pivot of each row within its block and the cosine to it."""
    import pyarrow as pa

    def flush(held):
        t = pa.Table.from_batches(held)
        h, k = t.column("hash").to_numpy(), t.column("key").to_numpy(zero_copy_only=False)
        order = np.lexsort((k, h))
        x = matrix(t.column("vec").combine_chunks(), size)[order]
        own, sim = pivots_in_order(x, least)
        k = k[order]
        kind = t.schema.field("key").type
        return pa.RecordBatch.from_arrays([pa.array(k, kind), pa.array(k[own], kind), pa.array(sim.astype(np.float64)), pa.array(h[order]), lists(x)], names=["key", "root", "sim", "hash", "vec"])

    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= block_rows:
            yield flush(held)
            held, n = [], 0
    if n:
        yield flush(held)


def _near(pivots: DataFrame, anchors: np.ndarray, margin: float, size: int, cells: int = 4) -> DataFrame:
    """(cell, key, hash, vec): each pivot in the cells of its nearest anchors."""
    shared = pivots.sparkSession.sparkContext.broadcast(anchors)
    key_type = pivots.schema["key"].dataType

    def send(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("vec"), size)
            t = x @ shared.value.T
            top = np.argpartition(-t, min(cells, t.shape[1]) - 1, axis=1)[:, :cells]
            v = np.take_along_axis(t, top, 1)
            row, col = np.nonzero(v >= v.max(axis=1, keepdims=True) - margin)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(top[row, col].astype(np.int32)), b.column("key").take(take), b.column("hash").take(take), lists(x[row])], names=["cell", "key", "hash", "vec"])

    sent = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("key", key_type), T.StructField("hash", T.LongType()), T.StructField("vec", T.ArrayType(T.FloatType()))])
    return pivots.select("key", "hash", "vec").mapInArrow(send, sent)


def _all_pairs(pivots: DataFrame, blocks: int) -> DataFrame:
    """(cell, key, hash, vec): a cell for any two of two or more blocks, so that every two pivots share one."""
    own = F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(blocks)).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda j: j != own)
    cell = F.explode(F.transform(others, lambda j: F.least(j, own) * blocks + F.greatest(j, own)))
    return pivots.select(cell.alias("cell"), "key", "hash", "vec")


def _meet(sent: DataFrame, least: float, size: int) -> DataFrame:
    """(key, root, sim): within each cell the closest earlier pivot of every pivot that has one."""
    key_type = sent.schema["key"].dataType

    def meet(table):
        import pyarrow as pa

        kind = table.schema.field("key").type
        h, k = table.column("hash").to_numpy(), table.column("key").to_numpy(zero_copy_only=False)
        order = np.lexsort((k, h))
        own, sim = pivots_in_order(matrix(table.column("vec").combine_chunks(), size)[order], least)
        k = k[order]
        got = np.nonzero(own != np.arange(len(own)))[0]
        return pa.table([pa.array(k[got], kind), pa.array(k[own[got]], kind), pa.array(sim[got].astype(np.float64))], names=["key", "root", "sim"])

    edge = T.StructType([T.StructField("key", key_type), T.StructField("root", key_type), T.StructField("sim", T.DoubleType())])
    return sent.groupBy("cell").applyInArrow(meet, edge)


def _bounded(sent: DataFrame, most: int, r: int) -> DataFrame:
    """``sent`` with cells of more than ``most`` pivots cut into slices by hash; what is cut apart meets in the rounds of all pairs."""
    big = sent.groupBy("cell").count().where(F.col("count") > most).collect()
    if not big:
        return sent
    cuts = sent.sparkSession.createDataFrame([(c, -(-n // most)) for c, n in big], "cell int, cuts bigint")
    sent = sent.join(F.broadcast(cuts), "cell", "left")
    slice_ = F.pmod(F.xxhash64("key", F.lit(~r)), F.coalesce("cuts", F.lit(1)))
    return sent.select((F.col("cell") + slice_ * (1 << 20)).alias("cell"), "key", "hash", "vec")


def _merge(pivots: DataFrame, least: float, size: int, cell_rows: int, max_anchors: int, margin: float, quiet: int, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """The pivots that remain, no two of them similar, and the absorptions of each round.

    ``quiet`` and ``most`` only say when the rounds over anchors give way to those of all pairs.
    """
    absorbed, still, r = [], 0, 0
    while True:
        n = pivots.count()
        a = max(1, min(max_anchors, -(-n // cell_rows)))
        whole = n <= cell_rows or still >= quiet or r >= most
        if whole:
            sent = pivots.select(F.lit(0).alias("cell"), "key", "hash", "vec") if n <= 2 * cell_rows else _all_pairs(pivots, max(2, -(-n // (2 * cell_rows))))
        else:
            # about ``a`` anchors: those whose hash lies below a threshold set by their number
            below = int(min(1.0, (a + 2) / n) * 2**64) - 2**63
            drawn = pivots.where(F.xxhash64("key", F.lit(r)) <= F.lit(below)).select("key", "vec").toArrow().sort_by("key").column("vec").combine_chunks()
            r += 1
            if not len(drawn):
                continue
            sent = _bounded(_near(pivots, matrix(drawn, size), margin, size), 4 * cell_rows, r)
        edges = cut(_meet(sent, least, size))
        if edges.isEmpty():
            if whole:
                return pivots, absorbed
            still += 1
            continue
        # local minima: an edge counts only if its earlier pivot is itself absorbed by none; the
        # earliest of all is absorbed by none, so each such round leaves fewer pivots
        gone = edges.select(F.col("key").alias("root")).distinct()
        firm = edges.join(gone, "root", "left_anti").groupBy("key").agg(F.max(F.struct("sim", "root")).alias("m")).select("key", F.col("m.root").alias("root"))
        firm = cut(firm)
        absorbed.append(firm)
        pivots = cut(pivots.join(firm.select("key"), "key", "left_anti"))
        if not whole:
            still = 0


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def _by_root(rows: DataFrame, one: DataFrame, most_bytes: int = 16 << 20, salts: int = 16, hot: int = 10_000) -> DataFrame:
    """Left join of rows, of which a third may share one root, with one row a root: broadcast up to ``most_bytes``, else shuffled.

    The bytes are counted: of texts and arrays by their lengths, of all else as eight a value. A
    broadcast stands in the driver several times over while it is made. Only what is joined to
    roots of more than ``hot`` rows is salted, all other rows of ``one`` are sent once.
    """
    size = {"string": F.octet_length, "array<float>": lambda c: 4 * F.size(c), "array<double>": lambda c: 8 * F.size(c)}
    row = sum((F.coalesce(size[t](F.col(c)), F.lit(0)) if t in size else F.lit(8) for c, t in one.dtypes), F.lit(32))
    if (one.agg(F.sum(row)).first()[0] or 0) <= most_bytes:
        return rows.join(F.broadcast(one), "root", "left")
    many = store(rows.groupBy("root").count().where(F.col("count") > hot).select("root", F.lit(True).alias("_hot")))
    many = F.broadcast(many)
    one = one.join(many, "root", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("_hot"), F.lit(salts - 1)).otherwise(F.lit(0))))).drop("_hot")
    rows = rows.join(many, "root", "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int")).otherwise(F.lit(0))).drop("_hot")
    return rows.join(one.hint("merge"), ["root", "_salt"], "left").drop("_salt")


def _closest(rows: DataFrame, pivots: DataFrame, least: float, size: int, cell_rows: int) -> DataFrame:
    """``rows`` (key, root, sim, ...) with the closest of all pivots as root.

    A pivot closer to a member than its own lies within twice the angle of the farthest member from
    it. The pairs of pivots so near come from blocks in which every two pivots meet; only the members
    of their first pivot are compared with the second.
    """
    # float products of unit vectors can be off by some 1e-6: the angle is taken a little wider
    angle = rows.where("key <> root").groupBy("root").agg((F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.min("sim") - 1e-5)))).alias("far"))
    reach = pivots.select(F.col("key").alias("root"), "vec").join(angle, "root", "left").select(F.col("root").alias("key"), "vec", F.when(F.col("far").isNotNull(), F.cos(F.least(F.lit(np.pi), 2 * F.col("far")))).alias("hash"))
    n = pivots.count()
    sent = reach.select(F.lit(0).alias("cell"), "key", "hash", "vec") if n <= 2 * cell_rows else _all_pairs(reach, max(2, -(-n // (2 * cell_rows))))
    key_type = pivots.schema["key"].dataType

    def meet(table):
        import pyarrow as pa

        kind = table.schema.field("key").type
        low = table.column("hash").to_numpy(zero_copy_only=False)
        names = table.column("key").to_numpy(zero_copy_only=False)
        x = matrix(table.column("vec").combine_chunks(), size)
        own, other = [], []
        ask = np.nonzero(~np.isnan(low))[0]
        for s in range(0, len(ask), 512):
            rows_ = ask[s : s + 512]
            i, j = np.nonzero(x[rows_] @ x.T >= low[rows_][:, None])
            keep = rows_[i] != j
            own.append(rows_[i[keep]])
            other.append(j[keep])
        own, other = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (own, other))
        return pa.table([pa.array(names[own], kind), pa.array(names[other], kind), lists(x[other])], names=["root", "other", "pivot"])

    near = T.StructType([T.StructField("root", key_type), T.StructField("other", key_type), T.StructField("pivot", T.ArrayType(T.FloatType()))])
    pairs = sent.groupBy("cell").applyInArrow(meet, near)
    pairs = store(pairs.groupBy("root", "other").agg(F.min("pivot").alias("pivot")))
    tried = rows.where("key <> root").select("key", "root", "vec", "sim").join(pairs, "root").select("key", "other", "sim", _dot("vec", "pivot").alias("new"))
    better = tried.where(F.col("new") > F.col("sim") + 1e-6).groupBy("key").agg(F.max(F.struct("new", "other")).alias("m"))
    better = cut(better.select("key", F.col("m.other").alias("to"), F.col("m.new").alias("new")))
    if better.isEmpty():
        return rows
    return cut(rows.join(better, "key", "left").select("key", F.coalesce("to", "root").alias("root"), F.coalesce("new", "sim").alias("sim"), "vec", "hash"))


def similarity_clusters(
    df: DataFrame, key: str, vector: str, size: int, least: float = 0.835, block_rows: int = 16_384,
    cell_rows: int = 4_096, max_anchors: int = 2_048, margin: float = 0.1, quiet: int = 1, most: int = 24,
) -> DataFrame:
    """(key, root, sim, vec): the closest pivot of each record and the cosine to it, which is at least ``least``.

    Null, short, non-finite and zero vectors and null keys are left out; a key counts once, with
    its smallest vector; a record like no other is its own pivot; an empty table gives no rows. No
    two pivots are similar. The result depends on keys and vectors only through hash order and the
    blocks of the first step: where groups are cliques apart from one another it is the same for
    every partitioning. About ``max_anchors`` vectors a round are sent to the driver and the tasks.
    The last rounds compare all pivots that are left, so their work grows with the square of that
    number, in blocks of ``cell_rows``.
    """
    vecs = one_per_key(df, key, vector, size)
    key_type = vecs.schema["key"].dataType
    vec_type = T.StructField("vec", T.ArrayType(T.FloatType()))

    def units(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), lists(unit(matrix(b.column(1), size)))], names=["key", "vec"])

    rows = vecs.mapInArrow(units, T.StructType([T.StructField("key", key_type), vec_type])).withColumn("hash", F.xxhash64("key"))
    shape = T.StructType([T.StructField("key", key_type), T.StructField("root", key_type), T.StructField("sim", T.DoubleType()), T.StructField("hash", T.LongType()), vec_type])
    out = store(rows.select("key", "hash", "vec").mapInArrow(lambda b: _local(b, least, block_rows, size), shape))
    pivots = cut(out.where("key = root").select("key", "hash", "vec"))
    if pivots.isEmpty():
        return out.select("key", "root", "sim", "vec")

    def followed(of, absorbed):
        for a in absorbed:
            a = a.select(F.col("key").alias("at"), F.col("root").alias("to"))
            of = of.join(a, of["at"] == a["at"], "left").select("root", F.coalesce("to", of["at"]).alias("at"))
        return of

    def moved(out, pivots, absorbed):
        """``out`` with the roots that absorbed others, and the cosines to these."""
        was = out.where("key = root").select("root", F.col("root").alias("at"))
        of = followed(was, absorbed).where(F.col("root") != F.col("at"))
        of = store(of.join(pivots.select(F.col("key").alias("at"), F.col("vec").alias("pivot")), "at").select("root", "at", "pivot"))
        new = _by_root(out, of)
        sim = F.when(F.col("pivot").isNull(), F.col("sim")).otherwise(_dot("vec", "pivot"))
        return store(new.select("key", F.coalesce("at", "root").alias("root"), sim.alias("sim"), "hash", "vec"))

    pivots, absorbed = _merge(pivots, least, size, cell_rows, max_anchors, margin, quiet, most)
    if absorbed:
        out = moved(out, pivots, absorbed)
    far = out.where(F.col("sim") < least - 1e-5)
    # members that only a chain led to their pivot meet the pivots again, which come first and absorb one another no
    # more; the earliest of these members ends at a pivot like it or as a pivot, so each pass leaves fewer
    while not far.isEmpty():
        low = F.lit(-(1 << 63)).cast("long")
        both = pivots.select("key", low.alias("hash"), "vec").unionByName(far.select("key", "hash", "vec"))
        pivots, absorbed = _merge(cut(both), least, size, cell_rows, max_anchors, margin, quiet, most)
        loose = out.withColumn("root", F.when(F.col("sim") < least - 1e-5, F.col("key")).otherwise(F.col("root")))
        loose = store(loose.withColumn("sim", F.when(F.col("key") == F.col("root"), 1.0).otherwise(F.col("sim"))).select("key", "root", "sim", "hash", "vec"))
        out = moved(loose, pivots, absorbed) if absorbed else loose
        far = out.where(F.col("sim") < least - 1e-5)
    return _closest(out, pivots, least, size, cell_rows).select("key", "root", "sim", "vec")


def cluster_members(clusters: DataFrame, least_size: int = 3) -> DataFrame:
    """(key, cluster_key): members of clusters of at least ``least_size``, named by their smallest key."""
    names = clusters.groupBy("root").agg(F.min("key").alias("cluster_key"), F.count(F.lit(1)).alias("size"))
    names = store(names.where(F.col("size") >= least_size).select("root", "cluster_key"))
    return _by_root(clusters.select("key", "root"), names).where(F.col("cluster_key").isNotNull()).select("key", "cluster_key")


def describe_clusters(clusters: DataFrame, size: int, typical: int = 3, least_size: int = 2) -> DataFrame:
    """(cluster_key, size, medoid, typical, mean_similarity) of each cluster of ``least_size`` or more.

    The medoid is the member whose cosines to all members add up to most. As vectors have length one,
    that sum is the product with the sum of all members, so it is found exactly and without a pair;
    ``typical`` lists the next ones with it. Sums are made a partition at a time, so a hot cluster
    ships one sum a task.
    """
    key_type = clusters.schema["root"].dataType

    def sums(batches):
        import pyarrow as pa

        total: dict = {}
        kind = None
        for b in batches:
            if not b.num_rows:
                continue
            kind = b.column(0).type
            roots, index = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
            x = matrix(b.column(1), size).astype(np.float64)
            part = np.zeros((len(roots), size))
            np.add.at(part, index, x)
            for r, s in zip(roots.tolist(), part):
                total[r] = total[r] + s if r in total else s
            if len(total) > 50_000:
                yield _sum_batch(total, kind, size)
                total = {}
        if total:
            yield _sum_batch(total, kind, size)

    def add(table):
        import pyarrow as pa

        x = table.column("sum").combine_chunks().flatten().to_numpy().reshape(-1, size).sum(axis=0)
        x = x / max(np.linalg.norm(x), 1e-300)
        return pa.table([table.column("root").slice(0, 1), pa.array([x.tolist()], pa.list_(pa.float64()))], names=["root", "mean"])

    wide = Window.partitionBy("root").orderBy(F.desc("sim"), "key")
    sized = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.min("key").alias("cluster_key")).where(F.col("size") >= least_size)
    big = _by_root(clusters, store(sized)).where(F.col("size").isNotNull())
    part = T.StructType([T.StructField("root", key_type), T.StructField("sum", T.ArrayType(T.DoubleType()))])
    mean = T.StructType([T.StructField("root", key_type), T.StructField("mean", T.ArrayType(T.DoubleType()))])
    means = store(big.select("root", "vec").mapInArrow(sums, part).groupBy("root").applyInArrow(add, mean))
    near = store(_by_root(big, means).select("root", "cluster_key", "size", "key", F.round(_dot("vec", "mean"), 6).alias("sim")))
    top = near.select("root", "key", "sim").withColumn("r", F.row_number().over(wide)).where(F.col("r") <= typical)
    top = top.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "key"))), lambda s: s["key"]).alias("typical"))
    figures = near.groupBy("root", "cluster_key", "size").agg(F.round(F.avg("sim"), 6).alias("mean_similarity"))
    return figures.join(top, "root").select("cluster_key", "size", F.col("typical")[0].alias("medoid"), "typical", "mean_similarity")


def _sum_batch(total, kind, size):
    import pyarrow as pa

    flat = np.concatenate(list(total.values()))
    vec = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, size, dtype=np.int32)), pa.array(flat))
    return pa.RecordBatch.from_arrays([pa.array(list(total), kind), vec], names=["root", "sum"])
