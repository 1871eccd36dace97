"""Problem 5: a subset of given size that covers the variety of the data.

Method: cluster-feature tree. Records are condensed, bucket by bucket of their keys' hashes, to the
leaf entries (count, linear sum, square sum) of a tree of bounded size whose threshold grows when
the entries become too many; the summaries of the buckets are merged step by step; the leaf entries
are agglomerated by Ward linkage and cut at the number of groups wanted, and of the records whose
nearest entry belongs to a group, the one nearest to the group's centre is returned. The order of
acquisition is that of the linkage from the top: each further record stands for the group that the
next cut splits off. Where the budget is more than a tree can hold, groups are cells in which the
same is done again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thicketry.llm.vectors import lists, matrix, unit, usable
from thicketry.operators.relations import numbered
from thicketry.session import cut, store


class CFTree:
    """A cluster-feature tree of height two: nodes of at most ``branch`` leaf entries."""

    def __init__(self, size: int, most: int = 1024, branch: int = 32, threshold: float = 0.2):
        self.size, self.most, self.branch, self.t = size, most, branch, threshold
        self._empty()

    def _empty(self):
        self.n, self.ls, self.ss = np.zeros(0), np.zeros((0, self.size)), np.zeros(0)
        self.node = np.zeros(0, np.int64)
        self.nodes = 0

    def add(self, n: np.ndarray, ls: np.ndarray, ss: np.ndarray, chunk: int = 512) -> None:
        for s in range(0, len(n), chunk):
            self._add(n[s : s + chunk], ls[s : s + chunk], ss[s : s + chunk])
            while len(self.n) > self.most:
                old = self.n, self.ls, self.ss
                self.t = self._wider()
                self._empty()
                for k in range(0, len(old[0]), chunk):
                    self._add(*(x[k : k + chunk] for x in old))

    def _wider(self) -> float:
        """The threshold at which about three in ten of the entries merge with their nearest."""
        c = self.ls / self.n[:, None]
        d = (c * c).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * c @ c.T
        np.fill_diagonal(d, np.inf)
        j = d.argmin(1)
        m, s = self.n + self.n[j], self.ls + self.ls[j]
        r = np.sqrt(np.maximum(0, (self.ss + self.ss[j]) / m - (s * s).sum(1) / (m * m)))
        return max(self.t * 1.01, float(np.quantile(r, 0.3)))

    def _add(self, n, ls, ss):
        c = ls / n[:, None]
        at = np.full(len(n), -1)
        if len(self.n):
            held = self.ls / self.n[:, None]
            # down the tree: the nearest node, then the nearest of its entries
            total = np.zeros((self.nodes, self.size))
            np.add.at(total, self.node, self.ls)
            weight = np.bincount(self.node, self.n, self.nodes)
            mid = total / weight[:, None]
            down = ((mid * mid).sum(1) - 2 * c @ mid.T).argmin(1)
            for k in np.unique(down):
                rows, own = np.nonzero(down == k)[0], np.nonzero(self.node == k)[0]
                d = (held[own] * held[own]).sum(1) - 2 * c[rows] @ held[own].T
                at[rows] = own[d.argmin(1)]
            m = self.n[at] + n
            s = self.ls[at] + ls
            r2 = (self.ss[at] + ss) / m - (s * s).sum(1) / (m * m)
            fits = r2 <= self.t**2
            np.add.at(self.n, at[fits], n[fits])
            np.add.at(self.ls, at[fits], ls[fits])
            np.add.at(self.ss, at[fits], ss[fits])
            left = np.nonzero(~fits)[0]
        else:
            left = np.arange(len(n))
        new_n: list[float] = []
        new_ls: list[np.ndarray] = []
        new_ss: list[float] = []
        new_c = np.zeros((len(left), self.size))
        for i in left:
            if new_n:
                d = new_c[: len(new_n)] - c[i]
                j = int((d * d).sum(1).argmin())
                m, s = new_n[j] + n[i], new_ls[j] + ls[i]
                if (new_ss[j] + ss[i]) / m - s @ s / (m * m) <= self.t**2:
                    new_n[j], new_ls[j] = m, s
                    new_ss[j] += ss[i]
                    new_c[j] = s / m
                    continue
            new_c[len(new_n)] = c[i]
            new_n.append(float(n[i]))
            new_ls.append(ls[i].copy())
            new_ss.append(float(ss[i]))
        if new_n:
            self.n = np.concatenate([self.n, new_n])
            self.ls = np.concatenate([self.ls, np.stack(new_ls)])
            self.ss = np.concatenate([self.ss, new_ss])
            self._nodes()

    def _nodes(self):
        """Entries go to nodes around some of them, spread by farthest-first choice."""
        c = self.ls / self.n[:, None]
        want = max(1, -(-len(c) // self.branch))
        far = ((c - c[0]) ** 2).sum(1)
        near = np.zeros(len(c), np.int64)
        for k in range(1, want):
            i = int(far.argmax())
            d = ((c - c[i]) ** 2).sum(1)
            closer = d < far
            near[closer] = k
            far = np.minimum(far, d)
        _, self.node = np.unique(near, return_inverse=True)
        self.nodes = int(self.node.max()) + 1


def ward(n: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(group of each entry, turn of each group) of Ward agglomeration by nearest-neighbour chains, cut at k groups.

    Turns follow the linkage from the top down: the group with most records is first, and each cut
    gives the next turn to the largest group of the part that it splits off.
    """
    m = len(n)
    n, c, live = n.astype(float).copy(), c.copy(), np.ones(m, bool)
    count, sq = n.copy(), (c * c).sum(1)
    merges, chain = [], []

    def cost(i):
        d = np.maximum(0, sq + sq[i] - 2 * c @ c[i]) * n * n[i] / (n + n[i])
        d[~live] = np.inf
        d[i] = np.inf
        return d

    for _ in range(m - 1):
        if not chain:
            chain = [int(np.nonzero(live)[0][0])]
        while True:
            d = cost(chain[-1])
            j = int(d.argmin())
            if len(chain) > 1 and d[chain[-2]] <= d[j]:
                j = chain[-2]
            if len(chain) > 1 and j == chain[-2]:
                break
            chain.append(j)
        a, b = chain.pop(), chain.pop()
        merges.append((float(d[b]), len(merges), a, b))
        total = n[a] + n[b]
        c[b] = (n[a] * c[a] + n[b] * c[b]) / total
        sq[b] = c[b] @ c[b]
        n[b] = total
        live[a] = False
    parent = np.arange(m)

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    # a merge folds group a into b: the cheapest m - k make the groups, the others the order
    merges.sort()
    for _, _, a, b in merges[: max(0, m - k)]:
        parent[find(a)] = find(b)
    label = np.unique([find(i) for i in range(m)], return_inverse=True)[1]
    size = np.bincount(label, count)
    leader = {find(i): int(label[i]) for i in range(m)}
    splits = []
    for _, _, a, b in merges[max(0, m - k) :]:
        x, y = find(a), find(b)
        low, high = sorted((leader.pop(x), leader.pop(y)), key=lambda g: (size[g], -g))
        parent[x] = y
        leader[y] = high
        splits.append(low)
    order = [*leader.values(), *splits[::-1]]
    turn = np.empty(len(size), np.int64)
    turn[order] = np.arange(len(size))
    return label, turn


def quotas(sizes: dict, budget: int) -> dict:
    """Shares by the square root of sizes, largest remainders first, none beyond its size, one at least where the budget allows."""
    left = {s: 0 for s in sizes}
    order = sorted(sizes, key=lambda s: (sizes[s], s))
    todo = min(budget, sum(sizes.values()))
    for s in order[:todo]:
        left[s] = 1
    todo -= sum(left.values())
    while todo > 0:
        open_ = [s for s in order if left[s] < sizes[s]]
        total = sum(sizes[s] ** 0.5 for s in open_)
        raw = {s: todo * sizes[s] ** 0.5 / total for s in open_}
        give = {s: min(sizes[s] - left[s], int(raw[s])) for s in open_}
        if not any(give.values()):
            for s in sorted(open_, key=lambda s: (-(raw[s] % 1), s))[:todo]:
                give[s] = 1
        for s, g in give.items():
            left[s] += g
            todo -= g
    return left


def varied_subset(df: DataFrame, key: str, stratum: str, vector: str, size: int, budget: int, most_entries: int = 2048, bucket_rows: int = 6_144, fan: int = 16, threshold: float = 0.36, block_bytes: int = 64 << 20) -> DataFrame:
    """(key, stratum, selection_order, group_size): exactly ``budget`` records in an order of acquisition.

    Null, short, non-finite and zero vectors and null keys are left out; a key counts once, with its
    smallest vector and stratum; a null stratum is one of its own (the empty string); with fewer
    records than ``budget`` all come out. Where there are fewer groups than that (records within
    ``threshold``, a root mean square distance, are look-alikes and one entry), the next nearest
    records of the groups fill the subset up, group by group in turns, last in order. A stratum that
    no group's record comes from takes over the group that one of its (64 most central) records
    belongs to, if that group's stratum has another. The result depends on keys and vectors only,
    not on partitions or batches.

    A task holds a bucket of some ``bucket_rows`` records or at most ``fan`` summaries of
    ``most_entries``; a budget beyond a third of ``most_entries`` is divided over cells by the
    square root of their sizes. Entries are sent to the tasks in blocks of ``block_bytes``, one pass
    over the records of those cells each; the driver holds one block and one count a cell. Strata
    must be few.
    """
    ok = df.select(F.col(key).alias("key"), F.col(stratum).alias("stratum"), F.col(vector).cast("array<float>").alias("vec")).where(F.col("key").isNotNull())
    one = ok.groupBy("key").agg(F.min(F.when(usable("vec", size), F.col("vec"))).alias("vec"), F.coalesce(F.min("stratum"), F.lit("")).alias("stratum")).where("vec is not null")
    key_type = one.schema["key"].dataType
    vec_field = T.StructField("vec", T.ArrayType(T.FloatType()))

    def units(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists(unit(matrix(b.column(2), size)))], names=["key", "stratum", "vec"])

    rows = store(one.select("key", "stratum", "vec").mapInArrow(units, T.StructType([T.StructField("key", key_type), T.StructField("stratum", T.StringType()), vec_field])))
    final = T.StructType([T.StructField("key", key_type), T.StructField("stratum", T.StringType()), T.StructField("selection_order", T.IntegerType()), T.StructField("group_size", T.LongType())])
    n = rows.count()
    budget = min(budget, n)
    if budget <= 0:
        return df.sparkSession.createDataFrame([], final)

    # cells: one at first; those with too much to choose are split by their own groups
    held, sizes, wanted, spots, groups, lowest = rows.withColumn("cell", F.lit(0)), {0: n}, {0: budget}, [], [], 0
    cap = max(1, most_entries // 3)
    while wanted:
        entries = _entries(held, wanted, max(sizes[c] for c in wanted), size, most_entries, bucket_rows, fan, threshold, cap)
        least, spread = min(wanted), {}
        summary = entries.groupBy("cell").agg(F.max("final").alias("final"), F.count(F.lit(1)).alias("n"))
        blocks, full = [[]], 0
        for r in sorted(summary.collect(), key=lambda r: r["cell"]):
            spread[r["cell"]] = r["final"]
            if full and full + r["n"] * size * 8 > block_bytes:
                blocks.append([])
                full = 0
            blocks[-1].append(r["cell"])
            full += r["n"] * size * 8
        moved = []
        for block in blocks:
            found = _assigned(held, entries, block[0], block[-1], size, key_type)
            done = [c for c in block if spread[c]]
            if done:
                spots.append(found.where(F.col("cell").isin(done)).drop("vec"))
            if len(done) < len(block):
                moved.append(found.where(~F.col("cell").isin(done)))
        groups.append(entries.where("final").select("cell", "group", "turn").distinct())
        wanted, parents = {}, wanted
        if moved:
            from functools import reduce

            top = max(sizes) + 1
            child = (F.col("cell") - least) * most_entries + F.col("group") + top
            held = store(reduce(DataFrame.unionByName, moved).select("key", "stratum", "vec", child.cast("int").alias("next"), "cell"))
            counted: dict = {}
            for r in held.groupBy("cell", "next").count().collect():
                counted.setdefault(r["cell"], {})[r["next"]] = r["count"]
            sizes = {}
            for c, own in sorted(counted.items()):
                sizes |= own
                wanted |= quotas(own, parents[c])
            # numbers close up, so that they stay small
            place = {c: top + i for i, c in enumerate(sorted(sizes))}
            names = df.sparkSession.createDataFrame(list(place.items()), "next int, cell int")
            held = held.drop("cell").join(F.broadcast(names), "next").drop("next")
            sizes, wanted = {place[c]: x for c, x in sizes.items()}, {place[c]: x for c, x in wanted.items()}
    return _chosen(_union(spots), _union(groups), budget, final)


def _union(frames):
    from functools import reduce

    return store(reduce(DataFrame.unionByName, frames))


_ENTRY = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("n", T.DoubleType()), T.StructField("ls", T.ArrayType(T.DoubleType())), T.StructField("ss", T.DoubleType())])
_GROUPED = T.StructType(
    [
        T.StructField("cell", T.IntegerType()), T.StructField("final", T.BooleanType()), T.StructField("group", T.IntegerType()), T.StructField("turn", T.IntegerType()), T.StructField("entry", T.ArrayType(T.FloatType())),
        T.StructField("centre", T.ArrayType(T.FloatType())),
    ]
)


def _entries(rows, wanted, largest, size, most_entries, bucket_rows, fan, threshold, cap):
    """(cell, final, group, turn, entry, centre): the leaf entries of each cell's tree with their Ward groups."""

    def tree(cell):
        return CFTree(size, min(most_entries, max(256, 3 * wanted[cell])), threshold=threshold)

    def packed(t, cell, bucket):
        import pyarrow as pa

        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, t.ls.size + 1, size, dtype=np.int32)), pa.array(t.ls.ravel()))
        whole = lambda x: pa.array(np.full(len(t.n), x, np.int32))
        return pa.table([whole(cell), whole(bucket), pa.array(t.n), flat, pa.array(t.ss)], names=_ENTRY.names)

    def condense(table):
        table = table.sort_by("key")
        cell, bucket = table.column("cell")[0].as_py(), table.column("bucket")[0].as_py()
        x = matrix(table.column("vec").combine_chunks(), size).astype(np.float64)
        t = tree(cell)
        t.add(np.ones(len(x)), x, (x * x).sum(1))
        return packed(t, cell, bucket)

    def read(table):
        ls = table.column("ls").combine_chunks().flatten().to_numpy().reshape(-1, size)
        n, ss = table.column("n").to_numpy(), table.column("ss").to_numpy()
        order = np.lexsort((ss, *ls.T, -n))
        return n[order], ls[order], ss[order]

    def merge(table):
        cell = table.column("cell")[0].as_py()
        t = tree(cell)
        t.add(*read(table))
        return packed(t, cell, table.column("bucket")[0].as_py())

    def group(table):
        import pyarrow as pa

        cell = table.column("cell")[0].as_py()
        n, ls, _ = read(table)
        final = wanted[cell] <= cap or len(n) <= cap
        label, turn = ward(n, ls / n[:, None], min(wanted[cell], len(n)) if final else max(2, most_entries // 8))
        total = np.zeros((len(turn), size))
        np.add.at(total, label, ls)
        centre = total / np.bincount(label, n)[:, None]
        whole = lambda x: pa.array(np.asarray(x, np.int32))
        return pa.table([whole(np.full(len(n), cell)), pa.array(np.full(len(n), final)), whole(label), whole(turn[label]), lists(ls / n[:, None]), lists(centre[label])], names=_GROUPED.names)

    buckets = max(1, -(-largest // bucket_rows))
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket")
    parts = rows.select("cell", bucket, "key", "vec").groupBy("cell", "bucket").applyInArrow(condense, _ENTRY)
    while buckets > 1:
        parts = cut(parts).withColumn("bucket", F.floor(F.col("bucket") / fan).cast("int")).groupBy("cell", "bucket").applyInArrow(merge, _ENTRY)
        buckets = -(-buckets // fan)
    return store(parts.groupBy("cell").applyInArrow(group, _GROUPED))


def _assigned(rows, entries, first, last, size, key_type):
    """(cell, group, stratum, key, dist, vec): the group of each record's nearest entry, and the distance to the group's centre."""
    part = entries.where(F.col("cell").between(first, last)).select("cell", "group", "entry", "centre").toArrow()
    cell = part.column("cell").to_numpy()
    every = (part.column("group").to_numpy(), matrix(part.column("entry").combine_chunks(), size), matrix(part.column("centre").combine_chunks(), size))
    shared = rows.sparkSession.sparkContext.broadcast({int(c): tuple(x[cell == c] for x in every) for c in np.unique(cell)})
    shape = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("group", T.IntegerType()), T.StructField("stratum", T.StringType()), T.StructField("key", key_type), T.StructField("dist", T.DoubleType()), T.StructField("vec", T.ArrayType(T.FloatType()))])

    def assign(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            cells = b.column(0).to_numpy()
            x = matrix(b.column(3), size)
            grp, dist = np.zeros(len(cells), np.int32), np.zeros(len(cells))
            for c in np.unique(cells):
                own = np.nonzero(cells == c)[0]
                label, entry, centre = shared.value[int(c)]
                half = (entry * entry).sum(1) / 2
                for s in range(0, len(own), 2048):
                    r = own[s : s + 2048]
                    at = (np.round(half - x[r] @ entry.T, 5)).argmin(1)
                    grp[r] = label[at]
                    dist[r] = np.round(((x[r].astype(np.float64) - centre[at]) ** 2).sum(1), 9)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(grp), b.column(1), b.column(2), pa.array(dist), b.column(3)], names=shape.names)

    return rows.where(F.col("cell").between(first, last)).select("cell", "stratum", "key", "vec").mapInArrow(assign, shape)


def _chosen(spots, groups, budget, final):
    """The record nearest to the centre of each group in the order of the groups' turns; then what fills the budget up."""
    by = ["cell", "group"]
    best = F.min(F.struct("dist", "key", "stratum")).alias("m")
    first = spots.groupBy(*by).agg(best, F.count(F.lit(1)).alias("group_size")).join(groups, by)
    first = store(first.select(*by, "turn", F.col("m.key").alias("key"), F.col("m.stratum").alias("stratum"), "group_size"))
    first = _reach(spots, first, by)
    have = first.count()
    out = first.withColumn("r", F.lit(0).cast("bigint"))
    if have < budget:
        # ranks of the others within their groups, and how many turns all groups can take
        rest = numbered(spots.join(first.select("key"), "key", "left_anti").select(*by, "dist", "key", "stratum"), *by, "dist", "key")
        sizes = rest.groupBy(*by).agg(F.count(F.lit(1)).alias("s"), F.min("position").alias("_first"))
        counts = sorted((r["s"], r["g"]) for r in sizes.groupBy("s").agg(F.count(F.lit(1)).alias("g")).collect())
        missing, turns, open_ = budget - have, 0, sum(g for _, g in counts)
        for s, g in counts:
            if open_ * (s - turns) > missing:
                break
            missing -= open_ * (s - turns)
            turns, open_ = s, open_ - g
        if open_:
            turns, missing = turns + missing // open_, missing % open_
        rest = rest.join(sizes, by).withColumn("r", F.col("position") - F.col("_first") + 1).where(F.col("r") <= turns + 1)
        rest = store(rest.join(first.select(*by, "turn", "group_size"), by).select(*by, "turn", "key", "stratum", "group_size", "r"))
        last = numbered(rest.where(F.col("r") == turns + 1), "turn", "cell").where(F.col("position") < missing).drop("position")
        out = out.select(*rest.columns).unionByName(rest.where(F.col("r") <= turns)).unionByName(last)
    out = numbered(out, "r", "turn", "cell")
    return out.select("key", "stratum", F.col("position").cast("int").alias("selection_order"), "group_size").to(final)


def _reach(spots, first, by):
    """``first`` with a record of each stratum that none of its groups chose, where one can give way."""
    have = {r["stratum"]: r["count"] for r in first.groupBy("stratum").count().collect()}
    lacking = sorted(r["stratum"] for r in spots.select("stratum").distinct().collect() if r["stratum"] not in have)
    if not lacking:
        return first
    near = spots.where(F.col("stratum").isin(lacking)).groupBy("stratum", *by).agg(F.min(F.struct("dist", "key")).alias("m"))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("stratum").orderBy("m", *by))).where("r <= 64")
    near = near.join(first.select(*by, F.col("stratum").alias("own")), by).orderBy("stratum", "r").collect()
    swaps: dict = {}
    for s in lacking:
        for r in near:
            if r["stratum"] == s and (r["cell"], r["group"]) not in swaps and have[r["own"]] > 1:
                swaps[r["cell"], r["group"]] = (r["m"]["key"], s)
                have[r["own"]] -= 1
                break
    if not swaps:
        return first
    shape = T.StructType([*(first.schema[c] for c in by), T.StructField("_k", first.schema["key"].dataType), T.StructField("_s", T.StringType())])
    new = first.sparkSession.createDataFrame([(*g, *k) for g, k in swaps.items()], shape)
    out = first.join(F.broadcast(new), by, "left")
    return store(out.select(*by, "turn", F.coalesce("_k", "key").alias("key"), F.coalesce("_s", "stratum").alias("stratum"), "group_size"))
