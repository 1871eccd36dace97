"""Catalog relations: uniqueness, lookups, semi and anti joins, set operations, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that stand more than once, with their number."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` itself; raises on the driver if a key stands twice, naming the three smallest."""
    bad = duplicates(df, *keys).orderBy(*keys).limit(3).collect()
    if bad:
        raise ValueError(f"repeated keys: {[tuple(r)[:-1] for r in bad]}")
    return df


def first_per_key(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def strict_lookup(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that must find every left row: the query fails on the first that has none."""
    marked = left.join(right.withColumn("_found", F.lit(True)), key, "left")
    found = F.when(F.col("_found"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no match for "), F.col(key).cast("string"))).cast("boolean"))
    return marked.where(found).drop("_found")


def coalesced_lookup(left: DataFrame, keys: list[str], table: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """The value of the first of several left keys that the table knows, by one join over exploded keys."""
    left = left.withColumn("_id", F.struct(*left.columns))
    tried = left.select("_id", F.posexplode(F.array(*keys)).alias("_p", "_k")).where("_k is not null").distinct()
    hit = tried.join(table.select(F.col(key).alias("_k"), F.col(value).alias("_v")), "_k").groupBy("_id").agg(F.min_by("_v", "_p").alias(out))
    return left.join(hit, "_id", "left").drop("_id")


def semi_by_either(df: DataFrame, key: str, other_key: str, wanted: DataFrame, column: str) -> DataFrame:
    """Rows whose key or other key is wanted: two equi semi joins in place of a join on OR."""
    w = wanted.select(F.col(column).alias("_w")).where("_w is not null").distinct()
    a = df.join(w, df[key] == w["_w"], "left_semi")
    b = df.join(w, df[key] == w["_w"], "left_anti").join(w, F.col(other_key) == F.col("_w"), "left_semi")
    return a.unionByName(b)


def resolve_names(names: DataFrame, name: str, catalog: DataFrame, key: str) -> DataFrame:
    """(name, resolved, kind): by exact key, by key without ending, by a stem that stands once; else ``ambiguous`` or ``unknown``."""
    keys = catalog.select(F.col(key).alias("_k")).where("_k is not null").distinct()
    n = names.select(F.col(name).alias("name")).where("name is not null").distinct()
    n = n.withColumn("_bare", F.regexp_replace("name", r"(?i)\.(png|jpe?g)$", "")).withColumn("_stem", F.substring_index("_bare", "/", -1))
    stems = keys.groupBy(F.substring_index("_k", "/", -1).alias("_stem")).agg(F.count(F.lit(1)).alias("_n"), F.min("_k").alias("_by_stem"))
    out = n.join(keys.select(F.col("_k").alias("_exact")), F.col("name") == F.col("_exact"), "left")
    out = out.join(keys.select(F.col("_k").alias("_noext")), F.col("_bare") == F.col("_noext"), "left").join(stems, "_stem", "left")
    resolved = F.coalesce("_exact", "_noext", F.when(F.col("_n") == 1, F.col("_by_stem")))
    kind = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_noext").isNotNull(), "ending").when(F.col("_n") == 1, "stem").when(F.col("_n") > 1, "ambiguous").otherwise("unknown")
    return out.select("name", resolved.alias("resolved"), kind.alias("kind"))


def cyclic_zip(drive: DataFrame, drive_key: str, cycle: DataFrame, cycle_key: str, buckets: int = 256) -> DataFrame:
    """(drive key, cycle key, position): the driving rows in key order, the other side again and again.

    Positions come from a ranged two-step numbering, so no task sorts the whole driving side.
    """
    d, c = numbered(drive.select(drive_key), drive_key), numbered(cycle.select(cycle_key), cycle_key)
    n = cycle.agg(F.count(F.lit(1)).alias("_n"))
    d = d.crossJoin(F.broadcast(n)).withColumn("_slot", F.pmod("position", F.greatest("_n", F.lit(1))))
    return d.join(c.withColumnRenamed("position", "_slot"), "_slot").select(drive_key, cycle_key, "position")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Adds ``position`` from 0 in the given order; rows equal in all of it stand in any order, once.

    Rows are ranged and sorted, numbered within their range, and written once with the number of
    the range, so that the counts before each range and the rows come from the same ranges however
    often they are read. Null comes first. The counts, one row a range, are all that is broadcast.
    """
    from thicketry.session import store

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    ranged = store(ranged.withColumn("_part", F.shiftright("_m", 33)).withColumn("_row", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m"))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn("_before", F.sum("_c").over(Window.orderBy("_part")) - F.col("_c")).select("_part", "_before")
    return ranged.join(F.broadcast(before), "_part").withColumn("position", F.col("_before") + F.col("_row")).drop("_part", "_row", "_before")


def join_groups(df: DataFrame, of_groups: DataFrame, group: list[str]) -> DataFrame:
    """Inner join of rows with one row a group, in which a null is a group too; without group columns, the one row there is."""
    if not group:
        return df.crossJoin(F.broadcast(of_groups))
    right = of_groups.withColumnsRenamed({g: f"_of_{g}" for g in group})
    on = [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in group]
    return df.join(right, on).drop(*(f"_of_{g}" for g in group))


def lagged(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds the value of the row before in the group, null for the first, by a join on numbers over ranges: no group is sorted in one task."""
    rows = numbered(df, *group, *order)
    before = rows.select((F.col("position") + 1).alias("position"), *(F.col(g).alias(f"_{g}") for g in group), F.col(value).alias("_v"))
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return rows.join(before, "position", "left").withColumn(out, F.when(same, F.col("_v"))).select(*df.columns, out)


def replicated(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` for a broadcast join, after a count: more than ``most_rows`` rows are an error, not a broadcast."""
    n = df.limit(most_rows + 1).count()
    if n > most_rows:
        raise ValueError(f"more than {most_rows} rows to replicate")
    return F.broadcast(df)


def difference(a: DataFrame, b: DataFrame, key: str, preview: int = 3) -> DataFrame:
    """One row: how many keys each side has alone, and the first few of them."""
    both = a.select(key, F.lit(1).alias("_a")).unionByName(b.select(key, F.lit(2).alias("_a"))).groupBy(key).agg(F.bit_or("_a").alias("_s"))
    alone = both.where("_s < 3")
    ranked = alone.withColumn("_r", F.row_number().over(Window.partitionBy("_s").orderBy(key)))
    first = lambda s: F.array_join(F.array_sort(F.collect_list(F.when((F.col("_s") == s) & (F.col("_r") <= preview), F.col(key)))), ",")
    counts = alone.agg(F.count(F.when(F.col("_s") == 1, 1)).alias("missing"), F.count(F.when(F.col("_s") == 2, 1)).alias("extra"))
    some = ranked.where(F.col("_r") <= preview).agg(first(1).alias("missing_first"), first(2).alias("extra_first"))
    return counts.crossJoin(some)


def same_bag(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same rows equally often."""
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def split_report(lists: DataFrame, catalog: DataFrame, group: list[str], key: str, budget: str) -> DataFrame:
    """Per list: rows, distinct keys, keys the catalog does not hold, and whether the budget is met exactly."""
    keys = catalog.select(F.col(key).alias("_k")).where("_k is not null").distinct()
    counts = lists.groupBy(*group, key).agg(F.count(F.lit(1)).alias("_n"), F.max(budget).alias("_b"))
    marked = counts.join(keys.withColumn("_in", F.lit(1)), counts[key] == F.col("_k"), "left")
    return marked.groupBy(*group).agg(
        F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.count(F.when(F.col("_in").isNull(), 1)).alias("n_unknown"), (F.count(F.lit(1)) == F.max("_b")).alias("exact"),
    )


def nesting_report(lists: DataFrame, run: str, level: str, key: str) -> DataFrame:
    """Per run and level: the distinct keys, and how many of them the next level lacks (0 where nested, null at the last)."""
    d = lists.select(run, level, key).distinct()
    levels = d.groupBy(run).agg(F.array_sort(F.collect_set(level)).alias("_l"))
    per = d.groupBy(run, key).agg(F.collect_set(level).alias("_s")).join(levels, run)
    pairs = per.select(run, key, "_l", "_s", F.explode("_s").alias(level))
    at = F.array_position("_l", F.col(level))
    nxt = F.when(at < F.size("_l"), F.get("_l", at.cast("int")))
    pairs = pairs.withColumn("_next", nxt)
    return pairs.groupBy(run, level).agg(F.count(F.lit(1)).alias("n_keys"), F.max(F.when(F.col("_next").isNotNull(), F.lit(0))).alias("_has"), F.count(F.when(F.col("_next").isNotNull() & ~F.array_contains("_s", F.col("_next")), 1)).alias("_lost")).select(
        run, level, "n_keys", F.when(F.col("_has") == 0, F.col("_lost")).alias("lost")
    )


def first_failed(*rules: tuple[str, Column]) -> Column:
    """The reason of the first rule that does not hold, null if all do. A null condition does not hold."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(why)) for why, ok in rules))


def running_counts(df: DataFrame, run: list[str], order: Column, group: str) -> DataFrame:
    """Adds how many rows of the same group stand up to each row, in the order of its run."""
    w = Window.partitionBy(*run, group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.count(F.lit(1)).over(w))


def broken_references(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose reference is not null and not held by the parent."""
    p = parent.select(F.col(key).alias("_p")).distinct()
    return child.where(F.col(column).isNotNull()).join(p, F.col(column) == F.col("_p"), "left_anti")


def follow_pointer(left: DataFrame, pointer: str, right: DataFrame, key: str, checks: list[tuple[str, str]], values: list[str]) -> DataFrame:
    """Left join by pointer and further equalities; ``found`` is false, and values null, where nothing matches."""
    r = right.select(F.col(key).alias("_p"), *(F.col(b).alias(f"_c{i}") for i, (_, b) in enumerate(checks)), *values)
    on = F.col(pointer) == F.col("_p")
    for i, (a, _) in enumerate(checks):
        on = on & (F.col(a) == F.col(f"_c{i}"))
    return left.join(r, on, "left").withColumn("found", F.col("_p").isNotNull()).drop("_p", *(f"_c{i}" for i in range(len(checks))))
