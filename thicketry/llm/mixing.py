"""Problem 1: a sample whose shares per category follow given targets.

Method: systematic unequal-probability sampling. Within a pool the records stand by category and,
within it, in random (hash) order; their inclusion probabilities are summed up across partitions;
from one random start, the records at which the sum crosses a whole number are taken. The floors
of small categories are repaired afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicketry.session import store


def _targets(targets: DataFrame) -> DataFrame:
    """One row per pool and category: the wanted number, the floor, the budget. Repeated rows count once."""
    t = targets.where(F.col("pool").isNotNull() & F.col("category").isNotNull())
    wanted = F.round(F.coalesce("share", F.lit(0.0)) * F.coalesce("budget", F.lit(0)).cast("double"), 0).cast("bigint")
    t = t.select("pool", "category", F.greatest(F.lit(0).cast("bigint"), wanted).alias("wanted"), F.greatest(F.lit(0), F.coalesce("floor", F.lit(0))).cast("bigint").alias("floor"), F.coalesce("budget", F.lit(0)).cast("bigint").alias("budget"))
    return t.groupBy("pool", "category").agg(F.max("wanted").alias("wanted"), F.max("floor").alias("floor"), F.max("budget").alias("budget"))


def _number(text, digits: int = 15):
    """A number from the md5 of a text, the same in any engine."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


def sample_to_mix(records: DataFrame, targets: DataFrame, seed: int = 17, buckets: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(sample, report) of ``records`` (pool, category, id) against ``targets`` (pool, category, share, budget, floor).

    ``sample`` has (pool, category, id); ``report`` one row per target with the available and wanted
    numbers, those ``drawn`` (hits of the systematic sample, and what lifts a category to its floor),
    those ``taken`` after the surplus of floors went back, and ``unmet``: the draw fell short of
    share x budget (rounded) or of the floor, which it does only where the pool has no more. A record
    counts once; rows with a null in pool, category or id are left out; a null share, budget or floor
    asks for none; a category that no target names has probability zero. The same seed gives the
    same sample for every partitioning: the order is a hash of the record. A hot pool or category is
    split into ``buckets`` hash ranges, ranked one by one; only their counts are summed up over a
    pool. What a record's rank makes of it is arithmetic, so no category's sample is ranked again.
    The sample of a pool has its budget, as far as targets and supply allow; floors come first.
    """
    t = _targets(targets)
    rows = records.where(F.col("pool").isNotNull() & F.col("category").isNotNull() & F.col("id").isNotNull()).select("pool", "category", F.col("id").cast("string").alias("_id"), "id").distinct()
    bits = max(0, buckets.bit_length() - 1)
    rows = rows.withColumn("_h", _number(F.concat(F.lit(f"{seed}|"), "_id"))).drop("_id")
    rows = store(rows.withColumn("_b", F.shiftright("_h", 60 - bits).cast("int") if bits else F.lit(0)))
    # counts per hash range, summed up: what stands before each range in its category
    count = rows.groupBy("pool", "category", "_b").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("pool", "category")
    count = store(count.withColumn("before", F.sum("n").over(w.orderBy("_b")) - F.col("n")).withColumn("available", F.sum("n").over(w)))
    strata = count.groupBy("pool", "category").agg(F.max("available").alias("available"))
    none = F.lit(0).cast("bigint")
    plan = t.join(strata, ["pool", "category"], "left").withColumn("available", F.coalesce("available", none))
    # probabilities wanted / available, at most one, add up to a whole number a category
    plan = plan.withColumn("mass", F.least("wanted", "available")).withColumn("p", F.when(F.col("available") > 0, F.col("mass") / F.col("available")).otherwise(0.0))
    # one random start a pool, and the sum of probabilities before each category
    start = _number(F.concat(F.lit(f"{seed}|"), F.col("pool").cast("string")), 5) / F.lit(float(1 << 20))
    plan = plan.withColumn("base", (F.sum("mass").over(Window.partitionBy("pool").orderBy("category")) - F.col("mass")) + start)
    # repair: floors up, then the surplus of a pool goes back, in proportion to what exceeds the floors
    plan = plan.withColumn("least", F.least("floor", "available")).withColumn("kept", F.greatest("mass", "least")).withColumn("slack", F.col("kept") - F.col("least"))
    pool = Window.partitionBy("pool")
    plan = plan.withColumn("over", F.least(F.sum("slack").over(pool), F.greatest(none, F.sum("kept").over(pool) - F.max("budget").over(pool))))
    part = F.when(F.sum("slack").over(pool) > 0, F.col("over") * F.col("slack") / F.sum("slack").over(pool)).otherwise(0.0)
    plan = plan.withColumn("part", F.round(part, 6)).withColumn("back", F.floor("part"))
    more = F.row_number().over(pool.orderBy(F.desc(F.col("part") - F.col("back")), "category")) <= F.col("over") - F.sum("back").over(pool)
    plan = store(plan.withColumn("take", F.col("kept") - F.col("back") - F.when(more & (F.col("slack") > F.col("back")), 1).otherwise(0)))
    # rank within the category = rank within the hash range + what stands before the range
    steps = plan.where("kept > 0").select("pool", "category", "p", "base", "mass", "kept", "take")
    ranges = count.select("pool", "category", "_b", "before").join(steps, ["pool", "category"])
    ranked = rows.join(ranges, ["pool", "category", "_b"]).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("pool", "category", "_b").orderBy("_h", "id")) - 1)
    # the sum crosses a whole number at a hit; ``hits`` of those stand before the record
    crossed = lambda r: F.floor(F.round(F.col("base") + r * F.col("p"), 6)) - F.floor(F.round("base", 6))
    ranked = ranked.withColumn("hits", crossed(F.col("rank"))).withColumn("hit", crossed(F.col("rank") + 1) > F.col("hits"))
    ranked = ranked.withColumn("place", F.when(F.col("hit"), F.col("hits")).otherwise(F.col("mass") + F.col("rank") - F.col("hits")))
    drawn = ranked.where(F.col("place") < F.col("kept"))
    sample = drawn.where(F.col("place") < F.col("take")).select("pool", "category", "id")
    counts = drawn.groupBy("pool", "category").agg(F.count(F.lit(1)).alias("drawn"), F.count(F.when(F.col("place") < F.col("take"), 1)).alias("taken"))
    report = plan.join(counts, ["pool", "category"], "left").withColumn("drawn", F.coalesce("drawn", none)).select(
        "pool", "category", "budget", "wanted", "floor", "available", "drawn", F.coalesce("taken", none).alias("taken"), ((F.col("drawn") < F.col("wanted")) | (F.col("drawn") < F.col("floor"))).alias("unmet"),
    )
    return sample, report
