"""A memory bank of parents and children: checks, concatenation with pointers moved, size, snapshots, and what to do without one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def violations(df: DataFrame, group: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row a group: its rows, and how many break each rule; a null condition breaks it. One pass, added up map-side."""
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n_rows"), *(F.count(F.when(~F.coalesce(ok, F.lit(False)), 1)).alias(name) for name, ok in rules.items()))


def repeated_rows(df: DataFrame, group: list[str], keys: list[str], out: str = "n_repeated") -> DataFrame:
    """One row a group: how many rows repeat a key of it. Groups without any have 0."""
    n = df.groupBy(*group, *(k for k in keys if k not in group)).agg((F.count(F.lit(1)) - 1).alias("_m"))
    return n.groupBy(*group).agg(F.sum("_m").alias(out))


def missing_references(df: DataFrame, group: list[str], column: str, parent: DataFrame, key: str, out: str = "n_unknown") -> DataFrame:
    """One row a group: how many of its rows refer to a key that the parent does not hold; a null reference is none."""
    p = parent.select(F.col(key).alias("_p")).distinct().withColumn("_there", F.lit(True))
    return df.join(p, F.col(column) == F.col("_p"), "left").groupBy(*group).agg(F.count(F.when(F.col(column).isNotNull() & F.col("_there").isNull(), 1)).alias(out))


def appended(banks: Sequence[DataFrame], index: str, pointers: Sequence[str]) -> DataFrame:
    """The rows of several banks in one, with the index and the pointers of each moved beyond the banks before it.

    A pointer below 0 points nowhere and stays. One aggregate row a bank fixes the offsets; an empty
    bank moves nothing.
    """
    from functools import reduce

    out, before = [], 0
    for b in banks:
        move = lambda c, k=before: F.when(F.col(c) >= 0, F.col(c) + F.lit(k)).otherwise(F.col(c))
        out.append(b.withColumns({c: move(c).cast("bigint") for c in (index, *pointers)}))
        top = b.agg(F.max(index)).first()[0]
        before += 0 if top is None else int(top) + 1
    return reduce(DataFrame.unionByName, out)


def stored_bytes(df: DataFrame, group: list[str], arrays: dict[str, int]) -> DataFrame:
    """One row a group: ``n_bytes`` of the distinct arrays of its rows, with the bytes of one value given for each column."""
    parts = [df.select(*group, F.lit(c).alias("_c"), F.xxhash64(c).alias("_a"), F.xxhash64(F.lit("second"), c).alias("_b"), (F.size(c) * w).cast("bigint").alias("_n")).where(F.col(c).isNotNull()) for c, w in arrays.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    one = rows.groupBy(*group, "_c", "_a", "_b").agg(F.max("_n").alias("_n"))
    return one.groupBy(*group).agg(F.sum("_n").alias("n_bytes"))


def admitted(banks: DataFrame, refused: Column, strict: bool, diagnostic: bool = False) -> DataFrame:
    """Adds ``decision``: ``use`` where nothing is refused, else ``without``; ``fail`` if ``strict`` and not ``diagnostic``."""
    other = "fail" if strict and not diagnostic else "without"
    return banks.withColumn("decision", F.when(refused.isNull(), "use").otherwise(other))


def load_bank(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of a bank by name; raises, naming all that is wrong, if a table or column is missing or of another type."""
    from pyspark.sql import types as T

    from thicketry.sources.files import exists

    wrong, out = [], {}
    for name, ddl in schemas.items():
        if not exists(spark, f"{path}/{name}"):
            wrong.append(f"no table {name}")
            continue
        df = spark.read.parquet(f"{path}/{name}")
        have = {f.name: f.dataType.simpleString() for f in df.schema}
        for f in T.StructType.fromDDL(ddl):
            if have.get(f.name) != f.dataType.simpleString():
                wrong.append(f"{name}.{f.name}: {have.get(f.name, 'missing')} in place of {f.dataType.simpleString()}")
        out[name] = df
    if wrong:
        raise ValueError("; ".join(wrong))
    return out


def rebuilt(df: DataFrame, path: str, key: str, version: int) -> str:
    """A snapshot of the whole bank under ``path``; a repeated key fails it, and one that stands is not written over."""
    from thicketry.operators.relations import require_unique
    from thicketry.sources.files import exists, place

    to = f"{path}/version={version}"
    if exists(df.sparkSession, to):
        raise FileExistsError(to)
    place(require_unique(df, key), to, f"{path}.writing")
    return to
