"""Spelling of keys, subsets and file names of the picture catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slashed(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def file_name(path: Column) -> Column:
    """The last part of a path of any system."""
    return F.element_at(F.split(slashed(path), "/"), -1)


def loose(name: Column) -> Column:
    """A subset name without case, blanks, and kinds of dashes."""
    plain = F.translate(F.upper(F.trim(F.regexp_replace(name, r"[\s  　]+", " "))), "_‐‑‒–—―−－ ", "----------")
    return F.regexp_replace(F.regexp_replace(plain, r"[​-‍﻿]", ""), "-+", "-")


def raw_subset(subset: str, key: str, path: str) -> Column:
    """The subset of a record: its own, else the first part of its key, else the folder above ``im``."""
    own = F.when(F.trim(F.col(subset)) != "", F.col(subset))
    parts = F.split(slashed(F.col(key)), "/")
    of_key = F.when(F.size(F.filter(parts, lambda x: F.trim(x) != "")) >= 2, F.filter(parts, lambda x: ~F.trim(x).isin("", "."))[0])
    of_path = F.regexp_extract(slashed(F.col(path)), r"([^/]+)/im/[^/]*$", 1)
    return F.coalesce(own, of_key, F.when(of_path != "", of_path))


def with_subset(df: DataFrame, roles: DataFrame, subset: str = "subset", key: str = "sample_key", path: str = "path", out: str = "subset_name") -> DataFrame:
    """Adds the right spelling and the split role of each record's subset; null where no role names it.

    ``roles`` has one row per subset: a dimension of fixed size, which Spark broadcasts by its size.
    """
    names = roles.select(F.col("subset").alias(out), F.col("split_role").alias("role"), loose(F.col("subset")).alias("_loose"))
    names = names.dropDuplicates(["_loose"])
    return df.withColumn("_loose", loose(raw_subset(subset, key, path))).join(names, "_loose", "left").drop("_loose")
