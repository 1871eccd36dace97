"""Fingerprints that do not depend on row order or partitioning."""

from __future__ import annotations

import hashlib
import json
import math
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical_json(value) -> str:
    """Sorted keys, compact separators, no NaN or infinity, texts in composed form."""

    def clean(v):
        if isinstance(v, float) and not math.isfinite(v):
            raise ValueError("no finite number")
        if isinstance(v, str):
            return unicodedata.normalize("NFC", v)
        if isinstance(v, dict):
            return {str(k): clean(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [clean(x) for x in v]
        if isinstance(v, (set, frozenset)):
            return sorted(clean(x) for x in v)
        return v

    return json.dumps(clean(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def value_fingerprint(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def key_fingerprint(df: DataFrame, key: str, levels: tuple[int, ...] = (5, 2, 0)) -> DataFrame:
    """One row (n_keys, fingerprint) over the distinct keys, by a tree of digests.

    Keys meet in leaves by the first five hexadecimal digits of their md5, leaves by the first two,
    and those at the root; a node is the sha256 of what it holds, in order. The recipe is the same
    at every size, and at 10^10 keys a leaf holds some 10,000 of them, a node 4,096 leaves.
    """
    keys = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k")).distinct()
    of = lambda c, n: F.substring(c, 1, n) if n else F.lit("")
    out = keys.groupBy(of(F.md5("k"), levels[0]).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("k")), "\n"), 256).alias("d"))
    for n in levels[1:]:
        held = F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda s: F.concat(s["b"], F.lit(":"), s["d"]))
        out = out.groupBy(of(F.col("b"), n).alias("b")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(held, "\n"), 256).alias("d"))
    none = F.sha2(F.lit(""), 256)  # of no keys at all
    return out.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n_keys"), F.coalesce(F.max("d"), none).alias("fingerprint"))


def ordered_fingerprint(df: DataFrame, key: str, name: str = "sample_keys") -> str:
    """sha256 of the canonical JSON list of the sorted distinct keys, streamed partition by partition."""
    h = hashlib.sha256(f'{{"{name}":['.encode())
    first = True
    for (k,) in df.where(F.col(key).isNotNull()).select(key).distinct().orderBy(key).toLocalIterator(prefetchPartitions=True):
        h.update((b"" if first else b",") + json.dumps(unicodedata.normalize("NFC", k), ensure_ascii=False).encode())
        first = False
    h.update(b"]}")
    return h.hexdigest()


def content_fingerprint(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, size, sha256) of binary rows, for a chained or bucketed fingerprint."""
    return files.select(key, F.length(content).alias("size"), F.sha2(F.col(content), 256).alias("sha256"))


def chained_fingerprint(df: DataFrame, order: str, columns: list[str]) -> str:
    """sha256 over one line a row in the order of a unique key, its columns joined by tabs; partitions are streamed, not collected."""
    h = hashlib.sha256()
    line = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    for (x,) in df.select(order, line.alias("_l")).orderBy(order).select("_l").toLocalIterator(prefetchPartitions=True):
        h.update(x.encode() + b"\n")
    return h.hexdigest()


def content_chain(files: DataFrame, key: str = "sample_key", content: str = "content") -> str:
    """Digest of the contents of all files in key order: of lines of key, size and sha256."""
    return chained_fingerprint(content_fingerprint(files, key, content), key, [key, "size", "sha256"])
