"""Problem 4: a reproducible sample that keeps its members as the data grow.

Method: stratified hash thresholds. A record is selected if the salted hash of its key lies below
the threshold of its stratum. Rates are fixed per stratum, never taken from counts, and thresholds
are only ever raised, so what was selected stays so whatever is added, in any order or partitioning.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ENDING = re.compile(r"\.(?:jpe?g|png|tiff?|bmp|webp|gif)$", re.I)
_BLANK = " \t\n\r\x0b\x0c\xa0 -​  　﻿"
HASH_DIGITS = 12  # hexadecimal digits of the salted hash that are compared


def canonical_key(key: str) -> str:
    """A key in the catalog's writing: composed accents, slashes, no blanks around parts, no file ending."""
    key = unicodedata.normalize("NFC", key).replace("\\", "/")
    parts = [p.strip(_BLANK) for p in key.split("/")]
    return _ENDING.sub("", "/".join(p for p in parts if p not in ("", "."))).strip(_BLANK)


def with_canonical(df: DataFrame, key: str, out: str = "key") -> DataFrame:
    """Adds ``canonical_key``: by built-in expressions, only what is not ASCII also by Python, for its accents."""

    @F.pandas_udf("string")
    def canon(s):
        return s.map(canonical_key, na_action="ignore")

    c = F.col(key)
    parts = F.filter(F.transform(F.split(F.translate(c, "\\", "/"), "/"), lambda p: F.regexp_replace(p, r"^[ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+$", "")), lambda p: (p != "") & (p != "."))
    plain = F.regexp_replace(F.regexp_replace(F.array_join(parts, "/"), r"(?i)\.(?:jpe?g|png|tiff?|bmp|webp|gif)\z", ""), r"^[ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+$", "")
    odd = c.rlike(r"[^\x00-\x7f]")
    # Python sees nulls in place of the keys that need nothing of it
    return df.withColumn(out, F.when(odd, canon(F.when(odd, c))).otherwise(plain))


def salted(key: str, salt: str):
    """A number below 16 ** HASH_DIGITS from the md5 of salt and key; the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt + "|"), F.col(key))), 1, HASH_DIGITS), 16, 10).cast("bigint")


def stable_sample(records: DataFrame, rates: DataFrame, salt: str = "v1", previous: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(sample, thresholds) of ``records`` (key, stratum) at ``rates`` (stratum, rate).

    ``previous`` holds the thresholds (stratum, threshold) of an earlier sample; a threshold is the
    larger of it and the rate's, also for strata that have no rate any more. Keys count once (in
    each stratum); null keys and null strata are left out; a stratum without rate or threshold
    gives nothing; rates beyond 0 to 1 are clipped, null rates ask for nothing. Raising the rates
    gives nested samples. No row is ranked or counted, so a hot stratum costs no more than others.
    """
    full = float(16**HASH_DIGITS)
    want = rates.where("stratum is not null and rate is not null").select("stratum", F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.nanvl("rate", F.lit(0.0)))) * full).cast("bigint").alias("threshold"))
    if previous is not None:
        want = want.unionByName(previous.where("stratum is not null and threshold is not null").select("stratum", "threshold"))
    want = want.groupBy("stratum").agg(F.max("threshold").alias("threshold"))
    rows = records.where("key is not null and stratum is not null").select("key", "stratum")
    sample = rows.withColumn("hash", salted("key", salt)).join(want, "stratum").where(F.col("hash") < F.col("threshold"))
    return sample.select("key", "stratum", "hash").distinct(), want


def lost_members(lists: DataFrame) -> DataFrame:
    """(run, level, key): selected before, and gone: what a threshold that only rises can never lose.

    ``lists`` has (run, parent, level, key), rows in any number and order; level counts from 0 to
    60, and the query fails at any other. A key is lost from a list of a run if a list of a lower level of the run, or the list of the
    same level of the run's parent holds it. Selection levels of a key are thresholds it has
    passed, kept as the bits of one number per run and key: one exchange of small rows by (run,
    key), and no list is ever held whole. Nulls in run, level or key are left out; a level at which
    a run has no list at all loses nothing; a parent without rows is ignored.
    """
    rows = lists.where("run is not null and level is not null and key is not null")
    bit = F.when(F.col("level").between(0, 60), F.expr("shiftleft(1L, cast(level as int))")).otherwise(F.raise_error(F.concat(F.lit("a level beyond 0 to 60: "), F.col("level").cast("string"))).cast("bigint"))
    own = rows.groupBy("run", "key").agg(F.bit_or(bit).alias("own"))
    runs = rows.groupBy("run").agg(F.bit_or(bit).alias("has"))
    parents = rows.where("parent is not null").select(F.col("run").alias("child"), "parent").distinct()
    handed = own.join(parents, own["run"] == parents["parent"]).select(F.col("child").alias("run"), "key", F.lit(0).cast("bigint").alias("own"), F.col("own").alias("due"))
    both = own.withColumn("due", F.lit(0).cast("bigint")).unionByName(handed).groupBy("run", "key").agg(F.bit_or("own").alias("own"), F.bit_or("due").alias("due"))
    higher = F.expr("case when own = 0 then 0L else ~((own & -own) * 2 - 1) end")
    gone = (F.col("due").bitwiseOR(higher)).bitwiseAND(F.bitwise_not("own")).bitwiseAND(F.col("has"))
    lost = both.where(F.expr("(due & ~own) <> 0 or (own & (own + (own & -own))) <> 0 or own <> 0")).join(runs, "run").withColumn("gone", gone).where("gone <> 0")
    levels = F.filter(F.sequence(F.lit(0), F.lit(60)), lambda x: F.expr("1") == F.getbit("gone", x))
    return lost.select("run", F.explode(levels).alias("level"), "key")
