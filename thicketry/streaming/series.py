"""Stateful streams: alarms over the last rows of a series, a running average, appends to a bank."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def alarm_stream(df: DataFrame, series: str, order: str, value: str, above: float, length: int = 3) -> DataFrame:
    """(series, order, value, alarm) as rows arrive: the value was above in each of the last ``length`` rows.

    The state of a series is its last ``length`` values. Within a micro-batch rows are taken in
    order; rows that come later than that are taken as they come.
    """

    def step(key, frames: Iterator, state):
        import pandas as pd

        last = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(order)
        out = []
        for o, v in zip(rows[order], rows[value]):
            last = [*last, float(v)][-length:]
            out.append((key[0], o, float(v), len(last) == length and min(last) > above))
        state.update((last,))
        yield pd.DataFrame(out, columns=[series, order, value, "alarm"])

    kinds = dict(df.dtypes)
    return df.groupBy(series).applyInPandasWithState(step, f"{series} {kinds[series]}, {order} {kinds[order]}, {value} double, alarm boolean", "last array<double>", "append", "NoTimeout")


def average_stream(df: DataFrame, series: str, order: str, value: str, keep: float) -> DataFrame:
    """(series, n, ema) after each micro-batch: t = keep t + (1 - keep) v from the first value on."""

    def step(key, frames: Iterator, state):
        import pandas as pd

        n, t = state.get if state.exists else (0, 0.0)
        for v in pd.concat(list(frames)).sort_values(order)[value]:
            t = float(v) if n == 0 else keep * t + (1 - keep) * float(v)
            n += 1
        state.update((n, t))
        yield pd.DataFrame([(key[0], n, t)], columns=[series, "n", "ema"])

    return df.groupBy(series).applyInPandasWithState(step, f"{series} {dict(df.dtypes)[series]}, n bigint, ema double", "n bigint, ema double", "update", "NoTimeout")


def windowed_means(df: DataFrame, time: str, value: str, group: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Mean and count per group and time window, with a watermark for late rows."""
    w = df.withWatermark(time, late).groupBy(F.window(time, width), group)
    return w.agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), group, "mean", "n")


def append_bank(stream: DataFrame, path: str, checkpoint: str, key: str):
    """Appends each micro-batch to a bank; a key that the bank already holds fails the stream.

    A batch is written beside the bank and renamed into it, so a batch that stands in the bank is
    whole; what a crash left half written is written anew when the stream starts again.
    """

    def add(batch: DataFrame, number: int) -> None:
        from thicketry.operators.relations import require_unique
        from thicketry.sources.files import exists, place

        spark = batch.sparkSession
        batch = require_unique(batch, key)
        if exists(spark, f"{path}/part={number}"):
            return  # this batch was written before a restart
        if exists(spark, path):
            twice = batch.join(spark.read.parquet(path).select(key), key, "left_semi").limit(3).collect()
            if twice:
                raise ValueError(f"repeated keys: {[r[key] for r in twice]}")
        place(batch, f"{path}/part={number}", f"{path}.writing")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
