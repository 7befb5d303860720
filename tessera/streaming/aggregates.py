"""Grouped sums and counts over streams: each party's stream is aggregated as it comes, with the same operators as batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.sets import concat
from tessera.schema import ref


def grouped(streams: Sequence[DataFrame], group: Sequence[str], over: str | None, out: str) -> DataFrame:
    """Running sum (or, without ``over``, count) by key over the union of the streams, for output mode "complete" or "update"."""
    rows = streams[0] if len(streams) == 1 else concat(streams)
    return rows.groupBy(*map(ref, group)).agg((F.sum(ref(over)) if over else F.count(F.lit(1))).alias(out))


def windowed(stream: DataFrame, time: str, window: str, group: Sequence[str], over: str | None, out: str, late: str = "10 minutes") -> DataFrame:
    """The same per time window, final once the watermark has passed it; rows that are later than ``late`` are not counted."""
    rows = stream.withWatermark(time, late)
    value = F.sum(ref(over)) if over else F.count(F.lit(1))
    done = rows.groupBy(F.window(ref(time), window).alias("w"), *map(ref, group)).agg(value.alias(out))
    return done.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *map(ref, group), ref(out))
