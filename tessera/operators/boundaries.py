"""Where data crosses a party boundary: identities on the rows. There is no cryptography here; owners and trust are metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.schema import ref


def persist(df: DataFrame, name: str) -> DataFrame:
    """Keep an intermediate under a name, and pass it on."""
    kept = df.persist()
    kept.createOrReplaceTempView("".join(ch if ch.isalnum() else "_" for ch in name))
    return kept


def close(df: DataFrame, keep: str | None = None) -> DataFrame:
    """Into joint computation. With ``keep``: every row starts with a flag 1, for filters that flag instead of dropping."""
    return df.withColumn(keep, F.lit(1)) if keep else df


def flagged_filter(df: DataFrame, condition, keep: str = "keep") -> DataFrame:
    """A filter that drops nothing: rows that fail get flag 0."""
    return df.withColumn(keep, F.when(condition, ref(keep)).otherwise(F.lit(0)))


def open_(df: DataFrame, keep: str | None = None) -> DataFrame:
    """Out of joint computation: rows whose flag is 0 go, and so does the flag."""
    return df.where(ref(keep) == 1).drop(keep) if keep else df


def send(df: DataFrame) -> DataFrame:
    return df
