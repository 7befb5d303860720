"""Grouped and global aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.arithmetic import whole_quotient
from tessera.schema import is_whole, need, ref

#: What ``aggregate`` knows. std_dev is, as workflows have it, the population variance; stddev_pop is its root.
AGGREGATORS = {
    "sum": F.sum,
    "count": lambda c: F.count(F.lit(1)),
    "mean": F.avg,
    "std_dev": F.var_pop,
    "stddev_pop": F.stddev_pop,
    "min": F.min,
    "max": F.max,
}


def aggregate(df: DataFrame, group: Sequence[str], over: str | None, aggregator: str, out: str, salt: int = 1) -> DataFrame:
    """The group columns and one aggregate. Spark aggregates each partition before it shuffles, so a hot key is no hot task for
    any of these; ``salt`` splits the final step of "sum", "count", "min" and "max" further."""
    if aggregator not in AGGREGATORS:
        raise ValueError(f"no such aggregator: {aggregator}")
    if (over is None) != (aggregator == "count"):
        raise ValueError("count has no column to aggregate over; the others have one")
    need(df, *group, *([over] if over else []))
    if salt > 1 and aggregator in ("sum", "count", "min", "max"):
        part = df.groupBy(*map(ref, group), F.pmod(F.xxhash64(*map(ref, df.columns)), F.lit(salt)).alias("__salt")).agg(AGGREGATORS[aggregator](over and ref(over)).alias(out))
        return part.groupBy(*map(ref, group)).agg((F.sum if aggregator == "count" else AGGREGATORS[aggregator])(ref(out)).alias(out))
    return df.groupBy(*map(ref, group)).agg(AGGREGATORS[aggregator](over and ref(over)).alias(out))


def count_by(df: DataFrame, group: Sequence[str], out: str) -> DataFrame:
    return aggregate(df, group, None, "count", out)


def weighted_mean(df: DataFrame, group: Sequence[str], over: str, count: str, out: str, floats: bool = False) -> DataFrame:
    """The mean of values that stand for ``count`` rows each: their sum over the sum of the counts, truncated unless ``floats`` (exactly, at 64 bits, where
    both are whole numbers)."""
    need(df, *group, over, count)
    top, bottom = F.sum(ref(over)), F.sum(ref(count))
    if floats:
        mean = top / bottom
    else:
        mean = whole_quotient(top, bottom) if is_whole(df, over) and is_whole(df, count) else (top / bottom).cast("long")
    return df.groupBy(*map(ref, group)).agg(mean.alias(out))


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    """One row: how many different values the column has, under its name; null is not counted."""
    need(df, column)
    return df.agg(F.countDistinct(ref(column)).alias(column))


def row_count(df: DataFrame, name: str = "len") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def index_aggregate(df: DataFrame, group: Sequence[str], over: str, out: str, index_map: DataFrame, row_index: str = "row_idx", key_index: str = "key_idx", index: str = "index") -> DataFrame:
    """Sum by key where a helper has dealt the rows to keys already: ``df`` carries its row number ``index``; ``index_map`` has the
    key number of each row number. Groups that sum to zero stay."""
    need(df, *group, over, index)
    need(index_map, row_index, key_index)
    dealt = df.join(index_map.select(ref(row_index).alias("__row"), ref(key_index).alias("__key")), ref(index) == F.col("__row"))
    return dealt.groupBy("__key").agg(*[F.min(ref(g)).alias(g) for g in group], F.sum(ref(over)).alias(out)).drop("__key")


def leaky_index_aggregate(df: DataFrame, over: str, out: str, index_map: DataFrame, keys: DataFrame, row_index: str = "row_idx", key_index: str = "key_idx", index: str = "index") -> DataFrame:
    """The same, where the list of distinct keys (``key_index`` and key columns) is known: its columns and the sum."""
    need(keys, key_index)
    dealt = df.join(index_map.select(ref(row_index).alias("__row"), ref(key_index).alias("__key")), ref(index) == F.col("__row"))
    sums = dealt.groupBy("__key").agg(F.sum(ref(over)).alias(out))
    rest = [c for c in keys.columns if c != key_index]
    return keys.join(sums, ref(key_index) == F.col("__key")).select(*map(ref, rest), ref(out))


def hybrid_aggregate(df: DataFrame, group: Sequence[str], over: str, out: str) -> DataFrame:
    """What the helper-party protocol computes: the sum by key."""
    return aggregate(df, group, over, "sum", out)
