"""Joins taken apart into flags and row numbers, as helper-party protocols use them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import relational
from tessera.schema import need, ref


def join_flags(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_index: str, right_index: str, out: str = "flag") -> DataFrame:
    """For each pair of rows, numbered by their index columns: 1 where the keys are equal, else 0.

    The result has n times m rows by definition, so it is for key lists that are short by definition only; a step that just reads the ones
    takes ``matching_flags``.
    """
    need(left, left_key, left_index)
    need(right, right_key, right_index)
    l, r = left.select(ref(left_index).alias("l_idx"), ref(left_key).alias("__l")), right.select(ref(right_index).alias("r_idx"), ref(right_key).alias("__r"))
    return l.crossJoin(r).select("l_idx", "r_idx", F.coalesce((F.col("__l") == F.col("__r")).cast("int"), F.lit(0)).alias(out))


def matching_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_index: str, right_index: str) -> DataFrame:
    """l_idx, r_idx of the pairs of rows with equal keys."""
    l, r = left.select(ref(left_index).alias("l_idx"), ref(left_key).alias("__l")), right.select(ref(right_index).alias("r_idx"), ref(right_key).alias("__r"))
    return l.join(r, F.col("__l") == F.col("__r")).select("l_idx", "r_idx")


def matching_flags(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_index: str, right_index: str, out: str = "flag") -> DataFrame:
    """The rows of ``join_flags`` whose flag is 1, by a join on the keys instead of over all pairs."""
    return matching_pairs(left, right, left_key, right_key, left_index, right_index).withColumn(out, F.lit(1))


def index_join(left: DataFrame, right: DataFrame, pairs: DataFrame, left_index: str, right_index: str, right_key: str | None = None) -> DataFrame:
    """The rows of both sides that a list of (l_idx, r_idx) names, side by side, without the index columns and the right key."""
    need(left, left_index)
    need(right, right_index)
    l_rest = [c for c in left.columns if c != left_index]
    r_rest = [c for c in right.columns if c not in (right_index, right_key)]
    l = left.withColumnRenamed(left_index, "__l")
    r = right.select(ref(right_index).alias("__r"), *map(ref, r_rest))
    return pairs.select("l_idx", "r_idx").join(l, F.col("l_idx") == F.col("__l")).join(r, F.col("r_idx") == F.col("__r")).select(*map(ref, l_rest), *map(ref, r_rest))


def flag_join(left: DataFrame, right: DataFrame, flags: DataFrame, left_index: str, right_index: str, right_key: str, flag: str = "flag") -> DataFrame:
    """The join that precomputed flags describe: the pairs whose flag is 1, gathered from both sides."""
    return index_join(left, right, flags.where(ref(flag) == 1), left_index, right_index, right_key)


def indexes_to_flags(lookup: DataFrame, indexes: DataFrame, lookup_index: str = "index", column: str | None = None, out: str = "flag") -> DataFrame:
    """For each row number of ``indexes``: 1 if ``lookup`` lists it, else 0. Several mentions count once."""
    at = column or indexes.columns[0]
    need(lookup, lookup_index)
    need(indexes, at)
    listed = lookup.select(ref(lookup_index).alias("__listed")).distinct().withColumn("__one", F.lit(1))
    return indexes.join(listed, ref(at) == F.col("__listed"), "left").select(ref(at), F.coalesce(F.col("__one"), F.lit(0)).alias(out))


def arranged(lookup: DataFrame, n: int, lookup_index: str = "index") -> DataFrame:
    """place, index, is_real: each different index of ``lookup`` once and first, then padding up to n rows; the arrangement from which a
    gather by flags is built."""
    from tessera.functions.positions import numbered

    real = numbered(lookup.select(ref(lookup_index).alias("index")).distinct(), ["index"], "place")
    every = lookup.sparkSession.range(n).toDF("place")
    return every.join(real, "place", "left").select("place", "index", F.col("index").isNotNull().cast("int").alias("is_real"))


def gather(df: DataFrame, picks: DataFrame, index: str = "index", pick: str = "index", order: str | None = None) -> DataFrame:
    """The rows of ``df`` that ``picks`` names by number, as often as it names them, with the order column of ``picks`` if given."""
    need(df, index)
    rest = [c for c in df.columns if c != index]
    p = picks.select(ref(pick).alias("__pick"), *([ref(order)] if order else []))
    return p.join(df, F.col("__pick") == ref(index)).select(*([ref(order)] if order else []), *map(ref, rest))


def hybrid_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """What the helper-party protocol computes: the inner join."""
    return relational.join(left, right, [left_key], [right_key])


public_join = hybrid_join
