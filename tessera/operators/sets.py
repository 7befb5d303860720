"""Set and bag operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.positions import numbered
from tessera.schema import need, ref


def concat(inputs: Sequence[DataFrame], columns: Sequence[str] | None = None) -> DataFrame:
    """All rows of two inputs or more, column by column; names of the first input, or those given."""
    if len(inputs) < 2:
        raise ValueError("two inputs at least")
    if len({len(df.columns) for df in inputs}) > 1:
        raise ValueError("all inputs have the same number of columns")
    names = list(columns or inputs[0].columns)
    return reduce(DataFrame.union, [df.toDF(*names) for df in inputs])


def union(left: DataFrame, right: DataFrame, left_col: str, right_col: str) -> DataFrame:
    """The different values of one column of each, under the left name."""
    need(left, left_col)
    need(right, right_col)
    return left.select(ref(left_col)).union(right.select(ref(right_col))).distinct()


def intersect(left: DataFrame, right: DataFrame, left_col: str, right_col: str | None = None) -> DataFrame:
    """The different values that one column of each has in common, under the left name."""
    need(left, left_col)
    need(right, right_col or left_col)
    return left.select(ref(left_col)).intersect(right.select(ref(right_col or left_col)))


def distinct(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Different rows of the columns named; the others go."""
    need(df, *columns)
    return df.select(*map(ref, columns)).distinct()


def concat_cols(inputs: Sequence[DataFrame], order_by: Sequence[Sequence[str]] | None = None, use_mult: bool = False) -> DataFrame:
    """Columns side by side, row by row; with ``use_mult`` the products of the columns at equal places (names of the first).

    All inputs have the same number of rows: the check is in the plan, so a row without a partner raises. ``order_by``: the order of
    each input's rows (needed for a result that does not depend on partitioning).
    """
    if len(inputs) < 2:
        raise ValueError("two inputs at least")
    if use_mult and len({len(df.columns) for df in inputs}) > 1:
        raise ValueError("all inputs have the same number of columns")
    names = [c for df in inputs for c in df.columns]
    if not use_mult and len(set(names)) < len(names):
        raise ValueError(f"column names repeat: {sorted({n for n in names if names.count(n) > 1})}")
    sides = []
    for i, df in enumerate(inputs):
        rows = numbered(df, order_by[i] if order_by else (), "__row")
        sides.append(rows.toDF(f"__row{i}", *[f"__{i}_{j}" for j in range(len(df.columns))]))
    out = sides[0]
    for i in range(1, len(sides)):
        pair = F.when(F.col("__row0").isNull() | F.col(f"__row{i}").isNull(), F.raise_error(F.lit("the inputs differ in their numbers of rows")).cast("long")).otherwise(F.col("__row0"))
        out = out.join(sides[i], F.col("__row0") == F.col(f"__row{i}"), "full_outer").withColumn("__row0", pair)
    if use_mult:
        cols = [reduce(lambda a, b: a * b, [F.col(f"__{i}_{j}").cast("long") for i in range(len(inputs))]).alias(n) for j, n in enumerate(inputs[0].columns)]
    else:
        cols = [F.col(f"__{i}_{j}").alias(n) for i, df in enumerate(inputs) for j, n in enumerate(df.columns)]
    return out.where(F.col("__row0").isNotNull()).select(*cols)
