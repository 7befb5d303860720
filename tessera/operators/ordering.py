"""Operators about the order of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.positions import numbered, with_next
from tessera.schema import need, ref


def sort_by(df: DataFrame, column: str) -> DataFrame:
    """Ascending by one column."""
    need(df, column)
    return df.orderBy(ref(column))


def limit(df: DataFrame, n: int, order_by: Sequence[str] = ()) -> DataFrame:
    """The first n rows in the given order (without one: any n). With an order, each task keeps n rows, and those meet."""
    need(df, *order_by)
    return (df.orderBy(*map(ref, order_by)) if order_by else df).limit(n)


def index(df: DataFrame, name: str = "index", order_by: Sequence[str] = ()) -> DataFrame:
    """A first column with the number of the row, from 0, in the given order."""
    return numbered(df, order_by, name)


#: Rows that are made of one row at once where equal values are written out again.
RUN = 10_000


def compare_neighbours(df: DataFrame, column: str, order_by: Sequence[str] = ()) -> DataFrame:
    """For all rows but the last, in the order of ``order_by`` (default: the column): 1 if the next row has the same value, else 0.

    In the column's own order equal values are neighbours, so they are counted, and only a row a value is set in order: a value that fills the
    column is in no task as a whole, its rows are written out RUN at a time.
    """
    need(df, column, *order_by)
    if list(order_by or [column]) != [column]:
        pairs = with_next(df, column, order_by)
        return pairs.where(~F.col("is_last")).select(F.col("value").eqNullSafe(F.col("next")).cast("int").alias(column))
    values = df.groupBy(ref(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    least = values.agg(F.min(F.struct("value")).alias("least")).select(F.col("least.value").alias("least"))
    changes = values.join(least, F.col("value").eqNullSafe(F.col("least")), "left_anti").select(F.lit(0).alias("flag"))
    runs = values.where("n > 1").select((F.col("n") - 1).alias("n"), "value").select("n", "value", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {RUN}"))).alias("run"))
    here = F.least(F.lit(RUN).cast("long"), F.col("n") - F.col("run") * RUN)
    # a fixed number of parts: the runs are few bytes, by which Spark would put them together, but many rows
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    same = runs.repartition(parts, "value", "run").select(F.explode(F.sequence(F.lit(1).cast("long"), here))).select(F.lit(1).alias("flag"))
    return same.unionByName(changes).select(F.col("flag").alias(column))


def unpermute(df: DataFrame, sort_col: str, new_index: str = "index", order_by: Sequence[str] = ()) -> DataFrame:
    """Number the rows, then sort by the index that they had before a shuffle."""
    return index(df, new_index, order_by).orderBy(ref(sort_col))


def shuffle(df: DataFrame, seed: int | None = None) -> DataFrame:
    """The same rows in a random order."""
    return df.orderBy(F.rand(seed) if seed is not None else F.rand())
