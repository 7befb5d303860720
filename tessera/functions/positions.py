"""Row numbers over a whole table without putting it into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.schema import need, ref

_PART, _PLACE = "__part", "__place"
#: monotonically_increasing_id() has the row's place in its partition in the low 33 bits.
_PLACE_MASK = (1 << 33) - 1


def total_order(df: DataFrame, order_by: Sequence[str | Column]) -> list[Column]:
    """The order asked for and, behind it, every column, so that only equal rows tie."""
    asked = [ref(x).asc_nulls_first() if isinstance(x, str) else x for x in order_by]
    simple = {f.name for f in df.schema if f.dataType.typeName() not in ("map", "variant")}
    return asked + [ref(n).asc_nulls_first() for n in df.columns if n in simple and n not in order_by]


def numbered(df: DataFrame, order_by: Sequence[str | Column] = (), name: str = "index", with_part: bool = False) -> DataFrame:
    """``df`` with a first column ``name``: 0, 1, 2, ... in the given order (without one: in the order of the scan).

    Rows are range-partitioned and sorted once and kept by a checkpoint, so that part numbers stay what they are when a task
    is lost; a row's number is what earlier parts hold plus its place in its own. Only one count per part is gathered.
    """
    if name in df.columns:
        raise ValueError(f"there is a column {name!r} already")
    if order_by:
        need(df, *[x for x in order_by if isinstance(x, str)])
        order = total_order(df, order_by)
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = kept(df.withColumn(_PART, F.spark_partition_id()).withColumn(_PLACE, F.monotonically_increasing_id().bitwiseAND(_PLACE_MASK)))
    counts = placed.groupBy(_PART).agg(F.count(F.lit(1)).alias("n"))
    # a row for each part: as many as there were partitions, whatever the rows
    before = counts.select(_PART, (F.sum("n").over(Window.orderBy(_PART)) - F.col("n")).alias("before"))
    out = placed.join(F.broadcast(before), _PART).withColumn(name, F.col("before") + F.col(_PLACE))
    return out.select(ref(name), *map(ref, df.columns), *([_PART] if with_part else []))


def kept(df: DataFrame) -> DataFrame:
    """Checkpoint to the folder that the cluster shares (``spark.checkpoint.dir``); a temporary one only where driver and executors are one process."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        top = sc.getConf().get("spark.checkpoint.dir", None)
        if top is None:
            if not sc._jsc.sc().isLocal():
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            top = tempfile.mkdtemp(prefix="tessera-")
        sc.setCheckpointDir(top)
    return df.checkpoint()


def with_next(df: DataFrame, column: str, order_by: Sequence[str]) -> DataFrame:
    """index, value, next: the values of a column in the given order, each with the one behind it; the last has none.

    Only within a part is the next value found by a window; the first values of the parts, one a part, link them. Rows that are equal in all columns
    of the order share a part.
    """
    rows = numbered(df.select(*dict.fromkeys([column, *order_by])), order_by, "__i", with_part=True).select("__i", ref(column).alias("__value"), _PART)
    inner = F.lead(F.struct("__value")).over(Window.partitionBy(_PART).orderBy("__i"))
    firsts = rows.groupBy(_PART).agg(F.min(F.struct("__i", "__value")).alias("__first"))
    following = firsts.select(_PART, F.lead("__first").over(Window.orderBy(_PART)).alias("__after"))
    joined = rows.withColumn("__inner", inner).join(F.broadcast(following), _PART)
    last = F.col("__inner").isNull() & F.col("__after").isNull()
    return joined.select(
        F.col("__i").alias("index"),
        F.col("__value").alias("value"),
        F.when(F.col("__inner").isNotNull(), F.col("__inner.__value")).otherwise(F.col("__after.__value")).alias("next"),
        last.alias("is_last"),
    )
