"""Projection, filters, arithmetic and joins: pure functions from DataFrames to a DataFrame."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.arithmetic import Operand, product, quotient
from tessera.functions.positions import kept
from tessera.schema import is_whole, need, ref

#: The two that workflows have, and others that cost nothing.
COMPARISONS = {
    "==": lambda a, b: a == b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "!=": lambda a, b: a != b,
}


#: Rows of the result that a task makes, about, where a join is spread: some seconds of work, written as Parquet.
TASK_ROWS = 1 << 23


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns named, in that order; repeated rows stay."""
    need(df, *columns)
    return df.select(*map(ref, columns))


def where(df: DataFrame, column: str, operator: str, *, scalar: int | float | None = None, other: str | None = None) -> DataFrame:
    """Rows whose column compares so with a number or with another column."""
    if (scalar is None) == (other is None):
        raise ValueError("give either a scalar or another column")
    if operator not in COMPARISONS:
        raise ValueError(f"no such comparison: {operator}")
    need(df, column, *([other] if other else []))
    return df.where(COMPARISONS[operator](ref(column), ref(other) if other else F.lit(scalar)))


def keep_listed(df: DataFrame, column: str, keys: DataFrame, negate: bool = False) -> DataFrame:
    """Rows whose value is (or with ``negate`` is not) in the only column of ``keys``; repeated rows stay.

    A semi or anti join; as an anti join it keeps null values, which SQL's NOT IN would not.
    """
    need(df, column)
    if len(keys.columns) != 1:
        raise ValueError("the keys have one column")
    listed = keys.toDF("__key")
    return df.join(listed, ref(column) == F.col("__key"), "left_anti" if negate else "left_semi")


def _with(df: DataFrame, target: str, value, replaces: bool) -> DataFrame:
    if not replaces and target in df.columns:
        raise ValueError(f"there is a column {target!r} already; to replace it, make it the first operand")
    return df.withColumn(target, value)


def multiply(df: DataFrame, target: str, operands: Sequence[Operand], floats: bool = False) -> DataFrame:
    """target = the product of columns and numbers. It replaces the first operand if that has its name, else it is a new last column."""
    return _arithmetic(df, target, operands, product(operands, floats))


def divide(df: DataFrame, target: str, operands: Sequence[Operand], floats: bool = False, on_zero: str = "raise") -> DataFrame:
    """target = the first operand divided by all others, truncated to a whole number (exactly, at 64 bits, where all operands are whole numbers). Where it
    goes: as with ``multiply``."""
    need(df, *[x for x in operands if isinstance(x, str)])
    whole = all(is_whole(df, x) if isinstance(x, str) else isinstance(x, int) for x in operands)
    return _arithmetic(df, target, operands, quotient(operands, floats, on_zero, whole))


def _arithmetic(df: DataFrame, target: str, operands: Sequence[Operand], value) -> DataFrame:
    if not operands or not isinstance(operands[0], str):
        raise ValueError("the first operand is a column")
    need(df, *[x for x in operands if isinstance(x, str)])
    return _with(df, target, value, target == operands[0])


def join(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], salt: int = 1, spread: int | None = None) -> DataFrame:
    """Inner equi-join on any number of keys. Columns: the keys under their left names, the rest of the left, the rest of the right.

    Spark picks the strategy, broadcasts only below its own size limit, and splits skewed partitions at run time. Where statistics
    fail it, ``salt`` deals each key over so many tasks: left rows draw one, right rows are repeated for each.

    All of that goes by the size of the inputs. Where few keys meet on both sides the result is far larger than they are, and a small input is
    one task. ``spread`` deals such a join by rows of the result, about so many a task (``TASK_ROWS``): see ``_spread``. It takes the place of ``salt``.
    """
    if len(left_keys) != len(right_keys) or not left_keys:
        raise ValueError("as many left keys as right keys, one at least")
    need(left, *left_keys)
    need(right, *right_keys)
    l_rest, r_rest = [c for c in left.columns if c not in left_keys], [c for c in right.columns if c not in right_keys]
    if clash := {*left_keys, *l_rest} & {*r_rest}:
        raise ValueError(f"both sides have {sorted(clash)}; rename one")
    r = right.select(*[ref(c).alias(f"__k{i}") for i, c in enumerate(right_keys)], *map(ref, r_rest))
    on = [ref(c) == F.col(f"__k{i}") for i, c in enumerate(left_keys)]
    if spread is not None:
        left, r, on = _spread(left, r, left_keys, on, spread)
    elif salt > 1:
        left = left.withColumn("__salt", F.pmod(F.xxhash64(*map(ref, left.columns)), F.lit(salt)))
        r = r.withColumn("__salt_r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long"))))
        on.append(F.col("__salt") == F.col("__salt_r"))
    return left.join(r, on, "inner").select(*map(ref, left_keys), *map(ref, l_rest), *map(ref, r_rest))


def _spread(left: DataFrame, right: DataFrame, left_keys: Sequence[str], on: list, most: int) -> tuple[DataFrame, DataFrame, list]:
    """Both sides of a join and its condition, dealt so that a task makes about ``most`` rows of the result; as they are if that is all of it.

    The rows of the result are counted key by key first. A key that makes more than ``most`` is cut into cells, a grid over its left and its right
    rows: a row draws its line by a hash of its columns and is repeated along it. Cells are as square as the key allows, so that a row is repeated once for each
    sqrt(most) rows of the other side at most, and copies are few beside the result. What is broadcast: keys with more than ``most`` rows of the result, at most
    one for each ``most`` rows of it. The number of tasks is given outright, since AQE would merge parts whose bytes are few. Rows that are equal in all
    columns share a line.
    """
    if most < 1:
        raise ValueError("spread is a number of rows, 1 at least")
    k = len(left_keys)
    right_keys, keys = [f"__k{i}" for i in range(k)], [f"__h{i}" for i in range(k)]
    if any(left.schema[x].dataType != right.schema[y].dataType for x, y in zip(left_keys, right_keys)):
        raise ValueError("a join is spread over keys of the same types on both sides")
    n = left.groupBy(*[ref(c).alias(h) for c, h in zip(left_keys, keys)]).agg(F.count(F.lit(1)).alias("__n"))
    m = right.groupBy(*right_keys).agg(F.count(F.lit(1)).alias("__m"))
    made = n.join(m, [F.col(h) == F.col(c) for h, c in zip(keys, right_keys)]).select(*keys, "__n", "__m", (F.col("__n").cast("double") * F.col("__m")).alias("__made"))
    total = made.agg(F.sum("__made")).first()[0] or 0
    if total <= most:
        return left, right, on
    side = F.lit(math.sqrt(most))
    lines = F.ceil(F.col("__n") / F.greatest(side, F.lit(most) / F.col("__m"))), F.ceil(F.col("__m") / F.greatest(side, F.lit(most) / F.col("__n")))
    # kept, so that both sides are cut by the same numbers whatever is computed again
    large = kept(made.where(F.col("__made") > most).select(*keys, lines[0].alias("__n"), lines[1].alias("__m")))
    cells = large.agg(F.sum(F.col("__n") * F.col("__m"))).first()[0] or 0
    width = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(width, math.ceil(total / most), cells)

    def dealt(df: DataFrame, by: Sequence[str], lines: str, other: str, drawn: str, repeated: str) -> DataFrame:
        hashed = [ref(f.name) for f in df.schema if f.dataType.typeName() not in ("map", "variant")]
        # dealt first, or a small table would be copied by the one task that reads it
        rows = df.repartition(width, *hashed).join(F.broadcast(large), [ref(c) == F.col(h) for c, h in zip(by, keys)], "left")
        one = F.lit(1).cast("long")
        line = F.pmod(F.xxhash64(*hashed), F.coalesce(F.col(lines), one)).alias(drawn)
        rows = rows.select(*map(ref, df.columns), line, F.explode(F.sequence(one, F.coalesce(F.col(other), one))).alias(repeated))
        return rows.withColumn(repeated, F.col(repeated) - 1)

    # both by key, left line, right line: the join takes these parts as they are
    a = dealt(left, left_keys, "__n", "__m", "__a", "__b").repartition(parts, *map(ref, left_keys), "__a", "__b")
    b = dealt(right, right_keys, "__m", "__n", "__b_r", "__a_r").repartition(parts, *right_keys, "__a_r", "__b_r")
    return a, b.hint("merge"), [*on, F.col("__a") == F.col("__a_r"), F.col("__b") == F.col("__b_r")]


def aligned_with_join(one: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """The rows of ``one`` as often as the join with ``other`` has them, sorted by the key: one party's part of a public join. A plain join
    with the other side's key column, so Spark can split a hot key."""
    need(one, key)
    need(other, other_key)
    return one.join(other.select(ref(other_key).alias("__key")), ref(key) == F.col("__key")).select(*map(ref, one.columns)).orderBy(ref(key))


def partitioned_join(lefts: Sequence[DataFrame], rights: Sequence[DataFrame], left_keys: Sequence[str], right_keys: Sequence[str]) -> DataFrame:
    """Join of two relations that are each spread over parties; the parts of a side have the same columns in the same order."""
    from tessera.operators.sets import concat

    return join(lefts[0] if len(lefts) == 1 else concat(lefts), rights[0] if len(rights) == 1 else concat(rights), left_keys, right_keys)


def blackbox(inputs: Sequence[DataFrame], code, columns: Sequence[str]) -> DataFrame:
    """A step of the user's own: a function of the inputs, or SQL over views ``in0``, ``in1``, ...; the result takes the names given."""
    if callable(code):
        out = code(*inputs)
    else:
        out = inputs[0].sparkSession.sql(code, **{f"in{i}": df for i, df in enumerate(inputs)}) if "{in0}" in code else _sql_over_views(inputs, code)
    if len(out.columns) != len(columns):
        raise ValueError(f"the step returns {len(out.columns)} columns, {len(columns)} are named")
    return out.toDF(*columns)


def _sql_over_views(inputs: Sequence[DataFrame], code: str) -> DataFrame:
    spark = inputs[0].sparkSession
    for i, df in enumerate(inputs):
        df.createOrReplaceTempView(f"in{i}")
    return spark.sql(code)
