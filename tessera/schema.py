"""Columns with trust sets, and the schemas made of them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Declared type name -> Spark type. INTEGER is the one that workflows are written in; the others are for the user's own tables.
TYPES: dict[str, T.DataType] = {"INTEGER": T.LongType(), "FLOAT": T.DoubleType(), "STRING": T.StringType()}


class UnknownColumn(KeyError):
    """A column that the relation does not have; raised when the plan is built, not when it runs."""

    def __str__(self) -> str:
        return self.args[0]


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type_name: str = "INTEGER"
    trust: frozenset[int] = frozenset()

    def field(self) -> T.StructField:
        return T.StructField(self.name, TYPES[self.type_name], True, {"trust": sorted(self.trust)})


def col_spec(name: str, type_name: str = "INTEGER", *parties: int | Iterable[int]) -> ColumnSpec:
    """A column that the given parties (numbers or collections of numbers) may see in the clear."""
    if type_name not in TYPES:
        raise ValueError(f"no such column type: {type_name}")
    flat = [p for given in parties for p in ([given] if isinstance(given, int) else given)]
    return ColumnSpec(name, type_name, frozenset(flat))


def struct(columns: Iterable[ColumnSpec]) -> T.StructType:
    return T.StructType([c.field() for c in columns])


def ref(name: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_whole(df: DataFrame, name: str) -> bool:
    """Whether a column has an integer type."""
    return df.schema[name].dataType.typeName() in ("byte", "short", "integer", "long")


def need(df: DataFrame, *names: str) -> None:
    for n in names:
        if n not in df.columns:
            raise UnknownColumn(f"no column {n!r} among {df.columns}")


def common_trust(*sets: Iterable[int]) -> frozenset[int]:
    """Parties that are in all of the sets; none for no set."""
    given = [frozenset(s) for s in sets]
    return frozenset.intersection(*given) if given else frozenset()
