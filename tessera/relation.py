"""A relation: rows (a DataFrame) and policy (who holds it, who may see what), composed by the workflow operators.

Every method returns a new relation and changes nothing. Names are for reports and outputs; Spark never sees them.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tessera import policy
from tessera.functions.arithmetic import Operand
from tessera.operators import aggregates, boundaries, indexes, ordering, relational, sets
from tessera.schema import ColumnSpec, col_spec


@dataclass(frozen=True, eq=False)
class Relation:
    df: DataFrame
    node: policy.Node

    @staticmethod
    def create(df: DataFrame, name: str, columns: Sequence[ColumnSpec] | None = None, owners: Iterable[int] = (1,)) -> "Relation":
        """Over rows that are there already. Without ``columns``: those of the DataFrame, seen by the owners."""
        owners = frozenset(owners)
        specs = list(columns) if columns else [col_spec(c, "INTEGER", owners) for c in df.columns]
        if len(specs) != len(df.columns):
            raise ValueError(f"{name}: {len(specs)} columns are declared, the rows have {len(df.columns)}")
        return Relation(df.toDF(*[c.name for c in specs]), policy.create(name, specs, owners))

    # --- what it is

    @property
    def name(self) -> str:
        return self.node.name

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def owners(self) -> frozenset[int]:
        return self.node.owners

    def trust(self, column: str) -> frozenset[int]:
        return self.node.trust(column)

    def renamed(self, name: str) -> "Relation":
        return Relation(self.df, policy.replace(self.node, name=name))

    def _next(self, df: DataFrame, op: str, name: str, detail: str = "", parents: Sequence["Relation"] = ()) -> "Relation":
        return Relation(df, policy.opaque(op, [self.node, *(p.node for p in parents)], name, df.columns, detail))

    # --- rows and columns

    def project(self, name: str, columns: Sequence[str]) -> "Relation":
        return Relation(relational.project(self.df, columns), policy.project(self.node, name, columns))

    def filter(self, name: str, column: str, operator: str, *, scalar=None, other: str | None = None) -> "Relation":
        return Relation(relational.where(self.df, column, operator, scalar=scalar, other=other), policy.cc_filter(self.node, name, column, operator, other, scalar))

    def filter_by(self, name: str, column: str, by: "Relation", negate: bool = False) -> "Relation":
        return Relation(relational.keep_listed(self.df, column, by.df, negate), policy.filter_by(self.node, by.node, name, column, negate))

    def multiply(self, name: str, target: str, operands: Sequence[Operand], floats: bool = False) -> "Relation":
        return Relation(relational.multiply(self.df, target, operands, floats), policy.arithmetic("multiply", self.node, name, target, operands))

    def divide(self, name: str, target: str, operands: Sequence[Operand], floats: bool = False, on_zero: str = "raise") -> "Relation":
        return Relation(relational.divide(self.df, target, operands, floats, on_zero), policy.arithmetic("divide", self.node, name, target, operands))

    # --- joins

    def join(self, right: "Relation", name: str, left_keys: Sequence[str], right_keys: Sequence[str], salt: int = 1, spread: int | None = None) -> "Relation":
        return Relation(relational.join(self.df, right.df, left_keys, right_keys, salt, spread), policy.join(self.node, right.node, name, left_keys, right_keys))

    def hybrid_join(self, right: "Relation", name: str, left_key: str, right_key: str) -> "Relation":
        return Relation(indexes.hybrid_join(self.df, right.df, left_key, right_key), policy.join(self.node, right.node, name, [left_key], [right_key], "hybrid_join"))

    def public_join(self, right: "Relation", name: str, left_key: str, right_key: str) -> "Relation":
        return Relation(indexes.public_join(self.df, right.df, left_key, right_key), policy.join(self.node, right.node, name, [left_key], [right_key], "public_join"))

    def pub_join(self, name: str, key: str, other: "Relation", other_key: str | None = None) -> "Relation":
        return self._next(relational.aligned_with_join(self.df, key, other.df, other_key or key), "pub_join", name, key, [other])

    def join_flags(self, right: "Relation", name: str, left_key: str, right_key: str, left_index: str = "index", right_index: str = "index", out: str = "flag") -> "Relation":
        return self._next(indexes.join_flags(self.df, right.df, left_key, right_key, left_index, right_index, out), "join_flags", name, f"{left_key} = {right_key}", [right])

    def flag_join(self, right: "Relation", flags: "Relation", name: str, right_key: str, left_index: str = "index", right_index: str = "index") -> "Relation":
        return self._next(indexes.flag_join(self.df, right.df, flags.df, left_index, right_index, right_key), "flag_join", name, "", [right, flags])

    def index_join(self, right: "Relation", pairs: "Relation", name: str, right_key: str | None = None, left_index: str = "index", right_index: str = "index") -> "Relation":
        return self._next(indexes.index_join(self.df, right.df, pairs.df, left_index, right_index, right_key), "index_join", name, "", [right, pairs])

    def indexes_to_flags(self, lookup: "Relation", name: str, column: str | None = None, lookup_index: str = "index") -> "Relation":
        return self._next(indexes.indexes_to_flags(lookup.df, self.df, lookup_index, column), "indexes_to_flags", name, "", [lookup])

    # --- aggregates

    def aggregate(self, name: str, group: Sequence[str], over: str, aggregator: str, out: str) -> "Relation":
        return Relation(aggregates.aggregate(self.df, group, over, aggregator, out), policy.aggregate(self.node, name, group, over, out, aggregator))

    def aggregate_count(self, name: str, group: Sequence[str], out: str) -> "Relation":
        return Relation(aggregates.count_by(self.df, group, out), policy.aggregate(self.node, name, group, None, out, "count"))

    def weighted_mean(self, name: str, group: Sequence[str], over: str, count: str, out: str, floats: bool = False) -> "Relation":
        return Relation(aggregates.weighted_mean(self.df, group, over, count, out, floats), policy.aggregate(self.node, name, group, over, out, "weighted mean"))

    def hybrid_aggregate(self, name: str, group: Sequence[str], over: str, out: str) -> "Relation":
        return Relation(aggregates.hybrid_aggregate(self.df, group, over, out), policy.aggregate(self.node, name, group, over, out, "sum"))

    def index_aggregate(self, name: str, group: Sequence[str], over: str, out: str, index_map: "Relation", **columns: str) -> "Relation":
        return self._next(aggregates.index_aggregate(self.df, group, over, out, index_map.df, **columns), "index_aggregate", name, f"sum({over})", [index_map])

    def leaky_index_aggregate(self, name: str, over: str, out: str, index_map: "Relation", keys: "Relation", **columns: str) -> "Relation":
        return self._next(aggregates.leaky_index_aggregate(self.df, over, out, index_map.df, keys.df, **columns), "leaky_index_aggregate", name, f"sum({over})", [index_map, keys])

    def distinct_count(self, name: str, column: str) -> "Relation":
        return self._next(aggregates.distinct_count(self.df, column), "distinct_count", name, column)

    def num_rows(self, name: str, column: str = "len") -> "Relation":
        return self._next(aggregates.row_count(self.df, column), "num_rows", name)

    # --- order

    def sort_by(self, name: str, column: str) -> "Relation":
        return Relation(ordering.sort_by(self.df, column), policy.same("sort_by", self.node, name, column))

    def limit(self, name: str, n: int, order_by: Sequence[str] = ()) -> "Relation":
        return Relation(ordering.limit(self.df, n, order_by), policy.same("limit", self.node, name, str(n)))

    def index(self, name: str, column: str = "index", order_by: Sequence[str] = ()) -> "Relation":
        return self._next(ordering.index(self.df, column, order_by), "index", name, column)

    def comp_neighs(self, name: str, column: str, order_by: Sequence[str] = ()) -> "Relation":
        return self._next(ordering.compare_neighbours(self.df, column, order_by), "comp_neighs", name, column)

    def shuffle(self, name: str, seed: int | None = None) -> "Relation":
        return Relation(ordering.shuffle(self.df, seed), policy.same("shuffle", self.node, name))

    def unpermute(self, name: str, sort_col: str, new_index: str = "index", order_by: Sequence[str] = ()) -> "Relation":
        return self._next(ordering.unpermute(self.df, sort_col, new_index, order_by), "unpermute", name, sort_col)

    # --- sets

    def distinct(self, name: str, columns: Sequence[str]) -> "Relation":
        return Relation(sets.distinct(self.df, columns), policy.replace(policy.project(self.node, name, columns), op="distinct"))

    def union(self, right: "Relation", name: str, left_col: str, right_col: str) -> "Relation":
        return Relation(sets.union(self.df, right.df, left_col, right_col), policy.union(self.node, right.node, name, left_col, right_col))

    def pub_intersect(self, name: str, column: str, other: "Relation", other_col: str | None = None) -> "Relation":
        return Relation(sets.intersect(self.df, other.df, column, other_col), policy.pub_intersect(self.node, name, column, other.node, other_col))

    # --- boundaries

    def persist(self, name: str) -> "Relation":
        return Relation(boundaries.persist(self.df, name), policy.same("persist", self.node, name))

    def open(self, name: str, party: int, keep: str | None = None) -> "Relation":
        return Relation(boundaries.open_(self.df, keep), policy.same("open", self.node, name, f"to {party}", {party})) if not keep else self._opened(name, party, keep)

    def _opened(self, name: str, party: int, keep: str) -> "Relation":
        df = boundaries.open_(self.df, keep)
        return Relation(df, policy.opaque("open", [self.node], name, df.columns, f"to {party}", {party}))

    def close(self, name: str, parties: Iterable[int]) -> "Relation":
        return Relation(boundaries.close(self.df), policy.same("close", self.node, name, owners=parties))

    def send(self, name: str, party: int) -> "Relation":
        return Relation(boundaries.send(self.df), policy.same("send", self.node, name, f"to {party}", {party}))

    def collect_at(self, party: int) -> "Relation":
        """The result goes to one party."""
        return Relation(self.df, policy.replace(self.node, owners=frozenset({party})))


def concat(relations: Sequence[Relation], name: str, columns: Sequence[str] | None = None) -> Relation:
    return Relation(sets.concat([r.df for r in relations], columns), policy.concat([r.node for r in relations], name, columns))


def concat_cols(relations: Sequence[Relation], name: str, order_by: Sequence[Sequence[str]] | None = None, use_mult: bool = False) -> Relation:
    df = sets.concat_cols([r.df for r in relations], order_by, use_mult)
    return Relation(df, policy.opaque("concat_cols", [r.node for r in relations], name, df.columns))


def pub_join_parts(lefts: Sequence[Relation], rights: Sequence[Relation], name: str, left_keys: Sequence[str], right_keys: Sequence[str]) -> Relation:
    df = relational.partitioned_join([r.df for r in lefts], [r.df for r in rights], left_keys, right_keys)
    return Relation(df, policy.opaque("pub_join", [r.node for r in (*lefts, *rights)], name, df.columns))


def blackbox(relations: Sequence[Relation], name: str, columns: Sequence[str], code) -> Relation:
    df = relational.blackbox([r.df for r in relations], code, columns)
    return Relation(df, policy.opaque("blackbox", [r.node for r in relations], name, columns))
