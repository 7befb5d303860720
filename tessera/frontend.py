"""The workflow operators as functions, for protocols written in that style.

``run_workflow`` makes its context current while a protocol runs; ``create`` reads from it and ``collect`` adds an output to it. Names with a
leading underscore are the same functions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from tessera import relation as R
from tessera.relation import Relation
from tessera.schema import ColumnSpec, col_spec

_context: ContextVar = ContextVar("context")

defCol = col_spec


@contextmanager
def using(ctx) -> Iterator:
    token = _context.set(ctx)
    try:
        yield ctx
    finally:
        _context.reset(token)


def create(rel_name: str, columns: Sequence[ColumnSpec], stored_with: Iterable[int], df=None) -> Relation:
    return _context.get().create(rel_name, columns, stored_with, df)


def collect(node: Relation, target_party: int) -> Relation:
    """The relation becomes an output of the workflow, for one party."""
    out = node.collect_at(target_party)
    _context.get().outputs.append(out)
    return out


def project(node: Relation, output_name: str, selected_col_names: Sequence[str]) -> Relation:
    return node.project(output_name, selected_col_names)


def cc_filter(node: Relation, output_name: str, filter_col_name: str, operator: str, other_col_name: str | None = None, scalar=None) -> Relation:
    return node.filter(output_name, filter_col_name, operator, other=other_col_name, scalar=scalar)


def filter_by(node: Relation, output_name: str, filter_col_name: str, by_op: Relation, use_not_in: bool = False) -> Relation:
    return node.filter_by(output_name, filter_col_name, by_op, use_not_in)


def multiply(node: Relation, output_name: str, target_col_name: str, operands: Sequence) -> Relation:
    return node.multiply(output_name, target_col_name, operands, _floats())


def divide(node: Relation, output_name: str, target_col_name: str, operands: Sequence) -> Relation:
    return node.divide(output_name, target_col_name, operands, _floats())


def _floats() -> bool:
    ctx = _context.get(None)
    return bool(ctx and ctx.conf.use_floats)


def aggregate(node: Relation, output_name: str, group_col_names: Sequence[str], over_col_name: str, aggregator: str, agg_out_col_name: str) -> Relation:
    return node.aggregate(output_name, group_col_names, over_col_name, aggregator, agg_out_col_name)


def aggregate_count(node: Relation, output_name: str, group_col_names: Sequence[str], agg_out_col_name: str) -> Relation:
    return node.aggregate_count(output_name, group_col_names, agg_out_col_name)


def index_aggregate(node: Relation, output_name: str, group_col_names: Sequence[str], over_col_name: str, aggregator: str, agg_out_col_name: str, eq_flag_op: Relation | None = None, sorted_keys_op: Relation | None = None) -> Relation:
    """Order and flags that a helper prepared change how a joint computation runs, not what comes out: the sum by key."""
    if aggregator != "sum":
        raise ValueError("index aggregates are sums")
    return node.hybrid_aggregate(output_name, group_col_names, over_col_name, agg_out_col_name)


def leaky_index_aggregate(node: Relation, output_name: str, group_col_names: Sequence[str], over_col_name: str, aggregator: str, agg_out_col_name: str, dist_keys_op: Relation, keys_to_idx_map: Relation) -> Relation:
    if aggregator != "sum":
        raise ValueError("index aggregates are sums")
    return node.leaky_index_aggregate(output_name, over_col_name, agg_out_col_name, keys_to_idx_map, dist_keys_op)


def distinct(node: Relation, output_name: str, selected_col_names: Sequence[str]) -> Relation:
    return node.distinct(output_name, selected_col_names)


def distinct_count(node: Relation, output_name: str, selected_col_name: str) -> Relation:
    return node.distinct_count(output_name, selected_col_name)


def num_rows(node: Relation, output_name: str, col_name: str = "len") -> Relation:
    return node.num_rows(output_name, col_name)


def sort_by(node: Relation, output_name: str, sort_by_col_name: str) -> Relation:
    return node.sort_by(output_name, sort_by_col_name)


def limit(node: Relation, output_name: str, num: int, order_by: Sequence[str] = ()) -> Relation:
    return node.limit(output_name, num, order_by)


def index(node: Relation, output_name: str, idx_col_name: str = "index", order_by: Sequence[str] = ()) -> Relation:
    return node.index(output_name, idx_col_name, order_by)


def unpermute(node: Relation, output_name: str, sort_by_col_name: str, re_indexed_col_name: str, order_by: Sequence[str] = ()) -> Relation:
    return node.unpermute(output_name, sort_by_col_name, re_indexed_col_name, order_by)


def comp_neighs(node: Relation, output_name: str, comp_col_name: str, order_by: Sequence[str] = ()) -> Relation:
    return node.comp_neighs(output_name, comp_col_name, order_by)


def shuffle(node: Relation, output_name: str, seed: int | None = None) -> Relation:
    return node.shuffle(output_name, seed)


def union(left: Relation, right: Relation, output_name: str, left_col_name: str, right_col_name: str) -> Relation:
    return left.union(right, output_name, left_col_name, right_col_name)


def pub_intersect(node: Relation, output_name: str, col_name: str, other: Relation, other_col_name: str | None = None) -> Relation:
    """``other`` is the other party's relation, which needs no connection here."""
    return node.pub_intersect(output_name, col_name, other, other_col_name)


def pub_join(node: Relation, output_name: str, key_col_name: str, other: Relation, other_key_col_name: str | None = None) -> Relation:
    return node.pub_join(output_name, key_col_name, other, other_key_col_name)


def join(left: Relation, right: Relation, output_name: str, left_col_names: Sequence[str], right_col_names: Sequence[str]) -> Relation:
    return left.join(right, output_name, left_col_names, right_col_names)


def join_flags(left: Relation, right: Relation, output_name: str, left_col_names: Sequence[str], right_col_names: Sequence[str], out_col_name: str = "flags") -> Relation:
    """Both sides carry their row numbers in a column ``index``."""
    return left.join_flags(right, output_name, left_col_names[0], right_col_names[0], out=out_col_name)


def flag_join(left: Relation, right: Relation, output_name: str, left_col_names: Sequence[str], right_col_names: Sequence[str], join_flags_op: Relation) -> Relation:
    flag = join_flags_op.columns[-1]
    flags = Relation(join_flags_op.df.withColumnRenamed(flag, "flag"), join_flags_op.node)
    return left.flag_join(right, flags, output_name, right_col_names[0])


def index_join(left: Relation, right: Relation, output_name: str, left_col_names: Sequence[str], right_col_names: Sequence[str], index_op: Relation) -> Relation:
    return left.index_join(right, index_op, output_name, right_col_names[0])


def indexes_to_flags(node: Relation, lookup: Relation, output_name: str, stage: int = 0) -> Relation:
    if stage != 0:
        raise ValueError("the later stages arrange rows for oblivious gathers; see tessera.operators.indexes.arranged and gather")
    return node.indexes_to_flags(lookup, output_name)


def concat(nodes: Sequence[Relation], output_name: str, column_names: Sequence[str] | None = None) -> Relation:
    return R.concat(nodes, output_name, column_names)


def concat_cols(nodes: Sequence[Relation], output_name: str, use_mult: bool = False, order_by: Sequence[Sequence[str]] | None = None) -> Relation:
    return R.concat_cols(nodes, output_name, order_by, use_mult)


def blackbox(nodes: Sequence[Relation], output_name: str, column_names: Sequence[str], backend: str, code) -> Relation:
    """``backend`` is "spark"; ``code`` a function of DataFrames, or SQL over ``in0``, ``in1``, ..."""
    if backend != "spark":
        raise ValueError(f"no such backend here: {backend}")
    return R.blackbox(nodes, output_name, column_names, code)


def persist(node: Relation, output_name: str) -> Relation:
    return node.persist(output_name)


def close(node: Relation, output_name: str, target_parties: Iterable[int]) -> Relation:
    return node.close(output_name, target_parties)


def open_(node: Relation, output_name: str, target_party: int) -> Relation:
    return node.open(output_name, target_party)


_persist, _close, _open, _pub_intersect, _pub_join, _comp_neighs, _unpermute = persist, close, open_, pub_intersect, pub_join, comp_neighs, unpermute
_join_flags, _flag_join, _index_join, _indexes_to_flags, _leaky_index_aggregate = join_flags, flag_join, index_join, indexes_to_flags, leaky_index_aggregate
