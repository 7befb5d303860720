"""Plans as text and as Graphviz."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from tessera.policy import Node, placement, primitives, rewritten
from tessera.relation import Relation


def describe_node(n: Node) -> str:
    cols = ", ".join(f"{c.name}{{{','.join(map(str, sorted(c.trust)))}}}" for c in n.columns)
    sources = ", ".join(p.name for p in n.parents)
    return f"{n.op.upper()}({sources}{'; ' if sources and n.detail else ''}{n.detail}) AS {n.name}([{cols}]) {{{', '.join(map(str, sorted(n.owners)))}}}"


def _nodes(outputs: Relation | Sequence[Relation], rewrite: bool) -> list[Node]:
    nodes = [r.node for r in ([outputs] if isinstance(outputs, Relation) else outputs)]
    return rewritten(nodes) if rewrite else nodes


def describe(outputs: Relation | Sequence[Relation], all_parties: Iterable[int] = (1, 2, 3), expand: bool = False, rewrite: bool = False) -> str:
    """A line for each step, with trust and owners, where it would run and what would cross a boundary for it. ``expand``: indented below a
    public or hybrid step, the plain steps that it stands for. ``rewrite``: of the plan with fewer joint steps (``policy.rewritten``)."""
    nodes = _nodes(outputs, rewrite)
    lines = []
    for s in placement(nodes, all_parties):
        notes = "; ".join(x for x in (s.where, s.how, *s.crosses) if x)
        lines.append(f"{describe_node(s.node)}  -- {notes}")
        if expand:
            lines += [f"    {where}: {what}" for where, what in primitives(s)]
    return "\n".join(lines)


def dot(outputs: Relation | Sequence[Relation], all_parties: Iterable[int] = (1, 2, 3), rewrite: bool = False) -> str:
    """Joint steps are filled, hybrid and public ones in another colour."""
    nodes = _nodes(outputs, rewrite)
    lines = ["digraph plan {", "  node [shape=box, style=filled, fillcolor=white];"]
    for s in placement(nodes, all_parties):
        colour = "white" if s.where != "joint" else "lightsalmon" if not s.how else "lightblue"
        label = f"{s.node.op}\\n{s.node.name}\\n{s.node.detail}".replace('"', "'")
        lines.append(f'  n{s.node.id} [label="{label}", fillcolor={colour}];')
        lines += [f"  n{p.id} -> n{s.node.id};" for p in s.node.parents]
    return "\n".join([*lines, "}"])


def physical(relation: Relation, mode: str = "formatted") -> str:
    """Spark's own plan of the rows."""
    df = relation.df
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
