"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _common as C


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, root for every node of ``edges`` (a long, b long; self-loops and repeats allowed): root is the least node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until no edge changes: a number of rounds that
    is logarithmic in practice. Each round is written to the shared folder. A hub's neighbours are never gathered: a round takes the
    least neighbour of each node by an aggregate that combines before the shuffle, stores it, and joins it back; as it is stored, the join has
    a partitioning of its own, in which Spark splits a hub's rows.
    """
    links = C.stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), label)
    before = None
    while True:
        links = C.stored(_small_star(_large_star(links)), label)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    alone = links.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return roots.unionByName(alone)


def _large_star(links: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least of its neighbours and itself."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = C.stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")), "components-least")
    return both.where("b > a").join(least, "a").select(F.col("least").alias("a"), "b").where("a < b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours, and itself, to the least of them."""
    links = C.stored(links, "components-large")
    least = C.stored(links.groupBy("b").agg(F.min("a").alias("least")), "components-least")
    joined = links.join(least, "b")
    return joined.select(F.col("least").alias("x"), F.col("a").alias("y")).where("x < y").unionByName(least.select(F.col("least").alias("x"), F.col("b").alias("y"))).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
