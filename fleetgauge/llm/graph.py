"""Connected components of an edge table: contraction inside tasks, then rounds of joins and aggregates."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import stored

#: A task contracts about this many edges by itself.
EDGES_A_TASK = 1_000_000


def contracted(batches):
    """u, v: each node of a task's edges (u, v) with the smallest one that they join it to, if that is smaller."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (above := parent.setdefault(top, top)) != top:
            top = above
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            one, two = root(a), root(b)
            parent[max(one, two)] = min(one, two)
    nodes = [x for x in parent if parent[x] != x]
    for at in range(0, len(nodes), 100_000):
        part = nodes[at : at + 100_000]
        columns = [pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())]
        yield pa.record_batch(columns, names=["u", "v"])


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``edges`` (a, b longs, neither null).

    Each task first replaces some EDGES_A_TASK edges by stars, which needs no shuffle. Where there was more
    than one such task, stars are joined by large-star and small-star in turn: every node's larger
    neighbours, then its smaller ones with itself, are linked to the smallest of all. Only minima are
    aggregated and joined again; edges of one node meet in the join, where adaptive execution splits them.
    Every round is written to the shared folder; rounds end when none changes an edge. Edges from a node
    to itself, repeated and reversed ones add nothing; without edges there are no nodes.
    """
    given = stored(edges.filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")), "edges")
    tasks = given.count() // EDGES_A_TASK + 1
    current = stored(given.coalesce(tasks).mapInArrow(contracted, "u long, v long"), "edges")
    if tasks > 1:
        current = _starred(current, most_rounds)
    named = current.groupBy("u").agg(F.min("v").alias("component"))
    # In a star forest the smallest nodes are those that something is linked to.
    roots = current.select(F.col("v").alias("u")).distinct().select("u", F.col("u").alias("component"))
    return named.unionByName(roots).withColumnRenamed("u", "node")


def _starred(current: DataFrame, most_rounds: int) -> DataFrame:
    """A star forest, (node, smallest node) without the smallest ones, from edges (u > v)."""
    mark = None
    for _ in range(most_rounds):
        every = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = every.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("m", "u").alias("m"))
        large = every.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.distinct(), "edges")
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(smallest.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        current = stored(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
        now = current.agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("s"),
        ).first()
        if now == mark:
            return current
        mark = now
    raise RuntimeError("components did not settle")
