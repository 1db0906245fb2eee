"""Connected components of an edge table: forests within partitions, alternating star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators.common import dropped, stored

#: Edges that one task turns into a forest; the number of tasks follows from the number of edges.
EDGES = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A star for each component of a partition's edges, around its least node; nodes are numbers or structs of such."""
    parent: dict = {}
    kind = None

    def root(x):
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    def nodes(column: pa.Array) -> list:
        return list(zip(*(f.to_pylist() for f in column.flatten()))) if pa.types.is_struct(column.type) else column.to_pylist()

    def column(found: list) -> pa.Array:
        return pa.array([dict(zip((f.name for f in kind), x)) for x in found] if pa.types.is_struct(kind) else found, kind)

    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in zip(nodes(batch.column(0)), nodes(batch.column(1))):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    known = list(parent)
    for lo in range(0, len(known), 100_000):
        pairs = [(x, top) for x in known[lo : lo + 100_000] if (top := root(x)) != x]
        yield pa.RecordBatch.from_arrays([column([u for u, _ in pairs]), column([v for _, v in pairs])], names=["u", "v"])


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))  # combined before the shuffle, so a hub is no hot key


def _settled(e: DataFrame) -> bool:
    """Whether all edges are stars: no node has two centres or is both centre and leaf."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionByName(e.select(F.col("v").alias("n"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
    return not ends.groupBy("n").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).where("leaf > 1 or (leaf > 0 and centre > 0)").limit(1).count()


def _contracted(e: DataFrame) -> DataFrame:
    """One large and one small star: each node's larger neighbours point to its least one, then its smaller ones do."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    e = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    small = e.join(_least(e), "u")
    return small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60, per_task: int = EDGES) -> DataFrame:
    """(node, component): the least node reachable, for every node of the edges (u, v); nodes on no edge are absent.

    Each round first replaces the edges of every partition by a forest of stars. Edges that fit one task are done
    then; others go through a star contraction, whose number of rounds grows with the logarithm of the nodes."""
    e = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v"))
    for _ in range(most_rounds):
        tasks = max(1, -(-e.count() // per_task))
        stars = stored(e.repartition(tasks).mapInArrow(_forest, e.schema))
        dropped(e)
        if tasks == 1 or _settled(stars):
            leaves = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return leaves.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        e = stored(_contracted(stars))
        dropped(stars)
    raise RuntimeError("components did not settle")
