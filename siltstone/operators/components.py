"""Connected components by alternating stars (Kiveris et al. 2014): no task has to see a component."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.sources.scratch import materialise

#: Edges that a task holds at a time to turn them into stars.
HELD_EDGES = 1 << 19


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node) of all but the least node of each component of the edges given."""
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = ends[: len(u)], ends[len(u) :], np.arange(len(names))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        a, b = a[root[a] != root[b]], b[root[a] != root[b]]
    rest = np.flatnonzero(root < np.arange(len(names)))
    return names[rest], names[root[rest]]


def local_stars(edges: DataFrame) -> DataFrame:
    """(u, v) edges with the same components: each task turns HELD_EDGES of its edges at a time into stars.

    A table that fits one task needs no round after this; in a larger one no task sees more than those edges."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= HELD_EDGES:
                yield out(held)
                held, n = [], 0
        if n:
            yield out(held)

    def out(held):
        u, v = stars(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def lead_to_roots(edges: DataFrame) -> bool:
    """Whether every u of the edges (u, v), v < u, has one edge and no v is a u: then each v is the least of its component."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.filter("up + down > 1 and up > 0").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of an edge: root is the least node that can be reached.

    First each task turns its own edges into stars, where nodes are long numbers. Then rounds of two steps.
    Large star: each node hands the least of its neighbours and itself to its larger neighbours. Small
    star: to its smaller ones. Both are an aggregate and an equi-join. It ends when every edge leads to a
    root, which is seen from the edges themselves: no further round has to confirm it. Self loops and
    repeated edges do no harm; an edge with a null is left out.
    """
    u, v = F.col(a), F.col(b)
    loops = edges.filter(u == v).select(u.alias("node"), u.alias("root")).distinct()
    now = edges.filter(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    now = materialise(local_stars(now) if {k for _, k in now.dtypes} == {"bigint"} else now, "edges")
    while not lead_to_roots(now):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u != v").distinct()
        now = materialise(small, "small")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    found = now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
    return found.union(loops.join(found, "node", "left_anti"))
