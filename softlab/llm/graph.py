"""Connected components of an edge table, by large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_table

CONTRACTED = 1 << 18    # edges that a task contracts together


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root``: the smallest node reachable, for every node of the
    edge table (columns ``u``, ``v``) but the roots themselves.

    Every step first contracts the edges that a task has (to one star for each
    part that they connect), then replaces edges by edges to the smallest
    neighbour, keeps the components, and ends in one star per component.  Smallest
    neighbours are aggregated and joined back, so a node's neighbours are in no
    list; each step is written to the shared folder.  Steps end when what they
    wrote are stars.
    """
    now = edges.filter("u <> v")
    while True:
        now = shared_table(_small_star(_large_star(_distinct(now.mapInArrow(_contract, "u long, v long")))), "components")
        if _unfinished(now).isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _unfinished(edges: DataFrame) -> DataFrame:
    """Nodes with two smaller neighbours, or with both smaller and larger ones:
    without any, each component is one star round its smallest node."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")),
                   F.struct(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    nodes = edges.select(F.inline(ends)).groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return nodes.filter((F.col("below") > 1) | ((F.col("below") > 0) & (F.col("above") > 0)))


def _contract(batches):
    """Edges of what these connect, from each node to the smallest: some rows at a
    time, so memory is bounded."""
    held, n = [], 0
    for batch in batches:
        held.append((np.asarray(batch.column("u")), np.asarray(batch.column("v"))))
        n += batch.num_rows
        if n >= CONTRACTED:
            yield stars(held)
            held, n = [], 0
    if n:
        yield stars(held)


def stars(held) -> pa.RecordBatch:
    """(u, v): every node of the edges, (u, v) arrays, but the smallest of its part, to that."""
    u, v = (np.concatenate(x) for x in zip(*held, strict=True))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    root = np.arange(len(nodes))
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = np.minimum(low, low[low])
        if np.array_equal(low, root):
            break
        root = low
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.RecordBatch.from_pydict({"u": pa.array(nodes[own]), "v": pa.array(nodes[root[own]])})


def _distinct(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger node ``u`` to the smaller ``v``."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node, to the smallest of it and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _distinct(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours, to the smallest of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _distinct(others.unionByName(least.select("u", F.col("m").alias("v"))))
