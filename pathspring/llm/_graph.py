"""Connected components of a graph given by its edges, by alternating star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathspring.llm._store import arrow, written

MOST_ROUNDS = 60
HOT_NODES = 100_000
"""Nodes of very many edges are broadcast: as many at most, about 2 MB."""
FEW_EDGES = 200_000
"""Edges (after a first contraction in place) that one task settles: 3 MB. More are settled step by step in all tasks."""
LEAST_HOT = 64
"""A node with no more edges than that is not one of them."""


class Union:
    """Union-find over 0..n-1 whose roots are the smallest members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        up = self.up
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """The edges as stars around the smallest node of what they connect."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    union = Union(len(nodes))
    for a, b in zip(at[: len(u)].tolist(), at[len(u) :].tolist()):
        union.join(a, b)
    root = np.array([union.find(i) for i in range(len(nodes))], dtype=np.int64)
    tied = root != np.arange(len(nodes))
    return pa.RecordBatch.from_pydict({"u": pa.array(nodes[tied]), "v": pa.array(nodes[root[tied]])})


def _contract(batches):
    for batch in batches:
        yield _stars(*(batch.column(c).to_numpy() for c in ("u", "v")))


def _contract_all(batches):
    held = [tuple(batch.column(c).to_numpy() for c in ("u", "v")) for batch in batches]
    yield _stars(*(np.concatenate(x) for x in zip(*held, (np.zeros(0, dtype=np.int64),) * 2)))


def joined(left: DataFrame, right: DataFrame, key: list[str], weight: str, total: int) -> DataFrame:
    """left join right by key, where right has a row for each key, with the number of left's rows that have it; these are total at most.

    Rows of a key with very many of them stay in place: such keys are HOT_NODES at most,
    and their rows of right are broadcast. The others are joined by a shuffle.
    """
    hot = max(LEAST_HOT, total // HOT_NODES)
    top = right.filter(F.col(weight) > hot)
    rest = left.join(F.broadcast(top.select(*key)), key, "left_anti").join(right.filter(F.col(weight) <= hot).hint("shuffle_merge"), key)
    return left.join(F.broadcast(top), key).unionByName(rest)


def _star(edges: DataFrame, large: bool, hot: int) -> DataFrame:
    """Ties neighbours to the smallest of a node and its neighbours: the larger neighbours, or the smaller ones and the node.

    Edges of a node with more than hot of them stay where they are: such nodes are at
    most HOT_NODES, and the smallest neighbour of each is broadcast. The others' edges
    are joined by a shuffle.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
    least = least.select("u", F.least("u", "m").alias("m"), "k")
    largest = F.broadcast(least.filter(F.col("k") > hot).select("u", F.col("m").alias("of")))
    rows = (both.filter("v > u") if large else both).join(largest, "u", "left")
    few = rows.filter("of is null").drop("of").join(least.filter(F.col("k") <= hot).select("u", "m").hint("shuffle_merge"), "u")
    rows = rows.filter("of is not null").select("u", "v", F.col("of").alias("m")).unionByName(few.select("u", "v", "m"))
    out = rows.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component for every node of the edges (columns u and v, long): the smallest node that it is connected with.

    Large-star and small-star steps alternate (while there are many edges) until the edges stay the same; then
    each edge ties a node to its component. A step finds each node's smallest
    neighbour, combined in place first, and joins it with the node's edges; the edges
    of hot nodes do not move for that. Self-loops and repeated
    edges do no harm; without edges there are no rows.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    e = written(e.transform(arrow(_contract, "u long, v long")).distinct(), "edges")
    before = None
    for _ in range(MOST_ROUNDS):
        now = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if now == before or not now["n"]:
            break
        before = now
        if now["n"] <= FEW_EDGES:
            e = written(e.repartition(1).transform(arrow(_contract_all, "u long, v long")), "edges")
            break
        hot = max(LEAST_HOT, 2 * now["n"] // HOT_NODES)  # nodes with more are 2 n / hot at most
        e = written(_star(_star(e, True, hot), False, hot), "edges")
    else:
        raise RuntimeError("the components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
