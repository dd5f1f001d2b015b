"""Connected components of an edge table by alternating large-star and small-star rounds, each cut in the shared folder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MAX_ROUNDS = 60
#: A node with more than this share of all edges has its own way through a join; there are fewer such nodes than twice HUBS.
HUBS = 1024


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """edges (u, v) with m: the least of u and its v. A hub's rows stay where they are: its least is sent to them."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    hub = F.col("n") > max(1, total // HUBS)
    hubs = F.broadcast(least.where(hub).select("u", "m"))
    rest = edges.join(hubs.select("u"), "u", "left_anti").join(least.where(~hub).select("u", "m"), "u")
    return edges.join(hubs, "u").unionByName(rest)


def connected(edges: DataFrame) -> DataFrame:
    """edges (a, b: long) -> (id, component): for every id in an edge between two ids, the least id that edges lead to.

    A node with very many edges is never gathered: its least neighbour is an aggregate with partial sums, which is sent to its edges.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = C.cut(e, "edges")
    mark = _mark(e)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, mark[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = C.cut(large.distinct(), "edges")  # u > v throughout
        down = large.groupBy("u").agg(F.min("v").alias("v"))
        small = _with_least(large, mark[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down)
        nxt = C.cut(small.where("u <> v").distinct(), "edges")
        C.discard(e, large)
        e, before, mark = nxt, mark, _mark(nxt)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    found = e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("id"), "component").distinct())


def _mark(e: DataFrame) -> tuple:
    """Count and two sums of hashes: equal when the edges are."""
    h = F.xxhash64("u", "v")
    row = e.agg(F.count(F.lit(1)), F.sum(F.pmod(h, F.lit(1_000_003))), F.sum(F.pmod(h, F.lit(999_983)))).first()
    return tuple(row)


class Union:
    """Union-find over positions 0..n-1; the root of a set is its least position."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join_all(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self.find(x), self.find(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)

    def roots(self) -> np.ndarray:
        return np.array([self.find(x) for x in range(len(self.up))], np.int64)


def linked_roots(linked: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix, each row's least connected row: breadth-first by whole rows, without a list of pairs."""
    n = len(linked)
    root = np.full(n, -1, np.int64)
    for s in range(n):
        if root[s] >= 0:
            continue
        front = np.zeros(n, bool)
        front[s] = True
        while front.any():
            root[front] = s
            front = linked[front].any(axis=0) & (root < 0)
    return root
