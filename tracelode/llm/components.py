"""Connected components of an edge table by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept

#: Edges (two keys each) that one task may take to end the contraction, for callers that ask for it.
FEW = 200_000


def _united(edges):
    """``node, root`` of the edges of one bounded frame; the root is a smallest member."""
    import pandas as pd

    code, names = pd.factorize(pd.concat([edges["a"], edges["b"]], ignore_index=True), sort=True)
    parent = list(range(len(names)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for x, y in zip(code[: len(edges)].tolist(), code[len(edges) :].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return pd.DataFrame({"node": names, "root": [names[find(i)] for i in range(len(names))]})


def components(edges: DataFrame, few: int = 0) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b`` (any orderable type): equal roots, connected nodes.

    Each round, every node points to the neighbour (or itself) with the smallest hash under the round's seed, and the
    edges are drawn again between the nodes pointed to; about half of the nodes go, so the rounds
    grow with the logarithm of the size. Only edges and pointers move, never a component; minima combine
    before their shuffle, so a node with very many neighbours is no large group. Once at most ``few`` edges are left one task
    unites them, which saves the many small rounds at the end. The last step follows the pointers.
    """
    live = kept(edges.where("a <> b").select("a", "b").distinct(), "edges")
    rounds: list[DataFrame] = []
    while (left := live.count()) > few:
        rank = lambda c, seed=len(rounds): F.struct(F.xxhash64(F.lit(seed), F.col(c)).alias("h"), F.col(c).alias("x"))
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min(rank("b")).alias("low"))
        pointer = kept(nearest.select(F.col("a").alias("node"), F.least("low", rank("a"))["x"].alias("root")), "pointers")
        at_a = pointer.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        at_b = pointer.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        drawn = live.join(at_a, "a").join(at_b, "b").where("ra <> rb")
        live = kept(drawn.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        rounds.append(pointer)
    kind = edges.schema["a"].dataType.simpleString()
    if left:
        found = kept(live.groupBy(F.lit(0).alias("all")).applyInPandas(_united, f"node {kind}, root {kind}"), "united")
    elif rounds:
        found = rounds.pop()
    else:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    while rounds:
        later = found.select(F.col("node").alias("root"), F.col("root").alias("end"))
        found = rounds.pop().join(later, "root", "left").select("node", F.coalesce("end", "root").alias("root"))
    return found
