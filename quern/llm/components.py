"""Connected components by contraction.

In each round every node of the graph that is left points to its least neighbour, pointers are
followed to their ends, and each group becomes one node; links inside a group vanish. Rounds
are few: a node survives one only if it is less than all its neighbours. Each round's tables are
written to the shared folder, so that lineage is short and a lost executor costs no more than
the tasks it ran. No row of them comes to the driver, counts apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


class Forest:
    """Union-find over places in an array."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _ends(parents: DataFrame) -> DataFrame:
    """node, parent with each pointer followed to its end, stored; parents: the same, stored, with parent <= node and ends pointing to themselves."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        nexts = stored(parents.join(up, "parent").select("node", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")), "pointers")
        dropped(parents)
        parents = nexts
        if not nexts.filter("moved").limit(1).count():
            return nexts


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (node, label) with the least label of the node's component; edges: a, b. Nodes are of any type that has an order. Null labels are the greatest."""
    maps: list[DataFrame] = []
    left, contracted = edges.filter("a <> b").select("a", "b"), []
    while left.limit(1).count():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        parents = _ends(stored(least.select("node", F.least("node", "least").alias("parent")), "parents"))
        maps.append(parents)
        pa, pb = parents.select(F.col("node").alias("a"), F.col("parent").alias("ra")), parents.select(F.col("node").alias("b"), F.col("parent").alias("rb"))
        left = left.join(pa, "a").join(pb, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        left = stored(left, "contracted")
        dropped(*contracted)
        contracted = [left]
    if not maps:
        return nodes
    roots = maps[0].select("node", F.col("parent").alias("root"))
    for m in maps[1:]:
        up = m.select(F.col("node").alias("root"), F.col("parent").alias("above"))
        roots = roots.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    roots = stored(roots, "roots")  # nodes with links only
    linked = nodes.join(roots, "node").select("root", "label")
    labels = stored(linked.groupBy("root").agg(F.min("label").alias("least")), "labels")
    found = stored(roots.join(labels, "root").select("node", "least"), "labelled")
    dropped(*maps, *contracted, roots, labels)
    return nodes.join(found, "node", "left").select("node", F.coalesce("least", "label").alias("label"))
