"""Components of a similarity graph at every threshold: a maximum spanning forest, and one pass over its edges by bands of weight.

At any threshold the forest's edges of at least that weight connect what all edges of at least that weight connect, so the graph is read
once and every threshold after the first costs only the forest edges of its own band.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.groups import checkpoints, component_roots


#: Edges of which one task makes a forest.
ONE_TASK = 1_000_000


class _Union:
    """Nodes by number; a set's root is its smallest number."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _kept(f: pd.DataFrame) -> pd.DataFrame:
    """A maximum spanning forest of the edges of f, by Kruskal's steps; of equal scores the smaller pair comes first."""
    f = f[["a", "b", "score"]].sort_values(["score", "a", "b"], ascending=[False, True, True])
    nodes, number = np.unique(np.concatenate([f["a"], f["b"]]), return_inverse=True)
    sets, n = _Union(len(nodes)), len(f)
    return f[[sets.join(x, y) for x, y in zip(number[:n].tolist(), number[n:].tolist())]]


def _thinned(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges of which a maximum spanning forest is one of all edges, and their number: forests of parts, until one task can take them or that leaves most of them."""
    kinds = ", ".join(f"{c} {t}" for c, t in edges.dtypes)
    edges = edges.checkpoint()
    n = edges.count()
    while n > ONE_TASK:
        parts = max(2, -(-2 * n // max(1, ONE_TASK)))
        fewer = edges.groupBy(F.pmod(F.xxhash64("a", "b"), F.lit(parts)).alias("part")).applyInPandas(_kept, kinds).checkpoint()
        before, n, edges = n, fewer.count(), fewer
        if n > 0.7 * before:
            break
    return edges, n


def spanning_forest(edges: DataFrame) -> DataFrame:
    """a, b, score of a maximum spanning forest of edges (a, b, score), by Boruvka's rounds; of equal scores the smaller pair comes first.

    In a round every component takes its best edge outwards. As edges are in one order, the choices have no cycle but two components that choose
    each other, so following them to their end names the merged component; the number of components halves at least.
    Of the edges between two components only the best is kept. Every round is checkpointed. Parts of the edges are thinned to their forests first; up to ONE_TASK
    edges that are left are one task's work.
    """
    checkpoints(edges.sparkSession)
    edges, n = _thinned(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score"))
    if n <= ONE_TASK:
        return edges.withColumn("part", F.lit(0)).groupBy("part").applyInPandas(_kept, ", ".join(f"{c} {t}" for c, t in edges.dtypes))
    best = F.max(F.struct("score", (-F.col("a")).alias("na"), (-F.col("b")).alias("nb"))).alias("e")
    rows = edges.groupBy("a", "b").agg(F.max("score").alias("score"))
    rows = rows.select(F.col("a").alias("u"), F.col("b").alias("v"), "a", "b", "score").checkpoint()
    forest = rows.select("a", "b", "score").limit(0)
    while not rows.isEmpty():
        both = rows.unionByName(rows.select(F.col("v").alias("u"), F.col("u").alias("v"), "a", "b", "score"))
        chosen = both.groupBy("u").agg(F.max(F.struct("score", (-F.col("a")).alias("na"), (-F.col("b")).alias("nb"), "v")).alias("e")).select("u", F.col("e.v").alias("v"), (-F.col("e.na")).alias("a"), (-F.col("e.nb")).alias("b"), "e.score").checkpoint()
        forest = forest.unionByName(chosen.select("a", "b", "score").distinct())
        ahead = chosen.select(F.col("u").alias("v"), F.col("v").alias("w"))
        # Of two components that choose each other the smaller is the root.
        parent = chosen.select("u", "v").join(ahead, "v", "left").select("u", F.when((F.col("w") == F.col("u")) & (F.col("u") < F.col("v")), F.col("u")).otherwise(F.col("v")).alias("root")).checkpoint()
        while True:
            up = parent.select(F.col("u").alias("root"), F.col("root").alias("further"))
            moved = parent.join(up, "root", "left").select("u", F.coalesce("further", "root").alias("next"), "root").checkpoint()
            parent = moved.select("u", F.col("next").alias("root"))
            if moved.filter("next <> root").isEmpty():
                break
        rows = rows.join(parent.withColumnRenamed("root", "ru"), "u").join(parent.select(F.col("u").alias("v"), F.col("root").alias("rv")), "v").filter("ru <> rv")
        rows = rows.groupBy(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).agg(best)
        rows = rows.select("u", "v", (-F.col("e.na")).alias("a"), (-F.col("e.nb")).alias("b"), "e.score").checkpoint()
        forest = forest.checkpoint()
    return forest


def _roots(thresholds: list[float]):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        """The smallest node of its component at each threshold, for nodes that edges of f connect with another."""
        f = f.sort_values("score", ascending=False)
        nodes, number = np.unique(np.concatenate([f["a"], f["b"]]), return_inverse=True)
        sets, n, score, out, i = _Union(len(nodes)), len(f), f["score"].tolist(), [], 0
        a, b = number[:n].tolist(), number[n:].tolist()
        for t in sorted(thresholds, reverse=True):
            while i < n and score[i] >= t:
                sets.join(a[i], b[i])
                i += 1
            root = np.array([sets.find(x) for x in range(len(nodes))], int)
            moved = root != np.arange(len(nodes))
            out.append(pd.DataFrame({"threshold": float(t), "node": nodes[moved], "root": nodes[root[moved]]}))
        return pd.concat(out)

    return run


def components_by_threshold(nodes: DataFrame, forest: DataFrame, thresholds: list[float], key: str) -> DataFrame:
    """threshold, key, root for every node: the smallest node of its component at each threshold. Thresholds are taken from the highest down; each merges what the one before left."""
    checkpoints(nodes.sparkSession)
    now, forest = nodes.select(F.col(key), F.col(key).alias("root")).distinct().checkpoint(), forest.checkpoint()
    if forest.count() <= ONE_TASK:
        kind = now.schema[key].dataType.simpleString()
        ends = [now.select(F.col(key).alias(c)) for c in "ab"]
        linked = forest.join(ends[0], "a", "left_semi").join(ends[1], "b", "left_semi").withColumn("part", F.lit(0)).groupBy("part").applyInPandas(_roots(thresholds), f"threshold double, node {kind}, root {kind}")
        every = now.select(key, F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
        out = every.join(linked.withColumnRenamed("node", key), ["threshold", key], "left")
        return out.select("threshold", key, F.coalesce("root", key).alias("root"))
    out, above = None, None
    for t in sorted(thresholds, reverse=True):
        band = forest.filter((F.col("score") >= t) & (F.lit(True) if above is None else F.col("score") < above))
        at = now.select(F.col(key).alias("a"), F.col("root").alias("ra"))
        to = now.select(F.col(key).alias("b"), F.col("root").alias("rb"))
        if not band.isEmpty():  # else the components of the threshold above
            links = band.join(at, "a").join(to, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
            merged = component_roots(now.select(F.col("root").alias("node")).distinct(), links, "node").select(F.col("node").alias("root"), F.col("root").alias("new"))
            now = now.join(merged, "root").select(key, F.col("new").alias("root")).checkpoint()
        part = now.select(F.lit(float(t)).alias("threshold"), key, "root")
        out, above = part if out is None else out.unionByName(part), t
    return out


def sweep(labelled: DataFrame, edges: DataFrame, thresholds: list[float], key: str, label: str) -> DataFrame:
    """threshold, components, largest, and pairwise precision, recall and f1 of components against labels, from contingency counts. A null label is a label."""
    parts = components_by_threshold(labelled, spanning_forest(edges), thresholds, key).join(labelled.select(key, label), key).checkpoint()
    pairs = lambda *by: parts.groupBy("threshold", *by).agg(F.count("*").alias("n"))
    two = F.sum(F.col("n") * (F.col("n") - 1) / 2)
    held = pairs("root").groupBy("threshold").agg(F.count("*").alias("components"), F.max("n").alias("largest"), two.alias("together"))
    true = pairs(label).groupBy("threshold").agg(two.alias("alike"))
    right = pairs("root", label).groupBy("threshold").agg(two.alias("right"))
    out = held.join(true, "threshold").join(right, "threshold")
    p, r = F.col("right") / F.nullif(F.col("together"), F.lit(0.0)), F.col("right") / F.nullif(F.col("alike"), F.lit(0.0))
    out = out.withColumns({"precision": F.coalesce(p, F.lit(0.0)), "recall": F.coalesce(r, F.lit(0.0))})
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    return out.select("threshold", "components", "largest", "precision", "recall", f1.alias("f1"))
