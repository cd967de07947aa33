"""Grouping operators: exact-duplicate groups, near-duplicate components, families and their centroids."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.functions.math import dot
from vigil.functions.text import normalize_text

#: Rows of a block of vectors. A task holds two blocks; the number of blocks grows with the rows.
BLOCK = 2048


def content(*fields: str) -> Column:
    """What exact duplicates have in common: the normalised texts of these columns."""
    return F.concat_ws("|", *[normalize_text(F.coalesce(f, F.lit(""))) for f in fields])


def duplicate_groups(df: DataFrame, key: str, content: Column) -> DataFrame:
    """key and dup_group, the smallest key with the same content. Contents are hashed once, before anything is shuffled."""
    checkpoints(df.sparkSession)
    rows = df.select(F.col(key).alias("id"), F.sha2(content, 256).alias("h")).checkpoint()
    first = rows.groupBy("h").agg(F.min("id").alias("dup_group"))
    return rows.join(first, "h").select(F.col("id").alias(key), "dup_group")


def _cells(rows: DataFrame, both_ways: bool) -> DataFrame:
    """rows with cell (a pair of blocks) and side (0, 1 or, in a diagonal cell, 2). Each pair of rows meets in one cell, or in one for each order."""
    blocks = max(1, -(-rows.count() // BLOCK))
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    other = F.sequence(F.lit(0), F.lit(blocks - 1))
    diagonal = F.struct(F.col("blk").alias("x"), F.col("blk").alias("y"), F.lit(2).alias("side"))
    if both_ways:
        one = F.transform(F.filter(other, lambda o: o != F.col("blk")), lambda o: F.struct(F.col("blk").alias("x"), o.alias("y"), F.lit(0).alias("side")))
        two = F.transform(F.filter(other, lambda o: o != F.col("blk")), lambda o: F.struct(o.alias("x"), F.col("blk").alias("y"), F.lit(1).alias("side")))
        every = F.concat(one, two, F.array(diagonal))
    else:
        place = lambda o: F.struct(F.least("blk", o).alias("x"), F.greatest("blk", o).alias("y"), (F.col("blk") > o).cast("int").alias("side"))
        every = F.concat(F.transform(F.filter(other, lambda o: o != F.col("blk")), place), F.array(diagonal))
    return rows.withColumn("c", F.explode(every)).select(*[c for c in rows.columns if c != "blk"], (F.col("c.x") * blocks + F.col("c.y")).alias("cell"), "c.side")


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 1))


def similar_pairs(vectors: DataFrame, threshold: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Pairs a < b of unit vectors with inner product at or above the threshold; exact.

    Vectors are cut into blocks by a hash of their key; a pair of blocks is one task's work, a matrix product in one Arrow batch. The
    number of blocks grows with the rows, so no task sees more than two blocks of about BLOCK rows; the number of comparisons is
    quadratic, as any exact answer at low thresholds.
    """
    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        left, right = f[f["side"] != 1], f[f["side"] != 0]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        scores = _matrix(left["v"]) @ _matrix(right["v"]).T
        i, j = np.nonzero(scores >= threshold)
        a, b = left["id"].to_numpy()[i], right["id"].to_numpy()[j]
        keep = a < b if (f["side"] == 2).any() else a != b
        a, b, s = a[keep], b[keep], scores[i, j][keep]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "score": s})

    return _cells(rows, False).groupBy("cell").applyInPandas(run, "a long, b long, score double")


def _best_tree(s: np.ndarray, square: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A maximum spanning forest by Prim's steps: ends (rows of s first, then its columns, or rows only if it is square) and weights. -inf is no edge."""
    rows, n = len(s), len(s) if square else sum(s.shape)
    other = s if square else np.ascontiguousarray(s.T)
    best, parent, done, ends = np.full(n, -np.inf), np.zeros(n, int), np.zeros(n, bool), []
    fresh = 0
    for _ in range(n):
        v = int(best.argmax())
        if best[v] == -np.inf:
            while done[fresh]:
                fresh += 1
            v = fresh
        else:
            ends.append((parent[v], v, best[v]))
        done[v], best[v] = True, -np.inf
        part, row = (slice(0, n), s[v]) if square else (slice(rows, n), s[v]) if v < rows else (slice(0, rows), other[v - rows])
        better = (row > best[part]) & ~done[part]
        best[part][better], parent[part][better] = row[better], v
    found = np.array(ends).reshape(-1, 3)
    return found[:, 0].astype(int), found[:, 1].astype(int), found[:, 2]


def similar_forest(vectors: DataFrame, threshold: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Of the pairs that similar_pairs() gives, a maximum spanning forest for each pair of blocks: at any threshold they connect what all pairs connect, and a task gives
    fewer rows than its two blocks have."""
    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        left, right = f[f["side"] != 1], f[f["side"] != 0]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        scores = _matrix(left["v"]) @ _matrix(right["v"]).T
        scores[~(scores >= threshold)] = -np.inf
        square = bool((f["side"] == 2).any())
        ids = (left if square else pd.concat([left, right]))["id"].to_numpy()
        if square:
            scores[ids[:, None] == ids[None, :]] = -np.inf
        i, j, s = _best_tree(scores, square)
        return pd.DataFrame({"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j]), "score": s})

    return _cells(rows, False).groupBy("cell").applyInPandas(run, "a long, b long, score double")


def nearest(df: DataFrame, k: int, key: str, vector: str, group: Column | None = None, usable: Column | None = None) -> DataFrame:
    """a, b, score, rank: for every row the k usable rows of other groups with the largest inner products; ties go to the smaller key. Exact, by blocks."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), (group if group is not None else F.col(key)).cast("string").alias("g"), F.coalesce(usable, F.lit(False)).alias("u") if usable is not None else F.lit(True).alias("u"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        left, right = f[f["side"] != 1], f[(f["side"] != 0) & f["u"]].sort_values("id")
        if not len(left) or not len(right):
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        scores = _matrix(left["v"]) @ _matrix(right["v"]).T
        scores[left["g"].to_numpy()[:, None] == right["g"].to_numpy()[None, :]] = -np.inf
        order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        top = np.take_along_axis(scores, order, 1)
        a, b, s = np.repeat(left["id"].to_numpy(), order.shape[1]), right["id"].to_numpy()[order.reshape(-1)], top.reshape(-1)
        there = np.isfinite(s)
        return pd.DataFrame({"a": a[there], "b": b[there], "score": s[there]})

    found = _cells(rows.filter(F.col("v").isNotNull()), True).groupBy("cell").applyInPandas(run, "a long, b long, score double")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def checkpoints(spark: SparkSession) -> None:
    """Sees that the session has a checkpoint folder: the shared one, or a temporary one in a local session."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp()
        spark.sparkContext.setCheckpointDir(folder)


def work_path(spark: SparkSession, what: str) -> str:
    """A fresh path for a work table in the checkpoint folder."""
    checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a work table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def component_roots(nodes: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """key and root, the smallest node that links (a, b) connect it with, by large and small stars until nothing moves.

    Each round sends every neighbour of a node to the smallest of them; larger ones first, then the others. The number of
    rounds grows with the logarithm of the longest chain. Links with an end that isn't in nodes don't count.
    Every round is checkpointed in the shared folder, so lineage stays short and lost executors cost one round.
    """
    checkpoints(nodes.sparkSession)
    known = nodes.select(F.col(key).alias("u")).distinct().checkpoint()
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = edges.join(known, "u", "left_semi").join(known.withColumnRenamed("u", "v"), "v", "left_semi").select("u", "v").checkpoint()
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = small.filter("u <> v").distinct().checkpoint()
        # The rounds are over when every node hangs on one other and nothing has moved.
        state = edges.agg(F.count("*"), F.count_distinct("u"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
    rooted = nodes.select(F.col(key).alias("u")).join(edges, "u", "left")
    return rooted.select(F.col("u").alias(key), F.coalesce("v", "u").alias("root"))


def centroids(df: DataFrame, family: str, vector: str) -> DataFrame:
    """Per family the mean vector at unit length, by partial sums per coordinate."""
    parts = df.select(family, F.posexplode(vector).alias("i", "x")).groupBy(family, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = parts.groupBy(family).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("c"))
    values = F.transform("c", lambda s: s["x"])
    return whole.select(family, values.alias("c")).select(family, F.transform("c", lambda x: x / F.sqrt(dot(F.col("c"), F.col("c")))).alias("centroid"))


def purity(df: DataFrame, cluster: str, truth: str) -> DataFrame:
    n = df.groupBy(cluster, truth).agg(F.count("*").alias("n"))
    best = n.groupBy(cluster).agg(F.max("n").alias("best"), F.sum("n").alias("all"))
    return best.agg((F.sum("best") / F.sum("all")).alias("purity"))


def pairwise(df: DataFrame, cluster: str, truth: str) -> DataFrame:
    """Exact pairwise precision, recall and F1 from contingency counts."""
    pairs = lambda *k: df.groupBy(*k).agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("p"))
    both, c, t = pairs(cluster, truth).toDF("tp"), pairs(cluster).toDF("pc"), pairs(truth).toDF("pt")
    one = both.join(F.broadcast(c)).join(F.broadcast(t)).select((F.col("tp") / F.col("pc")).alias("precision"), (F.col("tp") / F.col("pt")).alias("recall"))
    return one.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))


def top_per_group(df: DataFrame, group: str, value: str, k: int) -> DataFrame:
    """The k most frequent values of each group with their shares; ties go to the smaller value."""
    n = df.groupBy(group, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group)
    out = n.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), value)))
    return out.filter(F.col("r") <= k).drop("n", "r")
