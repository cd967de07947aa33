"""Quantile regression by boosted trees over binned features, which Spark ML lacks.

Rows are binned once and written. A pass over them sends, per task, whole-number counts per (quantile, node, feature, bin), or of residuals per (quantile, leaf);
Spark sums them, and the driver gets at most quantiles * nodes * features * bins sums, whatever the number of rows. Counts are whole, so the same
rows give the same trees in any number of tasks and after any retry. Predictions so far are written every `keep` rounds, so a pass never goes through more than `keep` trees.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators.groups import remove, work_path

#: Cells of the grid on which a leaf's quantile of residuals is read, over twice the range of the target.
CELLS = 2048


def _below(edges: Column, v: Column) -> Column:
    """How many edges lie below a value."""
    return F.size(F.filter(edges, lambda e: e < v))


@dataclass
class Binner:
    """How columns become bins: categories by their sorted values, numbers by cuts; 0 is what is null or was not seen when it was fitted."""

    categories: dict[str, list[str]]
    cuts: dict[str, list[float]]

    @property
    def names(self) -> list[str]:
        return [*self.categories, *self.cuts]

    @staticmethod
    def fit(df: DataFrame, categorical: list[str], numeric: list[str], bins: int = 64) -> Binner:
        """Categories of more than `bins` - 1 values are an error; numbers are cut at approximate quantiles."""
        seen = {}
        for c in categorical:
            found = df.select(F.col(c).cast("string").alias("v")).filter("v IS NOT NULL").distinct().orderBy("v").limit(bins).collect()
            if len(found) >= bins:
                raise ValueError(f"{c} has {bins} values or more")
            seen[c] = [r["v"] for r in found]
        at = [i / (bins - 1) for i in range(1, bins - 1)]
        cuts = {}
        if numeric:
            row = df.agg(*[F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None)), at, 10_000).alias(c) for c in numeric]).first()
            cuts = {c: sorted(set(row[c] or [])) for c in numeric}
        return Binner(seen, cuts)

    def columns(self) -> list[Column]:
        """One array column of bins per row."""
        out = []
        for c, values in self.categories.items():
            known = F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")
            out.append(F.coalesce(F.array_position(known, F.col(c).cast("string")), F.lit(0)).cast("int"))
        for c, cuts in self.cuts.items():
            v = F.col(c).cast("double")
            edges = F.array(*[F.lit(float(e)) for e in cuts]) if cuts else F.array().cast("array<double>")
            out.append(F.when(v.isNull() | F.isnan(v), 0).otherwise(1 + _below(edges, v)).cast("int"))
        return out


@dataclass
class Tree:
    """A full binary tree: per inner node a feature (-1: all rows go left) and the bins that go left; values of the leaves."""

    features: list[int]
    left: list[list[int]]
    values: list[float] = field(default_factory=list)

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """The place of each row of bins within the deepest level that is split so far."""
        at, first, width = np.zeros(len(x), dtype=np.int64), 0, 1
        while first + width <= len(self.features):
            right = np.zeros(len(x), dtype=bool)
            for i in range(width):
                if self.features[first + i] >= 0 and (rows := at == i).any():
                    right[rows] = ~np.isin(x[rows, self.features[first + i]], self.left[first + i])
            at, first, width = 2 * at + right, first + width, 2 * width
        return at


@dataclass
class QuantileTrees:
    """Boosted trees for several quantiles of one target."""

    quantiles: list[float]
    binner: Binner
    base: list[float]
    rate: float
    trees: list[list[Tree]]  # per round one tree per quantile

    def predict(self, df: DataFrame, names: list[str]) -> DataFrame:
        """df with one column per quantile, in their order."""
        spans = self.trees

        @F.pandas_udf("array<double>")
        def run(x: pd.Series) -> pd.Series:
            bins = np.array(x.tolist(), dtype=np.int64).reshape(len(x), -1)
            out = np.tile(np.array(self.base), (len(x), 1))
            return pd.Series(list(_add(out, bins, spans, self.rate)))

        rows = df.withColumn("__p", run(F.array(*self.binner.columns())))
        return rows.withColumns({n: F.col("__p")[i] for i, n in enumerate(names)}).drop("__p")

    def to_json(self) -> str:
        trees = [[[t.features, t.left, t.values] for t in r] for r in self.trees]
        return json.dumps({"quantiles": self.quantiles, "categories": self.binner.categories, "cuts": self.binner.cuts, "base": self.base, "rate": self.rate, "trees": trees})

    @staticmethod
    def from_json(text: str) -> QuantileTrees:
        d = json.loads(text)
        return QuantileTrees(d["quantiles"], Binner(d["categories"], d["cuts"]), d["base"], d["rate"], [[Tree(*t) for t in r] for r in d["trees"]])


def _add(out: np.ndarray, bins: np.ndarray, rounds: list[list[Tree]], rate: float) -> np.ndarray:
    for r in rounds:
        for i, t in enumerate(r):
            out[:, i] += rate * np.array(t.values)[t.nodes(bins)]
    return out


def best_split(count: np.ndarray, below: np.ndarray, q: float, ordered: list[bool], least: int) -> tuple[int, list[int]]:
    """count, below: rows, and rows whose target is below the prediction, per feature and bin of one node. The feature and the bins to the left that lower the squared
    sums of the pinball loss's slopes most; feature -1 if no split does or none leaves `least` rows on both sides. Bins of categories are tried in the order of
    their mean slopes. Ties go to the first feature and the fewest bins."""
    slope = q * count - below
    n, s = count[0].sum(), slope[0].sum()
    best = (1e-9, -1, [])
    for f in range(len(count)):
        used = np.flatnonzero(count[f])
        order = used if ordered[f] else used[np.lexsort((used, slope[f][used] / count[f][used]))]
        left_n, left_s = np.cumsum(count[f][order])[:-1], np.cumsum(slope[f][order])[:-1]
        fits = (left_n >= least) & (n - left_n >= least)
        if not fits.any():
            continue
        gain = np.where(fits, left_s**2 / left_n + (s - left_s) ** 2 / (n - left_n) - s * s / n, -1.0)
        at = int(np.argmax(gain))
        if gain[at] > best[0] + 1e-12:
            best = (float(gain[at]), f, sorted(order[: at + 1].tolist()))
    return best[1], best[2]


def grid_quantile(counts: np.ndarray, low: float, width: float, q: float) -> float:
    """The q-quantile of values counted in cells from low on, evenly spread within a cell; 0 without values."""
    run = np.cumsum(counts)
    if not len(run) or run[-1] == 0:
        return 0.0
    want = q * run[-1]
    i = int(np.searchsorted(run, want, side="left"))
    before = run[i - 1] if i else 0
    return low + width * (i + (want - before) / counts[i] if counts[i] else i)


def fit(df: DataFrame, target: str, categorical: list[str], numeric: list[str], quantiles: list[float], rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, least: int = 20, keep: int = 10) -> QuantileTrees:
    """Trees for all quantiles at once. Rows without a finite target don't count; without any, every prediction is 0."""
    spark: SparkSession = df.sparkSession
    y = F.col(target).cast("double")
    rows = df.filter(y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    binner = Binner.fit(rows, categorical, numeric, bins)
    n, low, high = rows.agg(F.count("*"), F.min(y), F.max(y)).first()
    ordered = [False] * len(categorical) + [True] * len(numeric)
    if not n:
        return QuantileTrees(quantiles, binner, [0.0] * len(quantiles), rate, [])
    base = [float(v) for v in rows.agg(F.percentile_approx(y, quantiles, 10_000)).first()[0]]
    model = QuantileTrees(quantiles, binner, base, rate, [])
    start = rows.select(y.alias("y"), F.array(*binner.columns()).alias("x"), F.array(*[F.lit(b) for b in base]).alias("p"))
    state, done = _written(spark, start, None), 0
    span = max(high - low, 1e-12)
    for _ in range(rounds):
        pending = model.trees[done:]
        grown = [Tree([], []) for _ in quantiles]
        for _ in range(depth):
            sums = _histograms(state[0], pending, grown, rate, quantiles, len(ordered), bins)
            for i, t in enumerate(grown):
                for node in range(len(t.features) + 1):  # as many nodes on the next level as there are above it, and one
                    f, left = best_split(sums[i, node, :, :, 0], sums[i, node, :, :, 1], quantiles[i], ordered, least)
                    t.features.append(f)
                    t.left.append(left)
        counts = _residuals(state[0], pending, grown, rate, quantiles, span)
        for i, t in enumerate(grown):
            t.values = [grid_quantile(c, -2 * span, 4 * span / CELLS, quantiles[i]) for c in counts[i]]
        model.trees.append(grown)
        if len(model.trees) - done >= keep:
            state, done = _written(spark, _advanced(state[0], model.trees[done:], rate), state), len(model.trees)
    remove(spark, state[1])
    return model


def _written(spark: SparkSession, df: DataFrame, before: tuple[DataFrame, str] | None) -> tuple[DataFrame, str]:
    """A table of the work folder in place of the one before, which goes once this one is committed."""
    df.write.parquet(path := work_path(spark, "trees"))
    if before:
        remove(spark, before[1])
    return spark.read.schema(df.schema).parquet(path), path


def _arrays(f: pd.DataFrame, pending: list[list[Tree]], rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.array(f["x"].tolist(), dtype=np.int64).reshape(len(f), -1)
    p = np.array(f["p"].tolist(), dtype=np.float64).reshape(len(f), -1)
    return f["y"].to_numpy(), x, _add(p, x, pending, rate)


def _advanced(state: DataFrame, pending: list[list[Tree]], rate: float) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            yield f.assign(p=list(_arrays(f, pending, rate)[2]))

    return state.mapInPandas(run, state.schema)


def _summed(state: DataFrame, per_task: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
    """Counts that each task has made over its batches, by place, summed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in batches:
            got = per_task(f)
            total = got if total is None else total + got
        if total is not None:
            at = np.flatnonzero(total)
            yield pd.DataFrame({"at": at, "n": total.ravel()[at]})

    return state.mapInPandas(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))


def _filled(sums: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(int(np.prod(shape)), dtype=np.int64)
    got = sums.toPandas()  # as many rows as the shape has places, at most
    out[got["at"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.int64)
    return out.reshape(shape)


def _histograms(state: DataFrame, pending: list[list[Tree]], grown: list[Tree], rate: float, quantiles: list[float], features: int, bins: int) -> np.ndarray:
    """(quantile, node, feature, bin, rows or rows below the prediction)."""
    nodes = len(grown[0].features) + 1
    shape = (len(quantiles), nodes, features, bins + 1, 2)

    def per_task(f: pd.DataFrame) -> np.ndarray:
        y, x, p = _arrays(f, pending, rate)
        out = np.zeros(shape, dtype=np.int64)
        for i, t in enumerate(grown):
            at, under = t.nodes(x), y < p[:, i]
            for j in range(features):
                cell = at * (bins + 1) + x[:, j]
                out[i, :, j, :, 0] += np.bincount(cell, minlength=nodes * (bins + 1)).reshape(nodes, -1)
                out[i, :, j, :, 1] += np.bincount(cell[under], minlength=nodes * (bins + 1)).reshape(nodes, -1)
        return out

    return _filled(_summed(state, per_task), shape)


def _residuals(state: DataFrame, pending: list[list[Tree]], grown: list[Tree], rate: float, quantiles: list[float], span: float) -> np.ndarray:
    """(quantile, leaf, cell): residuals counted on the grid."""
    leaves = len(grown[0].features) + 1
    shape = (len(quantiles), leaves, CELLS)

    def per_task(f: pd.DataFrame) -> np.ndarray:
        y, x, p = _arrays(f, pending, rate)
        out = np.zeros(shape, dtype=np.int64)
        for i, t in enumerate(grown):
            cell = np.clip(np.floor((y - p[:, i] + 2 * span) / (4 * span / CELLS)), 0, CELLS - 1).astype(np.int64)
            out[i] += np.bincount(t.nodes(x) * CELLS + cell, minlength=leaves * CELLS).reshape(leaves, -1)
        return out

    return _filled(_summed(state, per_task), shape)
