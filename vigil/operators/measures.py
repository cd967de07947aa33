"""Measures of models on held-out rows: running sums without a global window, ranking measures of scores, errors of quantile predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.math import pinball

#: Ranges into which the keys of a running sum are cut; also the rows of the one window over all ranges.
RANGES = 256


def running(df: DataFrame, key: str, sums: list[str], groups: list[str] | None = None, ranges: int = RANGES) -> DataFrame:
    """df with <column>_before and <column>_all: the sums of whole-number columns over the rows of its group with a smaller key, and over all rows of the group.

    Keys are numbers and distinct within a group; null keys go. Keys are cut into ranges at approximate quantiles of all rows (at most `ranges` numbers pass the
    driver; any cuts give the same sums). A window runs within each group and range, and one over the totals of a group's ranges, so no task holds a large group.
    """
    names = groups or []
    at = F.col(key).cast("double")
    rows = df.filter(F.col(key).isNotNull())
    cuts = rows.agg(F.percentile_approx(at, [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []
    edges = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    rows = rows.withColumn("__range", F.size(F.filter(edges, lambda e: e < at)))
    keys = {f"__g{i}": F.col(c) for i, c in enumerate(names)} | {"__r": F.col("__range")}
    totals = rows.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(*[F.sum(c).alias(f"__s{i}") for i, c in enumerate(sums)])  # at most `ranges` rows of a group
    group = Window.partitionBy(*[n for n in keys if n != "__r"])
    ahead = group.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, *[x for i in range(len(sums)) for x in (F.coalesce(F.sum(f"__s{i}").over(ahead), F.lit(0)).alias(f"__b{i}"), F.sum(f"__s{i}").over(group).alias(f"__a{i}"))])
    same = reduce(lambda a, b: a & b, [c.eqNullSafe(F.col(n)) for n, c in keys.items()])
    out = rows.join(carried if names else F.broadcast(carried), same)  # without groups at most `ranges` rows
    within = Window.partitionBy(*keys).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    for i, c in enumerate(sums):
        out = out.withColumns({f"{c}_before": F.col(f"__b{i}") + F.coalesce(F.sum(c).over(within), F.lit(0)), f"{c}_all": F.col(f"__a{i}")})
    return out.drop("__range", *keys, *[f"__{x}{i}" for i in range(len(sums)) for x in "ba"])


def percentiles(df: DataFrame, value: Column, shares: dict[str, float], groups: list[str] | None = None) -> DataFrame:
    """One row per group (one in all without groups, none without values) with exact percentiles, between two ranks by linear interpolation; nulls don't count.

    Values are counted first and ranked by running counts, so neither a group of a third of all rows nor the whole table is held in one buffer.
    """
    names = groups or []
    per = df.select(*names, value.cast("double").alias("__v")).filter("__v IS NOT NULL").groupBy(*names, "__v").agg(F.count("*").alias("__n"))
    ranked = running(per, "__v", ["__n"], names)
    found = {}
    for i, share in enumerate(shares.values()):
        place = (F.col("__n_all") - 1) * share
        for side, rank in (("low", F.floor(place)), ("high", F.ceil(place))):
            found[f"__{side}{i}"] = F.max(F.when((F.col("__n_before") <= rank) & (rank < F.col("__n_before") + F.col("__n")), F.col("__v")))
    picked = ranked.groupBy(*names, F.col("__n_all").alias("__all")).agg(*[c.alias(n) for n, c in found.items()])
    out = []
    for i, (name, share) in enumerate(shares.items()):
        low, high, place = F.col(f"__low{i}"), F.col(f"__high{i}"), (F.col("__all") - 1) * share
        out.append(F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high).alias(name))
    return picked.select(*names, *out)


def classifier(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: n, positives, base_rate, roc_auc, pr_auc (average precision), brier, top_decile_rate and top_decile_lift of scores against 0/1 labels.

    Rows are counted per distinct score, so equal scores are one threshold and a score that a third of all rows share is one row. The top tenth (floor, one row at
    least) takes of the rows at its last score their share of positives, so it depends on no order among ties. Rows without a score or a label don't count;
    measures that need both classes are null without them.
    """
    y = F.col(label).cast("long")
    rows = df.filter(F.col(score).isNotNull() & y.isNotNull() & ~F.isnan(F.col(score).cast("double")))
    per = rows.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(y).alias("p"), F.sum(1 - y).alias("m"))
    p, m, P, M = (F.col(c) for c in ("p", "m", "p_all", "m_all"))
    r = running(per, "s", ["p", "m"])
    above_p, above_m = P - F.col("p_before") - p, M - F.col("m_before") - m
    cut = F.greatest(F.lit(1), F.floor((P + M) / 10))
    room = F.greatest(F.lit(0), F.least(p + m, cut - above_p - above_m))
    sums = r.agg(
        F.first("p_all").alias("p_all"), F.first("m_all").alias("m_all"), F.first(cut).alias("cut"), F.sum(p * (F.col("m_before") + m / 2)).alias("area"),
        F.sum(p * (above_p + p) / (above_p + p + above_m + m)).alias("precision"), F.sum(p * F.pow(1 - F.col("s"), 2) + m * F.pow(F.col("s"), 2)).alias("square"), F.sum(p * room / (p + m)).alias("top"),
    )
    n, both = P + M, (P > 0) & (M > 0)
    return sums.select(
        F.coalesce(n, F.lit(0)).alias("n"), F.coalesce(P, F.lit(0)).alias("positives"), (P / n).alias("base_rate"), F.when(both, F.col("area") / P / M).alias("roc_auc"),
        F.when(P > 0, F.col("precision") / P).alias("pr_auc"), (F.col("square") / n).alias("brier"), (F.col("top") / F.col("cut")).alias("top_decile_rate"),
        F.when(P > 0, F.col("top") / F.col("cut") / (P / n)).alias("top_decile_lift"),
    )


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per class of either column: precision, recall, f1 (0 where undefined) and support, from the counts of the pairs."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = pairs.select(F.explode(F.array(*[F.struct(F.col(c).alias("label"), (F.col("n") * F.lit(s)).alias("support"), (F.col("n") * F.lit(1 - s)).alias("found"),
                                                      F.when(F.col("t").eqNullSafe(F.col("p")), F.col("n") * F.lit(s)).otherwise(0).alias("ok")) for c, s in (("t", 1), ("p", 0))])).alias("x"))
    g = sides.groupBy("x.label").agg(*[F.sum(f"x.{c}").alias(c) for c in ("support", "found", "ok")])
    precision, recall = (F.coalesce(F.col("ok") / F.nullif(F.col(c), F.lit(0)), F.lit(0.0)) for c in ("found", "support"))
    both = precision + recall
    return g.select("label", precision.alias("precision"), recall.alias("recall"), F.when(both > 0, 2 * precision * recall / both).otherwise(0.0).alias("f1"), "support")


def quantiles(df: DataFrame, target: str, predicted: dict[float, str], middle: float = 0.5) -> DataFrame:
    """One row: n, pinball_<per cent> of each quantile, mae, rmse and r2 of the middle one, coverage of the outermost two."""
    y = F.col(target)
    lowest, highest = F.col(predicted[min(predicted)]), F.col(predicted[max(predicted)])
    mid = F.col(predicted[middle])
    losses = [F.avg(pinball(y, F.col(c), q)).alias(f"pinball_{round(q * 100)}") for q, c in sorted(predicted.items())]
    return df.agg(
        F.count("*").alias("n"), *losses, F.avg(F.abs(y - mid)).alias("mae"), F.sqrt(F.avg(F.pow(y - mid, 2))).alias("rmse"),
        (1 - F.avg(F.pow(y - mid, 2)) / F.nullif(F.var_pop(y), F.lit(0.0))).alias("r2"), F.avg(y.between(lowest, highest).cast("int")).alias("coverage"),
    )


def stratified(df: DataFrame, strata: list[str], u: Column, share: float) -> DataFrame:
    """df with train: of each stratum the floor of so large a share of its rows, those of the smallest numbers u in (0, 1); u has to differ from row to row.

    Places come from counts per stratum and range of u, so one large stratum is spread over the ranges.
    """
    cell = F.floor(u * RANGES).cast("int")
    rows = df.withColumns({"__u": u, "__cell": cell})
    per = rows.groupBy(*[F.col(c).alias(f"__s_{c}") for c in strata], F.col("__cell").alias("__c")).agg(F.count("*").alias("__k"))
    w = Window.partitionBy(*[f"__s_{c}" for c in strata])  # at most RANGES rows each
    per = per.withColumns({"__ahead": F.sum("__k").over(w.orderBy("__c")) - F.col("__k"), "__n": F.sum("__k").over(w)}).drop("__k")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__s_{c}")) for c in strata], F.col("__cell") == F.col("__c"))
    joined = rows.join(per, same)
    place = F.col("__ahead") + F.row_number().over(Window.partitionBy(*strata, "__cell").orderBy("__u"))
    return joined.withColumn("train", place <= F.floor(F.col("__n") * share)).drop("__u", "__cell", "__c", "__ahead", "__n", *[f"__s_{c}" for c in strata])
