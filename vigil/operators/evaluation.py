"""Evaluation measures over tables of results: rankings, clusterings, resampled intervals and flat reports; and allocation and draws for query sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators.measures import running


def uniform(*parts: Column, salt: str = "") -> Column:
    """A number in (0, 1) from a hash of the parts, the same in every run and in any engine that has MD5."""
    h = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts], F.lit(salt)))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def ranking(results: DataFrame, keys: list[str], rank: str, gain: str, k: int, relevant: DataFrame, ideal: DataFrame | None = None) -> DataFrame:
    """results: keys, rank, gain (0 if not relevant). Per keys precision@k (over k), recall@k, hit@k, reciprocal rank and nDCG@k.

    relevant: keys, n_relevant. ideal: keys, ideal (the gains in the best order); without it gains of the results are taken. Only sums per
    keys are shuffled, so no task gathers a list.
    """
    top, good = F.col(rank) <= k, F.col(gain) > 0
    dcg = (F.pow(F.lit(2.0), gain) - 1) / F.log2(F.col(rank) + 1.0)
    g = results.groupBy(*keys).agg(F.count_if(top & good).alias("hits"), F.min(F.when(good, F.col(rank))).alias("first"), F.sum(F.when(top, dcg).otherwise(0.0)).alias("dcg"))
    if ideal is None:
        best = results.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(gain), rank))).filter(F.col("__r") <= k)
        ideal_dcg = best.groupBy(*keys).agg(F.sum((F.pow(F.lit(2.0), gain) - 1) / F.log2(F.col("__r") + 1.0)).alias("ideal"))
    else:
        ideal_dcg = ideal
    out = g.join(relevant, keys, "left").join(ideal_dcg, keys, "left")
    return out.select(
        *keys, (F.col("hits") / k).alias("precision"), F.when(F.col("n_relevant") > 0, F.col("hits") / F.col("n_relevant")).otherwise(0.0).alias("recall"), (F.col("hits") > 0).cast("double").alias("hit"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg"),
    )


def clustering(df: DataFrame, cluster: str, truth: str) -> DataFrame:
    """One row from contingency counts: purity, inverse purity, normalised mutual information (arithmetic mean) and adjusted Rand index."""
    n = df.groupBy(F.col(cluster).alias("x"), F.col(truth).alias("y")).agg(F.count("*").cast("double").alias("n"))
    c, t = n.groupBy("x").agg(F.sum("n").alias("c"), F.max("n").alias("bc")), n.groupBy("y").agg(F.sum("n").alias("t"), F.max("n").alias("bt"))
    two = lambda x: x * (x - 1) / 2
    whole = n.agg(F.sum("n").alias("N"), F.sum(two(F.col("n"))).alias("both"))
    cs = c.agg(F.sum(two(F.col("c"))).alias("pc"), F.sum("bc").alias("bc"), F.sum(F.col("c") * F.log("c")).alias("hc"))
    ts = t.agg(F.sum(two(F.col("t"))).alias("pt"), F.sum("bt").alias("bt"), F.sum(F.col("t") * F.log("t")).alias("ht"))
    joint = n.join(c, "x").join(t, "y").agg(F.sum(F.col("n") * F.log(F.col("n") / (F.col("c") * F.col("t")))).alias("mi"))
    one = whole.join(F.broadcast(cs)).join(F.broadcast(ts)).join(F.broadcast(joint))  # one row each
    N = F.col("N")
    mi = F.col("mi") / N + F.log(N)
    hc, ht = F.log(N) - F.col("hc") / N, F.log(N) - F.col("ht") / N
    expected = F.col("pc") * F.col("pt") / two(N)
    return one.select(
        (F.col("bc") / N).alias("purity"), (F.col("bt") / N).alias("inverse_purity"), (2 * mi / F.nullif(hc + ht, F.lit(0.0))).alias("nmi"),
        ((F.col("both") - expected) / ((F.col("pc") + F.col("pt")) / 2 - expected)).alias("ari"),
    )


def sampled_pairs(df: DataFrame, key: str, cluster: str, truth: str, pairs: int, salt: str = "pairs") -> DataFrame:
    """Precision, recall and F1 over pairs of rows drawn at random (a sampling operator): one row. Rows are numbered 0 to n - 1 by key.

    Each draw picks two positions by a hash; positions are running counts over ranges of the key (a number, not null) and join back, so nothing is gathered. Draws of one row with itself don't count.
    """
    numbered = df.select(F.col(key).alias("i"), F.col(cluster).alias("c"), F.col(truth).alias("t"), F.lit(1).alias("pos"))
    rows = running(numbered, "i", ["pos"]).drop("pos", "pos_all").withColumnRenamed("pos_before", "pos")
    n = df.agg(F.count("*").alias("n"))
    at = lambda side: F.floor(uniform(F.col("d"), F.lit(side), salt=salt) * F.col("n"))
    draws = df.sparkSession.range(pairs).withColumnRenamed("id", "d").join(F.broadcast(n)).select("d", at("a").alias("a"), at("b").alias("b")).filter("a <> b")
    both = draws.join(rows.select(F.col("pos").alias("a"), F.col("c").alias("ca"), F.col("t").alias("ta")), "a").join(rows.select(F.col("pos").alias("b"), F.col("c").alias("cb"), F.col("t").alias("tb")), "b")
    c, t = F.col("ca") == F.col("cb"), F.col("ta") == F.col("tb")
    g = both.agg(F.count("*").alias("n"), F.count_if(c & t).alias("tp"), F.count_if(c).alias("pc"), F.count_if(t).alias("pt"))
    p, r = F.col("tp") / F.greatest(F.col("pc"), F.lit(1)), F.col("tp") / F.greatest(F.col("pt"), F.lit(1))
    return g.select("n", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def bootstrap(values: DataFrame, key: str, value: str, draws: int = 1000, salt: str = "boot", cover: float = 0.95) -> DataFrame:
    """One row, low and high: the interval that covers so much of the means of resamples with replacement.

    Instead of drawing rows, each row gets for each resample how often it was drawn, a Poisson(1) count from a hash: sums per resample are partial
    sums over the rows, so any number of rows is spread over tasks. (For the few rows of a query set it is wider than a multinomial draw by little.)
    """
    u = uniform(F.col("__d"), F.col(key), salt=salt)
    # Cumulative Poisson(1) probabilities.
    cuts, p, total = [], 0.36787944117144233, 0.0
    for i in range(1, 8):
        total += p
        cuts.append(total)
        p /= i
    times = sum(((u >= c).cast("int") for c in cuts), F.lit(0))
    each = values.select(key, value, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("__d")).withColumn("__n", times).filter(F.col("__n") > 0)
    means = each.groupBy("__d").agg((F.sum(F.col(value) * F.col("__n")) / F.sum("__n")).alias("mean"))
    edge = (1 - cover) / 2
    return means.agg(F.percentile("mean", F.lit(edge)).alias("low"), F.percentile("mean", F.lit(1 - edge)).alias("high"))  # as many values as draws


def graded(same_strategy: Column, same_family: Column) -> Column:
    """The gain of a result: 2 for the strategy, 1 for the family, else 0."""
    return F.when(same_strategy, 2).when(same_family, 1).otherwise(0)


def flags(df: DataFrame, found: Column, seeded: Column) -> DataFrame:
    """Precision and recall of a flag against seeded defects: one row."""
    g = df.agg(F.count_if(found & seeded).alias("tp"), F.count_if(found).alias("p"), F.count_if(seeded).alias("t"))
    return g.select("tp", F.when(F.col("p") > 0, F.col("tp") / F.col("p")).alias("precision"), F.when(F.col("t") > 0, F.col("tp") / F.col("t")).alias("recall"))


def flatten(report: dict, prefix: str = "") -> list[tuple[str, float]]:
    """Nested measures as (name.name, value) rows; what isn't a number is left out."""
    out: list[tuple[str, float]] = []
    for k, v in report.items():
        name = f"{prefix}.{k}" if prefix else str(k)
        if isinstance(v, dict):
            out += flatten(v, name)
        elif isinstance(v, (int, float)) and not isinstance(v, bool):
            out.append((name, float(v)))
    return out


def allocate(df: DataFrame, stratum: str, target: int, least: int, most: int) -> DataFrame:
    """stratum, eligible, n: rows of a target in proportion to the root of each stratum's size, between least and most, and no more than there are. Halves round to even."""
    g = df.groupBy(stratum).agg(F.count("*").alias("eligible"))
    whole = F.sum(F.sqrt("eligible")).over(Window.partitionBy(F.lit(0)))  # one row per stratum
    share = F.bround(F.lit(float(target)) * F.sqrt("eligible") / whole, 0).cast("long")
    return g.withColumn("n", F.least(F.greatest(share, F.lit(least)), F.lit(most), F.col("eligible")))


def weighted_sample(df: DataFrame, stratum: str, key: str, weight: Column, sizes: DataFrame, salt: str = "sample") -> DataFrame:
    """A sampling operator: per stratum n rows (sizes: stratum, n) without replacement, with chances by weight; rows of weight 0 only if nothing else is left. Reruns agree."""
    order = F.when(weight > 0, -F.log(uniform(F.col(key), salt=salt)) / weight)
    rows = df.withColumn("__o", order).join(F.broadcast(sizes.select(stratum, "n")), stratum)  # one row per stratum
    w = Window.partitionBy(stratum).orderBy(F.asc_nulls_last(F.round("__o", 9)), key)
    return rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= F.col("n")).drop("__o", "__r", "n")


def choose(weights: dict[str, Column], u: Column) -> Column:
    """One of several names with chances by weight, for a number in (0, 1)."""
    total = sum(weights.values(), F.lit(0.0))
    out, run = None, F.lit(0.0)
    for name, w in weights.items():
        run = run + w
        hit = u * total < run
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(list(weights)[-1])


def halves(df: DataFrame, strata: list[str], key: str, salt: str = "split") -> DataFrame:
    """df with split: in each stratum half of the rows (the smaller half of an odd number) for validation, the others for test, in a seeded order."""
    w = Window.partitionBy(*strata)
    rows = df.withColumns({"__n": F.count("*").over(w), "__r": F.row_number().over(w.orderBy(uniform(F.col(key), salt=salt), key))})
    return rows.withColumn("split", F.when(F.col("__r") <= F.floor(F.col("__n") / 2), "validation").otherwise("test")).drop("__n", "__r")
