"""Spark ML models: text classification, reopen risk, resolution-time quantiles and calibration."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import CountVectorizer, IDF, NGram, Normalizer, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.operators import measures, trees

#: What is known of a case when it is opened.
OPEN_CATEGORIES = ["ci_group", "ci_subcategory", "impact", "urgency", "priority"]
OPEN_NUMBERS = ["open_hour", "open_weekday"]


def balanced(df: DataFrame, label: str, least: int = 5) -> DataFrame:
    """Rows of classes with at least `least` rows, with weights that make the classes count alike."""
    n = df.groupBy(label).agg(F.count("*").alias("__n")).filter(F.col("__n") >= least)
    whole = n.agg(F.sum("__n").alias("__all"), F.count("*").alias("__k"))
    return df.join(n, label).join(F.broadcast(whole)).withColumn("weight", F.col("__all") / (F.col("__k") * F.col("__n"))).drop("__n", "__all", "__k")


def text_classifier(df: DataFrame, text: str, label: str) -> PipelineModel:
    """Uni- and bigram TF-IDF with balanced logistic regression."""
    stages = [
        StringIndexer(inputCol=label, outputCol="__label", handleInvalid="keep"), RegexTokenizer(inputCol=text, outputCol="__w1", pattern="[^a-z0-9]+"), NGram(n=2, inputCol="__w1", outputCol="__w2"),
        CountVectorizer(inputCol="__w1", outputCol="__c1", minDF=2), CountVectorizer(inputCol="__w2", outputCol="__c2", minDF=2), VectorAssembler(inputCols=["__c1", "__c2"], outputCol="__c"),
        IDF(inputCol="__c", outputCol="__i"), Normalizer(inputCol="__i", outputCol="features"), LogisticRegression(labelCol="__label", featuresCol="features", weightCol="weight", maxIter=30, regParam=0.001),
    ]
    return Pipeline(stages=stages).fit(balanced(df, label))


def reopen_classifier(df: DataFrame, categories: list[str], numbers: list[str], label: str, seed: int = 42) -> PipelineModel:
    index = [StringIndexer(inputCol=c, outputCol=f"__{c}", handleInvalid="keep") for c in categories]
    rows = VectorAssembler(inputCols=[*[f"__{c}" for c in categories], *numbers], outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[*index, rows, GBTClassifier(labelCol=label, featuresCol="features", maxIter=10, maxBins=128, seed=seed)]).fit(df)


def duration_quantiles(df: DataFrame, group: str, hours: str, least: int = 20) -> DataFrame:
    """Quartiles of log1p hours per group, backing off to all rows where a group is small. Stands in for boosted quantile regression, which Spark ML lacks."""
    shares, log = {"low": 0.25, "median": 0.5, "high": 0.75}, F.log1p(F.greatest(F.col(hours), F.lit(0.0)))
    per = measures.percentiles(df, log, shares, [group])
    sizes = df.groupBy(F.col(group).alias("__group")).agg(F.count(hours).alias("__n"))
    whole = measures.percentiles(df, log, {f"__{n}": s for n, s in shares.items()})  # one row, or none without any hours
    rows = sizes.join(per, F.col("__group").eqNullSafe(F.col(group)), "left").drop(group).withColumnRenamed("__group", group).join(F.broadcast(whole), how="left")
    return rows.select(group, *[F.expm1(F.when(F.col("__n") >= least, F.col(n)).otherwise(F.col(f"__{n}"))).alias(n) for n in shares])


def platt(df: DataFrame, score: str, label: str) -> tuple[float, float]:
    """a and b of 1 / (1 + exp(-(a x + b)))."""
    rows = VectorAssembler(inputCols=[score], outputCol="features").transform(df)
    model = LogisticRegression(labelCol=label, featuresCol="features", regParam=1e-6).fit(rows)
    return float(model.coefficients[0]), float(model.intercept)


def novelty_threshold(df: DataFrame, score: str, known: str, share: float = 0.02) -> DataFrame:
    """The threshold at which at most `share` of known rows fall below: midway between neighbours in the known scores' order."""
    rows = df.filter(F.col(known)).select(F.col(score).alias("s"))
    at = rows.agg(F.percentile("s", share).alias("t"))
    return rows.join(F.broadcast(at)).agg(((F.max(F.when(F.col("s") <= F.col("t"), F.col("s"))) + F.min(F.when(F.col("s") > F.col("t"), F.col("s")))) / 2).alias("threshold"))


def ordinal(df: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    """df with <column>_code: the value's place among the sorted values of fitted, from 0; -1 for values that fitted doesn't have, and for null.

    Each vocabulary is one row: categories don't grow with the rows.
    """
    words = fitted.agg(*[F.sort_array(F.collect_set(F.col(c).cast("string"))).alias(f"__{c}") for c in columns])
    code = lambda c: F.coalesce(F.array_position(F.col(f"__{c}"), F.col(c).cast("string")) - 1, F.lit(-1)).cast("int")
    return df.join(F.broadcast(words)).withColumns({f"{c}_code": code(c) for c in columns}).drop(*[f"__{c}" for c in columns])


def open_frame(df: DataFrame) -> DataFrame:
    """df with open_hour and open_weekday (Monday is 0): what is known of a case when it is opened; -1 without a time."""
    t = F.col("open_time")
    return df.withColumns({"open_hour": F.coalesce(F.hour(t), F.lit(-1)), "open_weekday": F.coalesce(F.weekday(t), F.lit(-1))})


def resolve_frame(df: DataFrame) -> DataFrame:
    """df with log_resolution_hours and no_of_reassignments: what is known of a case when it is resolved; 0 for nulls and negative hours."""
    hours = F.greatest(F.coalesce(F.col("resolution_hours").cast("double"), F.lit(0.0)), F.lit(0.0))
    return df.withColumns({"log_resolution_hours": F.log1p(hours), "no_of_reassignments": F.coalesce("reassignments", F.lit(0))})


def rates(df: DataFrame, train: Column, keys: list[str], label: str, weight: int = 5) -> DataFrame:
    """df with rate: the share of positive labels among training rows of equal keys, drawn towards the share of all of them as if by `weight` further rows. 0/1 labels; null ones don't count."""
    y = F.when(train, F.col(label).cast("int"))
    per = df.groupBy(*keys).agg(F.coalesce(F.sum(y), F.lit(0)).alias("__p"), F.count(y).alias("__n"))
    whole = per.agg((F.sum("__p") / F.sum("__n")).alias("__base"))  # one row
    per = per.join(F.broadcast(whole)).select(*[F.col(k).alias(f"__{k}") for k in keys], ((F.col("__p") + weight * F.col("__base")) / (F.col("__n") + weight)).alias("rate"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return df.join(per, same, "left").drop(*[f"__{k}" for k in keys])


def resolution_trees(df: DataFrame, cut, rounds: int = 40, depth: int = 3) -> trees.QuantileTrees:
    """Quartiles of log1p hours from what is known at the start, learnt from cases opened up to a time."""
    known = open_frame(df).filter((F.col("open_time") <= F.lit(cut)) & (F.col("resolution_hours") >= 0)).withColumn("__y", F.log1p("resolution_hours"))
    return trees.fit(known, "__y", OPEN_CATEGORIES, OPEN_NUMBERS, [0.25, 0.5, 0.75], rounds, depth)


def resolution_hours(model: trees.QuantileTrees, df: DataFrame) -> DataFrame:
    """df with low, median and high: predicted hours, not below 0."""
    names = ("low", "median", "high")
    out = model.predict(open_frame(df), [f"__{n}" for n in names])
    return out.withColumns({n: F.greatest(F.expm1(f"__{n}"), F.lit(0.0)) for n in names}).drop("open_hour", "open_weekday", *[f"__{n}" for n in names])
