"""Queries on families and strategies, over incident records with the vectors of `embeddings`."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions.math import dot
from vigil.operators import families, groups
from vigil.plans.catalog import query
from vigil.plans.records import RECORDS, records
from vigil.session import table

_DOT = "list_dot_product({}::DOUBLE[], {}::DOUBLE[])"
_VECS = f"(SELECT r.*, e.embedding::DOUBLE[] AS v, e.label FROM {RECORDS} r JOIN embeddings e ON e.vec_id = r.k)"


def _vectors(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("k"), F.col("embedding").alias("v"), "label")
    return records(spark, sf).join(e, "k")


def _cent(by: str, rel: str, v: str = "v") -> str:
    """Centroids at unit length: by, c."""
    return f"""(SELECT {by}, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS c FROM (SELECT {by}, list(x ORDER BY i) AS m FROM (
      SELECT {by}, i, avg(x) AS x FROM (SELECT {by}, unnest({v}) AS x, generate_subscripts({v}, 1) AS i FROM {rel}) GROUP BY {by}, i) GROUP BY {by}))"""


_HOT = [("closure_class", 0.9), ("ci_group", 0.5)]
_HOTS = ", ".join(f"list_transform((SELECT list_sort(list(DISTINCT {f})) FROM x WHERE {f} <> 'Unknown'), lambda w: CASE WHEN {f} = w THEN {p}e0 ELSE 0e0 END)" for f, p in _HOT)


@query("feature_vectors", f"""
WITH x AS (SELECT k, v, coalesce(closure_class, 'Unknown') AS closure_class, ci_group, k % 3 <> 0 AS usable FROM {_VECS}),
f AS (SELECT k, list_concat(v, list_transform(v, lambda a: CASE WHEN usable THEN a * 0.8e0 ELSE 0e0 END), {_HOTS}) AS f FROM x),
u AS (SELECT k, list_transform(f, lambda a: a / greatest(sqrt(list_dot_product(f, f)), 1e-9)) AS u FROM f)
SELECT k, len(u) AS dims, round(list_dot_product(u, u), 6) AS norm, round(u[1], 6) AS first, round(list_sum(u[-22:]), 6) AS tail FROM u""")
def feature_vectors(spark, sf):
    rows = _vectors(spark, sf).withColumn("closure_class", F.coalesce("closure_class", F.lit("Unknown")))
    out = families.features(families.onehot(rows, dict(_HOT)), "v", "v", F.col("k") % 3 != 0)
    u = F.col("features")
    return out.select("k", F.size(u).alias("dims"), F.round(dot(u, u), 6).alias("norm"), F.round(u[0], 6).alias("first"), F.round(F.aggregate(F.slice(u, -22, 22), F.lit(0.0), lambda a, x: a + x), 6).alias("tail"))


# Clusters: the label of the vector, and for some keys a small cluster of their own.
_CLUSTER = "CASE WHEN k % 25 = 3 THEN 100 + k % 75 ELSE label END"


@query("built_families", f"""
WITH x AS (SELECT k, v, {_CLUSTER} AS cluster FROM {_VECS}), n AS (SELECT cluster, count(*) AS n FROM x GROUP BY cluster),
m AS (SELECT cluster, row_number() OVER (ORDER BY n DESC, cluster) AS no FROM n WHERE n >= 3), a AS (SELECT k, 'F' || lpad(no::VARCHAR, 3, '0') AS family, v FROM x JOIN m USING (cluster)),
c AS {_cent('family', 'a')}, r AS (SELECT k, v FROM x ANTI JOIN m USING (cluster)),
b AS (SELECT k, arg_max(family, (s, family)) AS family, max(s) AS s FROM (SELECT k, family, {_DOT.format('v', 'c')} AS s FROM r, c) GROUP BY k),
o AS (SELECT k, 'F' || lpad(((SELECT max(no) FROM m) + row_number() OVER (ORDER BY k))::VARCHAR, 3, '0') AS family FROM b WHERE s < 0.5)
SELECT k, family, 'active' AS status FROM a UNION ALL SELECT k, family, 'active' FROM b WHERE s >= 0.5 UNION ALL SELECT k, family, 'emerging' FROM o""")
def built_families(spark, sf):
    cluster = F.when(F.col("k") % 25 == 3, 100 + F.col("k") % 75).otherwise(F.col("label"))
    return families.build(_vectors(spark, sf).select("k", "v", cluster.alias("cluster")), "k", "cluster", "v")


@query("family_matches", f"""
WITH x AS (SELECT k, v, label, k // 6 AS query_id, CASE WHEN k % 4 <> 0 THEN (k % 19) / 19 END AS conf, (k % 10) / 10 AS infl FROM {_VECS}), c AS {_cent('label', _VECS)},
q AS (SELECT query_id, arg_min(v, k) AS v FROM x GROUP BY query_id), s AS (SELECT query_id, label, {_DOT.format('v', 'c')} AS sim, row_number() OVER (PARTITION BY query_id ORDER BY {_DOT.format('v', 'c')} DESC, label) AS r FROM q, c),
g AS (SELECT query_id, label, sum(coalesce(conf, 0.5) * greatest(0.05, infl)) AS mass, max(coalesce(conf, 0)) AS rel FROM x GROUP BY query_id, label),
p AS (SELECT *, mass / sum(mass) OVER (PARTITION BY query_id) AS vote FROM g)
SELECT query_id, label AS family, round(coalesce(vote, 0), 9) AS vote, round(coalesce(vote * rel, 0), 9) AS match_strength, round(sim, 6) AS similarity FROM s LEFT JOIN p USING (query_id, label) WHERE r <= 3 OR vote IS NOT NULL""")
def family_matches(spark, sf):
    k = F.col("k")
    x = _vectors(spark, sf).select("k", "v", F.col("label").alias("family"), F.floor(k / 6).alias("query_id"), F.when(k % 4 != 0, (k % 19) / 19).alias("confidence"), ((k % 10) / 10).alias("influence"))
    asked = x.groupBy("query_id").agg(F.min_by("v", "k").alias("v"))
    c = groups.centroids(x, "family", "v")
    sims = asked.join(F.broadcast(c)).select("query_id", "family", dot(F.col("v"), F.col("centroid")).alias("similarity"))  # a centroid for each label
    out = families.match(x, "query_id", sims)
    return out.select("query_id", "family", F.round("vote", 9).alias("vote"), F.round("match_strength", 9).alias("match_strength"), F.round("similarity", 6).alias("similarity"))


@query("family_strategies", f"""
WITH x AS (SELECT *, label || '-S' || (k % 2) AS strat FROM {_VECS}), c AS {_cent('strat', 'x')},
d AS (SELECT strat, arg_min(k, (-round({_DOT.format('v', 'c')}, 9), k)) AS representative FROM x JOIN c USING (strat) GROUP BY strat),
n AS (SELECT label, strat, count(*) AS n, count(*) FILTER (resolution_notes_source = 'original') AS o, count(*) FILTER (resolution_notes_source = 'synthetic') AS s FROM x GROUP BY label, strat),
w AS (SELECT strat, list(closure_code ORDER BY r) AS codes FROM (SELECT strat, closure_code, row_number() OVER (PARTITION BY strat ORDER BY count(*) DESC, min(k)) AS r FROM x WHERE closure_code IS NOT NULL GROUP BY strat, closure_code) WHERE r <= 3 GROUP BY strat)
SELECT label, strat, n, round(n / sum(n) OVER (PARTITION BY label), 3) AS share, representative, codes, CASE WHEN o = n THEN 'original' WHEN s = n THEN 'synthetic' ELSE 'mixed' END AS text_provenance FROM n JOIN d USING (strat) LEFT JOIN w USING (strat)""")
def family_strategies(spark, sf):
    x = _vectors(spark, sf).withColumn("strat", F.concat(F.col("label").cast("string"), F.lit("-S"), (F.col("k") % 2).cast("string")))
    out = families.strategies(x, "label", "strat", "k", "v", "resolution_notes", "closure_code", "resolution_notes_source")
    return out.select("label", "strat", "n", "share", "representative", "codes", "text_provenance")


@query("assigned_strategies", f"""
WITH x AS (SELECT *, label || '-S' || (k % 2) AS strat FROM {_VECS}), c AS {_cent('label, strat', 'x').replace('SELECT label, strat, list(', 'SELECT label, strat, list(')},
b AS (SELECT x.k, arg_max(c.strat, {_DOT.format('v', 'c')}) AS strat, max({_DOT.format('v', 'c')}) AS s FROM x JOIN c USING (label) GROUP BY x.k)
SELECT k, CASE WHEN s >= 0.6 THEN strat END AS strategy, round(s, 6) AS similarity FROM b""")
def assigned_strategies(spark, sf):
    x = _vectors(spark, sf).withColumn("strat", F.concat(F.col("label").cast("string"), F.lit("-S"), (F.col("k") % 2).cast("string")))
    c = groups.centroids(x, "strat", "v").withColumnRenamed("strat", "strategy").withColumn("family", F.split("strategy", "-")[0].cast("int"))
    out = families.assign_strategy(x, "k", "label", "v", c)
    return out.select("k", "strategy", F.round("similarity", 6).alias("similarity"))


@query("dropped_similar_steps", f"""
WITH x AS (SELECT k // 20 AS session, k, v FROM {_VECS}), f AS (SELECT * FROM x WHERE k % 5 = 0),
m AS (SELECT x.session, x.k, max({_DOT.format('x.v', 'f.v')}) AS s FROM x JOIN f USING (session) WHERE x.k % 5 <> 0 GROUP BY x.session, x.k)
SELECT session, k FROM m WHERE s < 0.5""")
def dropped_similar_steps(spark, sf):
    x = _vectors(spark, sf).select(F.floor(F.col("k") / 20).alias("session"), "k", "v")
    return families.drop_similar(x.filter("k % 5 <> 0"), x.filter("k % 5 = 0"), "session", "k", "v").select("session", "k")


@query("strategy_lookup", f"SELECT incident_id, coalesce(CASE WHEN k % 3 = 0 THEN strategy END, 'INC:' || incident_id) AS strategy_key FROM {RECORDS}")
def strategy_lookup(spark, sf):
    return records(spark, sf).select("incident_id", families.strategy_key(F.when(F.col("k") % 3 == 0, F.col("strategy")), F.col("incident_id")).alias("strategy_key"))
