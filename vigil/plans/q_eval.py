"""Evaluation and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions import text
from vigil.operators import evaluation
from vigil.plans.catalog import query
from vigil.plans.records import RECORDS, records
from vigil.session import table


def _u(parts: str, salt: str) -> str:
    return f"((('0x' || substr(md5(concat_ws(':', {parts}, '{salt}')), 1, 8))::BIGINT + 0.5e0) / 4294967296e0)"


_RUNS = f"(SELECT k // 12 AS query_id, (['bm25', 'semantic', 'hybrid'])[(k % 12 // 4 + 1)::INT] AS config, (k % 4 + 1)::INT AS rank, CASE WHEN k % 7 = 0 THEN 2 WHEN k % 3 = 0 THEN 1 ELSE 0 END AS gain, k FROM {RECORDS})"


def _runs(spark, sf):
    k = F.col("k")
    config = F.get(F.array(*map(F.lit, ("bm25", "semantic", "hybrid"))), F.floor(k % 12 / 4).cast("int"))
    return records(spark, sf).select(F.floor(k / 12).alias("query_id"), config.alias("config"), (k % 4 + 1).cast("int").alias("rank"), evaluation.graded(k % 7 == 0, k % 3 == 0).alias("gain"))


_MEASURES = f"""
WITH r AS (SELECT * FROM {_RUNS}), n AS (SELECT query_id, config, count(*) FILTER (gain > 0) + 1 AS n_relevant FROM r GROUP BY ALL),
i AS (SELECT query_id, config, sum((pow(2, gain) - 1) / log2(o + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id, config ORDER BY gain DESC, rank) AS o FROM r) WHERE o <= 3 GROUP BY ALL),
g AS (SELECT query_id, config, count(*) FILTER (rank <= 3 AND gain > 0) AS hits, min(rank) FILTER (gain > 0) AS first, sum((pow(2, gain) - 1) / log2(rank + 1)) FILTER (rank <= 3) AS dcg FROM r GROUP BY ALL),
m AS (SELECT query_id, config, hits / 3 AS precision, hits / n_relevant AS recall, (hits > 0)::INT::DOUBLE AS hit, coalesce(1 / first, 0) AS rr, CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END AS ndcg FROM g JOIN n USING (query_id, config) JOIN i USING (query_id, config))"""


def _measures(spark, sf):
    r = _runs(spark, sf)
    relevant = r.groupBy("query_id", "config").agg((F.count_if(F.col("gain") > 0) + 1).alias("n_relevant"))
    return evaluation.ranking(r, ["query_id", "config"], "rank", "gain", 3, relevant)


@query("ranking_measures", f"{_MEASURES} SELECT query_id, config, round(precision, 9) AS precision, round(recall, 9) AS recall, hit, round(rr, 9) AS rr, round(ndcg, 9) AS ndcg FROM m")
def ranking_measures(spark, sf):
    return _measures(spark, sf).select("query_id", "config", *[F.round(c, 9).alias(c) for c in ("precision", "recall")], "hit", *[F.round(c, 9).alias(c) for c in ("rr", "ndcg")])


@query("config_means", f"{_MEASURES} SELECT config, (['lay', 'vague', 'technical'])[(query_id % 3 + 1)::INT] AS style, count(*) AS n, round(avg(rr), 9) AS mrr, round(avg(precision), 9) AS precision, round(avg(ndcg), 9) AS ndcg FROM m GROUP BY ALL")
def config_means(spark, sf):
    style = F.get(F.array(*map(F.lit, ("lay", "vague", "technical"))), (F.col("query_id") % 3).cast("int"))
    g = _measures(spark, sf).groupBy("config", style.alias("style"))
    return g.agg(F.count("*").alias("n"), F.round(F.avg("rr"), 9).alias("mrr"), F.round(F.avg("precision"), 9).alias("precision"), F.round(F.avg("ndcg"), 9).alias("ndcg"))


@query("clustering_measures", f"""
WITH x AS (SELECT k % 12 AS c, coalesce(closure_class, '-') AS t FROM {RECORDS}), n AS (SELECT c, t, count(*)::DOUBLE AS n FROM x GROUP BY c, t),
cs AS (SELECT c, sum(n) AS s, max(n) AS b FROM n GROUP BY c), ts AS (SELECT t, sum(n) AS s, max(n) AS b FROM n GROUP BY t), a AS (SELECT sum(n) AS tot, sum(n * (n - 1) / 2) AS bth FROM n),
m AS (SELECT sum(n / tot * ln(n * tot / (cs.s * ts.s))) AS mi FROM n JOIN cs USING (c) JOIN ts USING (t), a), h AS (SELECT (SELECT -sum(s / tot * ln(s / tot)) FROM cs, a) AS hc, (SELECT -sum(s / tot * ln(s / tot)) FROM ts, a) AS ht),
p AS (SELECT (SELECT sum(s * (s - 1) / 2) FROM cs) AS pc, (SELECT sum(s * (s - 1) / 2) FROM ts) AS pt)
SELECT round((SELECT sum(b) FROM cs) / tot, 9) AS purity, round((SELECT sum(b) FROM ts) / tot, 9) AS inverse_purity, round(2 * mi / (hc + ht), 9) AS nmi,
       round((bth - pc * pt / (tot * (tot - 1) / 2)) / ((pc + pt) / 2 - pc * pt / (tot * (tot - 1) / 2)), 9) AS ari FROM a, m, h, p""")
def clustering_measures(spark, sf):
    x = records(spark, sf).select((F.col("k") % 12).alias("c"), F.coalesce("closure_class", F.lit("-")).alias("t"))
    out = evaluation.clustering(x, "c", "t")
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query("sampled_pairwise", f"""
WITH r AS (SELECT vec_id % 7 AS c, label AS t, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings), n AS (SELECT count(*) AS n FROM embeddings),
d AS (SELECT floor({_u("d, 'a'", "pairs")} * n)::BIGINT AS a, floor({_u("d, 'b'", "pairs")} * n)::BIGINT AS b FROM range(20000) x(d), n),
j AS (SELECT x.c = y.c AS c, x.t = y.t AS t FROM d JOIN r x ON x.pos = a JOIN r y ON y.pos = b WHERE a <> b),
g AS (SELECT count(*) AS n, count(*) FILTER (c AND t) / greatest(count(*) FILTER (c), 1) AS p, count(*) FILTER (c AND t) / greatest(count(*) FILTER (t), 1) AS r FROM j)
SELECT n, round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / (p + r), 9) AS f1 FROM g""")
def sampled_pairwise(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 7).alias("c"), "label")
    out = evaluation.sampled_pairs(v, "vec_id", "c", "label", 20_000)
    return out.select("n", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


_POISSON = " + ".join(f"({_u('d, doc_id', 'boot')} >= {c})::INT" for c in ("0.36787944117144233e0", "0.7357588823428847e0", "0.9196986029286058e0", "0.9810118431238462e0", "0.9963401531726563e0", "0.9994058151824183e0", "0.9999167588507119e0"))


@query("bootstrap_interval", f"""
WITH e AS (SELECT d, quality, {_POISSON} AS n FROM labels, range(200) x(d)), m AS (SELECT sum(quality * n) / sum(n) AS mean FROM e GROUP BY d)
SELECT round(quantile_cont(mean, 0.025), 9) AS low, round(quantile_cont(mean, 0.975), 9) AS high FROM m""")
def bootstrap_interval(spark, sf):
    out = evaluation.bootstrap(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "quality", 200)
    return out.select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query("flag_quality", f"SELECT count(*) FILTER (f AND s) AS tp, round(count(*) FILTER (f AND s) / count(*) FILTER (f), 9) AS precision, round(count(*) FILTER (f AND s) / count(*) FILTER (s), 9) AS recall FROM (SELECT coalesce(resolution_notes, '') IN ('', 'closed', 'Fixed', 'done') AS f, k % 5 < 2 AS s FROM {RECORDS})")
def flag_quality(spark, sf):
    r = records(spark, sf)
    out = evaluation.flags(r, F.coalesce("resolution_notes", F.lit("")).isin("", "closed", "Fixed", "done"), F.col("k") % 5 < 2)
    return out.select("tp", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


_ALLOCATED = f"(SELECT ci_group, count(*) AS eligible, least(greatest(round_even(300 * sqrt(count(*)) / sum(sqrt(count(*))) OVER (), 0)::BIGINT, 5), 60, count(*)) AS n FROM {RECORDS} WHERE k % 3 = 0 OR ci_group < 'm' GROUP BY ci_group)"


def _pool(spark, sf):
    return records(spark, sf).filter("k % 3 = 0 OR ci_group < 'm'")


@query("allocation", f"SELECT * FROM {_ALLOCATED}")
def allocation(spark, sf):
    return evaluation.allocate(_pool(spark, sf), "ci_group", 300, 5, 60)


@query("stratified_sample", f"""
WITH o AS (SELECT ci_group, k, incident_id, CASE WHEN k % 10 > 0 THEN round(-ln({_u('k', 'sample')}) / (k % 10), 9) END AS o FROM {RECORDS} WHERE k % 3 = 0 OR ci_group < 'm'),
r AS (SELECT *, row_number() OVER (PARTITION BY ci_group ORDER BY o NULLS LAST, k) AS r FROM o)
SELECT ci_group, incident_id FROM r JOIN {_ALLOCATED} USING (ci_group) WHERE r <= n""")
def stratified_sample(spark, sf):
    pool = _pool(spark, sf)
    out = evaluation.weighted_sample(pool, "ci_group", "k", F.col("k") % 10, evaluation.allocate(pool, "ci_group", 300, 5, 60))
    return out.select("ci_group", "incident_id")


@query("briefs", f"""
WITH w AS (SELECT *, {_u('k', 'brief')} AS u, 1e0 AS w1, CASE WHEN closure_class = 'software_fix' THEN 3e0 ELSE 0.3e0 END AS w2, CASE WHEN coalesce(reassignments, 0) >= 3 THEN 2e0 ELSE 0.4e0 END AS w3 FROM {RECORDS})
SELECT incident_id, CASE WHEN u * (w1 + w2 + w3) < w1 THEN 'restart' WHEN u * (w1 + w2 + w3) < w1 + w2 THEN 'patch' ELSE 'escalate' END AS strategy, {_u('k', 'contradict')} < 0.015 AS contradiction,
       concat_ws(' ', 'Incident on', ci_name || ':', coalesce(title, 'no title') || '.', CASE WHEN priority <> 'Not Set' THEN 'Priority ' || priority || '.' END) AS rendered FROM w""")
def briefs(spark, sf):
    w = {"restart": F.lit(1.0), "patch": F.when(F.col("closure_class") == "software_fix", 3.0).otherwise(0.3), "escalate": F.when(F.coalesce("reassignments", F.lit(0)) >= 3, 2.0).otherwise(0.4)}
    chosen = evaluation.choose(w, evaluation.uniform(F.col("k"), salt="brief"))
    said = text.render("Incident on {ci}: {title}. {level}", ci=F.col("ci_name"), title=F.coalesce("title", F.lit("no title")), level=F.when(F.col("priority") != "Not Set", F.concat(F.lit("Priority "), "priority", F.lit("."))))
    return records(spark, sf).select("incident_id", chosen.alias("strategy"), (evaluation.uniform(F.col("k"), salt="contradict") < 0.015).alias("contradiction"), said.alias("rendered"))


@query("eval_split", f"""
SELECT incident_id, CASE WHEN r <= n // 2 THEN 'validation' ELSE 'test' END AS split FROM (SELECT incident_id, count(*) OVER (PARTITION BY family, category) AS n, row_number() OVER (PARTITION BY family, category ORDER BY {_u('k', 'split')}, k) AS r FROM {RECORDS})""")
def eval_split(spark, sf):
    return evaluation.halves(records(spark, sf), ["family", "category"], "k").select("incident_id", "split")
