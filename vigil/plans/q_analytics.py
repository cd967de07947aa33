"""Retrieval, timeline, text-rule, vector and evaluation queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vigil.functions import text
from vigil.functions.math import dcg, dot, precision_at, reciprocal_rank
from vigil.operators import groups, measures, retrieval, timeline
from vigil.plans.catalog import query
from vigil.session import table

QUERY = ["pathetic", "idiot", "thent", "the", "onthe", "idiot"]

_TOKENS = (
    "list_transform(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda w: length(w) > 1 AND NOT list_contains(["
    + ", ".join(f"'{w}'" for w in text.STOPWORDS)
    + "], w)), lambda t: CASE "
    + " ".join(f"WHEN length(t) > {len(s) + 3} AND t LIKE '%{s}' THEN t[:-{len(s) + 1}]" for s in text.SUFFIXES)
    + " ELSE t END)"
)


def _bm25_sql(limit: bool) -> str:
    words = ", ".join(f"'{q}'" for q in QUERY)
    return f"""
    WITH d AS (SELECT doc_id AS id, {_TOKENS} AS toks FROM documents), n AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM d),
    idf AS (SELECT term, ln(n.n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM (SELECT unnest(list_distinct(toks)) AS term FROM d), n GROUP BY term, n.n),
    q AS (SELECT term, count(*) AS times FROM (SELECT unnest([{words}]) AS term) GROUP BY term),
    w AS (SELECT q.term, times, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf) ELSE idf END AS weight FROM q JOIN idf USING (term))
    SELECT id, round(sum(times * weight * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score, list_sort(list_distinct(list(term))) AS matched
    FROM (SELECT id, len(toks) AS dl, term, times, weight, len(list_filter(toks, lambda t: t = term)) AS tf FROM d, w), n WHERE tf > 0
    GROUP BY id HAVING sum(times * weight * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) > 0 {"ORDER BY score DESC, id LIMIT 10" if limit else ""}"""


@query("analyzed_tokens", f"SELECT doc_id, {_TOKENS} AS tokens FROM documents")
def analyzed_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.analyze(F.col("text")).alias("tokens"))


_DOT = "list_dot_product({}::DOUBLE[], {}::DOUBLE[])"


@query("cosine_pairs", f"SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_DOT.format('a.embedding', 'b.embedding')} >= 0.4")
def cosine_pairs(spark, sf):
    return groups.similar_pairs(table(spark, sf, "embeddings"), 0.4).select("a", "b")


@query("knn_topk", f"SELECT query_id, id, rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT.format('q.embedding', 'v.embedding')} DESC, v.vec_id) AS rank FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0) WHERE rank <= 10")
def knn_topk(spark, sf):
    """The stated query set is every vector whose id is divisible by 20, against all vectors."""
    v = table(spark, sf, "embeddings")
    return retrieval.knn(v, v.filter("vec_id % 20 = 0"), 10).select("query_id", "id", "rank")


_RRF_SQL = f"""
WITH s AS (SELECT vec_id AS id, {_DOT.format('embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 0)')} AS score FROM embeddings),
r AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s UNION ALL SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) FROM documents),
top AS (SELECT * FROM r WHERE rank <= 50)
SELECT id, round(sum(1.0 / (60 + rank)), 9) AS score FROM top GROUP BY id"""


@query("rrf_fusion", _RRF_SQL)
def rrf_fusion(spark, sf):
    v, d = table(spark, sf, "embeddings"), table(spark, sf, "documents")
    near = v.join(F.broadcast(v.filter("vec_id = 0").select(F.col("embedding").alias("q")))).select(F.col("vec_id").alias("id"), dot(F.col("embedding"), F.col("q")).alias("s"))
    top = lambda df, *order: df.orderBy(*order).limit(50).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # noqa: E731  at most 50 rows
    one = top(near, F.desc("s"), F.col("id"))
    two = top(d.select(F.col("doc_id").alias("id"), "n_chars"), F.desc("n_chars"), F.col("id"))
    return retrieval.fuse(one, two).withColumn("score", F.round("score", 9))


@query("near_dup_components", f"""
WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE {_DOT.format('a.embedding', 'b.embedding')} >= 0.4),
r(id, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, e.b FROM r JOIN e ON r.seen = e.a)
SELECT id AS vec_id, min(seen) AS root FROM r GROUP BY id""")
def near_dup_components(spark, sf):
    v = table(spark, sf, "embeddings")
    return groups.component_roots(v.select("vec_id"), groups.similar_pairs(v, 0.4), "vec_id")


@query("dup_groups", "SELECT doc_id, min(doc_id) OVER (PARTITION BY trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'))) AS dup_group FROM documents")
def dup_groups(spark, sf):
    return groups.duplicate_groups(table(spark, sf, "documents"), "doc_id", text.normalize_text(F.col("text")))


@query("centroid_match", "WITH p AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i), c AS (SELECT label, list(x ORDER BY i) AS c FROM p GROUP BY label) SELECT vec_id, round(max(list_cosine_similarity(embedding::DOUBLE[], c)), 6) AS best FROM embeddings, c GROUP BY vec_id")
def centroid_match(spark, sf):
    """Centroids are one row per family; their number is checked before they are sent to all rows."""
    from vigil.operators.families import nearest_centroid, unit

    v = table(spark, sf, "embeddings")
    c = groups.centroids(v, "label", "embedding")
    rows = v.select("vec_id", unit(F.transform("embedding", lambda x: x.cast("double"))).alias("u"))
    return nearest_centroid(rows, "vec_id", "u", c, "label").select("vec_id", F.round("similarity", 6).alias("best"))


@query("purity", "SELECT sum(best) / sum(n) AS purity FROM (SELECT vec_id_mod, max(c) AS best, sum(c) AS n FROM (SELECT vec_id % 7 AS vec_id_mod, label, count(*) AS c FROM embeddings GROUP BY ALL) GROUP BY vec_id_mod)")
def purity(spark, sf):
    return groups.purity(table(spark, sf, "embeddings").withColumn("k", F.col("vec_id") % 7), "k", "label")


@query("pairwise_prf", "WITH t AS (SELECT vec_id % 7 AS k, label FROM embeddings), b AS (SELECT sum(c * (c - 1) / 2) AS x FROM (SELECT count(*)::DOUBLE AS c FROM t GROUP BY k, label)), k AS (SELECT sum(c * (c - 1) / 2) AS x FROM (SELECT count(*)::DOUBLE AS c FROM t GROUP BY k)), l AS (SELECT sum(c * (c - 1) / 2) AS x FROM (SELECT count(*)::DOUBLE AS c FROM t GROUP BY label)) SELECT b.x / k.x AS precision, b.x / l.x AS recall, 2 * (b.x / k.x) * (b.x / l.x) / (b.x / k.x + b.x / l.x) AS f1 FROM b, k, l")
def pairwise_prf(spark, sf):
    return groups.pairwise(table(spark, sf, "embeddings").withColumn("k", F.col("vec_id") % 7), "k", "label")


@query("hotspot_14d", "WITH w AS (SELECT user_id, epoch_us(ts) AS us, count(*) OVER p AS n, min(epoch_us(ts)) OVER p AS first FROM events WINDOW p AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 14 DAYS PRECEDING AND CURRENT ROW)), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, us) AS r, count(*) OVER (PARTITION BY user_id) AS total FROM w) SELECT user_id, total, n AS max_in_window, first AS window_start_us FROM b WHERE r = 1 AND n >= 10 ORDER BY n DESC, user_id LIMIT 15")
def hotspot_14d(spark, sf):
    return timeline.hotspots(table(spark, sf, "events"), "user_id", "ts")


@query("transitions_lift", "WITH x AS (SELECT event_type AS a, lead(event_type) OVER w AS b, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 8.64e10 AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), p AS (SELECT a, b, count(*) AS support FROM x WHERE gap <= 14 AND a <> b GROUP BY a, b), f AS (SELECT event_type, count(*) / (SELECT count(*) FROM events) AS share FROM events GROUP BY event_type) SELECT a, b, support, round(support / ((SELECT sum(support) FROM p) * fa.share * fb.share), 9) AS lift FROM p JOIN f fa ON fa.event_type = a JOIN f fb ON fb.event_type = b WHERE support >= 5")
def transitions_lift(spark, sf):
    return timeline.transitions(table(spark, sf, "events"), "user_id", "event_type", "ts", "event_id", lift=0.0).withColumn("lift", F.round("lift", 9))


@query("gap_stats", "SELECT event_type, count(*) AS n, count(g) FILTER (g <= 30) AS repeats, round(median(g), 6) AS median_gap FROM (SELECT event_type, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type, user_id ORDER BY ts)) / 8.64e10 AS g FROM events) GROUP BY event_type")
def gap_stats(spark, sf):
    g = timeline.gaps(table(spark, sf, "events"), ["event_type", "user_id"], "ts")
    p = measures.percentiles(g, F.col("gap_days"), {"median_gap": 0.5}, ["event_type"]).withColumn("median_gap", F.round("median_gap", 6))
    return g.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("gap_days") <= 30).alias("repeats")).join(p, "event_type", "left")


@query("monthly_counts", "SELECT event_type, strftime(ts, '%Y-%m') AS month, count(*) AS n FROM events GROUP BY event_type, month")
def monthly_counts(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query("chain_edges", "WITH x AS (SELECT event_id AS src_id, lead(event_id) OVER w AS dst_id, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 8.64e10 AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts NULLS LAST, event_id)) SELECT src_id, dst_id, 'same_ci' AS rel_type, 1.0::DOUBLE AS weight FROM x WHERE dst_id IS NOT NULL UNION ALL SELECT src_id, dst_id, 'repeat_same_ci', round(1 - gap / 7, 9) FROM x WHERE gap <= 7")
def chain_edges(spark, sf):
    return timeline.chain_edges(table(spark, sf, "events"), "user_id", "event_id", "ts", "same_ci", 7.0).withColumn("weight", F.round("weight", 9))


@query("burst_links", "SELECT a.event_id AS id, b.event_id AS other, a.event_type AS fam FROM events a JOIN events b ON a.event_type = b.event_type AND b.ts BETWEEN a.ts - INTERVAL 30 MINUTES AND a.ts AND a.event_id <> b.event_id")
def burst_links(spark, sf):
    return timeline.bursts(table(spark, sf, "events"), "event_id", "event_type", "ts")


@query("sentence_chunks")
def sentence_chunks(spark, sf):
    """No SQL twin: DuckDB's patterns have no look-behind. Tested on hand-made texts."""
    return table(spark, sf, "documents").select("doc_id", F.posexplode(text.chunks(F.coalesce("text", F.lit("")))).alias("chunk_index", "chunk"))


@query("ranking_metrics", "WITH g AS (SELECT toxic AS grp, list(quality ORDER BY doc_id) AS rel FROM labels GROUP BY toxic) SELECT grp, list_sum(rel[1:5]) / 5.0 AS p5, coalesce(1.0 / list_position(rel, 1), 0.0) AS rr, round(list_sum(list_transform(rel[1:10], lambda x, i: (2 ** x - 1) / log2(i + 1))), 9) AS dcg10 FROM g")
def ranking_metrics(spark, sf):
    g = table(spark, sf, "labels").groupBy(F.col("toxic").alias("grp")).agg(F.sort_array(F.collect_list(F.struct("doc_id", "quality"))).alias("l"))
    rel = F.transform("l", lambda x: x["quality"])
    g = g.select("grp", rel.alias("rel"))
    return g.select("grp", precision_at(F.col("rel"), 5).alias("p5"), reciprocal_rank(F.col("rel")).alias("rr"), F.round(dcg(F.slice("rel", 1, 10)), 9).alias("dcg10"))


@query("novelty_confusion", "SELECT count(*) FILTER (quality = 0 AND toxic = 1) AS tp, count(*) FILTER (quality = 1 AND toxic = 1) AS fp, count(*) FILTER (quality = 0 AND toxic = 0) AS fn FROM labels")
def novelty_confusion(spark, sf):
    q, t = F.col("quality"), F.col("toxic")
    return table(spark, sf, "labels").agg(F.count_if((q == 0) & (t == 1)).alias("tp"), F.count_if((q == 1) & (t == 1)).alias("fp"), F.count_if((q == 0) & (t == 0)).alias("fn"))
