"""Relational queries: projections, joins, aggregates, windows, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vigil.functions.clean import hours_between
from vigil.functions.math import wilson
from vigil.operators import measures, quality
from vigil.plans.catalog import query
from vigil.session import table


@query("metadata_filter", "SELECT event_id, user_id FROM events WHERE event_type IN ('click', 'view', 'purchase') AND value >= 10 AND user_id NOT IN (1, 2, 3) AND ts <= TIMESTAMP '2100-01-01'")
def metadata_filter(spark, sf):
    e = table(spark, sf, "events")
    return e.filter(F.col("event_type").isin("click", "view", "purchase") & (F.col("value") >= 10) & ~F.col("user_id").isin(1, 2, 3) & (F.col("ts") <= F.lit("2100-01-01").cast("timestamp"))).select("event_id", "user_id")


@query("dimension_lookup", "SELECT c_custkey, n_name, coalesce(n_name, 'Unknown') AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def dimension_lookup(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select("c_custkey", "n_name", F.coalesce("n_name", F.lit("Unknown")).alias("nation"))


@query("inner_join_filter", "SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 AND c_nationkey < 10")
def inner_join_filter(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).filter("o_totalprice > 1000 AND c_nationkey < 10").select("o_orderkey", "c_custkey")


@query("left_outer", "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def left_outer(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return c.join(o, o.o_custkey == c.c_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"))


@query("semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return c.join(o, o.o_custkey == c.c_custkey, "left_semi").select("c_custkey")


@query("anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def anti(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return c.join(o.filter("o_totalprice > 300000"), F.col("o_custkey") == c.c_custkey, "left_anti").select("c_custkey")


@query("source_target_lookup", "SELECT s_suppkey, a.n_name AS home, b.n_name AS next_nation FROM supplier LEFT JOIN nation a ON s_nationkey = a.n_nationkey LEFT JOIN nation b ON s_nationkey + 1 = b.n_nationkey")
def source_target_lookup(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation").select("n_nationkey", "n_name")
    a, b = n.toDF("ka", "home"), n.toDF("kb", "next_nation")
    return s.join(a, s.s_nationkey == a.ka, "left").join(b, s.s_nationkey + 1 == b.kb, "left").select("s_suppkey", "home", "next_nation")


@query("latest_per_key", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest_per_key(spark, sf):
    # max_by aggregates before the shuffle, where a window would move all rows.
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m")).select("o_custkey", "m.o_orderkey")


@query("value_counts", "SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def value_counts(spark, sf):
    return table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("flag_counts", "SELECT flag, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN l_discount > 0.05 THEN 'discounted' END, CASE WHEN l_quantity > 25 THEN 'bulk' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END], lambda x: x IS NOT NULL)) AS flag FROM lineitem) GROUP BY flag")
def flag_counts(spark, sf):
    flags = F.array_compact(F.array(F.when(F.col("l_discount") > 0.05, "discounted"), F.when(F.col("l_quantity") > 25, "bulk"), F.when(F.col("l_returnflag") == "R", "returned")))
    return table(spark, sf, "lineitem").select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@query("worst_records", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 15")
def worst_records(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "n_chars").orderBy("n_chars", "doc_id").limit(15)


@query("signature_topn", "SELECT fam, val, n::DOUBLE / total AS share FROM (SELECT l_returnflag AS fam, l_linenumber AS val, count(*) AS n, (sum(count(*)) OVER (PARTITION BY l_returnflag))::DOUBLE AS total, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_linenumber) AS r FROM lineitem GROUP BY l_returnflag, l_linenumber) WHERE r <= 4")
def signature_topn(spark, sf):
    n = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("fam"), F.col("l_linenumber").alias("val")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("fam")
    return n.withColumn("total", F.sum("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "val"))).filter("r <= 4").select("fam", "val", (F.col("n") / F.col("total")).alias("share"))


_WILSON_SQL = """
WITH g AS (SELECT event_type, count(*)::DOUBLE AS n, count(*) FILTER (value > 50)::DOUBLE AS k FROM events GROUP BY event_type),
p AS (SELECT *, k / n AS p, 1 + 1.96 * 1.96 / n AS den FROM g)
SELECT event_type, k / n AS rate,
       round(greatest(0.0, (p + 1.96 * 1.96 / (2 * n)) / den - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) / den), 9) AS low,
       round(least(1.0, (p + 1.96 * 1.96 / (2 * n)) / den + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) / den), 9) AS high
FROM p WHERE n >= 20
"""


@query("wilson_outcomes", _WILSON_SQL)
def wilson_outcomes(spark, sf):
    g = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").cast("double").alias("n"), F.count_if(F.col("value") > 50).cast("double").alias("k")).filter("n >= 20")
    low, high = wilson(F.col("k"), F.col("n"))
    return g.select("event_type", (F.col("k") / F.col("n")).alias("rate"), F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("median_baseline", "SELECT o_orderkey, coalesce(g.m, (SELECT median(o_totalprice) FROM orders)) AS baseline FROM orders LEFT JOIN (SELECT o_custkey, median(o_totalprice) AS m FROM orders GROUP BY o_custkey HAVING count(*) >= 5) g USING (o_custkey)")
def median_baseline(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    often = o.groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n >= 5")
    g = measures.percentiles(o.join(often, "o_custkey", "left_semi"), F.col("o_totalprice"), {"m": 0.5}, ["o_custkey"])
    whole = measures.percentiles(o, F.col("o_totalprice"), {"w": 0.5})
    return o.join(g, "o_custkey", "left").join(F.broadcast(whole)).select("o_orderkey", F.coalesce("m", "w").alias("baseline"))


@query("latency_summary", "SELECT event_type, count(*) AS n, avg(value) AS mean, median(value) AS median, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY event_type")
def latency_summary(spark, sf):
    e = table(spark, sf, "events").select("event_type", "value")
    p = measures.percentiles(e, F.col("value"), {"median": 0.5, "p95": 0.95}, ["event_type"])
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).join(p, "event_type", "left")


@query("low_fence", "SELECT quantile_cont(value, 0.05) AS fence FROM events")
def low_fence(spark, sf):
    return quality.low_fence(table(spark, sf, "events").select("value"), "value", 0.05)


@query("confidence_bins", "SELECT CASE WHEN l_tax * 12.5 <= 0.25 THEN 1 WHEN l_tax * 12.5 <= 0.5 THEN 2 WHEN l_tax * 12.5 <= 0.75 THEN 3 ELSE 4 END AS bin, count(*) AS n, avg((l_returnflag = 'R')::INT) AS accuracy FROM lineitem GROUP BY bin")
def confidence_bins(spark, sf):
    c = F.col("l_tax") * 12.5
    b = F.when(c <= 0.25, 1).when(c <= 0.5, 2).when(c <= 0.75, 3).otherwise(4)
    return table(spark, sf, "lineitem").groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg((F.col("l_returnflag") == "R").cast("int")).alias("accuracy"))


@query("time_split", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= (SELECT (count(*) * 4) // 5 FROM orders) AS train FROM orders")
def time_split(spark, sf):
    """The global position comes from the split point: the last training row's sort key, found by partial top sorts."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    # Rows before a date are counted per date first, so the window runs over dates and not over rows.
    days = o.groupBy("o_orderdate").agg(F.count("*").alias("n"))
    before = days.select("o_orderdate", (F.sum("n").over(Window.orderBy("o_orderdate")) - F.col("n")).alias("before"))
    cut = o.agg(F.floor(F.count("*") * 4 / 5).alias("cut"))
    pos = F.col("before") + F.row_number().over(Window.partitionBy("o_orderdate").orderBy("o_orderkey"))
    return o.join(before, "o_orderdate").join(F.broadcast(cut)).select("o_orderkey", (pos <= F.col("cut")).alias("train"))


@query("head_per_group", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r <= 3")
def head_per_group(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").withColumn("r", F.row_number().over(w)).filter("r <= 3").select("user_id", "event_id")


@query("union_all", "SELECT 'doc' AS kind, doc_id AS id FROM documents UNION ALL SELECT 'page', page_id FROM pages")
def union_all(spark, sf):
    return table(spark, sf, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id")).unionByName(table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").cast("long").alias("id")))


@query("key_overlap", "SELECT count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT page_id FROM pages)")
def key_overlap(spark, sf):
    return table(spark, sf, "documents").select("doc_id").intersect(table(spark, sf, "pages").select(F.col("page_id").cast("long"))).agg(F.count("*").alias("n"))


@query("key_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def key_difference(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").subtract(table(spark, sf, "orders").filter("o_totalprice > 300000").select("o_custkey"))


@query("durations", "SELECT event_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 3.6e9 AS hours FROM events")
def durations(spark, sf):
    first = table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("t0"))
    return table(spark, sf, "events").join(first, "user_id").select("event_id", hours_between(F.col("t0"), F.col("ts")).alias("hours"))


@query("open_frame", "SELECT event_id, hour(ts) AS h, isodow(ts) - 1 AS weekday, strftime(ts, '%Y-%m') AS month, ln(1 + greatest(coalesce(value, 0), 0)) AS log_value FROM events")
def open_frame(spark, sf):
    ts = F.col("ts")
    return table(spark, sf, "events").select("event_id", F.hour(ts).alias("h"), F.weekday(ts).alias("weekday"), F.date_format(ts, "yyyy-MM").alias("month"), F.log1p(F.greatest(F.coalesce("value", F.lit(0.0)), F.lit(0.0))).alias("log_value"))


@query("props_json", "SELECT event_id, (props ->> '$.k')::BIGINT AS k FROM events")
def props_json(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("content_key", "SELECT doc_id, sha256(coalesce(text, '') || '|' || coalesce(lang, '')) AS key FROM documents")
def content_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.concat(F.coalesce("text", F.lit("")), F.lit("|"), F.coalesce("lang", F.lit(""))), 256).alias("key"))
