"""Queries on families: signatures, outcomes, recurrence, votes, graphs and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import chains, evidence, fingerprints, timeline
from vigil.plans.catalog import query
from vigil.plans.q_records import _FP
from vigil.plans.records import RECORDS, records
from vigil.session import table

_FIELDS = ("ci_group", "closure_class", "category")
_LONG = " UNION ALL ".join(f"SELECT family, k, '{f}' AS field, coalesce({f}, 'Unknown') AS value FROM r" for f in _FIELDS)
_SIGNED = f"""
WITH r AS (SELECT * FROM {RECORDS}), l AS ({_LONG}), m AS (SELECT family, count(*) AS members FROM r GROUP BY family),
c AS (SELECT family, field, value, count(*) AS n, min(k) AS first FROM l GROUP BY family, field, value),
s AS (SELECT family, field, value, round(n / members, 3) AS share, rank FROM (SELECT *, row_number() OVER (PARTITION BY family, field ORDER BY n DESC, first) AS rank FROM c) JOIN m USING (family) WHERE rank <= 4)"""


@query("family_signatures", f"{_SIGNED} SELECT * FROM s")
def family_signatures(spark, sf):
    return evidence.signatures(records(spark, sf), "family", list(_FIELDS), "k")


@query("dominant_value", f"{_SIGNED} SELECT family, field, arg_min(value, rank) AS value, arg_min(share, rank) AS share FROM s WHERE value <> 'Unknown' GROUP BY family, field")
def dominant_value(spark, sf):
    return evidence.dominant(family_signatures(spark, sf), "family")


_FAMILY_FP = f"WITH j AS (SELECT incident_id, family, k, ci_group AS component, coalesce(title, 'Unknown') AS symptom, coalesce(closure_class, 'Unknown') AS root_cause FROM {RECORDS}),"


def _fingerprinted(spark, sf):
    """Records whose codes stand for the fields of a fingerprint."""
    known = lambda c, n: F.coalesce(c, F.lit("Unknown")).alias(n)
    return records(spark, sf).select("incident_id", "family", "k", F.col("ci_group").alias("component"), known("title", "symptom"), known("closure_class", "root_cause"))


@query("family_names", f"""{_FAMILY_FP}
l AS (SELECT family, k, 'component' AS field, component AS value FROM j UNION ALL SELECT family, k, 'symptom', symptom FROM j UNION ALL SELECT family, k, 'root_cause', root_cause FROM j),
c AS (SELECT family, field, value, count(*) AS n, min(k) AS first FROM l GROUP BY family, field, value),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family, field ORDER BY n DESC, first) AS rank FROM c) WHERE rank <= 4),
d AS (SELECT family, field, arg_min(value, rank) AS value FROM s WHERE value <> 'Unknown' GROUP BY family, field)
SELECT family, concat_ws(' — ', coalesce(nullif(concat_ws(' · ', max(value) FILTER (field = 'component'), max(value) FILTER (field = 'symptom')), ''), 'Mixed incidents'), max(value) FILTER (field = 'root_cause')) AS name FROM d GROUP BY family""")
def family_names(spark, sf):
    return evidence.family_names(evidence.signatures(_fingerprinted(spark, sf), "family", ["component", "symptom", "root_cause"], "k"), "family")


@query("cross_symptoms", f"""{_FAMILY_FP}
g AS (SELECT *, k % 8 AS grp FROM j), m AS (SELECT grp, count(*) AS members FROM g GROUP BY grp),
t AS (SELECT grp, root_cause, n FROM (SELECT grp, root_cause, count(*) AS n, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, min(k)) AS r FROM g GROUP BY grp, root_cause) WHERE r = 1),
s AS (SELECT t.grp, t.root_cause, round(n / members, 3) AS share, symptom FROM t JOIN m USING (grp) JOIN (SELECT grp, root_cause, symptom, count(*) AS c FROM g WHERE symptom <> 'Unknown' GROUP BY ALL) x ON x.grp = t.grp AND x.root_cause = t.root_cause
      WHERE t.root_cause <> 'Unknown' AND n / members >= 0.6 AND c / members >= 0.1)
SELECT grp, root_cause, share, list_sort(list(symptom)) AS symptoms FROM s GROUP BY grp, root_cause, share HAVING count(*) >= 2""")
def cross_symptoms(spark, sf):
    return evidence.cross_symptoms(_fingerprinted(spark, sf).withColumn("grp", F.col("k") % 8), "grp", "root_cause", "symptom", "k")


@query("family_outcomes", f"""
WITH r AS (SELECT *, reopened_source <> 'missing' AND reopened IS NOT NULL AS known FROM {RECORDS}),
g AS (SELECT strategy, (count(*) FILTER (known))::DOUBLE AS n, (count(*) FILTER (known AND reopened))::DOUBLE AS k, median(resolution_hours) FILTER (known) AS h, avg(coalesce(reassignments, 0)) FILTER (known) AS m FROM r GROUP BY strategy),
w AS (SELECT *, k / n AS p, 1 + 3.8416e0 / n AS den FROM g)
SELECT strategy, n::BIGINT AS n_with_outcome, n >= 20 AS supported, CASE WHEN n >= 20 THEN round(p, 4) END AS reopen_rate,
       CASE WHEN n >= 20 THEN round(greatest(0, (p + 3.8416e0 / (2 * n)) / den - 1.96e0 * sqrt(p * (1 - p) / n + 3.8416e0 / (4 * n * n)) / den), 4) END AS reopen_low,
       CASE WHEN n >= 20 THEN round(least(1, (p + 3.8416e0 / (2 * n)) / den + 1.96e0 * sqrt(p * (1 - p) / n + 3.8416e0 / (4 * n * n)) / den), 4) END AS reopen_high,
       CASE WHEN n >= 20 THEN round(m, 2) END AS mean_reassignments, CASE WHEN n >= 20 THEN round(h, 2) END AS median_hours FROM w""")
def family_outcomes(spark, sf):
    return evidence.outcomes(records(spark, sf), ["strategy"], True)


@query("family_recurrence", f"""
WITH r AS (SELECT *, CASE WHEN k % 5 <> 0 AND family <> 'F003' THEN open_time END AS t FROM {RECORDS}),
g AS (SELECT family, median(gap) AS gap FROM (SELECT family, (epoch_us(t) - lag(epoch_us(t)) OVER (PARTITION BY family ORDER BY t, k)) / 8.64e10 AS gap FROM r WHERE t IS NOT NULL) GROUP BY family),
i AS (SELECT family, ci_name, count(*) AS incidents, count(*) FILTER (gap <= 30) AS repeats FROM (SELECT family, ci_name, (epoch_us(t) - lag(epoch_us(t)) OVER (PARTITION BY family, ci_name ORDER BY t, k)) / 8.64e10 AS gap FROM r WHERE t IS NOT NULL) GROUP BY family, ci_name),
top AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY repeats DESC, incidents DESC, ci_name) AS o FROM i WHERE repeats >= 1),
l AS (SELECT family, list(ci_name ORDER BY o) FILTER (o <= 10) AS items, list(repeats ORDER BY o) FILTER (o <= 10) AS repeats FROM top GROUP BY family),
mm AS (SELECT family, list(month || '=' || n ORDER BY month) AS months FROM (SELECT family, strftime(t, '%Y-%m') AS month, count(*) AS n FROM r WHERE t IS NOT NULL GROUP BY family, month) GROUP BY family),
b AS (SELECT family, count(*) AS members, count(t) AS timed, min(t) AS first_seen, avg(reopened::INT) FILTER (t IS NOT NULL) AS rate FROM r GROUP BY family)
SELECT family, members, timed, CASE WHEN timed >= 3 THEN 'ok' ELSE 'insufficient temporal data' END AS status, CASE WHEN timed >= 3 THEN epoch_us(first_seen) END AS first_us, CASE WHEN timed >= 3 THEN round(gap, 2) END AS median_days_between,
       CASE WHEN timed >= 3 THEN items END AS items, CASE WHEN timed >= 3 THEN repeats END AS repeats, CASE WHEN timed >= 3 THEN months END AS months, CASE WHEN timed >= 3 THEN round(rate, 4) END AS reopen_rate
FROM b LEFT JOIN g USING (family) LEFT JOIN l USING (family) LEFT JOIN mm USING (family)""")
def family_recurrence(spark, sf):
    rows = records(spark, sf).withColumn("t", F.when((F.col("k") % 5 != 0) & (F.col("family") != "F003"), F.col("open_time")))
    out = evidence.recurrence(rows, "family", "ci_name", "t", "k")
    listed = lambda f: F.transform("recurring", lambda x: x[f])
    months = F.transform(F.map_entries("monthly"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return out.select("family", "members", "timed", "status", F.unix_micros("first_seen").alias("first_us"), "median_days_between", listed("item").alias("items"), listed("repeats").alias("repeats"), months.alias("months"), "reopen_rate")


@query("hotspot_codes", f"""
WITH w AS (SELECT ci_name, epoch_us(open_time) AS us, count(*) OVER p AS n, min(epoch_us(open_time)) OVER p AS first FROM {RECORDS} WINDOW p AS (PARTITION BY ci_name ORDER BY open_time RANGE BETWEEN INTERVAL 14 DAYS PRECEDING AND CURRENT ROW)),
b AS (SELECT ci_name, n, first FROM (SELECT *, row_number() OVER (PARTITION BY ci_name ORDER BY n DESC, us) AS r FROM w) WHERE r = 1 AND n >= 3 ORDER BY n DESC, ci_name LIMIT 15),
i AS (SELECT r.ci_name, coalesce(closure_code, 'Unknown') AS closure_code, open_time, k FROM {RECORDS} r JOIN b ON r.ci_name = b.ci_name AND epoch_us(open_time) BETWEEN first AND first + 14 * 86400000000)
SELECT ci_name, closure_code, n, rank FROM (SELECT ci_name, closure_code, count(*) AS n, row_number() OVER (PARTITION BY ci_name ORDER BY count(*) DESC, min((open_time, k))) AS rank FROM i GROUP BY ci_name, closure_code) WHERE rank <= 2""")
def hotspot_codes(spark, sf):
    rows = records(spark, sf)
    return evidence.hotspot_codes(rows, timeline.hotspots(rows, "ci_name", "open_time", least=3), "ci_name", "open_time", "closure_code", "k")


#: Five records retrieved for each of some queries: those of neighbouring keys.
_FOUND = f"(SELECT k // 5 AS query_id, (k % 5 + 1)::INT AS rank, incident_id, coalesce(closure_class, 'Unknown') AS root_cause, resolution_notes_source AS provenance, ci_group, impact_scope FROM {RECORDS})"


def _found(spark, sf):
    r = records(spark, sf)
    return r.select(F.floor(F.col("k") / 5).alias("query_id"), (F.col("k") % 5 + 1).cast("int").alias("rank"), "incident_id", F.coalesce("closure_class", F.lit("Unknown")).alias("root_cause"), F.col("resolution_notes_source").alias("provenance"), "ci_group", "impact_scope")


@query("root_cause_vote", f"""
WITH f AS (SELECT *, CASE WHEN provenance = 'original' THEN 'derived' ELSE provenance END AS p FROM {_FOUND}), t AS (SELECT query_id, count(*) AS retrieved FROM f GROUP BY query_id),
c AS (SELECT query_id, root_cause, n FROM (SELECT query_id, root_cause, count(*) AS n, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, min(rank)) AS o FROM f WHERE root_cause <> 'Unknown' GROUP BY query_id, root_cause) WHERE o = 1),
s AS (SELECT query_id, list(incident_id ORDER BY rank) AS supporting, count(*) FILTER (p = 'synthetic') >= count(*) FILTER (p = 'derived') AS i FROM f JOIN c USING (query_id, root_cause) GROUP BY query_id)
SELECT query_id, root_cause, round(n / retrieved, 3) AS share, CASE WHEN n IS NULL THEN 'insufficient evidence' WHEN n / retrieved >= 0.6 THEN 'likely' WHEN n / retrieved >= 0.3 THEN 'possible' ELSE 'weakly supported' END AS certainty,
       supporting, CASE WHEN n IS NOT NULL THEN CASE WHEN i THEN 'inferred' ELSE 'derived' END END AS tag FROM t LEFT JOIN c USING (query_id) LEFT JOIN s USING (query_id)""")
def root_cause_vote(spark, sf):
    rows = _found(spark, sf).withColumn("provenance", F.when(F.col("provenance") == "original", "derived").otherwise(F.col("provenance")))
    return evidence.root_cause_vote(rows)


@query("share_match", f"""
SELECT query_id, round(avg(coalesce(impact_scope = 'department' OR list_contains([ci_group], 'department'), false)::INT) FILTER (impact_scope IS NOT NULL AND impact_scope <> 'Unknown'), 4) AS scope_match,
       round(avg((ci_group = 'sap')::INT), 4) AS group_match FROM {_FOUND} GROUP BY query_id""")
def share_match(spark, sf):
    own = F.lit("department")
    return _found(spark, sf).groupBy("query_id").agg(evidence.share_match(own, F.col("impact_scope"), F.array("ci_group")).alias("scope_match"), evidence.share_match(F.lit("sap"), F.col("ci_group")).alias("group_match"))


@query("rating_summary", """
WITH e AS (SELECT user_id % 50 AS page, (floor(value / 20) % 5 + 1)::INT AS rating, ts, event_id FROM events),
l AS (SELECT page, list(event_id ORDER BY o) AS newest FROM (SELECT page, event_id, row_number() OVER (PARTITION BY page ORDER BY ts DESC, event_id DESC) AS o FROM e) WHERE o <= 5 GROUP BY page)
SELECT page, count(*) AS n, round(avg(rating), 2) AS mean, count(*) FILTER (rating = 1) AS n1, count(*) FILTER (rating = 2) AS n2, count(*) FILTER (rating = 3) AS n3, count(*) FILTER (rating = 4) AS n4, count(*) FILTER (rating = 5) AS n5,
       round(avg(rating) / 5 * 100)::INT AS percent_resolved, any_value(newest) AS newest FROM e JOIN l USING (page) GROUP BY page""")
def rating_summary(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 50).alias("page"), (F.floor(F.col("value") / 20) % 5 + 1).cast("int").alias("rating"), "ts", "event_id")
    return evidence.ratings(e, ["page"], "rating", "ts", "event_id")


_COLS = ("title", "closure_class", "ci_group", "impact", "reopened", "reassignments")
_UNPIVOT = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS value FROM r" for c in _COLS)


@query("profile", f"""
WITH r AS (SELECT * FROM {RECORDS}), n AS (SELECT "column", value, count(*) AS n FROM ({_UNPIVOT}) GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value NULLS LAST) AS o FROM n)
SELECT "column", coalesce(sum(n) FILTER (value IS NULL), 0)::BIGINT AS nulls, round(coalesce(sum(n) FILTER (value IS NULL), 0) / sum(n) * 100, 2) AS null_percent, count(value) AS "distinct",
       list(value ORDER BY o) FILTER (o <= 6) AS top, list(n ORDER BY o) FILTER (o <= 6) AS counts FROM o GROUP BY "column" """)
def profile(spark, sf):
    out = evidence.profile(records(spark, sf).select(*_COLS))
    return out.select("column", "nulls", "null_percent", "distinct", F.transform("top", lambda x: x["value"]).alias("top"), F.transform("top", lambda x: x["n"]).alias("counts"))


_SOURCED = ("description", "resolution_notes", "impact", "urgency", "priority", "closure_code", "open_time", "resolved_time", "reopened")
_CLASSES = ("original", "derived", "synthetic", "missing")


@query("provenance_counts", " UNION ALL ".join(f"SELECT '{f}' AS field, " + ", ".join(f"count(*) FILTER ({f}_source = '{c}') AS {c}" for c in _CLASSES) + f" FROM {RECORDS}" for f in _SOURCED))
def provenance_counts(spark, sf):
    return evidence.provenance_counts(records(spark, sf), list(_SOURCED), _CLASSES)


_INCONSISTENT = "try_cast(priority AS DOUBLE) <> least(try_cast(impact AS DOUBLE), try_cast(urgency AS DOUBLE))"
_REPORT = {
    "records": ("count(*)", lambda: F.count("*")), "with_description": ("count(nullif(description, ''))", lambda: F.count(F.nullif(F.col("description"), F.lit("")))), "with_notes": ("count(nullif(resolution_notes, ''))", lambda: F.count(F.nullif(F.col("resolution_notes"), F.lit("")))),
    "synthetic_descriptions": ("count(*) FILTER (description_source = 'synthetic')", lambda: F.count_if(F.col("description_source") == "synthetic")),
    "synthetic_percent": ("round(100.0 * count(*) FILTER (description_source = 'synthetic') / count(*), 2)", lambda: F.round(100.0 * F.count_if(F.col("description_source") == "synthetic") / F.count("*"), 2)),
    "opened": ("count(open_time)", lambda: F.count("open_time")), "resolved": ("count(resolved_time)", lambda: F.count("resolved_time")), "unresolved_closed": ("count(*) FILTER (resolved_time IS NULL AND closure_code IS NOT NULL)", lambda: F.count_if(F.col("resolved_time").isNull() & F.col("closure_code").isNotNull())),
    "impact_not_set": ("count(*) FILTER (impact = 'Not Set')", lambda: F.count_if(F.col("impact") == "Not Set")), "urgency_not_set": ("count(*) FILTER (urgency = 'Not Set')", lambda: F.count_if(F.col("urgency") == "Not Set")),
    "priority_not_set": ("count(*) FILTER (priority = 'Not Set')", lambda: F.count_if(F.col("priority") == "Not Set")), "closure_code_not_set": ("count(*) FILTER (closure_code = 'Not Set')", lambda: F.count_if(F.col("closure_code") == "Not Set")),
    "families": ("count(DISTINCT family)", lambda: F.count_distinct("family")), "strategies": ("count(DISTINCT strategy)", lambda: F.count_distinct("strategy")), "items": ("count(DISTINCT ci_name)", lambda: F.count_distinct("ci_name")),
    "groups": ("count(DISTINCT ci_group)", lambda: F.count_distinct("ci_group")), "reopened": ("count(*) FILTER (reopened)", lambda: F.count_if("reopened")), "outcome_unknown": ("count(*) FILTER (reopened IS NULL)", lambda: F.count_if(F.col("reopened").isNull())),
    "many_reassignments": ("count(*) FILTER (reassignments >= 5)", lambda: F.count_if(F.col("reassignments") >= 5)), "with_change": ("count(*) FILTER (related_change IS NOT NULL AND related_change <> 'Not Available')", lambda: F.count_if(F.col("related_change").isNotNull() & (F.col("related_change") != "Not Available"))),
    "change_placeholders": ("count(*) FILTER (related_change = 'Not Available')", lambda: F.count_if(F.col("related_change") == "Not Available")),
    "priority_inconsistent": (f"count(*) FILTER ({_INCONSISTENT})", lambda: F.count_if(F.col("priority").try_cast("double") != F.least(F.col("impact").try_cast("double"), F.col("urgency").try_cast("double")))),
    "mean_hours": ("round(avg(resolution_hours), 4)", lambda: F.round(F.avg("resolution_hours"), 4)), "first_us": ("min(epoch_us(open_time))", lambda: F.min(F.unix_micros("open_time"))), "last_us": ("max(epoch_us(open_time))", lambda: F.max(F.unix_micros("open_time"))),
}


@query("dataset_report", "SELECT " + ", ".join(f"{s} AS {n}" for n, (s, _) in _REPORT.items()) + f" FROM {RECORDS}")
def dataset_report(spark, sf):
    return records(spark, sf).agg(*[c().alias(n) for n, (_, c) in _REPORT.items()])


@query("histogram", "SELECT round(value / 100, 1) AS bucket, count(*) AS n FROM events GROUP BY bucket")
def histogram(spark, sf):
    return table(spark, sf, "events").groupBy(F.round(F.col("value") / 100, 1).alias("bucket")).agg(F.count("*").alias("n"))


_CHAIN = f"""
WITH fp AS ({_FP}), j AS (SELECT fp.trigger AS f_trigger, fp.root_cause AS f_cause, fp.business_impact AS f_impact, r.* FROM fp JOIN {RECORDS} r USING (incident_id)),
c AS (SELECT incident_id, open_time IS NOT NULL AND resolved_time IS NOT NULL AS available, list_filter([
  CASE WHEN related_change IS NOT NULL AND related_change <> '' AND related_change NOT IN ('None', 'nan', 'Not Available') THEN {{'stage': 'trigger', 'statement': 'Change record ' || related_change || ' is linked'}} WHEN f_trigger <> 'Unknown' THEN {{'stage': 'trigger', 'statement': f_trigger}} END,
  CASE WHEN f_cause <> 'Unknown' THEN {{'stage': 'technical_failure', 'statement': f_cause}} END, CASE WHEN description <> '' THEN {{'stage': 'symptom', 'statement': substr(description, 1, 220)}} END,
  CASE WHEN impact <> 'Not Set' OR urgency <> 'Not Set' THEN {{'stage': 'business_impact', 'statement': CASE WHEN f_impact <> 'Unknown' THEN f_impact ELSE 'Impact ' || impact || ' / Urgency ' || urgency END}} WHEN f_impact <> 'Unknown' THEN {{'stage': 'business_impact', 'statement': f_impact}} END,
  CASE WHEN resolution_notes <> '' THEN {{'stage': 'resolution', 'statement': substr(resolution_notes, 1, 220) || CASE WHEN closure_code <> 'Not Set' THEN ' [closure code: ' || closure_code || ']' ELSE '' END}} END,
  CASE WHEN resolved_time IS NOT NULL THEN {{'stage': 'outcome', 'statement': 'outcome'}} END], lambda x: x IS NOT NULL) AS facts FROM j)
SELECT incident_id, available, list_transform(facts, lambda x: x.stage) AS stages, list_transform(list_filter(facts, lambda x: x.stage <> 'outcome'), lambda x: x.statement) AS statements,
       CASE WHEN available THEN list_filter(['trigger', 'technical_failure', 'symptom', 'business_impact', 'resolution', 'outcome'], lambda s: NOT list_contains(list_transform(facts, lambda x: x.stage), s)) END AS missing_stages FROM c"""


@query("incident_chains", _CHAIN)
def incident_chains(spark, sf):
    out = chains.incident_chains(fingerprints.of_records(records(spark, sf)))
    said = F.transform(F.filter("facts", lambda x: x["stage"] != "outcome"), lambda x: x["statement"])
    return out.select("incident_id", "available", F.transform("facts", lambda x: x["stage"]).alias("stages"), said.alias("statements"), "missing_stages")


@query("incident_edges", f"""
WITH r AS (SELECT incident_id, open_time, ci_name, CASE WHEN k % 3 = 0 THEN 'KB' || (k % 97) END AS kb_number, CASE WHEN related_change NOT IN ('None', 'nan', 'Not Available', 'Unknown') THEN related_change END AS related_change FROM {RECORDS}),
p AS (SELECT 'same_ci' AS rel_type, incident_id AS src_id, lead(incident_id) OVER w AS dst_id, (epoch_us(lead(open_time) OVER w) - epoch_us(open_time)) / 8.64e10 AS gap FROM r WINDOW w AS (PARTITION BY ci_name ORDER BY open_time NULLS LAST, incident_id)
      UNION ALL SELECT 'same_kb_article', incident_id, lead(incident_id) OVER w, NULL FROM (SELECT * FROM r WHERE kb_number IS NOT NULL) WINDOW w AS (PARTITION BY kb_number ORDER BY open_time NULLS LAST, incident_id)
      UNION ALL SELECT 'same_change', incident_id, lead(incident_id) OVER w, NULL FROM (SELECT * FROM r WHERE related_change IS NOT NULL) WINDOW w AS (PARTITION BY related_change ORDER BY open_time NULLS LAST, incident_id))
SELECT rel_type, src_id, dst_id, 1e0 AS weight FROM p WHERE dst_id IS NOT NULL UNION ALL SELECT 'repeat_same_ci', src_id, dst_id, round(1 - gap / 7, 6) FROM p WHERE rel_type = 'same_ci' AND dst_id IS NOT NULL AND gap <= 7""")
def incident_edges(spark, sf):
    r = records(spark, sf).withColumn("kb_number", F.when(F.col("k") % 3 == 0, F.concat(F.lit("KB"), (F.col("k") % 97).cast("string"))))
    return chains.incident_edges(r, "incident_id", "open_time").withColumn("weight", F.round("weight", 6))


@query("family_graph", f"""
WITH r AS (SELECT *, k % 12 AS fam FROM {RECORDS}), m AS (SELECT fam, count(*) AS members FROM r GROUP BY fam),
l AS (SELECT fam, 'component' AS field, ci_group AS value FROM r UNION ALL SELECT fam, 'root_cause', coalesce(closure_class, 'Unknown') FROM r),
s AS (SELECT fam, field, value, round(count(*) / any_value(members), 3) AS share FROM l JOIN m USING (fam) WHERE value <> 'Unknown' GROUP BY fam, field, value HAVING round(count(*) / any_value(members), 3) >= 0.05),
d AS (SELECT DISTINCT fam, ci_name FROM r)
SELECT fam::VARCHAR AS src, field || ':' || value AS dst, 'has_' || field AS rel, share::DOUBLE AS weight FROM s
UNION ALL SELECT a.fam::VARCHAR, b.fam::VARCHAR, 'shared_cis', count(*)::DOUBLE FROM d a JOIN d b ON a.ci_name = b.ci_name AND a.fam < b.fam GROUP BY a.fam, b.fam HAVING count(*) >= 5
UNION ALL SELECT a.fam::VARCHAR, b.fam::VARCHAR, 'shared_root_cause', 1e0 FROM (SELECT DISTINCT fam, value FROM s WHERE field = 'root_cause' AND share >= 0.1) a JOIN (SELECT DISTINCT fam, value FROM s WHERE field = 'root_cause' AND share >= 0.1) b ON a.value = b.value AND a.fam < b.fam GROUP BY a.fam, b.fam""")
def family_graph(spark, sf):
    r = records(spark, sf).select("k", (F.col("k") % 12).alias("fam"), F.col("ci_group").alias("component"), F.col("closure_class").alias("root_cause"), "ci_name")
    sig = evidence.signatures(r, "fam", ["component", "root_cause"], "k", k=1000)
    g = chains.family_graph(sig, r, "fam", "ci_name", 0.05, 0.1, 5)
    return g.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "rel", "weight")


_SECTION = "CASE WHEN {0} THEN 'computed' ELSE 'insufficient evidence' END"


@query("evidence_chains", f"""
WITH r AS (SELECT incident_id, k % 6 = 0 AS novel, k % 4 > 0 AS fields, k % 5 > 0 AS strong, k % 7 > 0 AS got, k % 3 > 0 AS cause, k % 8 > 0 AS way, k % 2 = 0 AS c, k % 9 = 0 AS s FROM {RECORDS}),
t AS (SELECT *, ['computed', {", ".join(_SECTION.format(x) for x in ("fields", "NOT novel AND strong", "got", "NOT novel AND cause", "NOT novel AND way", "c OR s"))}] AS status FROM r)
SELECT incident_id, status, round(len(list_filter(status, lambda x: x = 'computed')) / 7, 9) AS completeness, list_filter([CASE WHEN NOT c THEN 'component' END, CASE WHEN NOT s THEN 'symptom' END], lambda x: x IS NOT NULL) AS not_computable FROM t""")
def evidence_chains(spark, sf):
    k = F.col("k")
    matches = F.create_map(F.lit("component"), F.when(k % 2 == 0, 0.5), F.lit("symptom"), F.when(k % 9 == 0, 1.0))
    rows = records(spark, sf).select(
        "incident_id", (k % 4).alias("known_fields"), (k % 6 == 0).alias("novel"), "family", F.when(k % 5 > 0, 0.4).alias("match_strength"), (k % 7).alias("n_retrieved"), F.when(k % 3 > 0, "memory leak").alias("root_cause"),
        F.when(k % 3 > 0, "likely").otherwise(evidence.INSUFFICIENT).alias("certainty"), F.when(k % 8 > 0, F.col("strategy")).alias("strategy"), F.lit(0.5).alias("confidence"), matches.alias("matches"),
    )
    out = evidence.chain(rows, "incident_id")
    return out.select("incident_id", F.transform("sections", lambda s: s["status"]).alias("status"), F.round("completeness", 9).alias("completeness"), "not_computable")
