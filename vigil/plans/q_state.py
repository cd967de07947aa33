"""Workflow state and scoring queries over incident records."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions import lexicon
from vigil.operators import groups, ranking, workflow
from vigil.plans.catalog import query
from vigil.plans.records import RECORDS, mapped, records
from vigil.session import table
from vigil.streaming import evolution

_ESC = "(SELECT event_id AS escalation_id, event_id AS created_seq, (['L1', 'L2', 'L3'])[(event_id % 3 + 1)::INT] AS tier FROM events)"


def _escalated(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("escalation_id"), F.col("event_id").alias("created_seq"), F.get(F.array(*map(F.lit, workflow.TIERS)), (F.col("event_id") % 3).cast("int")).alias("tier"))


@query("escalation_view", f"""
SELECT o.escalation_id, o.created_seq, CASE WHEN o.escalation_id % 7 = 0 THEN 'resolved' WHEN o.escalation_id % 4 = 0 THEN 'handed_off' ELSE 'open' END AS status, CASE WHEN o.escalation_id % 4 = 0 THEN 'L2' END AS handed_to FROM {_ESC} o""")
def escalation_view(spark, sf):
    o = _escalated(spark, sf).drop("tier")
    handed = o.filter("escalation_id % 4 = 0").select("escalation_id", F.lit("L2").alias("to_tier"), F.col("created_seq").alias("seq"))
    done = o.filter("escalation_id % 7 = 0").select("escalation_id", F.col("created_seq").alias("seq"))
    return workflow.escalations(o, handed, done).select("escalation_id", "created_seq", "status", F.col("tier").alias("handed_to"))


@query("hand_offs", f"""
WITH r AS (SELECT event_id AS request_id, event_id // 2 * 3 AS escalation_id, event_type AS note, row_number() OVER (PARTITION BY event_id // 2 * 3 ORDER BY event_id) AS n FROM events),
j AS (SELECT r.*, tier FROM r LEFT JOIN {_ESC} USING (escalation_id)), t AS (SELECT *, CASE tier WHEN 'L1' THEN 'L2' WHEN 'L2' THEN 'L3' END AS nxt FROM j),
v AS (SELECT *, CASE WHEN tier IS NULL THEN 'unknown escalation' WHEN escalation_id % 7 = 0 THEN 'already resolved' WHEN escalation_id % 4 = 0 OR (n > 1 AND nxt IS NOT NULL) THEN 'already handed off' WHEN nxt IS NULL THEN 'last tier' ELSE 'accepted' END AS verdict FROM t)
SELECT request_id, escalation_id, tier, verdict, CASE WHEN verdict = 'accepted' THEN nxt END AS to_tier, CASE WHEN verdict = 'accepted' THEN 'handed off by ' || tier || ': ' || trim(note) END AS reason FROM v""")
def hand_offs(spark, sf):
    e = table(spark, sf, "events")
    requests = e.select(F.col("event_id").alias("request_id"), (F.floor(F.col("event_id") / 2) * 3).alias("escalation_id"), F.col("event_type").alias("note"))
    opened = _escalated(spark, sf).withColumn("tier", F.get(F.array(*map(F.lit, ("L1", "L2", "L3"))), (F.col("escalation_id") % 3).cast("int")))
    return workflow.hand_offs(requests, opened, opened.filter("escalation_id % 4 = 0"), opened.filter("escalation_id % 7 = 0"))


_LOG = f"(SELECT incident_id, i AS seq, 'step ' || i AS step, (['FAILED', 'UNKNOWN', 'WORKED', 'FAILED'])[((k + i) % 4 + 1)::INT] AS answer, CASE WHEN k % 2 = 0 THEN 'noted' END AS note, 'S' || ((k + i) % 5) AS strategy FROM {RECORDS}, range(1, 4) t(i) WHERE k % 3 <> 2)"


def _log(spark, sf):
    r = records(spark, sf).filter("k % 3 <> 2").select("incident_id", "k", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("seq"))
    answers = F.array(*map(F.lit, ("FAILED", "UNKNOWN", "WORKED", "FAILED")))
    return r.select("incident_id", "seq", F.concat(F.lit("step "), F.col("seq").cast("string")).alias("step"), F.get(answers, ((F.col("k") + F.col("seq")) % 4).cast("int")).alias("answer"), F.when(F.col("k") % 2 == 0, "noted").alias("note"), F.concat(F.lit("S"), ((F.col("k") + F.col("seq")) % 5).cast("string")).alias("strategy"))


@query("kb_candidates", f"""
WITH i AS (SELECT *, CASE WHEN resolved_time IS NULL THEN 'Open' ELSE 'Resolved' END AS status FROM {RECORDS}),
a AS (SELECT incident_id, count(*) AS n, arg_max(step, seq) FILTER (answer = 'WORKED') AS w, arg_max(strategy, seq) FILTER (answer = 'WORKED') AS ws, max(note) AS noted, list(step ORDER BY seq) FILTER (answer = 'FAILED') AS failed FROM {_LOG} GROUP BY incident_id)
SELECT i.incident_id, coalesce(title, substr(description, 1, 80)) AS title,
       (CASE WHEN w IS NOT NULL THEN concat_ws('. ', w, noted) ELSE coalesce(resolution_notes, '') END) || coalesce(' Root cause (postmortem): ' || CASE WHEN k % 5 = 0 THEN ci_group END || '.', '')
         || CASE WHEN len(failed) > 0 THEN ' Previously tried without success: ' || array_to_string(failed, '; ') || '.' ELSE '' END AS resolution_notes,
       ws AS worked_strategy, coalesce(n, 0)::INT AS n_attempts, CASE WHEN k % 4 < 3 THEN k % 4 = 1 END AS helpful, CASE WHEN k % 4 < 3 THEN true END AS cause_correct, CASE WHEN k % 5 = 0 THEN ci_group END AS root_cause
FROM i LEFT JOIN a USING (incident_id) WHERE status = 'Resolved'""")
def kb_candidates(spark, sf):
    r = records(spark, sf)
    incidents = r.withColumn("status", F.when(F.col("resolved_time").isNull(), "Open").otherwise("Resolved"))
    older = r.filter("k % 4 < 3").select("incident_id", F.lit(1).alias("seq"), F.lit(False).alias("helpful"), F.lit(False).alias("cause_correct"))
    newer = r.filter("k % 4 < 3").select("incident_id", F.lit(2).alias("seq"), (F.col("k") % 4 == 1).alias("helpful"), F.lit(True).alias("cause_correct"))
    post = r.filter("k % 5 = 0").select("incident_id", F.col("k").alias("seq"), F.col("ci_group").alias("root_cause"))
    return workflow.candidates(incidents, _log(spark, sf), older.unionByName(newer), post)


@query("adjusted_scores", f"""
SELECT incident_id, round(least(1e0, greatest(0e0, s + CASE WHEN coalesce(NOT h, false) OR coalesce(NOT c, false) THEN -0.15e0 ELSE 0 END + CASE WHEN coalesce(h AND c, false) THEN 0.05e0 ELSE 0 END)), 4) AS score
FROM (SELECT incident_id, (k % 100) / 100 AS s, CASE WHEN k % 3 < 2 THEN k % 3 = 0 END AS h, CASE WHEN k % 5 < 4 THEN k % 5 <> 1 END AS c FROM {RECORDS})""")
def adjusted_scores(spark, sf):
    h, c = F.when(F.col("k") % 3 < 2, F.col("k") % 3 == 0), F.when(F.col("k") % 5 < 4, F.col("k") % 5 != 1)
    return records(spark, sf).select("incident_id", workflow.adjusted((F.col("k") % 100) / 100, h, c).alias("score"))


@query("reviewed_candidates", f"""
SELECT incident_id, before, status, CASE WHEN status <> before THEN 'review: ' || status END AS audit FROM (
  SELECT incident_id, CASE WHEN k % 2 = 0 THEN 'pending_review' ELSE 'indexed' END AS before, CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN CASE WHEN k % 9 = 0 THEN 'indexed' ELSE 'rejected' END WHEN k % 2 = 0 THEN 'pending_review' ELSE 'indexed' END AS status FROM {RECORDS})""")
def reviewed_candidates(spark, sf):
    r = records(spark, sf)
    d = r.filter("k % 3 = 0")
    first, later = d.select("incident_id", F.lit(1).alias("seq"), (F.col("k") % 9 == 0).alias("approve")), d.select("incident_id", F.lit(2).alias("seq"), (F.col("k") % 9 != 0).alias("approve"))
    return workflow.review(r.select("incident_id", F.when(F.col("k") % 2 == 0, "pending_review").otherwise("indexed").alias("status")), first.unionByName(later))


@query("escalation_packets", f"""
WITH l AS (SELECT incident_id, list_sort(list(DISTINCT strategy) FILTER (answer = 'FAILED')) AS failed, count(*) FILTER (answer = 'FAILED') AS n FROM {_LOG} GROUP BY incident_id),
p AS (SELECT r.incident_id, coalesce(failed, []) AS failed, coalesce(n, 0) AS n, list_filter([CASE WHEN priority IN ('1', '2') THEN 'priority' END, CASE WHEN k % 6 = 0 THEN 'novel' END, CASE WHEN n >= 2 THEN 'troubleshooting exhausted' END,
        CASE WHEN reassignments >= 2 THEN 'many reassignments' END, CASE WHEN k % 10 >= 2 AND n >= 2 THEN 'often reopened' END], lambda x: x IS NOT NULL) AS reasons, ci_group, k FROM {RECORDS} r JOIN l USING (incident_id)),
o AS (SELECT *, list_filter(['S' || (k % 5), 'S' || ((k + 1) % 5)], lambda s: NOT list_contains(failed, s))[1] AS nxt FROM p)
SELECT incident_id, (['L1', 'L2', 'L3'])[least(len(reasons) + 1, 3)] AS tier, reasons, failed, coalesce('try ' || nxt, 'Specialist diagnosis of ' || ci_group) AS next_action, nxt AS next_strategy FROM o""")
def escalation_packets(spark, sf):
    tried = _log(spark, sf).groupBy("incident_id").agg(F.sort_array(F.collect_list(F.struct("seq", "step", "answer", "strategy"))).alias("attempts"))
    way = lambda i: F.concat(F.lit("S"), ((F.col("k") + i) % 5).cast("string"))
    offer = F.array(*[F.struct(way(i).alias("strategy"), F.concat(F.lit("try "), way(i)).alias("action")) for i in (0, 1)])
    rows = records(spark, sf).join(tried, "incident_id").select("incident_id", F.col("ci_group").alias("component"), F.lit("hard failure").alias("failure_type"), "priority", (F.col("k") % 6 == 0).alias("novel"), "attempts", offer.alias("alternatives"), F.col("reassignments").alias("mean_reassignments"), ((F.col("k") % 10) / 10 - 0.05).alias("reopen_rate"))
    return workflow.escalation_packets(rows, rounds=2)


@query("postmortems", f"""
WITH i AS (SELECT incident_id, epoch_us(open_time) AS o, epoch_us(resolved_time) AS r FROM {RECORDS} WHERE k % 3 <> 2),
t AS (SELECT incident_id, o AS tm, 0 AS p, 'incident opened' AS event FROM i UNION ALL SELECT incident_id, r, 2, 'incident resolved' FROM i WHERE r IS NOT NULL
      UNION ALL SELECT l.incident_id, o + seq * 60000000, 1, 'attempt ' || lower(answer) FROM {_LOG} l JOIN i USING (incident_id)),
a AS (SELECT incident_id, arg_max(step, seq) FILTER (answer = 'WORKED') AS w, coalesce(list(step ORDER BY seq) FILTER (answer = 'FAILED'), []) AS failed FROM (SELECT incident_id, seq, answer, CASE WHEN seq = 2 THEN 'restart ' ELSE '' END || step AS step FROM {_LOG}) GROUP BY incident_id)
SELECT incident_id, list(event ORDER BY tm, p, event) AS timeline, any_value(w) AS final_fix, any_value(failed) AS failed, coalesce(any_value(w) LIKE '%restart%', false) AS workaround FROM t JOIN a USING (incident_id) GROUP BY incident_id""")
def postmortems(spark, sf):
    r = records(spark, sf).filter("k % 3 <> 2").select("incident_id", "open_time", "resolved_time")
    log = _log(spark, sf).withColumn("step", F.concat(F.when(F.col("seq") == 2, "restart ").otherwise(""), "step"))
    at = F.timestamp_micros(F.unix_micros("open_time") + F.col("seq") * 60_000_000)
    events = log.join(r, "incident_id").select("incident_id", at.alias("at"), F.concat(F.lit("attempt_"), F.lower("answer")).alias("kind"))
    return workflow.postmortems(r, events, log, lexicon.WORKAROUNDS)


_TEAM = f"coalesce({mapped('component', ranking.COMPONENT_TEAM)}, {mapped('ci_group', ranking.GROUP_TEAM)}, {mapped('category', ranking.CATEGORY_TEAM)}, 'Service Desk')"


@query("team_routing", f"""
SELECT incident_id, {_TEAM} AS team, CASE WHEN component <> 'Unknown' THEN concat_ws(' ', component, {mapped('failure', ranking.FAILURE_EXPERTISE)}) END AS expertise
FROM (SELECT *, coalesce(CASE WHEN k % 3 = 0 THEN {mapped('ci_group', lexicon.GROUP_COMPONENT)} END, 'Unknown') AS component, CASE WHEN k % 2 = 0 THEN 'hard failure' ELSE 'Unknown' END AS failure FROM {RECORDS})""")
def team_routing(spark, sf):
    from vigil.functions.clean import lookup

    component = F.coalesce(F.when(F.col("k") % 3 == 0, lookup(F.col("ci_group"), lexicon.GROUP_COMPONENT)), F.lit("Unknown"))
    team, skill = ranking.route_team(component, F.when(F.col("k") % 2 == 0, "hard failure").otherwise("Unknown"), F.col("ci_group"), F.col("category"))
    return records(spark, sf).select("incident_id", team.alias("team"), skill.alias("expertise"))


@query("tier_routing", f"SELECT incident_id, (['L1', 'L2', 'L3'])[least(1 + (priority IN ('1', '2'))::INT + coalesce(reopened, false)::INT + coalesce(reassignments >= 2, false)::INT, 3)] AS tier FROM {RECORDS}")
def tier_routing(spark, sf):
    return records(spark, sf).select("incident_id", ranking.route_tier(list(workflow.TIERS), F.col("priority").isin("1", "2"), F.col("reopened"), F.col("reassignments") >= 2).alias("tier"))


_NOV = f"(SELECT *, CASE WHEN k % 7 <> 0 THEN (k % 23) / 4 - 3 END AS logit, CASE WHEN k % 5 <> 0 THEN (k % 101) / 101 END AS sem, (k % 53) / 53 AS cent, CASE WHEN k % 3 = 0 THEN (k % 11) / 11 END AS supp FROM {RECORDS})"
_NX = [("coalesce(lm, -12)", 0.9, -1.0, 2.0), ("coalesce(sm, 0)", 1.4, 0.5, 0.2), ("coalesce(cm, 0)", 0.7, 0.5, 0.3), ("coalesce(sp, 0.5)", 0.3, 0.4, 0.25)]


@query("novelty", f"""
WITH f AS (SELECT k // 5 AS query_id, max(logit) AS lm, max(sem) AS sm, max(cent) AS cm, arg_min(supp, k) FILTER (supp IS NOT NULL) AS sp, bool_and(k % 50 < 45) AS reranked FROM {_NOV} GROUP BY k // 5),
p AS (SELECT *, 1 / (1 + exp(-({' + '.join(f'{w}e0 * ({x} - ({m}e0)) / {s}e0' for x, w, m, s in _NX)} + 0.2e0))) AS p FROM f)
SELECT query_id, CASE WHEN reranked THEN round(p, 9) END AS known_probability, CASE WHEN NOT reranked THEN 'undetermined' WHEN p < 0.5 THEN 'novel' ELSE 'known' END AS verdict FROM p""")
def novelty(spark, sf):
    k = F.col("k")
    r = records(spark, sf).select(F.floor(k / 5).alias("query_id"), "k", F.when(k % 7 != 0, (k % 23) / 4 - 3).alias("rerank_logit"), F.when(k % 5 != 0, (k % 101) / 101).alias("semantic"), ((k % 53) / 53).alias("centroid"), F.when(k % 3 == 0, (k % 11) / 11).alias("support"), (k % 50 < 45).alias("reranked"))
    f = ranking.novelty_features(r, "query_id", "k")
    model = ranking.NoveltyModel([0.9, 1.4, 0.7, 0.3], 0.2, [-1.0, 0.5, 0.5, 0.4], [2.0, 0.2, 0.3, 0.25], 0.5)
    return ranking.novelty(f, model).select("query_id", F.round("known_probability", 9).alias("known_probability"), "verdict")


@query("clarifications", f"""
WITH r AS (SELECT incident_id, CASE WHEN k % 4 <> 0 THEN (k % 10) / 10 END AS conf, k % 3 = 0 AS vague, k % 2 AS asked, k % 5 = 0 AS ending, CASE WHEN k % 2 = 0 THEN 'Database' ELSE 'Unknown' END AS component,
                  CASE WHEN k % 7 = 0 THEN 'team' ELSE 'Unknown' END AS impact_scope, CASE WHEN k % 11 = 0 THEN 'data load' ELSE 'Unknown' END AS trigger, 'Unknown' AS environment, 0.5e0 AS s1, 0.5e0 - (k % 20) / 100 AS s2 FROM {RECORDS}),
q AS (SELECT *, asked >= 1 AS done, (conf IS NULL OR conf < 0.45) AND vague AND NOT ending AS low, NOT ending AND s1 > 0 AND s2 > 0 AND s1 - s2 <= 0.1 AS close FROM r),
f AS (SELECT *, CASE WHEN component = 'Unknown' THEN 'component' WHEN impact_scope = 'Unknown' THEN 'impact_scope' WHEN trigger = 'Unknown' THEN 'trigger' WHEN environment = 'Unknown' THEN 'environment' END AS v,
             CASE WHEN component = 'Unknown' THEN 'component' END AS d,
             CASE WHEN trigger = 'Unknown' THEN 'trigger' WHEN impact_scope = 'Unknown' THEN 'impact_scope' WHEN environment = 'Unknown' THEN 'environment' WHEN component = 'Unknown' THEN 'component' END AS e FROM q)
SELECT incident_id, CASE WHEN done THEN NULL WHEN low AND v IS NOT NULL THEN v WHEN close AND d IS NOT NULL THEN d WHEN ending THEN e END AS field,
       CASE WHEN done THEN NULL WHEN low AND v IS NOT NULL THEN 'low_confidence_vague' WHEN close AND d IS NOT NULL THEN 'ambiguous_families' WHEN ending AND e IS NOT NULL THEN 'pre_escalation' END AS reason FROM f""")
def clarifications(spark, sf):
    k, lit = F.col("k"), F.lit
    known = {"component": F.when(k % 2 == 0, "Database").otherwise("Unknown"), "impact_scope": F.when(k % 7 == 0, "team").otherwise("Unknown"), "trigger": F.when(k % 11 == 0, "data load").otherwise("Unknown"), "environment": lit("Unknown")}
    differ = {"component": lit(True), "trigger": lit(False), "impact_scope": lit(False), "environment": lit(False)}
    field, reason = ranking.clarify(F.when(k % 4 != 0, (k % 10) / 10), k % 3 == 0, lit(0.5), 0.5 - (k % 20) / 100, differ, known, k % 2, k % 5 == 0)
    return records(spark, sf).select("incident_id", field.alias("field"), reason.alias("reason"))


@query("strategy_class", f"SELECT strategy, arg_min(closure_class, (-n, first)) AS cls FROM (SELECT strategy, closure_class, count(*) AS n, min(k) AS first FROM {RECORDS} WHERE closure_class IS NOT NULL GROUP BY ALL) GROUP BY strategy")
def strategy_class(spark, sf):
    return ranking.dominant_class(records(spark, sf), "strategy", "closure_class", "k")


@query("classification", f"""
SELECT incident_id, CASE WHEN impact <> 'Not Set' THEN impact ELSE predicted END AS value, CASE WHEN impact <> 'Not Set' THEN 'reported' WHEN predicted IS NOT NULL THEN 'predicted' ELSE 'unknown' END AS source
FROM (SELECT incident_id, impact, CASE WHEN k % 3 = 0 THEN '3' END AS predicted FROM {RECORDS})""")
def classification(spark, sf):
    c = ranking.classification(F.nullif(F.col("impact"), F.lit("Not Set")), F.when(F.col("k") % 3 == 0, "3"))
    return records(spark, sf).select("incident_id", c.alias("c")).select("incident_id", "c.*")


@query("query_grades", f"""
SELECT incident_id, round(m, 9) AS score, CASE WHEN k % 6 = 0 OR m IS NULL OR m < 0.4 THEN 'poor' WHEN m >= 0.7 THEN 'good' ELSE 'fair' END AS grade
FROM (SELECT incident_id, k, list_avg(list_filter([CASE WHEN k % 2 = 0 THEN (k % 10) / 10 END, CASE WHEN k % 3 = 0 THEN (k % 7) / 7 END, CASE WHEN k % 5 <> 1 THEN (k % 13) / 13 END], lambda x: x IS NOT NULL)) AS m FROM {RECORDS})""")
def query_grades(spark, sf):
    k = F.col("k")
    s, g = ranking.query_grade([F.when(k % 2 == 0, (k % 10) / 10), F.when(k % 3 == 0, (k % 7) / 7), F.when(k % 5 != 1, (k % 13) / 13)], k % 6 == 0)
    return records(spark, sf).select("incident_id", F.round(s, 9).alias("score"), g.alias("grade"))


@query("ranked_resolutions", f"""
WITH r AS (SELECT k // 8 AS query_id, strategy, incident_id, k, coalesce(CASE WHEN k % 9 <> 0 THEN (k % 17) / 17 END, 0.5) AS c, coalesce(CASE WHEN k % 9 <> 0 THEN (k % 17) / 17 END, 0) AS c0, (k % 10 + 1) / 11 AS w,
                  CASE WHEN resolution_notes_source = 'original' THEN 1e0 ELSE 0.8e0 END AS f, coalesce(resolution_notes, '') AS note FROM {RECORDS} WHERE k % 6 <> 5),
g AS (SELECT query_id, strategy, sum(c * w) AS mass, max(c) AS rel, avg(f) AS pf, count(*) AS n, arg_min(note, (-(c0 * w), incident_id)) AS step FROM r GROUP BY query_id, strategy),
s AS (SELECT *, regexp_matches(step, '(?i){lexicon.DESTRUCTIVE.replace("'", "''")}') AS bad FROM g)
SELECT query_id, strategy, round(mass, 9) AS mass, round(rel * mass / sum(mass) OVER (PARTITION BY query_id) * pf, 9) AS confidence, step, NOT bad OR n >= 2 AS allowed,
       row_number() OVER (PARTITION BY query_id ORDER BY NOT (NOT bad OR n >= 2), round(mass, 9) DESC, strategy) AS rank FROM s""")
def ranked_resolutions(spark, sf):
    k = F.col("k")
    e = records(spark, sf).select(
        F.floor(k / 8).alias("query_id"), "strategy", "incident_id", F.when(k % 9 != 0, (k % 17) / 17).alias("confidence"), ((k % 10 + 1) / 11).alias("influence"), F.when(k % 6 != 5, 0.9).otherwise(0.1).alias("detail"),
        F.col("resolution_notes_source").alias("provenance"), F.coalesce("resolution_notes", F.lit("")).alias("note"),
    )
    return ranking.rank_resolutions(e, "query_id").select("query_id", "strategy", F.round("mass", 9).alias("mass"), F.round("confidence", 9).alias("confidence"), "step", "allowed", "rank")


_RESET = "Reset password, account unlocked."


@query("evolution_batch", f"""
WITH r AS (SELECT k, incident_id, nullif(resolution_notes, '') AS notes, resolution_hours AS hours FROM {RECORDS}),
m AS (SELECT *, notes IS NULL AND k % 3 = 0 AS mended FROM r)
SELECT incident_id, CASE WHEN (notes IS NOT NULL OR mended) AND hours IS NOT NULL THEN 'added' ELSE 'failed' END AS status,
CASE WHEN notes IS NULL AND NOT mended THEN 'no resolution notes' WHEN hours IS NULL THEN 'not resolved' END AS reason,
CASE WHEN mended THEN '{_RESET}' ELSE notes END AS notes, CASE WHEN notes IS NULL AND mended AND hours IS NOT NULL THEN 1 WHEN k % 2 = 0 AND (notes IS NOT NULL AND hours IS NOT NULL) THEN 0 ELSE 1 END::BIGINT AS batch FROM m""")
def evolution_batch(spark, sf):
    """Two appends to a log, each taken in by a run of its own: records with even numbers; then the others, mended notes of a third, and a tenth once more with other notes, which is passed over if it was added."""
    path = groups.work_path(spark, "evolution")
    r = records(spark, sf).select("k", "incident_id", F.nullif("resolution_notes", F.lit("")).alias("notes"), F.col("resolution_hours").alias("hours"))
    even, lost = F.col("k") % 2 == 0, F.col("notes").isNull() & (F.col("k") % 3 == 0)
    first, rest = r.filter(even).withColumn("seq", F.lit(1)), r.filter(~even).withColumn("seq", F.lit(1))
    mended = r.filter(lost).withColumns({"notes": F.lit(_RESET), "seq": F.lit(2)})
    repeated = r.filter(even & (F.col("k") % 10 == 0) & F.col("notes").isNotNull() & F.col("hours").isNotNull()).withColumns({"notes": F.lit("Something else."), "seq": F.lit(3)})
    checks = {"no resolution notes": F.length("notes") > 0, "not resolved": F.col("hours") >= 0}
    run = evolution.Evolution(spark, f"{path}/kb", first.schema, "incident_id", "seq", checks)
    for part in (first, rest.unionByName(mended).unionByName(repeated)):
        part.write.mode("append").parquet(f"{path}/log")
        run.run(f"{path}/log")
    both = run.added().withColumns({"status": F.lit("added"), "reason": F.lit(None).cast("string")}).unionByName(run.failures().withColumn("status", F.lit("failed")), allowMissingColumns=True)
    return both.select("incident_id", "status", "reason", "notes", F.col("batch").cast("long").alias("batch"))
