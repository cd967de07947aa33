"""Rule, workflow, chain and scoring queries; event logs stand in for sessions and records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vigil.functions import clean, rules
from vigil.functions.math import sigmoid
from vigil.functions.rules import Rule
from vigil.operators import chains, ranking, workflow
from vigil.plans.catalog import query
from vigil.session import table

TONE = [Rule("pathetic|worthless|disgusting", "contempt"), Rule("idiot|moron|loser", "insult"), Rule("licensed under|all rights reserved", "licence")]
LEXICON = {"insult": ["idiot", "moron", "loser"], "contempt": ["pathetic", "worthless"], "licence": ["license"]}


def _case(rs: list[Rule], default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(t, '(?i){r.pattern}') THEN '{r.label}'" for r in rs) + f" ELSE {default} END"


_T = "(SELECT doc_id, coalesce(text, '') AS t FROM documents)"


@query("rule_first_match", f"SELECT doc_id, {_case(TONE, chr(39) + 'Unknown' + chr(39))} AS label FROM {_T}")
def rule_first_match(spark, sf):
    return table(spark, sf, "documents").select("doc_id", rules.first_match(F.coalesce("text", F.lit("")), TONE).alias("label"))


@query("rule_all_matches", "SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, '(?i){r.pattern}') THEN '{r.label}' END" for r in TONE) + f"], lambda x: x IS NOT NULL) AS labels FROM {_T}")
def rule_all_matches(spark, sf):
    return table(spark, sf, "documents").select("doc_id", rules.all_matches(F.coalesce("text", F.lit("")), TONE).alias("labels"))


_COUNT = {k: " + ".join(f"contains(' ' || lower(t) || ' ', '{w}')::INT" for w in v) for k, v in LEXICON.items()}
_BEST = f"greatest({', '.join(f'({c})' for c in _COUNT.values())})"


@query("keyword_category", f"SELECT doc_id, CASE WHEN {_BEST} = 0 THEN NULL " + " ".join(f"WHEN ({c}) = {_BEST} THEN '{k}'" for k, c in _COUNT.items()) + f" END AS category FROM {_T}")
def keyword_category(spark, sf):
    return table(spark, sf, "documents").select("doc_id", rules.keyword_category(F.coalesce("text", F.lit("")), LEXICON).alias("category"))


@query("fingerprint", f"SELECT doc_id, {_case(TONE, 'lang')} AS value, CASE WHEN {_case(TONE, 'NULL')} IS NOT NULL THEN 'derived' WHEN lang IS NOT NULL THEN 'derived' ELSE 'missing' END AS provenance FROM (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents)")
def fingerprint(spark, sf):
    fp = rules.fingerprint(F.coalesce("text", F.lit("")), {"tone": TONE}, {"tone": F.col("lang")})
    return table(spark, sf, "documents").select("doc_id", fp.alias("f")).select("doc_id", "f.tone.value", "f.tone.provenance")


_ANSWER = "CASE WHEN value < 20 THEN 'WORKED' WHEN value < 60 THEN 'FAILED' ELSE 'UNKNOWN' END"


def _sessions(spark, sf):
    answer = F.when(F.col("value") < 20, "WORKED").when(F.col("value") < 60, "FAILED").otherwise("UNKNOWN")
    kind = F.when(F.col("event_id") % 5 == 4, "clarified").otherwise("answer")
    return table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("event_type").alias("strategy"), answer.alias("answer"), (F.col("event_id") % 2 == 0).alias("informative"))


# The fold in SQL, event by event.
_FOLD = f"""
WITH RECURSIVE e AS (
  SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE WHEN event_id % 5 = 4 THEN 'clarified' ELSE 'answer' END AS kind, event_type AS strategy, {_ANSWER} AS answer, event_id % 2 = 0 AS informative FROM events),
s AS (
  SELECT DISTINCT session_id, 0::BIGINT AS n, 'active' AS status, 0 AS round, false AS bonus, []::VARCHAR[] AS excluded, []::VARCHAR[] AS skip, NULL::VARCHAR AS last FROM e
  UNION ALL
  SELECT session_id, n,
         CASE WHEN answered AND answer = 'WORKED' THEN 'resolved' WHEN answered AND (next >= 3 OR bonus) THEN CASE WHEN bonus THEN 'escalated' ELSE 'awaiting_clarification' END
              WHEN asked THEN CASE WHEN informative THEN 'active' ELSE 'escalated' END ELSE status END,
         next, bonus OR (asked AND informative), CASE WHEN answered AND answer = 'FAILED' AND NOT list_contains(excluded, strategy) THEN list_append(excluded, strategy) ELSE excluded END,
         CASE WHEN answered AND answer = 'FAILED' THEN [] WHEN answered AND answer = 'UNKNOWN' THEN [strategy] ELSE skip END, CASE WHEN answered THEN strategy ELSE last END
  FROM (SELECT s.session_id, e.n, s.status, s.bonus, s.excluded, s.skip, s.last, e.answer, e.strategy, e.informative, s.status = 'active' AND e.kind = 'answer' AS answered,
               s.status = 'awaiting_clarification' AND e.kind = 'clarified' AS asked, s.round + (s.status = 'active' AND e.kind = 'answer')::INT AS next
        FROM s JOIN e ON e.session_id = s.session_id AND e.n = s.n + 1))
SELECT session_id, status AS state, round AS attempts, list_sort(excluded) AS excluded, skip AS skip_once, last AS last_strategy, bonus AS bonus_round
FROM s QUALIFY n = max(n) OVER (PARTITION BY session_id)"""


@query("session_state", _FOLD)
def session_state(spark, sf):
    return workflow.sessions(_sessions(spark, sf))


@query("session_attempts", "SELECT user_id AS session_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt FROM events")
def session_attempts(spark, sf):
    return workflow.attempts(_sessions(spark, sf)).select("session_id", "seq", "attempt")


@query("influence_penalties", "SELECT vec_id AS incident_id, round(greatest(0.0, 1.0 - 0.15 * coalesce(n, 0)), 9) AS score FROM embeddings LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels WHERE quality = 0 GROUP BY doc_id) ON doc_id = vec_id")
def influence_penalties(spark, sf):
    scores = table(spark, sf, "embeddings").select(F.col("vec_id").alias("incident_id"), F.lit(1.0).alias("score"))
    feedback = table(spark, sf, "labels").select(F.col("doc_id").alias("feedback_id"), F.col("doc_id").alias("incident_id"), (F.col("quality") != 0).alias("helpful"))
    return workflow.penalties(scores, feedback).withColumn("score", F.round("score", 9))


@query("review_gate", "SELECT doc_id, round(score, 9) AS score, CASE WHEN score >= 0.55 THEN 'indexed' ELSE 'pending_review' END AS status FROM (SELECT doc_id, least(1.0, greatest(0.0, 0.6 + CASE WHEN quality = 1 THEN 0.05 ELSE -0.15 END)) AS score FROM labels)")
def review_gate(spark, sf):
    c = table(spark, sf, "labels").select("doc_id", F.lit(0.6).alias("score"), (F.col("quality") == 1).alias("feedback"))
    return workflow.gate(c).select("doc_id", F.round("score", 9).alias("score"), "status")


@query("family_vote", "WITH g AS (SELECT label AS family, sum(0.5 * greatest(0.05, (vec_id % 10) / 10.0)) AS weight, 0.5 AS max_relevance FROM embeddings GROUP BY label) SELECT family, round(weight / sum(weight) OVER (), 9) AS vote, round(weight / sum(weight) OVER () * 0.5, 9) AS match_strength FROM g")
def family_vote(spark, sf):
    r = table(spark, sf, "embeddings").select(F.col("label").alias("family"), F.lit(None).cast("double").alias("confidence"), ((F.col("vec_id") % 10) / 10.0).alias("influence"))
    return ranking.family_match(r).select("family", F.round("vote", 9).alias("vote"), F.round("match_strength", 9).alias("match_strength"))


@query("shared_values", "WITH d AS (SELECT DISTINCT event_type AS f, user_id AS v FROM events) SELECT a.f AS a, b.f AS b, count(*) AS shared FROM d a JOIN d b ON a.v = b.v AND a.f < b.f GROUP BY a.f, b.f HAVING count(*) >= 5")
def shared_values(spark, sf):
    return chains.shared_values(table(spark, sf, "events"), "event_type", "user_id", 5)


@query("platt_scores", "SELECT event_id, round(1 / (1 + exp(-(0.05 * value - 2))), 9) AS p FROM events")
def platt_scores(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(sigmoid(0.05 * F.col("value") - 2), 9).alias("p"))


@query("outcome_factor", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 0.5 WHEN l_quantity >= 5 THEN 0.75 ELSE 1.0 END::DOUBLE AS factor FROM lineitem")
def outcome_factor(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", clean.outcome_factor(F.col("l_returnflag") == "R", F.col("l_quantity")).alias("factor"))


@query("top_decile_lift", "WITH r AS (SELECT toxic, row_number() OVER (ORDER BY doc_id % 97 DESC, doc_id) AS pos, count(*) OVER () AS n FROM labels) SELECT round(avg(toxic) FILTER (pos <= greatest(1, n // 10)) / avg(toxic), 9) AS lift FROM r")
def top_decile_lift(spark, sf):
    """The top tenth is cut at its last row's sort key, so rows aren't gathered to be numbered."""
    rows = table(spark, sf, "labels").select("toxic", (F.col("doc_id") % 97).alias("s"), "doc_id")
    per = rows.groupBy("s").agg(F.count("*").alias("k"))
    ahead = per.select("s", (F.sum("k").over(Window.orderBy(F.desc("s"))) - F.col("k")).alias("ahead"))  # 97 rows
    n = rows.agg(F.greatest(F.lit(1), F.floor(F.count("*") / 10)).alias("cut"), F.avg("toxic").alias("base"))
    pos = F.col("ahead") + F.row_number().over(Window.partitionBy("s").orderBy("doc_id"))
    return rows.join(F.broadcast(ahead), "s").join(F.broadcast(n)).withColumn("pos", pos).filter("pos <= cut").agg(F.round(F.avg("toxic") / F.first("base"), 9).alias("lift"))


@query("context_precision", "WITH r AS (SELECT toxic AS grp, quality AS rel, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) AS pos FROM labels), c AS (SELECT *, sum(rel) OVER (PARTITION BY grp ORDER BY pos) AS hits FROM r) SELECT grp, round(sum(rel * hits / pos) / greatest(sum(rel), 1), 9) AS precision FROM c GROUP BY grp")
def context_precision(spark, sf):
    w = Window.partitionBy("toxic").orderBy("doc_id")
    r = table(spark, sf, "labels").withColumn("pos", F.row_number().over(w)).withColumn("hits", F.sum("quality").over(w))
    return r.groupBy(F.col("toxic").alias("grp")).agg(F.round(F.sum(F.col("quality") * F.col("hits") / F.col("pos")) / F.greatest(F.sum("quality"), F.lit(1)), 9).alias("precision"))
