"""Queries on incident records: fingerprints, query understanding, quality, safety and clauses of notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions import clean, lexicon, rules, text
from vigil.operators import fingerprints, groups, quality
from vigil.plans.catalog import query
from vigil.plans.records import RECORDS, case, content_sql, mapped, q, records
from vigil.session import table

_TEXT = {"component": lexicon.COMPONENTS, "trigger": lexicon.TRIGGERS, "environment": lexicon.ENVIRONMENTS, "dependency": lexicon.DEPENDENCIES, "impact_scope": lexicon.SCOPES}


def _any(c: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({c}, {q('(?i)' + pattern)}), false)"


def _labels(c: str, table: list) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {_any(c, r.pattern)} THEN {q(r.label)} END" for r in table) + "], lambda x: x IS NOT NULL)"


def _service(c: str) -> str:
    stop = "[" + ", ".join(map(q, lexicon.SERVICE_STOP)) + "]"
    words = "regexp_split_to_array(lower(p), '\\s+')"
    kept = f"list_filter({words}, lambda w: NOT list_contains({stop}, w))"
    whole = f"array_to_string(CASE WHEN list_contains({kept}, {words}[-1]) THEN {kept} ELSE list_append({kept}, {words}[-1]) END, ' ')"
    parts = f"list_transform(regexp_extract_all({c}, {q('(?i)' + lexicon.SERVICE)}, 1), lambda p: {{'n': len({kept}), 's': {whole}}})"
    start = "{'n': 0, 's': NULL::VARCHAR}"
    # A phrase beats the best one if it keeps more words than that one has, its last word included.
    return (
        f"list_reduce(list_prepend({start}, {parts}), lambda a, x: CASE WHEN x.n > 0 AND (a.s IS NULL OR x.n > len(string_split(a.s, ' '))) THEN x ELSE a END).s"
    )


_PAIRS = {f: (case(t, "said"), case(t, "said", "phrase")) for f, t in _TEXT.items()}
_ORIGIN = "CASE WHEN {0}_source = 'synthetic' THEN 'synthetic' ELSE 'derived' END"
_CHANGE = "CASE WHEN related_change NOT IN ('None', 'nan', 'Not Available', '') THEN related_change END"


def _impact_sql(urgency: str | None) -> str:
    effect = f"coalesce({mapped('failure_type', lexicon.EFFECT)}, 'service impact')"
    said = f"trim(upper({effect}[1]) || lower({effect}[2:]) || ' ' || coalesce({mapped('impact_scope', lexicon.SCOPE_PHRASE)}, ''))"
    tail = f" || CASE WHEN {urgency} IN ('1', '2') THEN ' — urgent (Urgency ' || {urgency} || ')' ELSE '' END" if urgency else ""
    return f"CASE WHEN failure_type = 'Unknown' AND impact_scope = 'Unknown' THEN 'Unknown' ELSE {said}{tail} END"


_FP = f"""
WITH r AS (SELECT *, coalesce(title, '') || '. ' || coalesce(description, '') AS said, coalesce(resolution_notes, '') AS noted, {_ORIGIN.format('description')} AS tp, {_ORIGIN.format('resolution_notes')} AS np FROM {RECORDS}),
h AS (SELECT *, {", ".join(f"{v} AS t_{f}" for f, (v, _) in _PAIRS.items())}, {case(lexicon.SYMPTOMS, 'said')} AS t_symptom, {case(lexicon.SYMPTOMS, 'said', 'group')} AS t_failure, {_service('said')} AS t_service,
             {case(lexicon.ROOT_CAUSES, 'noted')} AS n_cause, {case(lexicon.ROOT_CAUSES, 'said')} AS t_cause, {case(lexicon.TRIGGERS, 'noted')} AS n_trigger, {case(lexicon.DEPENDENCIES, 'noted')} AS n_dependency,
             {mapped('ci_group', lexicon.GROUP_COMPONENT)} AS c_component, {mapped('closure_class', lexicon.CLASS_ROOT_CAUSE)} AS c_cause, {mapped('closure_class', lexicon.CLASS_FAILURE)} AS c_failure,
             {_CHANGE} AS change, nullif(impact_scope, 'Unknown') AS c_scope FROM r),
f AS (SELECT incident_id, urgency, tp, np, coalesce(t_component, c_component, 'Unknown') AS component, coalesce(t_service, 'Unknown') AS service, coalesce(t_symptom, 'Unknown') AS symptom,
             coalesce(t_failure, c_failure, 'Unknown') AS failure_type, coalesce(t_trigger, n_trigger, CASE WHEN change IS NOT NULL THEN 'change (related change record)' END, 'Unknown') AS trigger,
             coalesce(n_cause, t_cause, c_cause, 'Unknown') AS root_cause, coalesce(t_environment, 'Unknown') AS environment, coalesce(t_dependency, n_dependency, 'Unknown') AS dependency,
             coalesce(t_impact_scope, c_scope, 'Unknown') AS impact_scope,
             CASE WHEN n_cause IS NOT NULL THEN np WHEN t_cause IS NOT NULL THEN tp WHEN c_cause IS NOT NULL THEN 'derived' ELSE 'missing' END AS root_cause_provenance,
             CASE WHEN n_cause IS NOT NULL THEN {case(lexicon.ROOT_CAUSES, 'noted', 'phrase')} WHEN t_cause IS NOT NULL THEN {case(lexicon.ROOT_CAUSES, 'said', 'phrase')} WHEN c_cause IS NOT NULL THEN closure_code END AS root_cause_evidence,
             {_labels('said', lexicon.SYMPTOMS)} AS symptoms FROM h)
SELECT * EXCLUDE (urgency, tp, np), {_impact_sql('urgency')} AS business_impact FROM f"""


@query("record_fingerprint", _FP)
def record_fingerprint(spark, sf):
    out = fingerprints.of_records(records(spark, sf))
    values = [F.col(f"fingerprint.{f}.value").alias(f) for f in fingerprints.FIELDS]
    return out.select("incident_id", *values, F.col("fingerprint.root_cause.provenance").alias("root_cause_provenance"), F.col("fingerprint.root_cause.evidence").alias("root_cause_evidence"), "symptoms")


_QFP = f"""
WITH r AS (SELECT incident_id, coalesce(description, '') AS said, CASE WHEN k % 2 = 0 THEN 'Staging' END AS answer FROM {RECORDS}),
f AS (SELECT incident_id, {", ".join(f"coalesce({v}{', answer' if f == 'environment' else ''}, 'Unknown') AS {f}" for f, (v, _) in _PAIRS.items())}, coalesce({case(lexicon.SYMPTOMS, 'said')}, 'Unknown') AS symptom,
             coalesce({case(lexicon.SYMPTOMS, 'said', 'group')}, 'Unknown') AS failure_type, coalesce({case(lexicon.ROOT_CAUSES, 'said')}, 'Unknown') AS root_cause, coalesce({_service('said')}, 'Unknown') AS service FROM r)
SELECT *, {_impact_sql(None)} AS business_impact FROM f"""


@query("query_fingerprint", _QFP)
def query_fingerprint(spark, sf):
    answers = F.when(F.col("k") % 2 == 0, F.create_map(F.lit("environment"), F.lit("Staging")))
    rows = records(spark, sf).select("incident_id", F.col("description").alias("query"), answers.alias("answers"))
    out = fingerprints.of_queries(rows, hints="answers")
    return out.select("incident_id", *[F.col(f"fingerprint.{f}.value").alias(f) for f in fingerprints.FIELDS])


_STOP = ", ".join(map(q, text.STOPWORDS))
_TOKENS = f"list_filter(regexp_extract_all(lower(said), '[a-z0-9]+'), lambda w: length(w) > 1 AND NOT list_contains([{_STOP}], w))"
_CONCEPTS = "list_concat(" + ", ".join(f"CASE WHEN {_any('said', r.pattern)} THEN [{', '.join(map(q, r.concepts))}] ELSE [] END" for r in lexicon.SYMPTOMS) + ", CASE WHEN combined THEN [" + ", ".join(map(q, lexicon.COMBINATION_CONCEPTS)) + "] ELSE [] END)"
_ORDERED = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_UNDERSTAND = f"""
WITH r AS (SELECT incident_id, trim(coalesce(description, '')) AS said, CASE WHEN k % 3 = 0 THEN 'single user' END AS answer FROM {RECORDS}),
a AS (SELECT *, {case(lexicon.ENVIRONMENTS, 'said')} AS environment, coalesce(answer, {case(lexicon.SCOPES, 'said')}) AS impact_scope, {case(lexicon.TRIGGERS, 'said')} AS trigger, {case(lexicon.COMPONENTS, 'said')} AS component,
             {_labels('said', lexicon.SYMPTOMS)} AS labels, len({_TOKENS}) AS n_tokens FROM r),
b AS (SELECT *, (list_contains(labels, 'slow response') OR list_contains(labels, 'freeze / hang')) AND {_any('said', lexicon.COMBINATION_PATTERN)} AS combined FROM a),
c AS (SELECT *, {_CONCEPTS} AS every FROM b),
d AS (SELECT *, {_ORDERED.format('every')} AS concepts,
             round(least(1.0, (((environment IS NOT NULL)::INT + (impact_scope IS NOT NULL)::INT + (trigger IS NOT NULL)::INT + (component IS NOT NULL)::INT + (len(labels) > 0)::INT) / 5) + least(n_tokens, 20) / 40), 3) AS specificity FROM c)
SELECT incident_id, environment, impact_scope, trigger, component, n_tokens, specificity, n_tokens <= 9 OR specificity < 0.4 AS is_vague, concepts,
       concat_ws(' ', said, nullif(array_to_string(concepts, ' '), ''), trigger, component) AS expanded FROM d"""


@query("query_understanding", _UNDERSTAND)
def query_understanding(spark, sf):
    answers = F.when(F.col("k") % 3 == 0, F.create_map(F.lit("impact_scope"), F.lit("single user")))
    out = fingerprints.understand(records(spark, sf).select("incident_id", F.col("description").alias("query"), answers.alias("answers")), answers="answers")
    return out.select("incident_id", "hints.*", "n_tokens", "specificity", "is_vague", "concepts", "expanded")


_PLAIN = "trim(regexp_replace(regexp_replace(lower(note), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'))"
_WORDS = f"len(list_filter(string_split({_PLAIN}, ' '), lambda w: w <> ''))"
_GENERIC = "[" + ", ".join(q(quality._plain(g)) for g in lexicon.GENERIC_NOTES) + "]"
_DETAIL = f"""CASE WHEN note = '' THEN 0e0 WHEN list_contains({_GENERIC}, {_PLAIN}) THEN 0.05e0
  ELSE round(least(1e0, {_WORDS} / 15) * 0.4e0 + {_any('note', lexicon.ACTION)}::INT * 0.25e0 + {_any('note', lexicon.CAUSE)}::INT * 0.2e0 + {_any('note', lexicon.VERIFY)}::INT * 0.15e0, 4) END"""
_DETAIL_FLAGS = f"""CASE WHEN note = '' THEN ['empty_resolution'] WHEN list_contains({_GENERIC}, {_PLAIN}) THEN ['generic_resolution']
  ELSE list_filter([CASE WHEN {_WORDS} < 4 THEN 'too_short' END, CASE WHEN NOT {_any('note', lexicon.ACTION)} THEN 'no_concrete_action' END], lambda x: x IS NOT NULL) END"""
_CONFLICT = f"""coalesce(CASE WHEN closure_class = 'hardware_fix' THEN ({_any('note', lexicon.SOFTWARE_FIX)} OR {_any('note', lexicon.USER_FIX)}) AND NOT {_any('note', lexicon.HARDWARE_FIX)}
  WHEN closure_class = 'software_fix' THEN {_any('note', lexicon.HARDWARE_FIX)} AND NOT {_any('note', lexicon.SOFTWARE_FIX)}
  WHEN closure_class IN ('user_or_operator', 'no_fault_found') THEN ({_any('note', lexicon.HARDWARE_FIX)} OR {_any('note', lexicon.SOFTWARE_FIX)}) AND NOT {_any('note', lexicon.USER_FIX)} ELSE false END, false)"""
_COMPLETE = "(" + " + ".join(f"({c}_source <> 'missing')::INT" for c in quality.COMPLETENESS) + ") / 6"


def _score_sql(rows: str, odd: str) -> str:
    """rows: a relation of records; odd: SQL for inconsistent with similar records."""
    return f"""
    SELECT *, round(0.5e0 * detail + 0.15e0 * completeness + 0.2e0 * consistency + 0.15e0 * outcome + 1e-9, 4) AS quality_score,
           CASE WHEN 0.5e0 * detail + 0.15e0 * completeness + 0.2e0 * consistency + 0.15e0 * outcome >= 0.7 THEN 'high' WHEN 0.5e0 * detail + 0.15e0 * completeness + 0.2e0 * consistency + 0.15e0 * outcome >= 0.5 THEN 'medium' ELSE 'low' END AS quality_tier,
           list_concat(dflags, cflags, CASE WHEN outcome = 0.5 THEN ['reopened_after_fix'] WHEN outcome = 0.75 THEN ['high_reassignments'] ELSE [] END) AS quality_flags
    FROM (SELECT *, greatest(0e0, 1 - len(cflags) * 0.5e0) AS consistency
          FROM (SELECT *, {_DETAIL} AS detail, {_DETAIL_FLAGS} AS dflags, {_COMPLETE} AS completeness,
                       CASE WHEN reopened_source = 'missing' OR reopened IS NULL THEN 0.85 WHEN reopened THEN 0.5 WHEN reassignments >= 5 THEN 0.75 ELSE 1.0 END::DOUBLE AS outcome,
                       list_filter([CASE WHEN {_CONFLICT} THEN 'closure_note_conflict' END, CASE WHEN coalesce({odd}, false) THEN 'resolution_inconsistent_with_similar' END,
                                    CASE WHEN try_cast(priority AS DOUBLE) <> least(try_cast(impact AS DOUBLE), try_cast(urgency AS DOUBLE)) THEN 'priority_matrix_inconsistent' END], lambda x: x IS NOT NULL) AS cflags
                FROM (SELECT *, trim(coalesce(resolution_notes, '')) AS note FROM {rows})))"""


@query("quality_score", f"SELECT incident_id, detail, round(completeness, 6) AS completeness, consistency, outcome, quality_score, quality_tier, quality_flags FROM ({_score_sql(RECORDS, 'false')})")
def quality_score(spark, sf):
    out = quality.score(records(spark, sf))
    return out.select("incident_id", "detail", F.round("completeness", 6).alias("completeness"), "consistency", "outcome", "quality_score", "quality_tier", "quality_flags")


_DOT = "list_dot_product({}::DOUBLE[], {}::DOUBLE[])"
_NEAR = f"""
WITH v AS (SELECT r.*, e.embedding AS about, (SELECT o.embedding FROM embeddings o WHERE o.vec_id = (e.vec_id * 7 + 3) % (SELECT count(*) FROM embeddings)) AS fix
           FROM {RECORDS} r JOIN embeddings e ON e.vec_id = r.k),
g AS (SELECT *, min(incident_id) OVER (PARTITION BY {content_sql('title', 'description', 'resolution_notes')}) AS dup_group, trim(coalesce(resolution_notes, '')) AS note FROM v),
u AS (SELECT *, {_DETAIL} > 0.2 AS usable FROM g),
n AS (SELECT a.incident_id, {_DOT.format('a.fix', 'b.fix')} AS s, row_number() OVER (PARTITION BY a.incident_id ORDER BY {_DOT.format('a.about', 'b.about')} DESC, b.k) AS rank
      FROM u a JOIN u b ON b.usable AND a.dup_group <> b.dup_group),
best AS (SELECT u.* EXCLUDE (note), coalesce(round(m, 6), 1.0) AS best FROM u LEFT JOIN (SELECT incident_id, max(s) AS m FROM n WHERE rank <= 10 GROUP BY incident_id) USING (incident_id)),
fence AS (SELECT round(quantile_cont(best, 0.05), 6) AS fence FROM best WHERE usable)"""


@query("quality_assess", f"""{_NEAR}
SELECT incident_id, best, dup_group = incident_id AS canonical, quality_score,
       list_concat(quality_flags, CASE WHEN dup_group <> incident_id THEN ['exact_duplicate'] ELSE [] END) AS quality_flags,
       round(1e-9 + quality_score * CASE WHEN resolution_notes_source = 'original' THEN 1e0 ELSE 0.8e0 END, 4) AS influence_weight
FROM ({_score_sql('(SELECT best.*, fence FROM best, fence)', 'usable AND best < fence')})""")
def quality_assess(spark, sf):
    """Records that have a vector; the vector of another row stands for the note's."""
    e = table(spark, sf, "embeddings")
    n = e.count()
    about, fix = e.select(F.col("vec_id").alias("k"), F.col("embedding").alias("about")), e.select(F.col("vec_id").alias("j"), F.col("embedding").alias("fix"))
    rows = records(spark, sf).join(about, "k").withColumn("j", (F.col("k") * 7 + 3) % n).join(fix, "j", "left").drop("j")
    content = groups.content("title", "description", "resolution_notes")
    groups.checkpoints(spark)
    rows = rows.join(groups.duplicate_groups(rows, "incident_id", content), "incident_id").checkpoint()
    near = quality.consistency(rows, "k", "dup_group", "about", "fix", quality.detail(F.col("resolution_notes"))["score"] > quality.USABLE)
    near = rows.select("k", "incident_id", "resolution_notes").join(near, "k").withColumn("best", F.round("best", 6)).checkpoint()
    fence = quality.low_fence(near.filter(quality.detail(F.col("resolution_notes"))["score"] > quality.USABLE), "best").first()[0]
    out = quality.assess(rows.withColumn("near_root", F.col("incident_id")), near.select("incident_id", "best"), round(fence, 6))
    return out.select("incident_id", "best", "canonical", "quality_score", "quality_flags", "influence_weight")


@query("note_conflict", f"SELECT incident_id, {_CONFLICT} AS conflict FROM (SELECT *, coalesce(resolution_notes, '') AS note FROM {RECORDS})")
def note_conflict(spark, sf):
    return records(spark, sf).select("incident_id", quality.note_conflict(F.col("closure_class"), F.col("resolution_notes")).alias("conflict"))


_BAD, _ROUGH = _any("note", lexicon.DESTRUCTIVE), _any("note", lexicon.DISRUPTIVE)


@query("safety_review", f"""
SELECT incident_id, CASE WHEN {_BAD} THEN 'destructive' WHEN {_ROUGH} THEN 'disruptive' ELSE 'routine' END AS kind, n > 0 AND (NOT {_BAD} OR n >= 2) AS allowed, {_BAD} OR {_ROUGH} AS confirm,
       list_filter([CASE WHEN {_BAD} AND n < 2 THEN 'too few sources for a destructive action' END, CASE WHEN {_BAD} AND n >= 2 THEN 'confirm and back up before a destructive action' END,
                    CASE WHEN {_ROUGH} THEN 'agree on a window for a disruptive action' END, CASE WHEN n = 0 THEN 'no historical grounding' END], lambda x: x IS NOT NULL) AS notes
FROM (SELECT incident_id, k % 4 AS n, coalesce(resolution_notes, '') AS note FROM {RECORDS})""")
def safety_review(spark, sf):
    s = rules.safety(F.col("resolution_notes"), lexicon.DESTRUCTIVE, lexicon.DISRUPTIVE, F.col("k") % 4)
    return records(spark, sf).select("incident_id", s.alias("s")).select("incident_id", "s.*")


_ASKED = ("trigger", "impact_scope", "environment", "component", "symptom")
_SAID = ("Production", "no, nothing changed", "yes, after a deployment / release", "a whole team", "the whole company", "since the maintenance window", "laptop / workstation", " ", "what?", "oracle database", "after the firmware update", None)


@query("parse_answer", f"""
SELECT incident_id, CASE WHEN a <> '' THEN coalesce({mapped('lower(a)', lexicon.ANSWERS)}, CASE field {" ".join(f"WHEN '{f}' THEN {case(t, 'a')}" for f, t in lexicon.ANSWER_RULES.items())} END,
       CASE WHEN field = 'trigger' AND starts_with(lower(a), 'no') THEN 'no recent change' END) END AS value
FROM (SELECT incident_id, ([{", ".join(map(q, _ASKED))}])[(k % 5 + 1)::INT] AS field, trim(([{", ".join(map(q, _SAID))}])[(k % 12 + 1)::INT]) AS a FROM {RECORDS})""")
def parse_answer(spark, sf):
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (F.col("k") % n).cast("int"))
    return records(spark, sf).select("incident_id", rules.parse_answer(pick(_ASKED, 5), pick(_SAID, 12), lexicon.ANSWERS, lexicon.ANSWER_RULES).alias("value"))


# DuckDB's patterns have no look-around: a mark is set at each cut first.
_CUT = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(note, '([.;:])\\s+', '\\1\x01', 'g'), ',\\s+(?:and\\s+)?', '\x01', 'g'), '\\s+by\\s+', '\x01', 'g'), '\\s+(?:and|then)\\s+(\\w+(?:ed|ing)\\b)', '\x01\\1', 'g'), '\\.\\s*$', '\x01')"
_PARTS = f"list_filter(list_transform(string_split({_CUT}, '\x01'), lambda p: trim(p, ' .;,:')), lambda p: p <> '')"
_ACTS = f"list_filter({_PARTS}, lambda p: regexp_matches(p, {q('(?i)' + lexicon.ACTION)}))"
_SEEN = "list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(note, '([.;])\\s+', '\\1\x01', 'g'), ',\\s+(?:and\\s+)?', '\x01', 'g'), ';\\s*', '\x01', 'g'), '\x01'), lambda p: trim(p, ' .;,')), lambda p: p <> '')"
_LAST = f"list_filter({_SEEN}, lambda p: regexp_matches(p, {q('(?i)' + lexicon.OBSERVE)}))[-1]"


@query("note_clauses", f"""
SELECT incident_id, {_ACTS} AS actions, substr(coalesce(upper({_ACTS}[1][1]) || {_ACTS}[1][2:], list_filter(list_transform(string_split(replace(resolution_notes, ';', '.'), '.'), lambda s: trim(s)), lambda s: s <> '')[1], resolution_notes), 1, 160) AS summary,
       upper({_LAST}[1]) || {_LAST}[2:] AS observation FROM (SELECT *, coalesce(resolution_notes, '') AS note FROM {RECORDS})""")
def note_clauses(spark, sf):
    n = F.col("resolution_notes")
    return records(spark, sf).select("incident_id", text.action_clauses(n, lexicon.ACTION).alias("actions"), text.action_summary(n, lexicon.ACTION).alias("summary"), text.observation(n, lexicon.OBSERVE).alias("observation"))


_NAMES = ["payroll portal", "customer banking application", "banking application", "shared drive"]


@query("masked_entities", f"""
SELECT incident_id, regexp_replace(replace(coalesce(description, ''), 'SBA123456', 'the system'), '(?i)(?:customer banking application|banking application|payroll portal|shared drive)', 'the service', 'g') AS masked FROM {RECORDS}""")
def masked_entities(spark, sf):
    return records(spark, sf).select("incident_id", text.mask_entities(F.col("description"), F.lit("SBA123456"), _NAMES).alias("masked"))


_LAY = [(r"\bslow(er)?\b", "really slow"), (r"\bfreez\w*", "gets stuck"), (r"\btime[sd]? ?out\w*", "keeps loading and then fails"), (r"\bcannot\b", "can not")]
_MASKED = "regexp_replace(coalesce(description, ''), '\\b[A-Z]{2,4}\\d{5,6}\\b', 'the server', 'g')"
_FIRST = f"coalesce(list_filter(list_transform(string_split(regexp_replace({_MASKED}, '([.!?])\\s+', '\\1\x01', 'g'), '\x01'), lambda s: trim(s)), lambda s: s <> '')[1], '')"
_LAID = _FIRST
for _p, _w in _LAY:
    _LAID = f"regexp_replace({_LAID}, {q('(?i)' + _p)}, {q(_w)}, 'g')"


@query("paraphrased", f"""
SELECT incident_id, CASE k % 3 WHEN 0 THEN {_LAID} WHEN 1 THEN array_to_string(list_filter(regexp_split_to_array({_LAID}, '\\s+'), lambda w: w <> '')[1:10], ' ') ELSE {_FIRST} END AS query FROM {RECORDS}""")
def paraphrased(spark, sf):
    style = F.get(F.array(*map(F.lit, ("lay", "vague", "technical"))), (F.col("k") % 3).cast("int"))
    return records(spark, sf).select("incident_id", text.paraphrase(F.col("description"), _LAY, style).alias("query"))


_KEYWORDS = {"Storage": ["disk", "volume", "storage"], "Database": ["database", "quer", "sql"], "Network": ["vpn", "packet", "switch"], "Application": ["portal", "application", "dashboard"]}
_HITS = {c: "(" + " + ".join(f"contains(' ' || lower(said) || ' ', {q(w)})::INT" for w in ws) + ")" for c, ws in _KEYWORDS.items()}
_MOST = f"greatest({', '.join(_HITS.values())})"
_INFERRED = f"CASE WHEN {_MOST} = 0 THEN NULL " + " ".join(f"WHEN {h} = {_MOST} THEN {q(c)}" for c, h in _HITS.items()) + " END"
_OWN = "CASE category " + " ".join(f"WHEN {q(c)} THEN {h}" for c, h in _HITS.items()) + " ELSE 0 END"


@query("text_rich_category", f"""
SELECT incident_id, category AS category_original, conflict AS category_conflict, CASE WHEN conflict THEN inferred ELSE category END AS category, CASE WHEN conflict THEN 'derived' ELSE 'original' END AS category_source
FROM (SELECT *, coalesce(inferred <> category AND own = 0, false) AS conflict FROM (SELECT incident_id, category, {_INFERRED} AS inferred, {_OWN} AS own FROM (SELECT *, coalesce(title, '') || '. ' || coalesce(description, '') AS said FROM {RECORDS})))""")
def text_rich_category(spark, sf):
    from vigil.operators.unify import corrected_category

    out = corrected_category(records(spark, sf), _KEYWORDS)
    return out.select("incident_id", "category_original", "category_conflict", "category", "category_source")


@query("closure_classes", f"SELECT cls, count(*) AS n FROM (SELECT CASE WHEN closure_code IS NULL OR closure_code = '' THEN 'Unknown' ELSE coalesce({mapped('lower(closure_code)', clean.CLOSURE_CLASSES)}, 'unspecified') END AS cls FROM {RECORDS}) GROUP BY cls")
def closure_classes(spark, sf):
    return records(spark, sf).groupBy(clean.closure_class(F.col("closure_code")).alias("cls")).agg(F.count("*").alias("n"))


_REPLY = """CASE doc_id % 5 WHEN 0 THEN '```json' || chr(10) || o || chr(10) || '``` and more' WHEN 1 THEN coalesce(text, '') || ' Here it is: ' || o || ' (end).' WHEN 2 THEN 'A list: [' || doc_id || ', "x", null] of three'
  WHEN 3 THEN text ELSE 'Broken {"id": ' || doc_id || ', and a list [1, 2]' END"""


@query("json_in_prose", f"""
WITH d AS (SELECT doc_id, {_REPLY} AS reply FROM (SELECT *, '{{"id": ' || doc_id || ', "lang": "' || coalesce(lang, '?') || '", "deep": {{"a": [1, "}}"]}}}}' AS o FROM documents)),
s AS (SELECT doc_id, CASE WHEN starts_with(trim(reply), '```') THEN regexp_replace(regexp_replace(trim(reply), '^[^\\n]*\\n', ''), '```[^`]*$', '') ELSE trim(reply) END AS s FROM d),
p AS (SELECT doc_id, nullif(regexp_extract(s, '(?s)\\{{.*\\}}', 0), '') AS a, nullif(regexp_extract(s, '(?s)\\[.*\\]', 0), '') AS b FROM s)
SELECT doc_id, CASE WHEN json_valid(a) THEN a WHEN json_valid(b) THEN b END AS found FROM p""")
def json_in_prose(spark, sf):
    o = F.concat(F.lit('{"id": '), F.col("doc_id").cast("string"), F.lit(', "lang": "'), F.coalesce("lang", F.lit("?")), F.lit('", "deep": {"a": [1, "}"]}}'))
    n = F.col("doc_id") % 5
    fenced, said = F.concat(F.lit("```json\n"), o, F.lit("\n``` and more")), F.concat(F.coalesce("text", F.lit("")), F.lit(" Here it is: "), o, F.lit(" (end)."))
    listed = F.concat(F.lit("A list: ["), F.col("doc_id").cast("string"), F.lit(', "x", null] of three'))
    broken = F.concat(F.lit('Broken {"id": '), F.col("doc_id").cast("string"), F.lit(", and a list [1, 2]"))
    reply = F.when(n == 0, fenced).when(n == 1, said).when(n == 2, listed).when(n == 3, F.col("text")).otherwise(broken)
    return table(spark, sf, "documents").select("doc_id", text.json_in_prose(reply).alias("found"))
