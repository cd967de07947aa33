"""Rules, chains and workflow folds on hand-made inputs."""

import pytest
from pyspark.sql import functions as F

from vigil.functions import rules
from vigil.functions.rules import Rule
from vigil.operators import chains, workflow

SYMPTOMS = [Rule(r"cannot log in|login fail\w*", "login failure"), Rule(r"slow\w*", "slowness")]
SCOPE = [Rule(r"all users", "organization-wide")]


def test_rules(spark):
    df = spark.createDataFrame([("Users Cannot log in, all slow; all users hit",), ("fine",), (None,)], "x string")
    x = F.col("x")
    a, b, c = df.select(rules.first_match(x, SYMPTOMS).alias("f"), rules.all_matches(x, SYMPTOMS).alias("a"), rules.evidence(x, SYMPTOMS).alias("e"), rules.fingerprint(x, {"symptom": SYMPTOMS, "scope": SCOPE}).alias("p")).collect()
    assert (a.f, a.a, a.e) == ("login failure", ["login failure", "slowness"], "Cannot log in")
    assert a.p.scope.value == "organization-wide" and b.p.symptom.value == "Unknown" and b.p.symptom.provenance == "missing"
    assert (b.f, b.a, c.f) == ("Unknown", [], "Unknown")
    cats = df.select(rules.keyword_category(x, {"Access": ["log in", "users"], "Speed": ["slow"]}).alias("k")).collect()
    assert [r.k for r in cats] == ["Access", None, None]
    s = df.select(rules.safety(F.lit("drop the table"), r"\bdrop\b", "restart", F.lit(1)).alias("s")).first().s
    assert (s.kind, s.allowed) == ("destructive", False)


def test_workflow(spark):
    told = {"s1": "A FAILED, B WORKED, C FAILED", "s2": "A FAILED, B UNKNOWN, C FAILED", "s3": "A UNKNOWN", "s4": "A FAILED, A FAILED, B FAILED, ? yes, C FAILED, D WORKED", "s5": "A FAILED, B FAILED, C FAILED, ? no, D WORKED", "s6": "A FAILED, B FAILED, C FAILED, D WORKED", "s7": "A FAILED, B FAILED, C FAILED, ? yes, C WORKED"}
    events = [(s, i, "clarified" if x[0] == "?" else "answer", None if x[0] == "?" else x[0], None if x[0] == "?" else x[2:], x == "? yes") for s, t in told.items() for i, x in enumerate(t.split(", "))]
    log = spark.createDataFrame(events, "session_id string, seq int, kind string, strategy string, answer string, informative boolean")
    got = {r.session_id: (r.state, r.attempts, r.excluded, r.skip_once) for r in workflow.sessions(log).collect()}
    assert got["s1"] == ("resolved", 2, ["A"], []) and got["s2"] == ("awaiting_clarification", 3, ["A", "C"], []) and got["s3"] == ("active", 1, [], ["A"])
    assert got["s4"][:3] == ("escalated", 4, ["A", "B", "C"]) and got["s5"][0] == "escalated" and got["s6"][:2] == ("awaiting_clarification", 3) and got["s7"][0] == "resolved"
    log = log.filter("kind = 'answer'")
    assert workflow.bad_answers(log).count() == 0 and workflow.attempts(log).agg(F.max("attempt")).first()[0] == 5
    scores = spark.createDataFrame([("i", 0.72), ("j", 0.1)], "incident_id string, score double")
    feedback = spark.createDataFrame([(1, "i", False), (1, "i", False), (2, "i", False), (3, "j", False), (4, "j", True)], "feedback_id int, incident_id string, helpful boolean")
    assert {r.incident_id: round(r.score, 4) for r in workflow.penalties(scores, feedback).collect()} == {"i": 0.42, "j": 0.0}
    opened = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "escalation_id string, created_seq int")
    handed = spark.createDataFrame([("b", "L2", 1), ("b", "L3", 2)], "escalation_id string, to_tier string, seq int")
    resolved = spark.createDataFrame([("c", 5)], "escalation_id string, seq int")
    assert [(r.escalation_id, r.status) for r in workflow.escalations(opened, handed, resolved).collect()] == [("a", "open"), ("b", "handed_off"), ("c", "resolved")]
    c = spark.createDataFrame([(0.56, False), (0.52, True), (0.6, None)], "score double, feedback boolean")
    assert [r.status for r in workflow.gate(c).collect()] == ["pending_review", "indexed", "indexed"]


def test_chains(spark):
    df = spark.createDataFrame([("f", "patch", "disk", True), ("f", None, "disk", True), ("f", "patch", "cpu", False)], "family string, change string, cause string, timed boolean")
    chain = chains.build_chain({"change": (F.col("change"), F.lit("observed")), "root_cause": (F.col("cause"), F.lit("inferred"))}, F.col("timed"))
    rows = df.withColumn("c", chain).collect()
    assert [len(r.c.links) for r in rows] == [2, 1, 0] and len(rows[2].c.facts) == 2 and rows[0].c.strength == pytest.approx(1.5 / 6)
    fam = {r.stage: (r.statement, r.share, round(r.coverage, 3)) for r in chains.family_chain(df.select("family", chain.alias("c")).select("family", "c.links")).collect()}
    assert fam == {"change": ("patch", 1.0, 0.333), "root_cause": ("disk", 1.0, 0.667)}
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("d", "e", "x")], "src_id string, dst_id string, rel_type string")
    assert chains.neighbourhood(edges, "b").count() == 2


def test_needed_literals_never_hide_a_match():
    """A text that a rule matches, in any case, contains one of the literals that are looked for first."""
    import re

    from vigil.functions import lexicon, rules
    from vigil.plans.records import DESCRIPTIONS, NOTES

    assert rules.needed(r"out of (?:memory|heap)|\boom\b") == ("oom", "out of ")
    assert rules.needed(r"\d+%|x") == ("%", "x") and rules.needed(r"\d+") == () and rules.needed(r"(?:ab)?cde+f?") == ("cd",) and rules.needed(r"(?:ab)+") == ("ab",)
    texts = [t for t in (*DESCRIPTIONS, *NOTES) if t] + ["ÎLE SQL DB", "the JVM heap is exhausted", "DISK 99% full"]
    tables = (lexicon.COMPONENTS, lexicon.TRIGGERS, lexicon.ENVIRONMENTS, lexicon.DEPENDENCIES, lexicon.SCOPES, lexicon.SYMPTOMS, lexicon.ROOT_CAUSES)
    seen = 0
    for rule in (r for t in tables for r in t):
        for text in (x for t in texts for x in (t, t.upper())):
            if re.search(rule.pattern, text, re.IGNORECASE | re.ASCII):
                seen += 1
                assert any(w in text.lower() for w in rules.needed(rule.pattern) or [""])
    assert seen > 50
