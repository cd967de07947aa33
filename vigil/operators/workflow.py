"""Append-only workflow logs folded into current state: sessions, attempts, escalations, feedback and review gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PENALTY, BONUS, GATE, ROUNDS = 0.15, 0.05, 0.55, 3


def sessions(events: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """events: session_id, seq, kind (answer or clarified), strategy, answer (WORKED, FAILED or UNKNOWN), informative. The state of each session after its last event.

    An ordered fold over a session's events, whose number the rounds bound: WORKED resolves; FAILED excludes the strategy for good; UNKNOWN skips it for the
    next pick only. At the cap of rounds one clarifying question is asked; an informative answer gives one bonus round, any other escalates,
    and so does a failure in the bonus round. Events after the end don't count.
    """
    e = F.sort_array(F.collect_list(F.struct("seq", "kind", "strategy", "answer", F.coalesce("informative", F.lit(False)).alias("informative"))))
    none = F.array().cast("array<string>")
    start = F.struct(F.lit("active").alias("status"), F.lit(0).alias("round"), F.lit(False).alias("bonus"), none.alias("excluded"), none.alias("skip"), F.lit(None).cast("string").alias("last"))

    def step(s: Column, x: Column) -> Column:
        answered = (s["status"] == "active") & (x["kind"] == "answer")
        asked = (s["status"] == "awaiting_clarification") & (x["kind"] == "clarified")
        n = s["round"] + answered.cast("int")
        worked, failed = answered & (x["answer"] == "WORKED"), answered & (x["answer"] == "FAILED")
        spent = answered & ~worked & ((n >= rounds) | s["bonus"])
        status = F.when(worked, "resolved").when(spent & s["bonus"], "escalated").when(spent, "awaiting_clarification")
        status = status.when(asked & x["informative"], "active").when(asked, "escalated").otherwise(s["status"])
        excluded = F.when(failed, F.array_distinct(F.concat(s["excluded"], F.array(x["strategy"])))).otherwise(s["excluded"])
        skip = F.when(failed, none).when(answered & ~worked, F.array(x["strategy"])).otherwise(s["skip"])
        return F.struct(
            status.alias("status"), n.alias("round"), (s["bonus"] | (asked & x["informative"])).alias("bonus"), excluded.alias("excluded"), skip.alias("skip"),
            F.when(answered, x["strategy"]).otherwise(s["last"]).alias("last"),
        )

    folded = events.groupBy("session_id").agg(F.aggregate(e, start, step).alias("s"))
    return folded.select("session_id", F.col("s.status").alias("state"), F.col("s.round").alias("attempts"), F.sort_array("s.excluded").alias("excluded"), F.col("s.skip").alias("skip_once"), F.col("s.last").alias("last_strategy"), F.col("s.bonus").alias("bonus_round"))


def attempts(events: DataFrame) -> DataFrame:
    """Attempts numbered by time within their session."""
    return events.withColumn("attempt", F.row_number().over(Window.partitionBy("session_id").orderBy("seq")))


def bad_answers(events: DataFrame) -> DataFrame:
    """Answers outside the set, and second answers to one attempt; empty for a sound log."""
    again = Window.partitionBy("session_id", "strategy", "seq")
    return events.withColumn("n", F.count("*").over(again)).filter(~F.col("answer").isin("WORKED", "FAILED", "UNKNOWN") | (F.col("n") > 1)).drop("n")


def escalations(opened: DataFrame, handed: DataFrame, resolved: DataFrame) -> DataFrame:
    """Escalations with their last hand-off and resolution: open ones first, then handed off, then resolved; newest first."""
    last = handed.groupBy("escalation_id").agg(F.max_by("to_tier", "seq").alias("tier"))
    done = resolved.groupBy("escalation_id").agg(F.max("seq").alias("resolved_seq"))
    out = opened.join(last, "escalation_id", "left").join(done, "escalation_id", "left")
    status = F.when(F.col("resolved_seq").isNotNull(), "resolved").when(F.col("tier").isNotNull(), "handed_off").otherwise("open")
    rank = F.when(F.col("resolved_seq").isNotNull(), 2).when(F.col("tier").isNotNull(), 1).otherwise(0)
    return out.withColumn("status", status).withColumn("status_rank", rank).orderBy("status_rank", F.desc("created_seq"), "escalation_id")


def penalties(scores: DataFrame, feedback: DataFrame) -> DataFrame:
    """scores: incident_id, score; feedback: feedback_id, incident_id, helpful. Each complaint counts once and costs PENALTY; the floor is 0."""
    once = feedback.dropDuplicates(["feedback_id"]).filter(~F.col("helpful"))
    cost = once.groupBy("incident_id").agg((F.count("*") * PENALTY).alias("cost"))
    return scores.join(cost, "incident_id", "left").select("incident_id", F.greatest(F.lit(0.0), F.col("score") - F.coalesce("cost", F.lit(0.0))).alias("score"))


def gate(candidates: DataFrame) -> DataFrame:
    """candidates: score, feedback (true, false or null). The adjusted score, and whether it is indexed or reviewed."""
    adjusted = F.col("score") + F.when(F.col("feedback"), BONUS).when(~F.col("feedback"), -PENALTY).otherwise(0.0)
    clipped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), adjusted))
    return candidates.withColumn("score", clipped).withColumn("status", F.when(F.col("score") >= GATE, "indexed").otherwise("pending_review"))


TIERS = ("L1", "L2", "L3")


def next_tier(tier: Column, tiers: tuple[str, ...] = TIERS) -> Column:
    """The tier after this one; null for the last and for unknown ones."""
    names = F.array(*map(F.lit, tiers))
    at = F.array_position(names, tier)
    return F.when(at > 0, F.get(names, at.cast("int")))


def hand_offs(requests: DataFrame, opened: DataFrame, handed: DataFrame, resolved: DataFrame, tiers: tuple[str, ...] = TIERS) -> DataFrame:
    """requests: request_id, escalation_id, note. Each with its verdict: accepted with the next tier, or why not: unknown, resolved, handed off or last tier.

    Of several requests for one escalation the first counts; the others are already handed off.
    """
    first = F.row_number().over(Window.partitionBy("escalation_id").orderBy("request_id"))
    rows = requests.withColumn("__n", first).join(opened.select("escalation_id", "tier"), "escalation_id", "left")
    rows = rows.join(handed.select("escalation_id", F.lit(True).alias("__h")).distinct(), "escalation_id", "left").join(resolved.select("escalation_id", F.lit(True).alias("__r")).distinct(), "escalation_id", "left")
    to = next_tier(F.col("tier"), tiers)
    verdict = F.when(F.col("tier").isNull(), "unknown escalation").when(F.coalesce("__r", F.lit(False)), "already resolved")
    verdict = verdict.when(F.coalesce("__h", F.lit(False)) | ((F.col("__n") > 1) & to.isNotNull()), "already handed off").when(to.isNull(), "last tier").otherwise("accepted")
    rows = rows.withColumn("verdict", verdict)
    return rows.select("request_id", "escalation_id", "tier", "verdict", F.when(F.col("verdict") == "accepted", to).alias("to_tier"), F.when(F.col("verdict") == "accepted", F.concat(F.lit("handed off by "), "tier", F.lit(": "), F.trim("note"))).alias("reason"))


def candidates(incidents: DataFrame, attempts_log: DataFrame, feedback: DataFrame, postmortems: DataFrame) -> DataFrame:
    """Knowledge candidates of resolved incidents: attempts, latest feedback and latest postmortem folded into one record each.

    incidents: incident_id, title, description, resolution_notes, status; attempts_log: incident_id, seq, step, answer, note, strategy; feedback: incident_id,
    seq, helpful, cause_correct; postmortems: incident_id, seq, root_cause. The note is the last step that worked, with its note, else the
    incident's own; then the postmortem's root cause; then what was tried in vain.
    """
    tried = F.sort_array(F.collect_list(F.struct("seq", "step", "answer", "note", "strategy")))
    a = attempts_log.groupBy("incident_id").agg(tried.alias("a"))
    f = feedback.groupBy("incident_id").agg(F.max(F.struct("seq", "helpful", "cause_correct")).alias("f"))
    p = postmortems.groupBy("incident_id").agg(F.max(F.struct("seq", "root_cause")).alias("p"))
    rows = incidents.filter(F.col("status").isin("Resolved", "Closed")).join(a, "incident_id", "left").join(f, "incident_id", "left").join(p, "incident_id", "left")
    worked = F.try_element_at(F.filter("a", lambda x: x["answer"] == "WORKED"), F.lit(-1))
    failed = F.transform(F.filter("a", lambda x: x["answer"] == "FAILED"), lambda x: x["step"])
    fix = F.coalesce(F.concat_ws(". ", worked["step"], F.nullif(F.trim(worked["note"]), F.lit(""))), F.lit(""))
    note = F.when(worked["step"].isNotNull(), fix).otherwise(F.coalesce("resolution_notes", F.lit("")))
    note = F.concat(note, F.coalesce(F.concat(F.lit(" Root cause (postmortem): "), F.col("p.root_cause"), F.lit(".")), F.lit("")))
    note = F.concat(note, F.when(F.size(failed) > 0, F.concat(F.lit(" Previously tried without success: "), F.array_join(failed, "; "), F.lit("."))).otherwise(""))
    return rows.select(
        "incident_id", F.coalesce("title", F.substring("description", 1, 80)).alias("title"), note.alias("resolution_notes"), worked["strategy"].alias("worked_strategy"),
        F.coalesce(F.size("a"), F.lit(0)).alias("n_attempts"), F.col("f.helpful").alias("helpful"), F.col("f.cause_correct").alias("cause_correct"), F.col("p.root_cause").alias("root_cause"),
    )


def adjusted(score: Column, helpful: Column, cause_correct: Column) -> Column:
    """A candidate's quality after feedback: less if it or its cause is called wrong, more if both are called right; within 0 and 1."""
    bad = F.coalesce(~helpful, F.lit(False)) | F.coalesce(~cause_correct, F.lit(False))
    good = F.coalesce(helpful & cause_correct, F.lit(False))
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score + F.when(bad, -PENALTY).otherwise(0.0) + F.when(good, BONUS).otherwise(0.0))), 4)


def review(pending: DataFrame, decisions: DataFrame) -> DataFrame:
    """pending: incident_id, status; decisions: incident_id, seq, approve. The status after the first decision on each pending candidate, with an audit entry each."""
    d = decisions.groupBy("incident_id").agg(F.min(F.struct("seq", "approve")).alias("d"))
    out = pending.join(d, "incident_id", "left")
    status = F.when((F.col("status") == "pending_review") & F.col("d").isNotNull(), F.when(F.col("d.approve"), "indexed").otherwise("rejected")).otherwise(F.col("status"))
    return out.select("incident_id", F.col("status").alias("before"), status.alias("status"), F.when(status != F.col("status"), F.concat(F.lit("review: "), status)).alias("audit"))


def escalation_packets(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """rows: incident_id, component, failure_type, priority, novel, attempts (array of step, answer, strategy), alternatives (array of strategy, action), mean_reassignments, reopen_rate.

    One packet per incident: tier and its reasons, failed approaches, and the next action: the first alternative that hasn't failed, else a diagnosis.
    """
    failed = F.transform(F.filter("attempts", lambda x: x["answer"] == "FAILED"), lambda x: x["strategy"])
    rows = rows.withColumn("failed", F.sort_array(F.array_distinct(failed))).withColumn("__n", F.size(failed))
    exhausted = F.col("__n") >= rounds
    reasons = F.array_compact(
        F.array(
            F.when(F.col("priority").isin("1", "2"), "priority"), F.when(F.coalesce("novel", F.lit(False)), "novel"), F.when(exhausted, "troubleshooting exhausted"),
            F.when(F.col("mean_reassignments") >= 2, "many reassignments"), F.when((F.col("reopen_rate") >= 0.15) & exhausted, "often reopened"),
        )
    )
    tier = F.element_at(F.array(*map(F.lit, TIERS)), F.least(F.size(reasons) + 1, F.lit(len(TIERS))))
    open_ = F.get(F.filter("alternatives", lambda x: ~F.array_contains(F.col("failed"), x["strategy"])), 0)
    after = F.coalesce(open_["action"], F.concat(F.lit("Specialist diagnosis of "), F.coalesce(F.nullif(F.col("component"), F.lit("Unknown")), F.lit("the affected component"))))
    return rows.select("incident_id", tier.alias("tier"), reasons.alias("reasons"), "failed", after.alias("next_action"), open_["strategy"].alias("next_strategy"))


def postmortems(incidents: DataFrame, events: DataFrame, attempts_log: DataFrame, workarounds: tuple[str, ...]) -> DataFrame:
    """One postmortem per incident: its timeline in order (opening, session events, resolution), the last fix that worked, what failed, and whether the fix looks like a work-around."""
    end = incidents.filter(F.col("resolved_time").isNotNull()).select("incident_id", F.col("resolved_time").alias("at"), F.lit(2).alias("o"), F.lit("incident resolved").alias("event"))
    begin = incidents.select("incident_id", F.col("open_time").alias("at"), F.lit(0).alias("o"), F.lit("incident opened").alias("event"))
    inner = events.select("incident_id", "at", F.lit(1).alias("o"), F.replace("kind", F.lit("_"), F.lit(" ")).alias("event"))
    line = begin.unionByName(inner).unionByName(end).groupBy("incident_id").agg(F.sort_array(F.collect_list(F.struct("at", "o", "event"))).alias("t"))
    a = attempts_log.groupBy("incident_id").agg(F.max(F.when(F.col("answer") == "WORKED", F.struct("seq", "step"))).alias("w"), F.sort_array(F.collect_list(F.when(F.col("answer") == "FAILED", F.struct("seq", "step")))).alias("f"))
    rough = F.lit(False)
    for w in workarounds:
        rough = rough | F.contains(F.lower("w.step"), F.lit(w))
    out = line.join(a, "incident_id", "left")
    return out.select("incident_id", F.transform("t", lambda x: x["event"]).alias("timeline"), F.col("w.step").alias("final_fix"), F.coalesce(F.transform("f", lambda x: x["step"]), F.array().cast("array<string>")).alias("failed"), F.coalesce(rough, F.lit(False)).alias("workaround"))
