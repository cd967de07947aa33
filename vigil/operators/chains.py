"""Causal chains of incidents and their summary per family; graph neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How much a link's tag counts, and the order of stages.
TAG_WEIGHT = {"observed": 1.0, "derived": 0.7, "inferred": 0.5}
STAGES = ("change", "trigger", "root_cause", "failure", "symptom", "impact")


def build_chain(statements: dict[str, tuple[Column, Column]], timed: Column) -> Column:
    """statements: stage -> (statement, tag). Ordered links if the record has times, else none; and the chain's strength."""
    links = F.array_compact(F.array(*[F.when(statements[s][0].isNotNull() & (statements[s][0] != "Unknown"), F.struct(F.lit(s).alias("stage"), statements[s][0].alias("statement"), statements[s][1].alias("tag"))) for s in STAGES if s in statements]))
    weight = F.create_map(*[F.lit(x) for kv in TAG_WEIGHT.items() for x in kv])
    strength = F.aggregate(links, F.lit(0.0), lambda a, x: a + F.coalesce(F.try_element_at(weight, x["tag"]), F.lit(0.0))) / len(STAGES)
    return F.struct(timed.alias("available"), F.when(timed, links).otherwise(F.slice(links, 1, 0)).alias("links"), links.alias("facts"), F.when(timed, strength).alias("strength"))


def family_chain(chains: DataFrame) -> DataFrame:
    """chains: family, links. Per family and stage the most common statement, its share, and how many members have the stage."""
    members = chains.groupBy("family").agg(F.count("*").alias("members"))
    links = chains.select("family", F.explode("links").alias("l")).select("family", "l.stage", "l.statement")
    n = links.groupBy("family", "stage", "statement").agg(F.count("*").alias("n"))
    best = n.groupBy("family", "stage").agg(F.max(F.struct("n", "statement")).alias("b"), F.sum("n").alias("all"))
    return best.join(members, "family").select("family", "stage", F.col("b.statement").alias("statement"), (F.col("b.n") / F.col("all")).alias("share"), (F.col("all") / F.col("members")).alias("coverage"))


def neighbourhood(edges: DataFrame, node, limit: int = 30) -> DataFrame:
    return edges.filter((F.col("src_id") == node) | (F.col("dst_id") == node)).orderBy("src_id", "dst_id", "rel_type").limit(limit)


def shared_values(df: DataFrame, family: str, value: str, least: int) -> DataFrame:
    """Pairs of families that share at least so many distinct values: a, b, shared. A value in all families costs its families squared, so families, not rows, are paired."""
    d = df.select(F.col(family).alias("f"), F.col(value).alias("v")).distinct()
    a, b = d.toDF("a", "v"), d.toDF("b", "v")
    return a.join(b, "v").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)


# The stages of an incident's chain, and what isn't a related change.
INCIDENT_STAGES = ("trigger", "technical_failure", "symptom", "business_impact", "resolution", "outcome")
NO_CHANGE = ("None", "nan", "Not Available")


def _link(stage: str, when: Column, statement: Column, tag: Column) -> Column:
    return F.when(when, F.struct(F.lit(stage).alias("stage"), statement.alias("statement"), tag.alias("tag")))


def incident_chains(df: DataFrame) -> DataFrame:
    """df: records with fingerprint. incident_id, available, links, facts, missing_stages and strength.

    A recorded change is observed; what rules found in generated text is inferred, in other text derived; texts themselves are observed unless
    generated. Without both times no order can be observed: there are facts then, and no links.
    """
    c, fp = F.col, lambda f: F.col(f"fingerprint.{f}.value")
    ruled = lambda f: F.when(c(f"fingerprint.{f}.provenance") == "synthetic", "inferred").otherwise("derived")
    written = lambda f: F.when(c(f"{f}_source") == "synthetic", "inferred").otherwise("observed")
    changed = c("related_change").isNotNull() & (c("related_change") != "") & ~c("related_change").isin(*NO_CHANGE)
    known = lambda f: fp(f) != "Unknown"
    levels = F.coalesce(c("impact") != "Not Set", F.lit(False)) | F.coalesce(c("urgency") != "Not Set", F.lit(False))
    impact = F.when(known("business_impact"), fp("business_impact")).otherwise(F.concat(F.lit("Impact "), c("impact"), F.lit(" / Urgency "), c("urgency")))
    coded = F.when(F.coalesce(c("closure_code") != "Not Set", F.lit(False)), F.concat(F.lit(" [closure code: "), c("closure_code"), F.lit("]"))).otherwise("")
    timed = c("open_time").isNotNull() & c("resolved_time").isNotNull()
    after = F.concat(
        F.lit("Resolved "), F.format_string("%.1f", c("resolution_hours")), F.lit(" h after opening"), F.when(F.coalesce(c("reopened"), F.lit(False)), "; reopened").otherwise("; not reopened"),
        F.coalesce(F.concat(F.lit("; "), c("reassignments").cast("string"), F.lit(" reassignment(s)")), F.lit("")),
    )
    links = F.array_compact(
        F.array(
            F.coalesce(_link("trigger", changed, F.concat(F.lit("Change record "), c("related_change"), F.lit(" is linked")), F.lit("observed")), _link("trigger", known("trigger"), fp("trigger"), ruled("trigger"))),
            _link("technical_failure", known("root_cause"), fp("root_cause"), ruled("root_cause")),
            _link("symptom", F.coalesce(c("description") != "", F.lit(False)), F.substring("description", 1, 220), written("description")),
            F.coalesce(_link("business_impact", levels, impact, F.lit("derived")), _link("business_impact", known("business_impact"), fp("business_impact"), ruled("business_impact"))),
            _link("resolution", F.coalesce(c("resolution_notes") != "", F.lit(False)), F.concat(F.substring("resolution_notes", 1, 220), coded), written("resolution_notes")),
            _link("outcome", timed, after, F.lit("observed")),
        )
    )
    rows = df.select("incident_id", timed.alias("available"), links.alias("facts"))
    weight = F.create_map(*[F.lit(x) for kv in TAG_WEIGHT.items() for x in kv])
    strength = F.round(F.aggregate("facts", F.lit(0.0), lambda a, x: a + F.try_element_at(weight, x["tag"])) / len(INCIDENT_STAGES), 3)
    have = F.transform("facts", lambda x: x["stage"])
    missing = F.array_except(F.array(*map(F.lit, INCIDENT_STAGES)), have)
    return rows.select("incident_id", "available", F.when(F.col("available"), F.col("facts")).otherwise(F.slice("facts", 1, 0)).alias("links"), "facts", F.when(F.col("available"), missing).alias("missing_stages"), F.when(F.col("available"), strength).alias("strength"))


def incident_edges(df: DataFrame, key: str, time: str, repeat_days: float = 7.0) -> DataFrame:
    """Edges between consecutive records of the same item, article and change and of the same near-duplicate group, and repeats on an item within some days.

    df: key, time, ci_name, kb_number, related_change, near_root; columns that are absent give no edges. Edges grow with the records, not their squares.
    """
    from functools import reduce

    from vigil.operators.timeline import chain_edges

    kinds = {"ci_name": ("same_ci", repeat_days), "kb_number": ("same_kb_article", None), "related_change": ("same_change", None), "near_root": ("near_duplicate", None)}
    parts = []
    for column, (relation, days) in kinds.items():
        if column in df.columns:
            rows = df.filter(F.col(column).isNotNull() & ~F.col(column).cast("string").isin(*NO_CHANGE, "Unknown"))
            parts.append(chain_edges(rows, column, key, time, relation, days))
    return reduce(DataFrame.unionByName, parts)


def family_graph(signature: DataFrame, items: DataFrame, family: str, item: str, least_share: float = 0.2, same_cause: float = 0.4, least_items: int = 5) -> DataFrame:
    """Edges src, dst, rel, weight: families to root causes and components that a fair part of them has, pairs of families with many items in common, and
    pairs that share a frequent root cause. signature: family, field, value, share."""
    has = signature.filter(F.col("field").isin("root_cause", "component") & (F.col("value") != "Unknown") & (F.col("share") >= least_share))
    own = has.select(F.col(family).cast("string").alias("src"), F.concat_ws(":", "field", "value").alias("dst"), F.concat(F.lit("has_"), F.col("field")).alias("rel"), F.col("share").cast("double").alias("weight"))
    pairs = shared_values(items.filter(F.col(item).isNotNull() & F.col(family).isNotNull()), family, item, least_items)
    shared = pairs.select(F.col("a").cast("string").alias("src"), F.col("b").cast("string").alias("dst"), F.lit("shared_cis").alias("rel"), F.col("shared").cast("double").alias("weight"))
    causes = has.filter((F.col("field") == "root_cause") & (F.col("share") >= same_cause))
    same = shared_values(causes, family, "value", 1).select(F.col("a").cast("string").alias("src"), F.col("b").cast("string").alias("dst"), F.lit("shared_root_cause").alias("rel"), F.lit(1.0).alias("weight"))
    return own.unionByName(shared).unionByName(same)
