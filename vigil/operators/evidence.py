"""Evidence over families and retrieved incidents: votes, shares, outcome statistics, recurrence and hotspots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.clean import UNKNOWN, days_between
from vigil.functions.math import wilson
from vigil.operators.measures import percentiles

OUTCOMES_NEEDED, REPEAT_DAYS, HOTSPOT_DAYS = 20, 30, 14


def _first_seen(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """keys, value, n and first (the smallest order that has the value): counts whose ties go to what came first."""
    return rows.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))


def most_common(rows: DataFrame, keys: list[str], value: str, order: str, k: int) -> DataFrame:
    """The k most frequent values of each group: keys, value, n, rank. Values are counted before they are ranked, so a window holds distinct values only."""
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "first")
    return _first_seen(rows, keys, value, order).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("first")


def signatures(rows: DataFrame, family: str, fields: list[str], order: str, k: int = 4) -> DataFrame:
    """Per family and field the k most frequent values with their shares of all members, most frequent first: family, field, value, share, rank."""
    members = rows.groupBy(family).agg(F.count("*").alias("members"))
    long = rows.select(family, order, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit(UNKNOWN)).alias("value")) for f in fields])).alias("x"))
    top = most_common(long.select(family, order, "x.field", "x.value"), [family, "field"], "value", order, k)
    return top.join(members, family).select(family, "field", "value", F.round(F.col("n") / F.col("members"), 3).alias("share"), "rank")


def dominant(signature: DataFrame, family: str) -> DataFrame:
    """Per family and field the most frequent value that isn't Unknown."""
    known = signature.filter(F.col("value") != UNKNOWN)
    return known.groupBy(family, "field").agg(F.min(F.struct("rank", "value", "share")).alias("b")).select(family, "field", "b.value", "b.share")


def family_names(signature: DataFrame, family: str) -> DataFrame:
    """family, name: component and symptom, then the root cause."""
    d = dominant(signature, family)
    of = lambda f: F.max(F.when(F.col("field") == f, F.col("value")))
    g = signature.select(family).distinct().join(d, family, "left").groupBy(family).agg(of("component").alias("c"), of("symptom").alias("s"), of("root_cause").alias("r"))
    head = F.coalesce(F.nullif(F.concat_ws(" · ", "c", "s"), F.lit("")), F.lit("Mixed incidents"))
    return g.select(family, F.concat_ws(" — ", head, "r").alias("name"))


def cross_symptoms(rows: DataFrame, family: str, cause: str, symptom: str, order: str, most: float = 0.6, each: float = 0.1) -> DataFrame:
    """Families in which one known root cause has most of the members and several symptoms have a fair part each: family, root_cause, share, symptoms."""
    n = rows.groupBy(family).agg(F.count("*").alias("members"))
    top = most_common(rows.select(family, order, F.coalesce(cause, F.lit(UNKNOWN)).alias("c")), [family], "c", order, 1).join(n, family)
    top = top.filter((F.col("c") != UNKNOWN) & (F.col("n") / F.col("members") >= most)).select(family, F.col("c").alias("root_cause"), F.round(F.col("n") / F.col("members"), 3).alias("share"), "members")
    said = rows.filter(F.col(symptom).isNotNull() & (F.col(symptom) != UNKNOWN)).groupBy(family, F.col(cause).alias("root_cause"), F.col(symptom).alias("s")).agg(F.count("*").alias("k"))
    fair = top.join(said, [family, "root_cause"]).filter(F.col("k") / F.col("members") >= each)
    out = fair.groupBy(family, "root_cause", "share").agg(F.sort_array(F.collect_list("s")).alias("symptoms"))  # at most 1 / each of them
    return out.filter(F.size("symptoms") >= 2)


def outcomes(rows: DataFrame, keys: list[str], missing_as_zero: bool = False) -> DataFrame:
    """rows: reopened, reopened_source, reassignments, resolution_hours. Statistics of rows with an outcome; null under OUTCOMES_NEEDED of them."""
    known = (F.col("reopened_source") != "missing") & F.col("reopened").isNotNull()
    moved = F.coalesce("reassignments", F.lit(0)) if missing_as_zero else F.col("reassignments")
    g = rows.groupBy(*keys).agg(
        F.count_if(known).alias("n_with_outcome"), F.count_if(known & F.col("reopened")).alias("k"),
        F.avg(F.when(known, moved.cast("double"))).alias("m"),
    )
    middle = percentiles(rows.filter(known), F.col("resolution_hours"), {"h": 0.5}, keys).withColumnsRenamed({k: f"__{k}" for k in keys})
    g = g.join(middle, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), "left")
    enough = F.col("n_with_outcome") >= OUTCOMES_NEEDED
    low, high = wilson(F.col("k"), F.col("n_with_outcome"))
    shown = {"reopen_rate": F.col("k") / F.col("n_with_outcome"), "reopen_low": low, "reopen_high": high, "mean_reassignments": F.col("m"), "median_hours": F.col("h")}
    return g.select(*keys, "n_with_outcome", enough.alias("supported"), *[F.when(enough, F.round(v, 2 if n in ("mean_reassignments", "median_hours") else 4)).alias(n) for n, v in shown.items()])


def recurrence(rows: DataFrame, family: str, item: str, time: str, key: str) -> DataFrame:
    """One record per family: members, timed, status, first and last time, counts by month, median gap in days, recurring items and reopen rate.

    An item recurs if two of its incidents in the family lie at most REPEAT_DAYS apart; the ten that recur most are listed. Fewer
    than three timed members are insufficient. Gaps go over (family, time); a family's members are one window partition.
    """
    timed = rows.filter(F.col(time).isNotNull())
    gaps = timed.select(family, days_between(F.lag(time).over(Window.partitionBy(family).orderBy(time, key)), F.col(time)).alias("gap"))
    gap = percentiles(gaps, F.col("gap"), {"gap": 0.5}, [family]).select(family, F.round("gap", 2).alias("median_days_between"))
    base = rows.groupBy(family).agg(F.count("*").alias("members"), F.count(time).alias("timed"), F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.round(F.avg(F.when(F.col(time).isNotNull(), F.col("reopened").cast("double"))), 4).alias("reopen_rate"))
    months = timed.groupBy(family, F.date_format(time, "yyyy-MM").alias("month")).agg(F.count("*").alias("n")).groupBy(family).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("month", "n")))).alias("monthly"))
    near = timed.select(family, item, days_between(F.lag(time).over(Window.partitionBy(family, item).orderBy(time, key)), F.col(time)).alias("gap"))
    again = near.groupBy(family, item).agg(F.count("*").alias("incidents"), F.count_if(F.col("gap") <= REPEAT_DAYS).alias("repeats")).filter("repeats >= 1")
    w = Window.partitionBy(family).orderBy(F.desc("repeats"), F.desc("incidents"), item)
    top = again.withColumn("r", F.row_number().over(w)).filter("r <= 10")
    listed = top.groupBy(family).agg(F.sort_array(F.collect_list(F.struct("r", F.col(item).alias("item"), "incidents", "repeats"))).alias("recurring"))
    out = base.join(gap, family, "left").join(months, family, "left").join(listed, family, "left")
    ok = F.col("timed") >= 3
    finding = F.when(F.size("recurring") > 0, F.concat(F.lit("Potential pattern requiring investigation: "), F.col("recurring")[0]["item"], F.lit(" had "), F.col("recurring")[0]["incidents"].cast("string"), F.lit(" incidents")))
    shown = [F.when(ok, F.col(c)).alias(c) for c in ("first_seen", "last_seen", "monthly", "median_days_between", "recurring", "reopen_rate")]
    return out.select(family, "members", "timed", F.when(ok, "ok").otherwise("insufficient temporal data").alias("status"), *shown, F.when(ok, finding).alias("finding"))


def hotspot_codes(rows: DataFrame, hotspots: DataFrame, item: str, time: str, code: str, key: str, k: int = 2) -> DataFrame:
    """The k most frequent codes among the rows of each hotspot's window: item, code, n, rank. hotspots: item, window_start_us, of timeline.hotspots()."""
    span = HOTSPOT_DAYS * 86_400_000_000
    rows = rows.select(item, F.coalesce(code, F.lit(UNKNOWN)).alias(code), F.unix_micros(F.col(time).cast("timestamp")).alias("us"), F.struct(time, key).alias("place"))
    inside = rows.join(hotspots.select(item, "window_start_us"), item).filter((F.col("us") >= F.col("window_start_us")) & (F.col("us") <= F.col("window_start_us") + span))
    return most_common(inside, [item], code, "place", k)


def root_cause_vote(retrieved: DataFrame, query: str = "query_id") -> DataFrame:
    """retrieved: query, rank, incident_id, root_cause, provenance. Per query the most frequent known cause (the first of equals by rank), its share of all
    retrieved, how certain that makes it, and what supports it; insufficient evidence if none is known."""
    total = retrieved.groupBy(query).agg(F.count("*").alias("retrieved"))
    known = retrieved.filter(F.col("root_cause").isNotNull() & (F.col("root_cause") != UNKNOWN))
    top = most_common(known, [query], "root_cause", "rank", 1).select(query, "root_cause", "n")
    with_top = known.join(top, [query, "root_cause"]).groupBy(query).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "incident_id"))), lambda x: x["incident_id"]).alias("supporting"),
        F.count_if(F.col("provenance") == "synthetic").alias("synthetic"), F.count_if(F.col("provenance") == "derived").alias("derived"),
    )
    out = total.join(top, query, "left").join(with_top, query, "left")
    share = F.col("n") / F.col("retrieved")
    certainty = F.when(F.col("n").isNull(), "insufficient evidence").when(share >= 0.6, "likely").when(share >= 0.3, "possible").otherwise("weakly supported")
    tag = F.when(F.col("n").isNotNull(), F.when(F.col("synthetic") >= F.col("derived"), "inferred").otherwise("derived"))
    return out.select(query, "root_cause", F.round(share, 3).alias("share"), certainty.alias("certainty"), "supporting", tag.alias("tag"))


def share_match(own: Column, value: Column, listed: Column | None = None) -> Column:
    """An aggregate: of the rows whose value is known, the share equal to own, or that list it; null if own or all values are Unknown."""
    known = value.isNotNull() & (value != UNKNOWN)
    hit = value == own if listed is None else (value == own) | F.array_contains(listed, own)
    return F.round(F.avg(F.when(known & (own != UNKNOWN), F.coalesce(hit, F.lit(False)).cast("double"))), 4)


def ratings(rows: DataFrame, keys: list[str], rating: str, time: str, key: str, newest: int = 5) -> DataFrame:
    """Mean, how often each of 1 to 5 was given, the mean as per cent of 5, and the newest few."""
    g = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(rating).alias("mean"), *[F.count_if(F.col(rating) == i).alias(f"n{i}") for i in range(1, 6)])
    w = Window.partitionBy(*keys).orderBy(F.desc(time), F.desc(key))
    last = rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= newest).groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", key))), lambda x: x[key]).alias("newest"))
    out = g.join(last, keys)
    return out.select(*keys, "n", F.round("mean", 2).alias("mean"), *[f"n{i}" for i in range(1, 6)], F.round(F.col("mean") / 5 * 100).cast("int").alias("percent_resolved"), "newest")


def profile(df: DataFrame, top: int = 6) -> DataFrame:
    """One row per column: nulls, null share, distinct values (nulls excluded) and its most frequent values (null included) with counts.

    The table is turned into (column, value) pairs and counted with partial sums; one window partition holds a column's distinct values.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns])).alias("x")).select("x.*")
    n = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc_nulls_last("value"))
    ranked = n.withColumn("r", F.row_number().over(w))
    total = F.sum("n")
    return ranked.groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.round(F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)) / total * 100, 2).alias("null_percent"),
        F.count("value").alias("distinct"), F.sort_array(F.collect_list(F.when(F.col("r") <= top, F.struct("r", "value", "n")))).alias("top"),
    )


def provenance_counts(df: DataFrame, fields: list[str], classes: tuple[str, ...]) -> DataFrame:
    """Per field how many rows have each provenance class."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_source").alias("p")) for f in fields])).alias("x")).select("x.*")
    return long.groupBy("field").agg(*[F.count_if(F.col("p") == c).alias(c) for c in classes])


SECTIONS = ("query_understood", "extracted_fingerprint", "matched_incident_family", "retrieved_incidents", "root_cause_evidence", "resolution_evidence", "evidence_strength")
INSUFFICIENT = "insufficient evidence"


def chain(rows: DataFrame, query: str) -> DataFrame:
    """rows: query, known_fields, novel, family, match_strength, n_retrieved, root_cause, certainty, strategy, confidence, and matches (map of field to share).

    One evidence chain per query: its sections in order with status and value, the share of them that is computed, and the fields whose match
    couldn't be computed. Every section is filled from data or insufficient; for a novel query the nearest family, its root causes and its fixes are no evidence.
    """
    known = ~F.coalesce("novel", F.lit(False))
    values = {
        "query_understood": F.lit("understood"), "extracted_fingerprint": F.when(F.col("known_fields") > 0, F.concat(F.col("known_fields").cast("string"), F.lit(" fields"))),
        "matched_incident_family": F.when(known & F.col("match_strength").isNotNull(), F.col("family")), "retrieved_incidents": F.when(F.col("n_retrieved") > 0, F.col("n_retrieved").cast("string")),
        "root_cause_evidence": F.when(known, F.concat_ws(": ", F.nullif(F.col("certainty"), F.lit(INSUFFICIENT)), "root_cause")), "resolution_evidence": F.when(known, F.col("strategy")),
        "evidence_strength": F.when(F.exists(F.map_values("matches"), lambda v: v.isNotNull()), F.lit("computed")),
    }
    section = lambda n: F.struct(F.lit(n).alias("section"), F.when(F.coalesce(values[n], F.lit("")) != "", "computed").otherwise(INSUFFICIENT).alias("status"), F.nullif(values[n], F.lit("")).alias("value"))
    out = rows.withColumn("sections", F.array(*map(section, SECTIONS)))
    done = F.size(F.filter("sections", lambda s: s["status"] == "computed"))
    gaps = F.sort_array(F.map_keys(F.map_filter("matches", lambda k, v: v.isNull())))
    return out.select(query, "sections", (done / len(SECTIONS)).alias("completeness"), gaps.alias("not_computable"))
