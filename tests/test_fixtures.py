"""Hand-made inputs with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vigil.functions import clean, text
from vigil.functions.math import wilson
from vigil.operators import ranking, unify
from vigil.sources import tables
from vigil.streaming.correlate import correlate_stream

T0 = dt.datetime(2026, 1, 1, 10, 0)


def one(spark, value, *exprs):
    return tuple(spark.createDataFrame([(value,)], "x string").select(*exprs).first())


def test_cleaning(spark):
    x = F.col("x")
    day = lambda v: one(spark, v, clean.parse_dayfirst(x).cast("string"))[0]
    assert (day("5/2/2012 13:32"), day("29-03-2012 12:36"), day(None), day("soon")) == ("2012-02-05 13:32:00", "2012-03-29 12:36:00", None, None)
    kinds = [one(spark, v, clean.classify_duration(x), clean.decimal_comma(x)) for v in ("3,87,16,91,111", "0,862777778", None, "x")]
    assert kinds == [("corrupted_digit_grouping", None), ("decimal_comma", 0.862777778), ("missing", None), ("unparseable", None)]
    assert [one(spark, v, clean.itil_level(x))[0] for v in ("NS", None, "5 - Very Low", "4.0", "?")] == ["Not Set", "Not Set", "5", "4", "Not Set"]
    assert [one(spark, v, clean.placeholder(x))[0] for v in ("#MULTIVALUE", "#N/B", " a ", None)] == ["Multiple", "Not Available", "a", None]
    assert [one(spark, v, clean.closure_class(x))[0] for v in ("Software", "User error", None, "odd")] == ["software_fix", "user_or_operator", "Unknown", "unspecified"]


def test_text(spark):
    x = F.col("x")
    long = " ".join(f"Sentence {i} has exactly six words." for i in range(60))
    parts = one(spark, long, text.chunks(x))[0]
    assert len(parts) > 1 and all(p.endswith(".") for p in parts) and " ".join(parts) == long and max(len(p.split()) for p in parts) <= 200
    assert one(spark, "short one. ", text.chunks(x))[0] == ["short one."]
    assert one(spark, "The printers' restarting stations, a U2", text.analyze(x))[0] == ["printer", "restart", "station", "u2"]
    assert one(spark, "see [INC-1234] and [IM000004]", text.citations(x))[0] == ["INC-1234", "IM000004"]
    assert one(spark, "Ab, c!", text.normalize_text(x), clean.slug(x)) == ("ab c", "AB-C")


def test_wilson(spark):
    low, high = wilson(F.lit(5.0), F.lit(100.0))
    a, b = spark.range(1).select(low, high).first()
    assert a < 0.05 < b
    assert tuple(spark.range(1).select(*wilson(F.lit(0.0), F.lit(0.0))).first()) == (0.0, 1.0)


LOG = ["CI_Name", "CI_Cat", "CI_Subcat", "WBS", "Incident_ID", "Status", "Impact", "Urgency", "Priority", "Category", "KB_number", "No_of_Reassignments", "Open_Time", "Reopen_Time", "Resolved_Time", "Close_Time", "Handle_Time_hrs", "Closure_Code", "No_of_Related_Interactions", "Related_Interaction", "Related_Change"]


def test_unify_event_log(spark, tmp_path):
    rows = [
        ("A1", "app", "SAN", "w", "IM1", "Closed", "4", "4", "4", "incident", "KM1", "2", "5/2/2012 13:32", None, "6/2/2012 13:32", "6/2/2012 14:32", "0,5", "Overig", "1", "#MULTIVALUE", None),
        ("A2", None, None, "w", "IM2", "Closed", "2", "5", "3", "incident", "KM1", None, "29-03-2012 12:36", "30-03-2012 12:36", None, None, None, None, "1", "x", "C1"),
    ]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in LOG))
    a, b = unify.from_event_log(df, "log.csv").orderBy("incident_id").collect()
    assert (a.resolution_hours, a.resolution_hours_source, a.closure_code, a.closure_class, a.priority_consistent, a.category, a.suggested_team) == (24.0, "derived", "Other", "unspecified", True, "Storage", "Storage Engineering")
    assert (b.resolution_hours, b.reopened, b.priority_consistent, b.ci_category_source, b.related_change) == (None, True, False, "missing", "C1")
    out = unify.from_event_log(df, "log.csv")
    assert unify.bad_provenance(out.drop("source")).count() == 0 and unify.eligible_for_text(out).count() == 1
    df.write.csv(str(tmp_path / "log"), header=True)
    raw = tables.read_raw_csv(spark, str(tmp_path / "log"))
    assert raw.columns == LOG and tables.role_of(raw) == "structured"
    assert tables.role_of(spark.createDataFrame([("a b c",)], "Description string")) == "text_rich"


def test_tables(spark, tmp_path):
    log = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, seq int, v string")
    assert sorted(tuple(r) for r in tables.latest(log, "k", "seq").collect()) == [(1, 2, "b"), (2, 1, "c")]
    assert tables.export_csv(log, str(tmp_path / "csv")) == 3
    tables.write_table(log, str(tmp_path / "t"))
    tables.write_table(log.withColumn("more", F.lit(1)), str(tmp_path / "t"), mode="append")
    assert tables.read_table(spark, str(tmp_path / "t"), merge_schema=True).filter("more IS NULL").count() == 3
    assert tables.read_table(spark, str(tmp_path / "t"), ["k"]).columns == ["k"]
    assert tables.top_up(log, log.filter("k = 1"), "k").count() == 1
    assert log.filter(tables.metadata_predicate({"k": [1], "v": []}, {"v": ["a"]})).count() == 1


EVIDENCE = [("S1", "A", 0.9, 1.0, 0.9, "original", "na"), ("S1", "B", 0.8, 1.0, 0.9, "original", "nb"), ("S2", "C", 0.7, 1.0, 0.9, "original", "nc"), ("S3", "D", 0.9, 1.0, 0.05, "original", "closed")]
FIELDS = "strategy string, incident_id string, confidence double, influence double, detail double, provenance string, note string"


def test_ranking(spark):
    df = spark.createDataFrame([(0, *r) for r in EVIDENCE], f"q int, {FIELDS}")
    rows = ranking.rank_resolutions(df, "q").orderBy("rank").collect()
    assert [r.strategy for r in rows] == ["S1", "S2"] and rows[0].supporting == ["A", "B"] and rows[0].step == "na"
    assert rows[0].confidence == pytest.approx(0.9 * 1.7 / 2.4)
    assert ranking.rank_resolutions(df, "q", reranked=False).first().confidence is None
    prior = [(0, "F1-S1", "A", 0.6, 1.0, 1.0, "original", "x"), (0, "F2-S1", "B", 0.7, 1.0, 1.0, "original", "y"), (1, "S1", "C", 0.9, 1.0, 1.0, "original", "delete it"), (1, "S2", "D", 0.1, 1.0, 1.0, "original", "z")]
    rows = ranking.rank_resolutions(spark.createDataFrame(prior, f"q int, {FIELDS}"), "q", (F.lit("F1"), F.lit(0.9))).filter("rank = 1").orderBy("q").collect()
    assert [r.strategy for r in rows] == ["F1-S1", "S2"]  # a destructive action on one source doesn't lead
    score, grade = ranking.query_grade([F.lit(0.9), F.lit(None).cast("double"), F.lit(0.6)], F.lit(False))
    assert tuple(spark.range(1).select(score, grade).first()) == (0.75, "good")
    assert spark.range(1).select(ranking.route_tier(["L1", "L2", "L3"], F.lit(True), F.lit(True), F.lit(True))).first()[0] == "L3"


EVENTS = [("A", 0, "F1"), ("B", 2, "F2"), ("C", 5, "F1"), ("D", 6, "F3"), ("E", 80, "F1")]


def frame(spark, rows):
    return spark.createDataFrame([("all", i, T0 + dt.timedelta(minutes=m), f, None) for i, m, f in rows], "scope string, event_id string, ts timestamp, family string, vector array<float>")


def check(rows):
    got = {r.event_id: r for r in rows}
    assert got["C"].members == ["A", "C"] and got["C"].alert_id and got["C"].detected
    assert all(got[i].alert_id is None for i in "ABDE")


def test_burst_in_batch(spark):
    check(correlate_stream(frame(spark, EVENTS)).collect())


def test_burst_as_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    for k, part in enumerate((EVENTS[:2], EVENTS[2:4], EVENTS[4:])):
        frame(spark, part).coalesce(1).write.mode("append").parquet(f"{src}/p{k}")
    schema = frame(spark, EVENTS).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    q = correlate_stream(stream).writeStream.format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    check(spark.table("bursts").collect())


def test_json_in_prose(spark):
    from pyspark.sql import functions as F

    from vigil.functions import text

    cases = {
        'Sure!\n```json\n{"a": 1}\n```': '{"a": 1}', '```json\n{"a": [1, 2]}\n```': '{"a": [1, 2]}', "```\n[1, 2]\n``` done": "[1, 2]", 'so [1, {"x": "}"}] it is': '{"x": "}"}',
        "no json": None, "": None, None: None, "{broken": None, "{broken} [1]": "[1]", 'x {"s": "a \\" } b"} y': '{"s": "a \\" } b"}', "} {": None,
    }
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    got = [r.j for r in df.select("i", text.json_in_prose(F.col("c")).alias("j")).orderBy("i").collect()]
    assert got == list(cases.values())
