import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.operators import families, fingerprints
from vigil.sources import stores, tables
from vigil.streaming import correlate

T0 = dt.datetime(2024, 3, 1, 12)


def test_batches_replace_themselves(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    stores.commit_batch(df, str(tmp_path / "t"), "one")
    assert stores.commit_batch(df.limit(1), str(tmp_path / "t"), "one").count() == 1
    stores.commit_batch(df, str(tmp_path / "t"), "two")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_vector_table(spark, tmp_path):
    t = stores.VectorTable(spark, str(tmp_path / "v"), "hash-256")
    assert not t.health()["ok"]
    t.upsert(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, v array<float>"), 0)
    t.upsert(spark.createDataFrame([("b", [0.6, 0.8])], "id string, v array<float>"), 1)
    assert {r.id: [round(x, 3) for x in r.v] for r in t.read().collect()} == {"a": [1.0, 0.0], "b": [0.6, 0.8]}
    assert t.health() == {"ok": True, "count": 2, "encoders": ["hash-256"]}
    wanted = spark.createDataFrame([("a",), ("c",)], "id string")
    assert [r.id for r in t.top_up(wanted).collect()] == ["c"] and t.by_ids(wanted).count() == 1


def test_knowledge_base_and_artefacts(spark, tmp_path):
    rec = spark.createDataFrame([("A", "A", "x"), ("B", "A", "x")], "incident_id string, dup_group string, title string")
    kb = stores.KnowledgeBase(rec, spark.createDataFrame([("A", "t"), ("B", "t")], "incident_id string, text string"))
    assert [r.incident_id for r in kb.duplicates_of("A").collect()] == ["B"]
    more = spark.createDataFrame([("B", "B", "new"), ("C", "C", "y"), ("D", "D", "z")], "incident_id string, dup_group string, title string")
    quality = spark.createDataFrame([("C", "indexed"), ("D", "pending_review"), ("B", "indexed")], "incident_id string, status string")
    grown = kb.accepted(more, quality, spark.createDataFrame([("C", "c"), ("D", "d")], "incident_id string, text string"))
    assert sorted((r.incident_id, r.title) for r in grown.records.collect()) == [("A", "x"), ("B", "x"), ("C", "y")] and grown.chunks.count() == 3
    fams = spark.createDataFrame([("F001", ["A", "B"])], "family string, members array<string>")
    chains = spark.createDataFrame([("A", [("trigger", "t"), ("symptom", "s")])], "incident_id string, links array<struct<stage: string, statement: string>>")
    edges = spark.createDataFrame([("A", "B")], "src_id string, dst_id string")
    n = stores.write_artefacts(str(tmp_path), rec, rec.select("incident_id"), fams, chains, edges)
    assert n == {"fingerprints": 2, "family_members": 2, "chain_links": 2, "edges": 1, "incidents": 2}
    assert {r.family for r in spark.read.parquet(str(tmp_path / "incidents")).collect()} == {"F001"}


def test_answer_cache(spark, tmp_path):
    cache = stores.AnswerCache(spark, str(tmp_path))
    asked = spark.createDataFrame([("m", "q1"), ("m", "q2")], "model string, question string").withColumn("key", stores.cache_key(F.col("model"), F.col("question")))
    cache.put(asked.filter("question = 'q1'").withColumn("answer", F.lit("first")), 0)
    cache.put(asked.filter("question = 'q1'").withColumn("answer", F.lit("later")), 1)
    assert {r.question: r.answer for r in cache.look_up(asked).collect()} == {"q1": "first", "q2": None}


def test_encoders_fall_back_and_say_why(spark):
    def absent():
        raise ImportError("no model here")

    df = spark.createDataFrame([(1, "disk full"), (2, None), (3, "disk full disk full")], "k int, text string")
    out, name, why = stores.embed(df, "text", [("big", absent), ("hash", stores.hashing_encoder(64))], batch=2)
    v = {r.k: np.array(r.v) for r in out.collect()}
    assert name == "hash" and "no model here" in why and np.allclose(v[1], v[3]) and abs(np.linalg.norm(v[1]) - 1) < 1e-6 and not v[2].any()
    with pytest.raises(ValueError):
        stores.embed(df, "text", [("big", absent)])


def test_grounding_and_timer(spark):
    answer = spark.createDataFrame([(1, "Restart it [INC-12345].", [1.0, 0.0]), (2, "Buy a boat.", [0.0, 1.0]), (3, "As in [INC-99999].", [1.0, 0.0])], "sentence_no int, sentence string, v array<double>")
    sources = spark.createDataFrame([("INC-12345", [0.9, 0.1])], "source_id string, v array<double>")
    got = {r.sentence_no: (r.grounded, r.unknown_citations) for r in stores.grounding(answer, sources).collect()}
    assert got == {1: (True, []), 2: (False, []), 3: (False, ["INC-99999"])}
    t = stores.StageTimer()
    with t.stage("a"):
        pass
    with t.stage("a"):
        pass
    assert list(t.ms) == ["a"]


def test_model_bundle(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import SQLTransformer

    model = Pipeline(stages=[SQLTransformer(statement="SELECT *, k * 2 AS d FROM __THIS__")]).fit(spark.range(3).withColumnRenamed("id", "k"))
    stores.save_bundle({"double": model}, {"double": {"mae": 0.5}}, str(tmp_path), spark)
    models, metrics = stores.load_bundle(str(tmp_path), spark)
    assert metrics == {"double": {"mae": 0.5}} and [r.d for r in models["double"].transform(spark.range(3).withColumnRenamed("id", "k")).collect()] == [0, 2, 4]


def test_schema_enforcement_and_csv_mark(spark, tmp_path):
    df = spark.createDataFrame([("1", "original")], "k string, k_source string")
    assert tables.enforce(df, {"k_source": "string", "k": "long"}, ("original",)).columns == ["k_source", "k"]
    with pytest.raises(ValueError):
        tables.enforce(df, {"absent": "string"}, ())
    with pytest.raises(Exception, match="no provenance class"):
        tables.enforce(df, {"k_source": "string"}, ("missing",)).collect()
    assert tables.export_csv(df, str(tmp_path / "c")) == 1
    assert next((tmp_path / "c").glob("part-*")).read_bytes().startswith(b'"\xef\xbb\xbfk"')


def brute(events, minutes=30, threshold=0.55):
    """Components by repeated passes over all pairs; alerts by their smallest known name."""
    out, alert, seen = {}, {}, []
    for e in sorted(events, key=lambda e: (e[1], e[0])):
        near = [x for x in seen if e[1] - minutes <= x[1] <= e[1]]
        group, grown = [e], True
        while grown:
            grown = False
            for x in near:
                if x not in group and any((x[2] and x[2] == g[2]) or (x[3] and g[3] and sum(a * b for a, b in zip(x[3], g[3])) >= threshold) for g in group):
                    group.append(x)
                    grown = True
        name = None
        if len(group) > 1:
            name = min((alert[x[0]] for x in group if alert.get(x[0])), default=f"CORR-{e[0]}")
            alert |= {x[0]: name for x in group}
        seen.append(e)
        out[e[0]] = (sorted(x[0] for x in group), name)
    return out


def test_bursts_equal_brute_force_and_alerts_grow(spark):
    rng = np.random.default_rng(6)
    events = []
    for i in range(120):
        v = rng.normal(size=3)
        events.append((f"e{i:03d}", int(rng.integers(0, 400)), None if i % 3 else f"F{rng.integers(0, 6)}", (v / np.linalg.norm(v)).tolist() if i % 2 else None))
    rows = [("s", i, T0 + dt.timedelta(minutes=m), f, v, {"component": "Database", "symptom": str(k % 2)}) for k, (i, m, f, v) in enumerate(events)]
    df = spark.createDataFrame(rows, "scope string, event_id string, ts timestamp, family string, vector array<float>, fields map<string,string>")
    out = correlate.correlate_stream(df).cache()
    got = {r.event_id: (list(r.members), r.alert_id) for r in out.collect()}
    assert got == brute(events)
    for a in correlate.alerts(out).collect():
        mine = out.filter(F.col("alert_id") == a.alert_id).collect()
        assert set(a.alert_members) >= {m for r in mine for m in r.members} and a.latency_minutes >= 0 and a.updates == len(mine) - 1
        assert a.shared["component"] == "Database"
    busy = correlate.with_busy_times(df.drop("scope"))
    assert {r.event_id: (list(r.members), r.alert_id) for r in correlate.correlate_stream(busy).collect()} == got


def test_stream_is_persisted_and_shown(spark, tmp_path):
    texts = spark.createDataFrame([("a", "disk full", 0.0), ("b", "disk full again", 5.0), ("c", "coffee", 90.0)], "event_id string, text string, minute double")
    events = correlate.replay(texts, "2024-03-01 12:00:00").drop("vector", "family").withColumn("vector", F.when(F.col("text").startswith("disk"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).cast("array<float>"))
    cents = spark.createDataFrame([("F001", [1.0, 0.0])], "family string, centroid array<double>")
    named = correlate.assign(events, cents)
    assert {r.event_id: (r.family, r.family_basis) for r in named.collect()} == {"a": ("F001", "centroid similarity"), "b": ("F001", "centroid similarity"), "c": (None, "none")}
    judged = spark.createDataFrame([("a", "F009", 0.8, False), ("b", "F009", 0.8, True)], "event_id string, family string, match_strength double, novel boolean")
    assert {r.event_id: r.family for r in correlate.assign(events, cents, judged).collect()} == {"a": "F009", "b": None, "c": None}
    src = str(tmp_path / "in")
    named.coalesce(1).write.parquet(src)
    stream = correlate.correlate_stream(spark.readStream.schema(named.schema).parquet(src))
    e, a = str(tmp_path / "e"), str(tmp_path / "a")
    correlate.persist(stream, e, a, str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    newest, shown = correlate.snapshot(spark.read.parquet(e), spark.read.parquet(a), 2)
    assert [r.event_id for r in newest.collect()] == ["c", "b"] and [(r.alert_members, r.latency_minutes) for r in shown.collect()] == [(["a", "b"], 5.0)]


def test_online_assignment_equals_a_plain_fold(spark):
    rng = np.random.default_rng(2)
    base = np.eye(4)
    new = [(f"n{i:02d}", base[rng.integers(0, 3)] + rng.normal(scale=0.2, size=4), i) for i in range(30)]
    new = [(k, (v / np.linalg.norm(v)).tolist(), i) for k, v, i in new]
    fams = spark.createDataFrame([("F001", base[0].tolist(), 5)], "family string, centroid array<double>, size int")
    df = spark.createDataFrame(new, "incident_id string, v array<double>, at int").repartition(4)
    got = {r.incident_id: (r.family, r.created) for r in families.assign_batch(df, fams, "incident_id", "v", "at").collect()}
    cents, want = {"F001": [base[0], 5]}, {}
    for k, v, _ in new:
        v = np.array(v)
        best = max(cents, key=lambda f: (round(float(cents[f][0] @ v), 12), f))
        if cents[best][0] @ v >= 0.55:
            c, n = cents[best]
            c = (c * n + v) / (n + 1)
            cents[best] = [c / np.linalg.norm(c), n + 1]
            want[k] = (best, False)
        else:
            best = f"F{len(cents) + 1:03d}"
            cents[best] = [v, 1]
            want[k] = (best, True)
    assert got == want and len(cents) == 3


def test_dimension_matches(spark):
    d = fingerprints.dimension_match(F.col("a"), F.col("b"))
    m = fingerprints.family_match(F.col("a"), F.create_map(F.lit("x"), F.lit(0.25)))
    rows = spark.createDataFrame([("x", "x"), ("x", "y"), ("Unknown", "x")], "a string, b string").select(d, m).collect()
    assert [tuple(r) for r in rows] == [(1.0, 0.25), (0.0, 0.25), (None, None)]


def test_unified_log_is_complete(spark):
    from vigil.operators import unify

    log = spark.createDataFrame([("1", "Not Set", "n/a", "Software", None, "2024-01-01", "Unknown")], "incident_id string, impact string, urgency string, closure_code string, open_time string, resolved_time string, closure_class string")
    log = log.selectExpr("*", "'2' AS priority", "CAST(NULL AS string) AS status")
    r = unify.complete(log).first()
    assert (r.impact_source, r.priority_source, r.open_time_source, r.resolved_time_source, r.status_source, r.closure_class_source) == ("missing", "original", "missing", "original", "missing", "missing")
    assert r.title is None and r.title_source == "missing" and r.reopened_source == "derived" and unify.bad_provenance(unify.complete(log)).count() == 0


def test_flat_reports():
    from vigil.operators.evaluation import flatten

    assert flatten({"a": {"b": 1, "c": {"d": 0.5}}, "e": "text", "f": True}) == [("a.b", 1.0), ("a.c.d", 0.5)]
