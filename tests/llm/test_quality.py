from tests.llm.oracle import compare
from vigil.llm import quality as op


def test_query_equals_sql(spark, sf):
    got = compare(spark, op.op6_quality_rules, op.SQL, sf)
    assert any(r[3] for r in got) and not all(r[3] for r in got)


def brute(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
    seen = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    return len(words), len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)})


TEXTS = ["", "a b c d e", "a b c d e a b c d e", "a a a a a a", "x y z w v u x y z w v q x y z w v", "a\tb\x0bc\rd e\nf g h i j k", "a b c d e f " * 3]


def test_windows_against_brute_force(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_repeat_words) for r in op.judge(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


GOOD = "The pump failed at night, and the crew changed the seal before the morning shift came in."


def test_lines(spark):
    texts = {1: GOOD, 2: GOOD + "\nHome | News | Sport | Weather | Login", 3: "THE PUMP FAILED AT NIGHT\n" * 1 + "a short tail of five", 4: "one## two$$ three%% four&& five** six## seven$$ eight%% nine&& ten**", 5: GOOD + "\nAll rights reserved."}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in op.judge(df).collect()}
    assert [got[i].kept for i in range(1, 6)] == [True, True, True, False, True]
    assert got[2].cleaned == GOOD and got[5].cleaned == GOOD and got[1].cleaned == GOOD


def test_nulls_repeats_clashes_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, 1), (1, GOOD, 2), (1, GOOD, 3), (None, "", 4)], "doc_id long, text string, kept int")
    got = op.keep_good(df)
    assert got.columns == df.columns and sorted(r.kept for r in got.collect()) == [2, 3]
    assert op.judge(df).filter("base_failed").count() == 2
    assert op.keep_good(df.limit(0)).count() == 0
    more = df.selectExpr("*", "1 AS __text", "2 AS __lines", "3 AS __doc", "4 AS __low", "5 AS __stop")
    assert op.keep_good(more).columns == more.columns and {(r["__text"], r["__doc"], r["__low"]) for r in op.judge(more).collect()} == {(1, 3, 4)}


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i % 7919}x{i % 104729}" for i in range(300_000)))], "doc_id long, text string")
    assert op.judge(df).select("n_words", "n_repeat_words").first() == (300_000, 0)


def test_plan_is_native_and_has_no_shuffle(spark, sf):
    plan = op.op6_quality_rules(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
