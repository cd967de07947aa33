from tests.llm.oracle import compare
from vigil.llm import exact_dedup as op
from vigil.llm.shared import work_path


def test_query_equals_sql(spark, sf):
    assert compare(spark, op.op8_exact_dedup, op.SQL, sf)


SCHEMA = "doc_id long, text string, keep_id string, __row int, row int, doc int, digest int, key int, _metadata int"


def test_nulls_ties_and_clashes(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "a", "z"), (3, "a", "z"), (None, "a", "w"), (None, "b", "v")]
    df = spark.createDataFrame([(*r, 0, 0, 0, 0, 0, 0) for r in rows], SCHEMA)
    got = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in op.groups(df, op.fresh_index(spark)).collect())
    assert got == [(0, 0, 1, True), (0, 3, 3, False), (1, 2, 2, False), (2, 2, 2, True), (3, 3, 3, False), (3, 3, 3, True)]
    kept = op.dedup(df, op.fresh_index(spark), "b")
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "", r.keep_id) for r in kept.collect()) == [(0, "b", "v"), (2, "", "y"), (3, "a", "z")]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert op.decide(df, op.fresh_index(spark), "b").count() == 0 and op.groups(df, op.fresh_index(spark)).count() == 0
    assert op.dedup(df, op.fresh_index(spark), "b").count() == 0


def test_later_batches_meet_the_persistent_index(spark):
    path = work_path(spark, "idx")
    first = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    second = spark.createDataFrame([(9, "a"), (8, "c"), (7, "c")], "doc_id long, text string")
    assert op.dedup(first, op.DigestIndex(spark, path, 4), "one").count() == 2
    spark.sql(f"DROP TABLE {op.DigestIndex(spark, path, 4).table}")  # as in a new session; the files stay
    index = op.DigestIndex(spark, path, 4)
    got = sorted((r.doc_id, r.keep_id, r.kept) for r in op.decide(second, index, "two").collect())
    assert got == [(7, 8, False), (8, 8, True), (9, 1, False)]
    again = sorted((r.doc_id, r.keep_id, r.kept) for r in op.decide(second, index, "two").collect())
    assert again == got and spark.table(index.table).count() == 3


def test_the_index_side_of_the_anti_join_is_not_shuffled(spark):
    index = op.DigestIndex(spark, work_path(spark, "idx"), 4)
    groups = spark.range(10).selectExpr("unhex(sha2(cast(id as string), 256)) AS digest").repartition(3)
    joined = groups.hint("merge").join(spark.table(index.table).select("digest"), "digest", "left_anti")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("hashpartitioning") == 1


def test_a_batch_read_again_in_other_partitions_keeps_every_text_once(spark):
    rows = [(i % 3, f"text {i % 7}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index, first = op.fresh_index(spark), None
    for n in (3, 2, 1):
        got = sorted((r.doc_id, r.text) for r in op.dedup(df.repartition(n), index, "b").collect())
        assert len(got) == 7 and got == (first or got)
        first = got
    assert spark.table(index.table).count() == 7


def test_the_second_batch_of_the_query_meets_the_first_in_the_index(spark, sf):
    index = op.fresh_index(spark)
    rows = op.groups(spark.read.parquet(f"{sf}/documents.parquet"), index).collect()
    entries = {r.batch: r["count"] for r in spark.table(index.table).groupBy("batch").count().collect()}
    assert sum(entries.values()) == sum(r.kept for r in rows) < len(rows)
    low = max(r.doc_id for r in rows) // 2
    assert any(r.doc_id <= low < r.keep_id for r in rows) and entries["upper"] < sum(r.doc_id > low for r in rows)


def test_scanned_files_are_not_written_again_and_repeated_rows_are_told_apart(spark, tmp_path):
    from vigil.llm.shared import identified

    spark.createDataFrame([(1, "a")] * 5, "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    rows = identified(docs, "x")
    assert rows.select("row").distinct().count() == 5 and rows.inputFiles()[0].startswith(f"file://{tmp_path}")
    assert identified(docs.selectExpr("*", "explode(array(1, 2)) AS k"), "x").select("row").distinct().count() == 10
    assert op.dedup(docs, op.fresh_index(spark), "b").count() == 1


def test_a_very_long_text(spark):
    long = "word " * 400_000
    df = spark.createDataFrame([(1, long), (2, long), (3, long + "x")], "doc_id long, text string")
    assert sorted(r.doc_id for r in op.dedup(df, op.fresh_index(spark), "b").collect()) == [2, 3]
