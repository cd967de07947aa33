import pytest
from pyspark.sql import functions as F

from vigil.streaming.evolution import Evolution

SCHEMA = "id string, seq long, text string"


def batch(spark, log, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(log)


def made(spark, path, **more):
    return Evolution(spark, f"{path}/kb", spark.createDataFrame([], SCHEMA).schema, "id", "seq", {"no text": F.length("text") > 0}, **more)


def state(e):
    added = {r["id"]: (r["text"], r["batch"]) for r in e.added().collect()}
    failed = {(r["id"], r["reason"], r["attempts"]) for r in e.failures().collect()}
    return added, failed


def length(record):
    if record["text"] == "bad":
        raise ValueError("cannot read it")
    return {"n": len(record["text"])}


def test_bad_records_stop_nothing_and_are_tried_again(spark, tmp_path):
    e = made(spark, str(tmp_path), each=length)
    batch(spark, f"{tmp_path}/log", [("a", 1, "one"), ("b", 1, "bad"), ("c", 1, None), (None, 1, "x"), ("d", 1, "old"), ("d", 2, "new"), ("d", 2, "new")])
    assert e.run(f"{tmp_path}/log") == 1
    added, failed = state(e)
    assert added == {"a": ("one", 0), "d": ("new", 0)}
    assert failed == {("b", "ValueError: cannot read it", 1), ("c", "no text", 1), (None, "no id", 1)}
    assert {r["id"]: r["result"] for r in e.added().collect()} == {"a": '{"n": 3}', "d": '{"n": 3}'}
    batch(spark, f"{tmp_path}/log", [("b", 2, "good"), ("a", 9, "again")])
    assert e.run(f"{tmp_path}/log") == 1 and e.run(f"{tmp_path}/log") == 0
    added, failed = state(e)
    assert added == {"a": ("one", 0), "d": ("new", 0), "b": ("good", 1)}
    assert failed == {("c", "no text", 2), (None, "no id", 1)}


def test_a_run_that_breaks_off_is_repeated_with_the_same_result(spark, tmp_path):
    rows = [[("a", 1, "one"), ("b", 1, "")], [("c", 1, "two"), ("b", 2, "three")], [("d", 1, "four")]]
    for where in ("before", "between", "after"):
        path = f"{tmp_path}/{where}"
        broken, sound = made(spark, path), made(spark, path)
        take = broken.take

        def stops(df, number, take=take, where=where):
            if number == 1 and where == "before":
                raise RuntimeError("lost")
            take(df, number)
            if number == 1 and where == "between":  # as if the failures had not been written yet
                at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/kb/failed/batch=1")
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            if number == 1:
                raise RuntimeError("lost")

        broken.take = stops
        batch(spark, f"{path}/log", rows[0])
        broken.run(f"{path}/log")
        batch(spark, f"{path}/log", rows[1])
        with pytest.raises(Exception, match="lost"):
            broken.run(f"{path}/log")
        batch(spark, f"{path}/log", rows[2])
        sound.run(f"{path}/log")
        assert state(sound) == ({"a": ("one", 0), "b": ("three", 1), "c": ("two", 1), "d": ("four", 2)}, set())
        assert sound.added().count() == 4


def test_what_process_adds_is_stored_and_a_batch_can_be_cut_by_files(spark, tmp_path):
    e = made(spark, str(tmp_path), process=lambda df: df.withColumn("size", F.length("text")))
    for i in range(3):
        batch(spark, f"{tmp_path}/log", [(f"r{i}", i, "x" * (i + 1))])
    assert e.run(f"{tmp_path}/log", files_per_batch=1) == 3
    assert sorted((r["id"], r["size"]) for r in e.added().collect()) == [("r0", 1), ("r1", 2), ("r2", 3)]
    assert e.failures().count() == 0
