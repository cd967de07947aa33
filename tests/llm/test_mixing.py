from collections import defaultdict

from tests.llm.oracle import compare
from vigil.llm import mixing as op


def test_query_equals_sql_and_comes_near_targets(spark, sf):
    got = compare(spark, op.op9_mix_sources, op.SQL, sf)
    by = defaultdict(lambda: [0, 0.0, 0, 0])
    for copies, _doc, size, source, source_size, taken, target in got:
        assert taken <= 3 * size and taken == copies * size
        b = by[source]
        b[0] += taken
        b[1], b[2], b[3] = target, source_size, max(b[3], size)
    for taken, target, source_size, longest in by.values():
        assert target <= 3 * source_size + 1e-6 and abs(taken - target) <= 2 * longest + 1
    assert abs(sum(b[1] for b in by.values()) - sum(b[2] for b in by.values())) < 1e-3


def test_larger_set_equals_sql(spark):
    assert len(compare(spark, op.op9_mix_sources, op.SQL, "/root/testdata/sf0.01")) == 1000


SCHEMA = "doc_id long, text string, source string, copies int"
CLASHES = SCHEMA + ", __row int, __copies int, row int, col int, sid int"


def test_nulls_zero_sizes_caps_and_clashes(spark):
    rows = [(1, "a b c", "s1", 0), (1, "a b c", "s1", 0), (2, None, "s2", 0), (3, "a " * 50, None, 0), (None, "", None, 0)]
    df = spark.createDataFrame([(*r, 0, 0, 0, 0, 0) for r in rows], CLASHES)
    got = op.plan(df).collect()
    assert len(got) == 5
    t = {r.source: (r.source_size, r.target) for r in got}
    # s1 weighs 5 of 8, but stops at three times its six words; s2 has none; the rest goes to the null source.
    assert t == {"s1": (6, 18.0), "s2": (0, 0.0), None: (50, 38.0)}
    assert [r.taken for r in got if r.source == "s1"] == [9, 9]
    mixed = op.mix(df)
    assert mixed.columns == df.columns and mixed.filter("source = 's1'").count() == 6


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert op.plan(df).count() == 0 and op.mix(df).count() == 0


def test_partitions_do_not_change_the_draw(spark):
    df = spark.createDataFrame([(i, "w " * (i % 7 + 1), f"s{i % 3}", 0) for i in range(500)], SCHEMA)
    one = sorted((r.doc_id, r.copies) for r in op.plan(df.coalesce(1)).collect())
    many = sorted((r.doc_id, r.copies) for r in op.plan(df.repartition(7)).collect())
    assert one == many


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "w " * 500_000, "a", 0), (2, "w w", "b", 0)], SCHEMA)
    assert {r.doc_id: r["size"] for r in op.plan(df).collect()} == {1: 500_000, 2: 2}
