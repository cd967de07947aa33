import hashlib
import math
import random

import numpy as np
import pytest

from tests.llm.oracle import compare
from vigil.llm import codes as op
from vigil.llm.ball_tree import BallTree, integers


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """rows: (id, vector, label) of one length. (code, error) a row and the codebooks, in Python integers."""
    ints = [[math.floor(x * scale) if abs(x) < 1e300 else math.floor(x) * scale for x in v] for _, v, _ in rows]
    w = len(ints[0]) // parts
    cut = [[v[p * w : p * w + w] for p in range(parts)] for v in ints]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    books = [[cut[i][p] for i in order] for p in range(parts)]
    near = lambda x, b: min((sum((s - t) ** 2 for s, t in zip(x, e)), k) for k, e in enumerate(b))
    for _ in range(rounds):
        for p in range(parts):
            got = [near(v[p], books[p])[1] for v in cut]
            for k in range(len(books[p])):
                mine = [v[p] for v, g in zip(cut, got) if g == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
    return [("".join(f"{k:02x}" for _, k in x), sum(d for d, _ in x)) for x in last], hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def test_query_equals_sql(spark, sf):
    assert len(compare(spark, op.op13_vector_codes, op.SQL, sf)) > 0


def test_larger_set_equals_sql(spark):
    assert len(compare(spark, op.op13_vector_codes, op.SQL, "/root/testdata/sf0.01")) == 500


@pytest.mark.parametrize("kind", ["wide", "ties", "huge"])
def test_tree_equals_comparing_all(kind):
    rng = np.random.default_rng(7)
    for n in (1, 2, 3, 16, 40):
        top = {"wide": 5_000, "ties": 2, "huge": 3}[kind]
        entries, queries = rng.integers(-top, top + 1, (n, 4)), rng.integers(-top, top + 1, (300, 4))
        if kind == "huge":
            entries, queries = (x.astype(object) * 10**40 for x in (entries, queries))
        d = ((queries[:, None, :].astype(object) - entries[None].astype(object)) ** 2).sum(2)
        want = [min(range(n), key=lambda e: (row[e], e)) for row in d.tolist()]
        best, error = BallTree(integers(entries)).nearest(integers(queries))
        assert best.tolist() == want and error.tolist() == [row[e] for row, e in zip(d.tolist(), want)]


SCHEMA = "vec_id long, embedding array<double>, label int, id int, v int"


def check(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(3)
    coded, books = op.encode(df, **kw)
    want, sha = brute([r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])], **kw)
    top = (1 << 63) - 1
    assert sorted((r.code, r.error) for r in coded.collect()) == sorted((c, e) for c, e in want) or max(e for _, e in want) > top
    assert sorted(r.code for r in coded.collect()) == sorted(c for c, _ in want)
    assert op.codebooks_sha256(books) == sha
    return coded


def test_ties_repeats_and_unused_entries(spark):
    rng = random.Random(2)
    rows = [(i // 2, [float(rng.randrange(-2, 3)) / 4096 for _ in range(16)], i % 3 or None) for i in range(200)]
    rows += [(1_000 + i, [float("nan")] * 16, 1) for i in range(2)] + [(2_000, None, 1), (2_001, [None] * 16, 1), (2_002, [math.inf] * 16, 2), (None, [0.5] * 16, None)]
    coded = check(spark, rows)
    assert coded.count() == 201


@pytest.mark.parametrize("size", [1e8, 1e18, 1e200, 1e305])
def test_components_of_any_size(spark, size):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-size, size) for _ in range(8)], 0) for i in range(60)]
    coded = check(spark, rows, parts=4, entries=4, rounds=3)
    if size > 1e17:
        assert coded.filter("error IS NULL").count() > 0


def test_other_lengths_few_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, [0.5] * 8, 1, 0, 0), (2, [1.0] * 4, 1, 0, 0), (3, [], 1, 0, 0), (4, [0.25] * 8, None, 0, 0)], SCHEMA)
    got = {r.id: (r.code, r.error) for r in op.encode(df)[0].collect()}
    assert got == {1: ("00" * 8, 0), 2: (None, None), 3: (None, None), 4: ("01" * 8, 0)}
    coded, books = op.encode(df.filter("vec_id = 2"))
    assert books == [] and [tuple(r) for r in coded.collect()] == [(2, 1, None, None)]
    assert op.encode(df.limit(0))[0].count() == 0


def test_digits():
    for x in (0, 5, -5, 1 << 40, -(1 << 90) - 3, 10**50):
        assert sum(d << (op.LIMB * i) for i, d in enumerate(op.digits(x))) == x
