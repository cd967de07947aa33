import random

import pytest

from vigil.operators import sweep as op


def roots(nodes, edges, t):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b, s in edges:
        if s >= t:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_every_threshold_equals_components_of_all_edges(spark, seed):
    rng = random.Random(seed)
    nodes = list(range(60))
    edges = [(rng.choice(nodes), rng.choice(nodes), rng.choice([0.4, 0.5, 0.55, 0.6, 0.7, 0.9])) for _ in range(25 + 25 * seed)] + [(3, 3, 0.9), (1, 2, 0.5), (2, 1, 0.8)]
    thresholds = [0.3, 0.5, 0.6, 0.85]
    df = spark.createDataFrame(edges, "a long, b long, score double")
    forest = op.spanning_forest(df).collect()
    assert len(forest) == len(nodes) - len(set(roots(nodes, edges, 0).values()))
    for t in thresholds + [0.55, 0.95]:
        assert roots(nodes, [(r.a, r.b, r.score) for r in forest], t) == roots(nodes, edges, t)
    known = spark.createDataFrame([(n, n % 7 or None) for n in nodes], "id long, label int")
    got = op.components_by_threshold(known, op.spanning_forest(df), thresholds, "id").collect()
    for t in thresholds:
        assert {r.id: r.root for r in got if r.threshold == t} == roots(nodes, edges, t)
    for r in op.sweep(known, df, thresholds, "id", "label").collect():
        of = roots(nodes, edges, r.threshold)
        pairs = [(a, b) for a in nodes for b in nodes if a < b]
        same = [(of[a] == of[b], (a % 7 or None) == (b % 7 or None)) for a, b in pairs]
        both, together, alike = sum(x and y for x, y in same), sum(x for x, _ in same), sum(y for _, y in same)
        assert (r.components, r.precision, r.recall) == (len(set(of.values())), both / together if together else 0, both / alike)


def test_no_edges(spark):
    known = spark.createDataFrame([(1, 1), (2, None)], "id long, label int")
    got = op.sweep(known, spark.createDataFrame([], "a long, b long, score double"), [0.5], "id", "label").collect()
    assert [tuple(r) for r in got] == [(0.5, 2, 1, 0.0, 0.0, 0.0)]


@pytest.mark.parametrize("one", [0, 40, 10**6])
def test_forests_of_blocks_connect_what_all_pairs_connect(spark, monkeypatch, one):
    import numpy as np

    from vigil.operators import groups

    rng = np.random.default_rng(7)
    x = rng.normal(size=(6, 5))[rng.integers(0, 6, 70)] + 0.5 * rng.normal(size=(70, 5))
    x[9] = x[3]  # equal vectors
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    monkeypatch.setattr(groups, "BLOCK", 20)
    monkeypatch.setattr(op, "ONE_TASK", one)
    df = spark.createDataFrame([(i, [float(y) for y in v], i % 3) for i, v in enumerate(x)] + [(70, None, 1)], "vec_id long, embedding array<double>, label int")
    pairs = groups.similar_pairs(df, 0.5)
    every = [tuple(r) for r in pairs.collect()]
    few = groups.similar_forest(df, 0.5).checkpoint()
    assert few.count() < len(every) / 2
    forest = [tuple(r) for r in op.spanning_forest(few).collect()]
    got = op.components_by_threshold(df, few.sparkSession.createDataFrame(forest, "a long, b long, score double"), [0.5, 0.9], "vec_id").collect()
    assert len(got) == 142
    for t in (0.5, 0.9):
        want = roots(range(71), every, t)
        assert roots(range(71), forest, t) == want and {r.vec_id: r.root for r in got if r.threshold == t} == want
    assert len(forest) == 71 - len(set(roots(range(71), every, 0.5).values()))
