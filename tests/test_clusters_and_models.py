import numpy as np
from pyspark.sql import functions as F

from vigil.operators import clusters, groups, models


def blobs(per=30, dim=32, seed=1):
    rng = np.random.default_rng(seed)
    base = np.eye(dim)[:3]
    return np.concatenate([b + rng.normal(0, 0.05, (per, dim)) for b in base]), np.repeat(np.arange(3), per)


def brute_average(x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    d, groups = 1 - x @ x.T, [[i] for i in range(len(x))]
    while len(groups) > k:
        _, i, j = min((d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


def test_average_linkage_equals_brute_force():
    x = np.random.default_rng(5).normal(size=(28, 4))
    tree = clusters.merges(x)
    for k in (2, 5, 11):
        labels = clusters.cut(28, tree, k=k)
        assert {frozenset(np.flatnonzero(labels == c)) for c in range(k)} == brute_average(x, k)


def test_three_blobs_are_three_pure_families(spark):
    x, truth = blobs()
    labels = clusters.best_cut(x, range(2, 7))
    assert labels.max() == 2 and all(len(set(truth[labels == c])) == 1 for c in range(3))
    df = spark.createDataFrame([("g", int(i), [float(y) for y in v]) for i, v in enumerate(x)], "grp string, id int, v array<float>")
    got = {r.id: r.cluster for r in clusters.cluster_groups(df, "grp", "id", "v").collect()}
    assert len({(got[i], t) for i, t in enumerate(truth)}) == 3
    fam = df.withColumn("family", F.concat(F.lit("F"), F.floor(F.col("id") / 30).cast("string")))
    near = clusters.nearest_family(df, fam, "id", "v", "family", 0.5).collect()
    assert all(r.family == f"F{truth[r.id]}" for r in near)


def test_large_groups_are_clustered_whole(spark, monkeypatch):
    x, truth = blobs(per=110)
    rows = [("big", int(i), [float(y) for y in v]) for i, v in enumerate(x)] + [("small", 1000 + i, [float(y) for y in x[i]]) for i in range(9)]
    df = spark.createDataFrame(rows, "grp string, id int, v array<float>")
    exact = {r.id: r.cluster for r in clusters.cluster_groups(df, "grp", "id", "v").collect()}
    monkeypatch.setattr(clusters, "MOST", 40)
    got = clusters.cluster_groups(df, "grp", "id", "v").collect()
    assert {r.id: r.cluster for r in got} == exact and len(got) == len(rows) and len({exact[i] for i in range(330)}) == 3
    assert {(r.grp, r.method) for r in got} == {("big", "average linkage"), ("small", "average linkage")}


def test_components_of_a_long_chain(spark):
    # Where labels move a node a round: 0 - 299 - 298 - ... - 1, beside a shuffled chain, a pair and single nodes.
    order = 1000 + np.random.default_rng(4).permutation(300)
    links = [(0, 299), *[(i + 1, i) for i in range(1, 299)], *zip(order[:-1].tolist(), order[1:].tolist()), (2001, 2000), (3000, 9999), (3001, 9999)]
    nodes = [*range(300), *range(1000, 1300), 2000, 2001, 3000, 3001]
    got = groups.component_roots(spark.createDataFrame([(i,) for i in nodes], "id long"), spark.createDataFrame(links, "a long, b long"), "id")
    want = {i: 0 if i < 300 else 1000 if i < 1300 else 2000 if i < 3000 else i for i in nodes}
    assert {r.id: r.root for r in got.collect()} == want


def test_burst_alerts_link_across_users_and_by_vectors(spark, tmp_path):
    from datetime import datetime, timedelta

    from vigil.plans.catalog import registry

    start = datetime(2024, 1, 1, 8, 0)
    rows = [(1, 0, 10, "error"), (2, 20, 11, "error"), (3, 45, 12, "error"), (4, 46, 13, "login"), (5, 300, 10, "error"), (6, 310, 14, "click"), (7, 325, 15, "view")]
    events = [(i, start + timedelta(minutes=m), u, f) for i, m, u, f in rows]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(6, [1.0, 0.0]), (7, [0.95, 0.3122]), (4, [0.0, 1.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.event_id: (list(r.members), r.alert_id, r.detected) for r in registry()["burst_alerts"][0](spark, str(tmp_path)).collect()}
    assert got == {
        "1": (["1"], None, False), "2": (["1", "2"], "CORR-2", True), "3": (["2", "3"], "CORR-2", False), "4": (["4"], None, False),
        "5": (["5"], None, False), "6": (["6"], None, False), "7": (["6", "7"], "CORR-7", True),
    }


def test_models(spark):
    rows = [(f"disk full on node {i}", "storage", i % 5 + 0.0, float(i % 2)) for i in range(40)] + [(f"login fails for user {i}", "access", 30.0 + i % 5, float(i % 2)) for i in range(40)] + [("odd", "rare", 1.0, 0.0)]
    df = spark.createDataFrame(rows, "text string, category string, hours double, y double")
    model = models.text_classifier(df, "text", "category")
    out = model.transform(df.withColumn("weight", F.lit(1.0)).filter("category <> 'rare'"))
    assert out.filter("prediction = __label").count() == 80
    q = {r.category: round(r.median, 6) for r in models.duration_quantiles(df, "category", "hours").collect()}
    assert q["storage"] == 2.0 and q["access"] == 32.0
    a, b = models.platt(df.withColumn("s", F.col("y") * 2 - 1 + (F.col("hours") % 3) * 0.7), "s", "y")
    assert a > 0
    scores = spark.createDataFrame([(0.6 + i / 250, True) for i in range(100)] + [(i / 100, False) for i in range(20)], "s double, known boolean")
    t = models.novelty_threshold(scores, "s", "known").first()[0]
    assert scores.filter(f"known AND s < {t}").count() <= 2 and scores.filter(f"NOT known AND s < {t}").count() == 20
