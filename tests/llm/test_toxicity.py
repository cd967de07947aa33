import random

import numpy as np

from vigil.llm import toxicity as op

RUDE = ["idiot", "moron", "pathetic", "worthless", "scumbag"]


def sample(n, seed):
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in ("pump", "valve", "disk", "cable", "router") for b in ("ing", "ed", "s", "room", "line")]
    texts, labels = [], []
    for i in range(n):
        t = [rng.choice(plain) for _ in range(rng.randrange(5, 60))]
        if i % 3 == 0:
            for _ in range(1 + len(t) // 15):
                t.insert(rng.randrange(len(t)), rng.choice(RUDE))
        texts.append(" ".join(t))
        labels.append(int(i % 3 == 0))
    return texts, labels


def test_held_out_accuracy_and_unseen_misspellings():
    model = op.fit(*sample(600, 1), 1 / 3)
    texts, labels = sample(300, 2)
    got = op.score_texts(texts, model)
    assert ((got >= 0.5) == labels).mean() > 0.97
    plain, odd = op.score_texts(["pumping valves diskroom cableline", "pumping valves diskroom you idiott"], model)
    assert odd > plain + 0.2
    again = op.fit(*sample(600, 1), 1 / 3)
    assert (again.weight == model.weight).all() and again.bias == model.bias


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op.op7_toxicity(spark, sf).collect()}
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert len(rows) == docs and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    held = [i for i in truth if rows[i].held_out]
    assert held and np.mean([rows[i].predicted == truth[i] for i in held]) > 0.85


def test_nulls_repeats_clashes_one_class_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, 5.0), (1, "a b", 5.0), (1, "a b", 5.0), (None, "", 5.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 1), (None, 0), (2, None)], "doc_id long, toxic int")
    model = op.train(docs, labels.filter("toxic = 1"))
    got = op.score(docs, model)
    assert got.columns == ["doc_id", "text", "score", "predicted"] and {r.predicted for r in got.collect()} == {1}
    assert op.score(docs.limit(0), op.train(docs.limit(0), labels.limit(0))).count() == 0
    assert all(0 <= r.score <= 1 for r in op.score(docs, op.train(docs, labels)).collect())


def test_scores_equal_a_plain_forward_pass():
    """By loops over characters: n-grams of each word between < and >, their mean, the weighted mean over words, the logistic function."""
    from collections import Counter
    from math import exp, log

    import xxhash

    rng = np.random.default_rng(3)
    model = op.Model(rng.normal(size=op.BUCKETS), 0.3)
    texts = ["You (idiot)! you you", "", None, "a", "É.. ünïcode <tag> -", "  ", "word " * 50 + "x"]
    for text, got in zip(texts, op.score_texts(texts, model)):
        total = weight = 0.0
        for word, n in Counter((text or "").lower().split()).items():
            w = "<" + word.strip(".,;:!?\"'()[]{}<>*#%&$|-_") + ">"
            pieces = [w] + [w[i : i + k] for k in (3, 4, 5) for i in range(len(w)) if i + k <= len(w)]
            value = sum(model.weight[xxhash.xxh3_64_intdigest(x.encode()) % op.BUCKETS] for x in pieces) / len(pieces)
            total, weight = total + (1 + log(n)) * value, weight + 1 + log(n)
        assert abs(got - 1 / (1 + exp(-((total / weight if weight else 0.0) + 0.3)))) < 1e-9


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(1)
    batch = op.Batch(np.array([0, 1, 1, 2]), np.array([0.5, 0.5, 1.0, 1.0]), np.array([0, 0, 1, 2]), np.array([3, 4, 4, 5, 6, 3]), np.array([2, 1, 3]), np.array([1, 0, 1]))
    values = [rng.normal(size=(9, 4)), rng.normal(size=(4, 2)), rng.normal(size=2)]
    _, grads = batch.gradients(*values)
    for x, g in zip(values, grads):
        for at in np.ndindex(x.shape):
            kept = x[at]
            x[at] = kept + 1e-6
            up = batch.gradients(*values)[0]
            x[at] = kept - 1e-6
            down = batch.gradients(*values)[0]
            x[at] = kept
            assert abs((up - down) / 2e-6 - g[at]) < 1e-6


def test_very_long_texts_are_scored_whole_and_not_learned_from(spark):
    long = "pump valve " * 40_000
    texts, labels = sample(60, 5)
    docs = spark.createDataFrame([*enumerate(texts), (900, long), (901, long + "idiot " * 40_000)], "doc_id long, text string")
    marked = spark.createDataFrame([*enumerate(labels), (900, 1), (901, 0)], "doc_id long, toxic int")
    scores = {r.doc_id: r.score for r in op.score(docs, op.train(docs, marked)).collect()}
    assert scores[901] > scores[900]
