import random
from collections import Counter

import numpy as np

from vigil.llm import near_dedup as op
from vigil.llm.components import components


def brute_classes(texts, threshold=0.8):
    """Classes by comparing all pairs that share a shingle."""
    bags = []
    for t in texts:
        w = (t or "").encode().split()
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)]) if w else Counter())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, b in enumerate(bags):
        for s in b:
            by.setdefault(s, []).append(i)
    pairs = {(i, j) for at in by.values() for i in at for j in at if i < j}
    pairs |= {(i, j) for i in range(len(texts)) for j in range(i) if not bags[i] and (texts[i] or "") == (texts[j] or "")}
    for i, j in pairs:
        a, b = bags[i], bags[j]
        union = (a | b).total()
        if not union or (a & b).total() >= threshold * union:
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def test_registers_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = rng.integers(1, 12, 300), rng.integers(1, 12, 300)
    s = op.signatures([(np.sort(keys), a), (np.sort(keys), b)], 4096)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((s[0] == s[1]).mean() - true) < 4 * (true * (1 - true) / 4096) ** 0.5
    assert op.similarity((np.sort(keys), a), (np.sort(keys), b)) == true
    one = op.signatures([(keys[:1], np.array([1])), (keys[:1], np.array([4]))], 2048)
    assert abs((one[0] == one[1]).mean() - 0.25) < 0.05


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 400)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert set(got.values()) == {0, 100} and sum(v == 0 for v in got.values()) == 61 and len(got) == 361
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def classes_of(df):
    rows = op.classes(df).collect()
    return {r.doc_id: r.class_id for r in rows}, rows


def test_whole_table_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    root = brute_classes([d.text for d in docs])
    got, rows = classes_of(spark.read.parquet(f"{sf}/documents.parquet"))
    assert got == {d.doc_id: docs[root[i]].doc_id for i, d in enumerate(docs)}
    assert sum(r.kept for r in rows) == len(set(root)) < len(docs)


def test_chains_and_borderline_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for g in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(120)]
        for _ in range(12):
            texts.append(" ".join(base))
            for _ in range(rng.choice([1, 2, 3])):
                base[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
    texts += ["a a a a a a a a"] * 2 + ["a a a a a a a a a", "one two three", "one  two three", "one two", "", None, " "]
    root = brute_classes(texts)
    got, _ = classes_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert got == dict(enumerate(root))


def test_large_group_costs_no_square(spark, monkeypatch):
    compared = []
    links = op._links
    monkeypatch.setattr(op, "_links", lambda pairs, *a: compared.append(pairs.count()) or links(pairs, *a))
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join([*base[:k], f"edit{k}", *base[k + 1 :]]) for k in range(300)] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = op.classes(df).collect()
    assert {(r.class_id, r.class_size, r.n_copies) for r in rows} == {(0, 600, 2)} and sum(compared) < 300 * 20


def test_unlinked_texts_of_a_bucket_are_not_compared_by_text(spark, monkeypatch):
    """Texts that share half their words: buckets bring some together, sketches keep all but a few from verification."""
    compared = []
    links = op._links
    monkeypatch.setattr(op, "_links", lambda pairs, *a: compared.append(pairs.count()) or links(pairs, *a))
    texts = [" ".join([*(f"w{i}" for i in range(150)), *(f"x{k}y{i}" for i in range(60))]) for k in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert op.classes(df).select("class_id").distinct().count() == 300 and sum(compared) < 0.05 * 300 * 299 / 2


def test_loose_groups_are_not_compared_by_text(spark, monkeypatch):
    """60 copies with an edit or none, 200 with four or five: those are at 0.7 to 0.8 to the others, too close for register sketches to tell from links."""
    compared = []
    links = op._links
    monkeypatch.setattr(op, "_links", lambda pairs, *a: compared.append(pairs.count()) or links(pairs, *a))
    rng = random.Random(5)
    texts = []
    for k in range(260):
        words = [f"w{i}" for i in range(150)]
        for i in rng.sample(range(150), rng.choice([0, 1]) if k < 60 else rng.choice([4, 5])):
            words[i] = f"x{k}y{i}"
        texts.append(" ".join(words))
    got, _ = classes_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    root = brute_classes(texts)
    assert got == dict(enumerate(root)) and len(set(root)) > 50
    assert sum(compared) < 3_000, compared


def test_parities_bound_similarity(spark):
    """No pair at or above the threshold is refused, few below it are let through, whatever the copies and the numbers of slots."""
    rng, bags = np.random.default_rng(6), []
    for k in range(60):
        n = int(rng.choice([3, 9, 100, 127, 129, 250]))
        keys, counts = np.sort(rng.integers(0, 2**63, n).astype(np.uint64)), rng.integers(1, 4, n)
        bags.append((keys, counts))
        for _ in range(4):
            other, c = keys.copy(), counts.copy()
            at = rng.random(n) < rng.choice([0.02, 0.1, 0.2])
            other[at] = rng.integers(0, 2**63, int(at.sum())).astype(np.uint64)
            c[rng.random(n) < 0.05] += 1
            order = np.argsort(other)
            bags.append((other[order], c[order]))
    # One shingle more or less than a threshold exactly met.
    exact = np.sort(rng.integers(0, 2**63, 50).astype(np.uint64))
    bags += [(exact[:n], np.ones(n, np.int64)) for n in (4, 5, 39, 40, 50)]
    planes = {f"s{k}": 0 for k in range(2 * op.BITS)}
    rows = [(i, int(c.sum()), *planes.values(), op.parities(h, c).tolist()) for i, (h, c) in enumerate(bags)]
    df = spark.createDataFrame(rows, f"i int, size long, {', '.join(f'{p} long' for p in planes)}, odd array<long>")
    passed = {(r.i, r.j) for r in df.alias("x").join(df.alias("y"), op._close("x", "y", 0.8)).selectExpr("x.i AS i", "y.i AS j").collect()}
    true = {(i, j) for i, a in enumerate(bags) for j, b in enumerate(bags) if op.similarity(a, b) >= 0.8}
    assert true <= passed and len(true) > 400 and len(passed - true) < 0.2 * len(true)
    assert {(305 - 5 + i, 305 - 5 + j) for i, j in ((0, 1), (3, 4))} <= true


def test_recall_of_bands_and_sketches():
    """At similarity 0.8 to 0.9, pairs that meet in a band and pass the sketch, over all pairs."""
    rng = np.random.default_rng(2)
    found = total = 0
    for _ in range(400):
        keys, n = rng.integers(0, 2**63, 400).astype(np.uint64), int(rng.integers(20, 45))
        one = np.sort(keys), np.ones(400, np.int64)
        other = np.sort(np.r_[keys[n:], rng.integers(0, 2**63, n).astype(np.uint64)]), np.ones(400, np.int64)
        if op.similarity(one, other) >= 0.8:
            s = op.signatures([one, other])
            bands, x = op.band_hashes(s), op.sketches(s).view(np.uint8).reshape(2, op.BITS, 16)
            bits = np.unpackbits(np.bitwise_or.reduce(x[0] ^ x[1]))
            total += 1
            found += bool((bands[0] == bands[1]).any() and bits.sum() <= op.DIFFERENT)
    assert total > 300 and found >= 0.98 * total


def test_very_long_texts(spark):
    words = [f"w{i % 5000}x{i % 7919}" for i in range(200_000)]
    texts = [" ".join(words), " ".join([*words[:-500], *(["z"] * 500)]), " ".join(reversed(words))]
    got, _ = classes_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert got == {0: 0, 1: 0, 2: 2}


def test_nulls_ties_clashes_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f", "p", 0, 0, 0), (4, "a b c d e f", "q", 0, 0, 0), (4, "a b c d e f", "q", 0, 0, 0), (9, None, "r", 0, 0, 0), (8, "", "s", 0, 0, 0)], "doc_id long, text string, class_id string, __row int, n int, key int")
    kept = op.dedup(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text, r.class_id) for r in kept.collect()) == [(4, "a b c d e f", "q"), (8, "", "s")]
    assert op.dedup(df.limit(0)).count() == 0 and op.classes(df.limit(0)).count() == 0
