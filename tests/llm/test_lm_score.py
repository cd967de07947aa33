import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from vigil.llm import lm_score as op
from vigil.llm.elias_fano import BigramTrie, EliasFano


def test_elias_fano_access_and_search():
    rng = np.random.default_rng(2)
    for n, top in [(0, 1), (1, 1), (500, 3), (3000, 10**9), (4000, 4100)]:
        values = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        s = EliasFano.build(values)
        ef = EliasFano(*s)
        if n:
            assert (ef.access(np.arange(n)) == values).all()
        wanted = np.r_[values, rng.integers(0, top + 5, 200).astype(np.uint64)]
        zero = np.zeros(len(wanted), np.int64)
        if n:
            at = ef.find(wanted, zero, zero + n)
            there = np.isin(wanted, values)
            assert ((at >= 0) == there).all() and (values[at[there]] == wanted[there]).all()
            low, high = np.searchsorted(values, wanted[:n]), np.searchsorted(values, wanted[:n], "right")
            assert ((at[:n] >= low) & (at[:n] < high)).all()


def test_trie_finds_each_pair_and_no_other():
    rng = np.random.default_rng(3)
    pairs = np.unique(rng.integers(0, 60, (900, 2)), axis=0)
    v, w = pairs[:, 0].astype(np.uint64), pairs[:, 1].astype(np.uint64)
    p = (1 + np.arange(len(v))).astype(np.uint16)
    b = (1 + np.unique(v)).astype(np.uint16)
    trie = BigramTrie.mapped(BigramTrie.build(v, w, p, b))
    gv, gw = (x.reshape(-1).astype(np.uint64) for x in np.meshgrid(np.arange(70), np.arange(70)))
    got_p, got_b = trie.lookup(gv, gw)
    want = {(int(x), int(y)): int(z) for x, y, z in zip(v, w, p)}
    assert [int(x) for x in got_p] == [want.get((int(x), int(y)), 0) for x, y in zip(gv, gw)]
    assert all(int(z) == (int(x) + 1 if x in v else 0) for x, z in zip(gv, got_b))
    empty = BigramTrie.mapped(op.train(*[np.zeros(0, np.uint64)] * 2, np.zeros(0, np.int64)))
    assert empty.lookup(gv, gw)[0].sum() == 0


def test_lookups_cost_a_few_selects_a_pair(monkeypatch):
    """Equal contexts in a row are looked up once, and the answers are those of a dictionary."""
    asked, select = [], EliasFano._select
    monkeypatch.setattr(EliasFano, "_select", lambda self, k, *a: asked.append(len(k)) or select(self, k, *a))
    rng = np.random.default_rng(9)
    for top in (5_000, 1 << 40):  # the latter don't fit one sort of 64 bits
        pairs = np.unique(np.stack([rng.integers(0, 40, 8000), rng.integers(0, top, 8000)]), axis=1).astype(np.uint64)
        trie = BigramTrie.mapped(op.train(pairs[0][::-1], pairs[1][::-1], 1 + np.arange(pairs.shape[1])))
        asked.clear()
        p, b = trie.lookup(pairs[0], pairs[1])
        assert (p > 0).all() and (b > 0).all() and sum(asked) < 3 * len(p)
        mixed = rng.permutation(pairs.shape[1])
        assert (trie.lookup(pairs[0][mixed], pairs[1][mixed])[0] == p[mixed]).all()
        assert not trie.lookup(pairs[0] + np.uint64(50), pairs[1])[1].any()


def test_select_in_words_of_any_bits():
    rng = np.random.default_rng(10)
    for share in (0.02, 0.5, 0.98):
        bits = np.r_[rng.random(64 * 50) < share, np.ones(64, bool), np.zeros(64, bool)]
        ef = EliasFano(np.zeros(2, np.int64), None, np.packbits(bits, bitorder="little"), None)
        for flags, ones in ((bits, True), (~bits, False)):
            before = np.r_[0, np.cumsum(flags.reshape(-1, 64).sum(axis=1))]
            assert (ef._select(np.arange(flags.sum()), before, ones) == np.flatnonzero(flags)).all()


def brute(docs):
    """docs: (key, text); both scores by dictionaries, without codes."""
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in docs]
    texts = [[*(t or "").encode().lower().split(), None] for _, t in docs]
    uni, bi, after = Counter(), Counter(), defaultdict(set)
    for t, h in zip(texts, held):
        if not h:
            uni.update(t)
            for v, w in zip(["start", *t], t):
                bi[v, w] += 1
                after[v].add(w)
    n, size, ctx = sum(uni.values()), len(uni), Counter()
    for (v, _), c in bi.items():
        ctx[v] += c
    for t, h in zip(texts, held):
        base = full = 0.0
        for v, w in zip(["start", *t], t):
            u = (uni[w] + 1) / (n + size + 1)
            base += math.log10(u)
            p = u
            if v in ctx:
                p = (bi[v, w] - 0.75) / ctx[v] * (bi[v, w] > 0) + 0.75 * len(after[v]) / ctx[v] * u
            full += math.log10(p)
        yield h, len(t), sum(uni[w] > 0 for w in t), n, base, full


def same(rows, want):
    for r, (h, n, known, tokens, base, full) in zip(rows, want, strict=True):
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, tokens), r
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and abs(r.score - full) <= 2.5e-4 * n, (r, base, full)


def test_contexts_with_hundreds_of_millions_of_tokens_are_not_clipped():
    v, w, c = np.array([1, 1, 1, 2], np.uint64), np.array([5, 6, 7, 5], np.uint64), np.array([3 * 10**8, 40, 1, 1])
    data = op.train(v, w, c)
    trie = BigramTrie.mapped(data)
    (answer,) = op._query([0], [op.put(*(op.small(x) for x in (np.array([1, 0, 0, 1], np.uint64), np.array([5, 1, 1, 5], np.uint64), c)))])
    p, b, step = op.take(answer)
    assert step[0] == trie.step and op.CODES * step[0] < 9.2
    seen = np.array([c[:3].sum()] * 3 + [1])
    got, true = op.value(p, step[0]), (c - op.DISCOUNT) / seen
    assert (got <= true * (1 + 1e-12)).all() and (np.log10(true) - np.log10(got) <= step[0] * 1.001).all()
    left = 1 - np.array([got[:3].sum()] * 3 + [got[3]])
    assert (op.value(b, step[0]) <= left + 1e-12).all() and (op.value(b, step[0]) >= 0.999 * left - 1e-9).all()


def test_the_probabilities_of_each_context_sum_to_one_at_most():
    rng = np.random.default_rng(8)
    v, w, c = np.r_[np.sort(rng.integers(0, 400, 6000)), 500, 501].astype(np.uint64), rng.integers(0, 3000, 6002).astype(np.uint64), rng.zipf(1.3, 6002).clip(1, 10**7)
    pairs = np.unique(np.stack([v, w]), axis=1)
    trie = BigramTrie.mapped(op.train(v, w, c))
    p, b = trie.lookup(pairs[0], pairs[1])
    for x in np.unique(pairs[0]):
        at = pairs[0] == x
        total = op.value(p[at], trie.step).sum() + op.value(b[at][:1], trie.step)[0]  # the unigrams that the weight spreads over sum to one
        assert 0.99 < total <= 1 + 1e-12


def test_query_equals_brute_force_and_beats_the_base(spark, sf):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    rows = op.op3_lm_score(spark, sf).orderBy("doc_id").collect()
    want = list(brute(docs))
    same(rows, want)
    assert [r.held_out for r in rows] == [w[0] for w in want]
    held = [r for r in rows if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_nulls_repeats_many_blocks_and_clashes(spark):
    docs = [(1, None), (2, "A b a B É"), (2, "A b a B É"), (None, ""), (16, "b\x0ba"), (9, "a " * 1000), (10, "z q"), (11, "q z")]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(docs)], "doc_id long, text string, score int").withColumnRenamed("score", "pos").selectExpr("*", "1 AS n_tokens", "2 AS held", "3 AS c0")
    out = op.score(df.repartition(4), op.fold("doc_id", 7) == 2, carry=("pos", "n_tokens", "held", "c0"))
    assert {(r.held, r.c0) for r in out.collect()} == {(2, 3)}
    same(out.orderBy("pos").collect(), brute(docs))


def test_no_training_rows_and_empty_tables(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = op.score(df, F.lit(True)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
    assert op.score(df.limit(0), F.lit(False)).count() == 0


def test_very_long_text(spark):
    text = " ".join(f"w{i % 5000}" for i in range(300_000))
    df = spark.createDataFrame([(1, text), (16, "w1 w2")], "doc_id long, text string")
    r = op.score(df, op.F.lit(False)).filter("doc_id = 1").first()
    assert r.n_tokens == 300_001 and r.n_known == 300_001 and r.base_score < r.score < 0
