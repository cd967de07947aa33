import hashlib
import random

from tests.llm.oracle import compare
from vigil.llm import substring_dedup as op


def brute(docs, length=13):
    """docs: (id, text); the id may be null. Kept words by position in docs."""
    first, words = {}, [(t or "").encode().split() for _, t in docs]
    for (i, _), w in zip(docs, words):
        if i is not None:
            for p in range(len(w) - length + 1):
                g = tuple(w[p : p + length])
                first[g] = min(first.get(g, i), i)
    out = []
    for (i, _), w in zip(docs, words):
        gone = set()
        if i is not None:
            for p in range(len(w) - length + 1):
                if first[tuple(w[p : p + length])] < i:
                    gone |= set(range(p, p + length))
        out.append(b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out


def test_query_equals_sql(spark, sf):
    got = compare(spark, op.op2_substring_dedup, op.SQL, sf)
    assert any(r[2] for r in got)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {i: hashlib.sha256(k.encode()).hexdigest() for (i, _), k in zip(rows, brute(rows))}
    assert {r.doc_id: r.kept_sha256 for r in op.op2_substring_dedup(spark, "/root/testdata/sf0.01").collect()} == want


def run(spark, docs, parts):
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(docs)], "doc_id long, text string, n_words int").repartition(parts)
    df = df.withColumnRenamed("n_words", "pos").selectExpr("*", "1 AS key", "2 AS c0", "3 AS n_removed")
    rows = op.remove_repeats(df, carry=("doc_id", "pos", "key", "c0", "n_removed")).collect()
    assert {(r.key, r.c0) for r in rows} == {(1, 2)}
    return [r.kept_text for r in sorted(rows, key=lambda r: r.pos)], rows


def test_overlaps_repeats_within_documents_and_few_words(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choice("ab") for _ in range(40)) for _ in range(6)]
    docs = [(i, " ".join(rng.choice(pool)[a : a + rng.randrange(1, 60)] for a in range(0, 12, 4))) for i in range(40)]
    assert run(spark, docs, 5)[0] == brute(docs)


def test_nulls_equal_ids_short_texts_and_spans(spark):
    p = " ".join(f"w{i}" for i in range(20))
    docs = [(5, p), (5, p), (None, p), (3, "x y " + p + " z"), (9, None), (8, ""), (7, " ".join(f"w{i}" for i in range(12))), (-2, "q"), (11, p + " end")]
    got, rows = run(spark, docs, 3)
    assert got == brute(docs)
    assert {(r.pos, s.first, s.last) for r in rows for s in r.matches} == {(0, 0, 19), (1, 0, 19), (8, 0, 19)}


def test_empty_table(spark):
    assert op.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_matches_name_their_source_and_are_maximal(spark):
    a, b = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(25)]
    docs = [(1, " ".join(["p", *a, "q"])), (2, " ".join(["r", *b, "s"])), (3, " ".join(["t", *a[4:], *b[:20], "u", *a[:12]])), (4, " ".join(["v", *a[:14], "w", *a[15:30]]))]
    got, rows = run(spark, docs, 2)
    assert got == brute(docs)
    by = {r.pos: [(m.first, m.last, m.source) for m in r.matches] for r in rows}
    assert by == {0: [], 1: [], 2: [(1, 26, 1), (27, 46, 2)], 3: [(1, 14, 1), (16, 30, 1)]}


def test_words_decide_not_their_hashes(spark, monkeypatch):
    """With a hash that gives all words the same value every window shares one anchor; the words still tell them apart."""
    monkeypatch.setattr(op._HASHES, "of", lambda words: op.np.zeros(len(words), op.np.uint64))
    docs = [(i, f"x{i % 3} " + " ".join(f"w{(i % 2) * k}" for k in range(16))) for i in range(6)]
    raw = [t.encode() for _, t in docs]
    ids, known = op.np.arange(6), op.np.ones(6, bool)
    w = op.Windows(raw, ids, known, 13)
    c = w.contexts(w.anchors())
    used, rows = op.np.unique(c.rows, return_inverse=True)
    pack = op.put(*op.join_bytes([c.words[k - 1] if k else b"" for k in used.tolist()]), op.small(rows.reshape(-1)), c.least.view(op.np.uint64))
    bits, values = op.take(op._extend(13)([0], [pack])[0])
    source = op.np.repeat(c.least[:, None], 9, axis=1)
    source[op.np.unpackbits(bits, count=source.size).astype(bool).reshape(source.shape)] = values.view(op.np.int64)
    got = dict(zip(zip(w.doc.tolist(), (w.start - w.offset[w.doc]).tolist()), source[c.of_window, c.before].tolist()))
    first = {}
    for (d, at), _ in got.items():
        g = tuple(w.texts[d][at : at + 13])
        first[g] = min(first.get(g, d), d)
    assert got == {(d, at): first[tuple(w.texts[d][at : at + 13])] for d, at in got}


def test_very_long_text(spark):
    words = [f"w{i % 5000}x{i % 7919}" for i in range(150_000)]
    docs = [(1, " ".join(words)), (2, " ".join(["new", *words[50_000:]]))]
    _, rows = run(spark, docs, 2)
    assert {(r.doc_id, r.n_words, r.n_removed) for r in rows} == {(1, 150_000, 0), (2, 100_001, 100_000)}
