import random
import re

import pytest

from tests.llm.oracle import compare
from vigil.llm import contamination as op
from vigil.llm.suffix_automaton import Automaton, words_of

WORDS = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(text, items, window):
    """(n_words, hit places, item ids)"""
    words = WORDS.findall((text or "").translate(LOWER))
    hit, ids = set(), set()
    for item, t in items:
        w = WORDS.findall((t or "").translate(LOWER))
        k = min(window, len(w))
        grams = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in grams:
                hit.update(range(i, i + k))
                ids.add("" if item is None else str(item))
    return len(words), hit, ids


def test_query_equals_sql(spark, sf):
    got = compare(spark, op.op11_decontaminate, op.SQL, sf)
    assert any(r[0] for r in got) and not all(r[0] for r in got)


def test_larger_set_equals_sql(spark):
    assert len(compare(spark, op.op11_decontaminate, op.SQL, "/root/testdata/sf0.01")) == 1000


@pytest.mark.parametrize("seed", range(30))
def test_automaton_finds_all_substrings(seed):
    """On few different words matches overlap and repeat in every way."""
    rng = random.Random(seed)
    draw = lambda n: " ".join(rng.choice("abc" if seed % 2 else "abcde") for _ in range(n))
    items = [(str(i), draw(rng.randrange(0, 14))) for i in range(rng.randrange(1, 9))]
    window = rng.choice([3, 5])
    a = Automaton([(i, words_of(t.encode()), True) for i, t in items if t], window) if any(t for _, t in items) else None
    for _ in range(20):
        text = draw(rng.randrange(0, 40)) + (" z " + draw(8) if rng.random() < 0.5 else "")
        words = words_of(text.encode())
        spans, found, longest = a.match(words) if a else ([], set(), 0)
        n, hit, ids = brute(text, items, window)
        assert (len(words), {p for x, y in spans for p in range(x, y + 1)}, found) == (n, hit, ids)
        assert all(y + 1 < spans[i + 1][0] for i, (x, y) in enumerate(spans[:-1]))
        if a and a.least <= 1:  # else short runs are passed over
            best = max((k for i in range(len(words)) for k in range(len(words) - i + 1) if any(f" {' '.join(map(bytes.decode, words[i : i + k]))} " in f" {t} " for _, t in items)), default=0)
            assert longest == best


ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog again and again"), (2, "Ünïcode words, 12 of them: a b c d e f g h i j"), (3, "short item"), (4, None), (5, "..."),
    (3, "short item"), (None, "one two three four five six seven eight nine ten eleven"), (20, "quick brown fox jumps over the lazy dog again and yonder"),
]
TEXTS = [
    (1, "Before: the QUICK brown-fox jumps, over the lazy dog again and (again) after."), (1, "Before: the QUICK brown-fox jumps, over the lazy dog again and (again) after."),
    (2, None), (3, ""), (4, "a short\nITEM and a short thing"), (5, "12 of them a b c d e f g h"), (None, "one two three four five six seven eight nine ten"), (7, "Éé clean text \x1c stays 　 here"),
]


def test_nulls_ties_clashes_and_cut_texts(spark):
    docs = spark.createDataFrame([(*r, 0, "x", 0) for r in TEXTS], "doc_id long, `te.xt` string, n_hit int, doc string, row int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    outs = [op.decontaminate(docs, items, text="te.xt", shard_words=s).collect() for s in (100_000, 12)]
    key = lambda r: str((r["doc_id"], r["te.xt"]))
    one, many = (sorted(rows, key=key) for rows in outs)
    assert one == many  # however the items are dealt to automata
    for r in one:
        n, hit, ids = brute(r["te.xt"], ITEMS, op.WINDOW)
        assert (r.n_words, r.n_hit, set(r["items"]), r.contaminated) == (n, len(hit), ids, bool(hit))
        assert r["doc"] == "x" and r["row"] == 0
    by = {r.doc_id: r for r in one}
    assert by[1].clean_text == "Before: ) after." and by[1].reject and by[1].longest_match == 12
    assert by[2].clean_text is None and by[3].clean_text == "" and by[7].clean_text == TEXTS[-1][1]
    assert by[4].clean_text == "a  and a short thing" and not by[4].reject
    assert by[5].n_hit == 11


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(TEXTS, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    got = op.decontaminate(docs, items).collect()
    assert len(got) == len(TEXTS) and not any(r.contaminated for r in got) and {r.n_words for r in got if r.doc_id == 1} == {14}
    assert op.decontaminate(docs.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_very_long_texts_and_items(spark):
    rng = random.Random(5)
    item = [f"w{rng.randrange(400)}" for _ in range(30_000)]
    text = " ".join(["x"] * 200_000 + item[11_990:12_020] + ["y"] * 100_000 + item[:9])
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    for shard in (100_000, 1_000):
        r = op.decontaminate(docs, items, shard_words=shard).first()
        assert (r.n_words, r.n_hit, r["items"], [tuple(s) for s in r.spans]) == (300_039, 30, ["9"], [(200_000, 200_029)])
