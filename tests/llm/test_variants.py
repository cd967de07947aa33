import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import pytest

from vigil.llm import variants as op

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_counts(docs, every=97, least_length=5, least_count=3):
    total = Counter()
    for key, text in docs:
        for run in RUN.findall(text or ""):
            w = run.translate(LOWER)
            h = crc32(f"{'' if key is None else key}:{w}".encode())
            if h % every == 0:
                i = h % len(w)
                w = w[:i] + w[i + 1 :]
            total[w] += 1
    return {w: n for w, n in total.items() if n >= least_count and len(w) >= least_length}


def brute_variants(total, ratio=2):
    """Near words by deleting every code point once: words that share a deletion at the same place, or are one another's deletion."""
    near, holes = defaultdict(set), defaultdict(set)
    for w in total:
        for i in range(len(w)):
            cut = w[:i] + w[i + 1 :]
            holes[i, cut].add(w)
            if cut in total and cut != w:
                near[w].add(cut)
                near[cut].add(w)
    for group in holes.values():
        for a in group:
            near[a] |= group - {a}
    form = {}
    for w, n in total.items():
        best = min(near[w], key=lambda x: (-total[x], x), default=None)
        form[w] = best if best is not None and total[best] >= ratio * n else None
    out = []
    for w, n in total.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), total.get(form[w])))
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_query_equals_brute_force(spark, size):
    sf = f"/root/testdata/sf{size}"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = rows(op.op12_spelling_variants(spark, sf))
    assert got == brute_variants(brute_counts(docs)) and any(x[1] for x in got) and any(x[1] and x[2] != x[1] for x in got) or size == "0.001"


@pytest.mark.parametrize("block", [1, 3, 2_000])
def test_few_letters_and_small_blocks(spark, block):
    """Words over few letters have many near words at ambiguous places; blocks are halved down to one free code point."""
    rng = random.Random(block)
    total = {"".join(rng.choice("ab" if n % 2 else "abé") for _ in range(rng.randrange(1, 12))): rng.randrange(1, 40) for n in range(900)}
    df = spark.createDataFrame(list(total.items()), "word string, n long").repartition(5)
    assert rows(op.variants(df, block_words=block)) == brute_variants(total)


def test_merge_keeps_what_is_on_enough_lists():
    rng = random.Random(3)
    for _ in range(300):
        lists = [sorted(rng.sample(range(30), rng.randrange(0, 15))) for _ in range(rng.randrange(1, 8))]
        starts = [rng.randrange(0, len(x) + 1) for x in lists]
        need = rng.randrange(1, 5)
        count = Counter(v for x, i in zip(lists, starts) for v in x[i:])
        assert list(op.merged(lists, starts, need)) == sorted(v for v, c in count.items() if c >= need)


def test_one_edit():
    for a, b, want in [("ab", "ab", False), ("ab", "ac", True), ("ab", "abc", True), ("ab", "ba", False), ("aab", "ab", True), ("a", "", True), ("abcd", "ab", False), ("aéb", "aèb", True)]:
        assert op.one_edit(a, b) == op.one_edit(b, a) == want


def test_counts_of_nulls_repeats_and_other_letters(spark):
    docs = [(1, "Étude étude ÉTUDE× naïve-naïve x"), (1, "Étude étude ÉTUDE× naïve-naïve x"), (2, None), (None, "nullkey nullkey"), (3, ""), (4, "日本 letterĀletter 5five5"), (5, "k" * 50_000 + " k")]
    df = spark.createDataFrame([(*d, 1, "w") for d in docs], "doc_id long, `te.xt` string, n int, word string")
    for every in (97, 2, 1):
        got = {r.word: r.n for r in op.count_words(df, text="te.xt", every=every, least_length=2, least_count=1).collect()}
        assert got == brute_counts(docs, every, 2, 1)
    plain = {r.word: r.n for r in op.count_words(df, text="te.xt").collect()}
    assert plain["étude"] == 2 and plain["letter"] == 2 and plain["k"] == 1 and len(max(plain, key=len)) == 50_000


def test_ties_go_to_the_smaller_word_and_roots_follow_forms(spark):
    total = {"abcde": 4, "abcdf": 8, "abcdg": 8, "abxdf": 16, "zzzzz": 1, "abcd": 1}
    got = {r[0]: r[1:] for r in rows(op.variants(spark.createDataFrame([*total.items(), (None, 3)], "word string, n long")))}
    assert got["abcde"] == ("abcdf", "abxdf", 4, 3, 8) and got["abcd"] == ("abcdf", "abxdf", 1, 3, 8)
    assert got["zzzzz"] == (None, "zzzzz", 1, 0, None) and None not in got


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op.variants(op.count_words(docs, every=97)).count() == 0


def test_a_hot_stem_is_split(spark):
    """A third of all words share a long stem: the block is cut until its parts are small, and nothing is lost."""
    rng = random.Random(1)
    total = {"stemstem" + "".join(rng.choice("abcdefgh") for _ in range(6)): rng.randrange(1, 9) for _ in range(3_000)}
    total |= {"".join(rng.choice("abcdefgh") for _ in range(14)): 1 for _ in range(3_000)}
    assert rows(op.variants(spark.createDataFrame(list(total.items()), "word string, n long"), block_words=50)) == brute_variants(total)
