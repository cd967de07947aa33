import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vigil.llm.bpe import merge
from vigil.llm.token_counts import count_tokens, op1_token_counts, text_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)


def library(texts):
    return [len(x.ids) for x in LIB.encode_batch(texts, add_special_tokens=False)]


def test_heap_takes_lowest_rank_then_leftmost():
    assert merge(list("aaa"), {("a", "a"): 0}) == (["aa", "a"], 1)
    assert merge(list("abc"), {("a", "b"): 1, ("b", "c"): 0}) == (["a", "bc"], 1)
    assert merge([], {}) == ([], 0)


CASES = [
    "", " ", "\n\t", "Hello, World's end 123 4.5!!", "<|endoftext|>a<|startoftext|><|ENDOFTEXT|> x", "<|endoftext|", "ΣΟΣ İstanbul",
    "été ﬁ ½Ⅷ٣", "a\x1cb\x85c\xa0d e", "\U0001f600‍\U0001f525 don't I'LL we'Ve", "x" * 5000, "你好 да", "한국어 ßẞ",
]


def test_cases_equal_the_library():
    assert text_tokens(CASES, PATH) == library(CASES)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_random_texts_equal_the_library(text):
    assert text_tokens([text], PATH) == library([text])


def test_every_code_point_equals_the_library():
    """Between letters, between a digit and marks, and alone: in all planes that have characters, with what Python's tables don't know."""
    points = [c for c in [*range(0x40000), *range(0xE0000, 0xE0200), 0xF0000, 0x10FFFF] if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"ab{chr(c)}cd 12{chr(c)}!? {chr(c)}" for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    assert text_tokens(texts, PATH) == library(texts)


def test_query_equals_the_library(spark, sf):
    got = {r.doc_id: r for r in op1_token_counts(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = library([d.text or "" for d in docs])
    assert len(got) == len(docs)
    for d, n in zip(docs, want, strict=True):
        assert (got[d.doc_id].n_tokens, got[d.doc_id].n_bytes, got[d.doc_id].over_limit) == (n, len((d.text or "").encode()), n > 2048)


def test_nulls_repeats_clashes_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, 5), (1, "a b", 6), (1, "a b", 6), (None, "", 7)], "doc_id long, text string, n_tokens int")
    got = sorted((r.doc_id or 0, r.n_tokens) for r in count_tokens(df, PATH).collect())
    assert got == [(0, 0), (1, 0), (1, 2), (1, 2)]
    assert count_tokens(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("n", [100_000])
def test_very_long_word(n):
    assert text_tokens(["ab" * n], PATH) == library(["ab" * n])
