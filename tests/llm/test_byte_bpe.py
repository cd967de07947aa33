import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from vigil.llm import byte_bpe as op
from vigil.llm import token_bytes

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIB = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def own(text):
    return [i for p in op.splitter(public_tokenizers.PATTERN)(text) for i in op.encode_word(p.encode(), RANKS)]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("abcé É'stvel 019!?\n\t .\x1c\x85\xa0", max_size=60)))
def test_random_texts_equal_the_library(text):
    assert own(text) == LIB.encode_ordinary(text)


def test_decoding_joins_the_token_table_and_keeps_order(spark, monkeypatch):
    texts = ["", "a b", "the " * 5000, "é" * 300, "x"] * 7
    rows = [(i, bytearray(op.np.array(LIB.encode_ordinary(t), "<u4").tobytes()), i) for i, t in enumerate(texts)] + [(99, None, 99)]
    df = spark.createDataFrame(rows, "doc int, ids binary, row int").repartition(3)
    for chunk, most in ((200_000, 10**9), (100, 10**9), (1, 0)):
        monkeypatch.setattr(token_bytes, "CHUNK", chunk)
        monkeypatch.setattr(token_bytes, "TABLE_BYTES", most)
        out = op.decode(df, PATH)
        assert out.columns == ["doc", "ids", "row", "decoded"]
        assert {r.doc: bytes(r.decoded).decode() for r in out.collect()} == dict(enumerate(texts)) | {99: ""}
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan) == (most > 0)


def test_query_equals_the_library_and_round_trips(spark, sf):
    got = {r.doc_id: r for r in op.op5_byte_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids, r = LIB.encode_ordinary(d.text or ""), got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), op.ids_sha256(ids))
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_nulls_repeats_clashes_and_empty_tables(spark):
    rows = [(1, None, "x"), (1, "a b", "y"), (1, "a b", "y"), (None, "", "z"), (2, "the " * 300_000, "long")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").coalesce(1).selectExpr("*", "1 AS n_tokens", "2 AS __text", "3 AS c0", "4 AS decoded")
    more = op.decode(op.encode(df, PATH, public_tokenizers.PATTERN, carry=("doc_id", "n_tokens", "__text", "c0", "decoded")), PATH)
    assert more.columns == ["doc_id", "__text", "c0", "decoded", "n_tokens", "ids"] or set(more.columns) == {"doc_id", "__text", "c0", "decoded", "n_tokens", "ids"}
    assert {r["__text"] for r in more.collect()} == {2}
    got = sorted((r.doc_id or 0, r.n_tokens, len(r.ids)) for r in op.encode(df, PATH, public_tokenizers.PATTERN).collect())
    n = len(LIB.encode_ordinary("the " * 300_000))
    assert got == [(0, 0, 0), (1, 0, 0), (1, 2, 8), (1, 2, 8), (2, n, 4 * n)]
    assert op.encode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_many_blocks_give_the_same(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    both = op.round_trip(docs.repartition(5), PATH, public_tokenizers.PATTERN).collect()
    assert all(bytes(r.decoded).decode() == t for r, t in zip(sorted(both, key=lambda r: r.doc_id), [r.text or "" for r in docs.orderBy("doc_id").collect()], strict=True))
    assert op.round_trip(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    want = {r.doc_id: bytes(r.ids) for r in op.encode(docs, PATH, public_tokenizers.PATTERN).collect()}
    got = {r.doc_id: bytes(r.ids) for r in op.encode(docs.repartition(9), PATH, public_tokenizers.PATTERN).collect()}
    assert got == want


def test_first_shuffle_is_made_once(spark, sf):
    df = op.encode(spark.read.parquet(f"{sf}/documents.parquet"), PATH, public_tokenizers.PATTERN)
    df.collect()
    assert "Reused" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [1, 500, 10**9])
def test_block_cutting_loses_nothing(block, monkeypatch):
    import pyarrow as pa

    import vigil.llm.packs as packs

    monkeypatch.setattr(packs, "BLOCK_BYTES", block)
    seen = []

    class Frame:
        def mapInArrow(self, run, schema):
            batches = [pa.record_batch({"i": pa.array(range(7)), "t": pa.array(["a" * (k * 100) for k in range(7)])}), pa.record_batch({"i": pa.array([7, 8]), "t": pa.array([None, "x"])})]
            monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("T", (), {"partitionId": lambda s: 0})())
            return list(run(iter(batches)))

    out = packs.scatter(Frame(), "t", lambda rows, texts: (seen.extend(rows.column("i").to_pylist()) or b"p", {0: b"x"}))
    assert seen == list(range(9)) and len({b.column("src")[0].as_py() for b in out}) == len(out)
