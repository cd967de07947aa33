"""Operator 5, byte-level BPE encoding and decoding by a global shuffle of distinct words.

Method: texts are exploded into pre-tokens with their positions; every distinct pre-token meets all its blocks in
one hash bucket, where it is encoded once; the identifiers join back to the blocks, and each text is reassembled
by position. Decoding takes texts in groups of about CHUNK identifiers, explodes each group's distinct identifiers, joins them
with the token-byte table and puts each text's bytes together by position. The table's size is the vocabulary's; up to TABLE_BYTES
it is broadcast, so a group stays in its task and in order, which is checked, and a larger one is joined by a shuffle.

The exchange is packed (see packs): per block, the distinct pre-tokens by bucket, and the positions as a stream of
numbers of distinct pre-tokens, most frequent first.

Defined cases: a null or empty text has no identifiers and decodes to empty bytes; texts and pre-tokens may have
any length; repeated rows and null keys come back as often as they came; an empty table gives an empty result; an
identifier that the vocabulary doesn't have decodes to no bytes; only the columns named in `carry` are taken along, and one
with an output's name is replaced.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from vigil.llm.bpe import TokenRanks, load_ranks, merge
from vigil.llm.packs import answer_each, finish_arrow, ipc, join_bytes, put, ragged, scatter, small, split_bytes, take, unipc
from vigil.llm.shared import SPACE, buckets
from vigil.llm.token_bytes import decode, empty_groups, groups, joined  # noqa: F401  decode belongs to this operator

#: Letters and signs for which Python's own regular expressions suffice: ASCII and Latin letters.
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-" + chr(0x24F)
_PLAIN = re.compile(f"[\x00-\x1b\x20-\x7f{_LETTERS}]*")
_QUICK = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\t-\\r 0-9{_LETTERS}]+|[\\t-\\r ]+(?![^\\t-\\r ])|[\\t-\\r ]+")
#: Bytes of text in a block, identifiers that a step handles at a time, and words that a bucket remembers.
BLOCK_BYTES, CHUNK, MEMO_WORDS = 4_000_000, 200_000, 100_000
OUT = ("n_tokens", "ids")


@lru_cache(maxsize=4)
def splitter(pattern: str):
    """Pattern -> function that splits a text. The quick way gives equal matches where it is taken."""
    import public_tokenizers
    import regex

    # In the library white space is Unicode's White_Space; \s here has four more controls.
    full = regex.compile(re.sub(r"\\s", lambda m: SPACE, re.sub(r"\\S", lambda m: f"[^{SPACE}]", re.sub(r"(?<!\[\^)\\s", lambda m: f"[{SPACE}]", pattern)))).findall
    quick, plain = _QUICK.findall, _PLAIN.fullmatch
    if pattern != public_tokenizers.PATTERN:
        return full
    return lambda text: quick(text) if plain(text) else full(text)


class _Numbers(dict):
    def __missing__(self, k):
        n = self[k] = len(self)
        return n


def _emit(pattern: str, n_buckets: int):
    def emit(rows: pa.Table, texts: pa.ChunkedArray):
        split, numbers, parts, counts = splitter(pattern), _Numbers(), [], []
        for chunk in texts.chunks:
            for text in chunk:
                text = text.as_py()
                if text:
                    found = split(text)
                    parts.append(np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found)))
                    counts.append(len(found))
                else:
                    counts.append(0)
        stream = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        words = [w.encode("utf-8") for w in numbers]
        order = np.argsort(-np.bincount(stream, minlength=len(words)), kind="stable") if words else np.zeros(0, int)
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        words = [words[i] for i in order]
        bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % n_buckets for w in words), np.int64, len(words))
        by = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[by], np.arange(n_buckets + 1))
        packs = {b: put(*join_bytes([words[i] for i in by[ends[b] : ends[b + 1]]])) for b in range(n_buckets) if ends[b + 1] > ends[b]}
        carried = ipc(rows.combine_chunks().to_batches()[0]) if rows.num_columns and rows.num_rows else b""
        return put(small(np.array(counts, np.int64)), small(rank[stream]), small(bucket), carried), packs

    return emit


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    if word in ranks:
        return [ranks[word]]
    return [ranks[s] for s in merge([word[i : i + 1] for i in range(len(word))], TokenRanks(ranks))[0]]


def _reduce(vocabulary: str):
    def bucket():
        ranks, known = load_ranks(vocabulary), {}

        def one(pack: bytes) -> bytes:
            found = []
            for w in split_bytes(*take(pack)):
                ids = known.get(w)
                if ids is None:
                    ids = known[w] = np.array(encode_word(w, ranks), "<u4").tobytes()
                found.append(ids)
            if len(known) > MEMO_WORDS:
                known.clear()
            return put(small(np.fromiter((len(x) // 4 for x in found), np.int64, len(found))), np.frombuffer(b"".join(found), "<u4"))

        return one

    return bucket


def _end(payload: bytes, answers: dict[int, bytes]) -> pa.Table:
    """The block's carried columns with n_tokens and ids."""
    counts, stream, bucket, carried = take(payload)
    n_ids = np.zeros(len(bucket), np.int64)
    values, starts, base = [], np.zeros(len(bucket), np.int64), 0
    by = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[by], np.arange(int(bucket.max()) + 2 if len(bucket) else 1))
    for b in range(len(ends) - 1):
        if ends[b + 1] > ends[b]:
            lengths, ids = take(answers[b])
            lengths, at = lengths.astype(np.int64), by[ends[b] : ends[b + 1]]
            n_ids[at], starts[at] = lengths, base + np.cumsum(lengths) - lengths
            values.append(ids)
            base += len(ids)
    flat = np.concatenate(values) if values else np.zeros(0, np.uint32)
    tokens, out, at = np.zeros(len(counts), np.int64), [], 0
    ends, doc = np.cumsum(counts.astype(np.int64)), 0
    while doc < len(counts):
        stop = max(doc + 1, int(np.searchsorted(ends, at + CHUNK, "right")))
        part = stream[at : ends[stop - 1]]
        sizes = n_ids[part]
        run = np.r_[0, np.cumsum(sizes)]
        cut = run[np.r_[0, ends[doc:stop] - at]]
        data = ragged(flat, starts[part], sizes).astype("<u4").tobytes()
        tokens[doc:stop] = np.diff(cut)
        out += [data[4 * a : 4 * b] for a, b in zip(cut.tolist(), cut[1:].tolist())]
        at, doc = int(ends[stop - 1]), stop
    table = unipc(carried) if carried else pa.table({})
    return table.append_column("n_tokens", pa.array(tokens, pa.int64())).append_column("ids", pa.array(out, pa.binary()))


def _blocks(df: DataFrame, vocabulary: str, pattern: str, text: str, carry: tuple[str, ...], end, group: bool) -> tuple[DataFrame, list[str]]:
    """The blocks of df ended by end, and the carried columns. Those travel under numbers, so that none can clash."""
    names = [c for c in carry if c not in OUT]
    rows = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(f"`{text}`").cast("string").alias("text"))
    x = scatter(rows, "text", _emit(pattern, buckets(df.sparkSession)), BLOCK_BYTES)
    flat = StructType([*rows.drop("text").schema.fields, StructField("n_tokens", LongType()), StructField("ids", BinaryType())])
    kind = f"doc {flat.simpleString()}, row long, at long, id int" if group else ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in flat)
    fields = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in flat])
    empty = pa.schema([("doc", pa.struct(list(fields))), ("row", pa.int64()), ("at", pa.int64()), ("id", pa.int32())]) if group else fields
    return finish_arrow(x, answer_each(x, _reduce(vocabulary)), end, empty, kind), names


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, n_tokens, and ids: little-endian unsigned 32-bit integers in one binary value."""
    out, names = _blocks(df, vocabulary, pattern, text, carry, lambda _, p, a: _end(p, a), False)
    return out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], *OUT)


def round_trip(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """encode() and decode() in one: the carried columns, n_tokens, ids and decoded. A block's groups leave it ready for the join, which saves a Python worker in each task."""

    def end(block: int, payload: bytes, answers: dict[int, bytes]) -> pa.Table:
        table = _end(payload, answers).combine_chunks()
        doc = pa.StructArray.from_arrays([c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns], names=table.column_names)
        return pa.Table.from_batches(groups(doc, "ids", block << 12)) if len(doc) else empty_groups(doc.type)

    out, names = _blocks(df, vocabulary, pattern, text, carry, end, True)
    whole = joined(out, "ids", vocabulary)
    return whole.select(*[F.col(f"doc.c{i}").alias(n) for i, n in enumerate(names)], *[F.col(f"doc.{c}").alias(c) for c in OUT], "decoded")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = round_trip(docs, path, public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def ids_sha256(ids: list[int]) -> str:
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
