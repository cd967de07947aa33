"""Operator 3, language-model scores from an Elias-Fano n-gram trie.

Method: a bigram model with absolute discounting, interpolated with add-one unigrams, is counted over all training
texts and kept as trie shards whose levels are Elias-Fano sequences with monotone pointers and 16-bit logarithmic
codes of the smoothed probabilities and back-off weights, in flat memory-mapped buffers. A query finds its context,
then the successor within the context's range (see elias_fano).

Both rounds are packed exchanges (see packs). First each block's distinct words with their training counts meet in
hash buckets, which answer with global counts and numbers. Then each block's distinct bigrams meet in the shard of
their first word, where the training counts are summed up, the shard's trie is built, and all blocks' distinct
bigrams are looked up. Texts are scored in their block from the answered codes. Counts come from all training texts;
what is shuffled grows with the texts, a few bytes per distinct item of a block.

P(w | v) = q(vw) + b(v) * (c(w) + 1) / (N + V + 1), where q(vw) is max(c(vw) - D, 0) / c(v) rounded down to a code, and b(v) is
one minus the sum of all q(vx), rounded down, too: unquantised it is D * N(v) / c(v), N(v) being the distinct words after v. So the
probabilities of a context sum to one but for the rounding of b(v), and never to more. A v that training didn't have leaves the
unigram. A step of the codes is 1/65534 of what the shard's probabilities can span: seven decades, or log10(c / (1 - D)) for the
largest context count c if that is more. It is kept in the shard and sent with its answers.

Defined cases: a null or empty text is its end token alone; texts of any length are scored whole; repeated rows
count and are scored as often as they come; a null key is hashed as an empty text; without training rows every
token has probability 1 / (0 + 0 + 1); an empty table gives an empty result; only the columns in `carry` are taken along, and one
with an output's name is replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.elias_fano import BigramTrie
from vigil.llm.hashing import mix
from vigil.llm.packs import answer, by_bucket, finish, ipc, join_bytes, put, rescatter, scatter, small, split_bytes, take, unipc
from vigil.llm.shared import buckets

DISCOUNT, CODES = 0.75, 65534
#: The end token has a space in it, so no word equals it.
END = b" "
OUT = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def step_of(most: int) -> float:
    """The step in log10 for contexts of up to so many training tokens, whose least probability is (1 - D) / most."""
    return max(7.0, float(np.log10(max(most, 1) / (1 - DISCOUNT)))) / CODES


def code(p: np.ndarray, step: float) -> np.ndarray:
    """Probabilities as 1 to CODES + 1, rounded down; those under the span get the last code."""
    return (1 + np.clip(np.ceil(-np.log10(p) / step), 0, CODES)).astype(np.uint16)


def value(codes: np.ndarray, step: float) -> np.ndarray:
    """The probabilities of codes; 0 for code 0."""
    return np.where(codes == 0, 0.0, 10.0 ** (-step * (codes.astype(np.float64) - 1)))


class _Numbers(dict):
    def __missing__(self, k):
        n = self[k] = len(self)
        return n


def _emit_words(n_buckets: int):
    def emit(rows: pa.Table, texts: pa.ChunkedArray):
        numbers, parts, counts = _Numbers(), [], []
        numbers[END] = 0
        for chunk in texts.chunks:
            for text in chunk:
                found = (text.as_py() or "").encode("utf-8").lower().split()  # bytes: A to Z only, the six separators
                found.append(END)
                counts.append(len(found))
                parts.append(np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found)))
        stream, counts = np.concatenate(parts), np.array(counts, np.int64)
        held = rows.column("held").to_numpy().astype(bool)
        words = list(numbers)
        order = np.argsort(-np.bincount(stream, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        stream, words = rank[stream], [words[i] for i in order]
        train = np.bincount(stream[np.repeat(~held, counts)], minlength=len(words))
        bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % n_buckets for w in words), np.int64, len(words))
        at, ends = by_bucket(bucket, n_buckets)
        packs = {b: put(*join_bytes([words[i] for i in at[ends[b] : ends[b + 1]]]), small(train[at[ends[b] : ends[b + 1]]])) for b in range(n_buckets)}
        carried = ipc(rows.drop_columns(["held"]).combine_chunks().to_batches()[0]) if rows.num_columns > 1 else b""
        return put(small(counts), small(stream), small(bucket), held.astype(np.uint8), carried), packs

    return emit


def _count_words(_: list[int], packs: list[bytes]) -> list[bytes]:
    """Per pack: the bucket's training tokens and distinct training words; each word's training count and its rank in the bucket."""
    read = [(split_bytes(n, data), c.astype(np.int64)) for n, data, c in map(take, packs)]
    numbers = _Numbers()
    at = [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) for words, _ in read]
    total = np.zeros(len(numbers), np.int64)
    for i, (_, c) in zip(at, read):
        np.add.at(total, i, c)
    order = np.argsort(-total, kind="stable")
    rank = np.empty(len(total), np.int64)
    rank[order] = np.arange(len(total))
    head = np.array([total.sum(), (total > 0).sum()], np.uint64)
    return [put(head, small(total[i]), small(rank[i])) for i in at]


class _Block:
    """A block's tokens with their global counts and numbers, and its distinct bigrams in the order of (shard, first, second)."""

    def __init__(self, counts: np.ndarray, stream: np.ndarray, number: np.ndarray, n_buckets: int):
        first = np.r_[0, np.cumsum(counts)[:-1]].astype(np.int64)
        before = np.r_[np.uint64(0), number[stream[:-1]]] if len(stream) else np.zeros(0, np.uint64)
        before[first] = 0  # the start of a text
        after = number[stream]
        local = np.r_[0, stream[:-1].astype(np.int64) + 1] if len(stream) else np.zeros(0, np.int64)
        local[first] = 0
        key, place, self.inverse = np.unique(local.astype(np.uint64) * np.uint64(len(number) + 1) + stream, return_index=True, return_inverse=True)
        v, w = before[place], after[place]
        shard = (mix(v + np.uint64(1)) % np.uint64(n_buckets)).astype(np.int64)
        order = np.lexsort((w, v, shard))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.inverse = back[self.inverse]
        self.v, self.w, self.shard = v[order], w[order], shard[order]
        self.ends = np.searchsorted(self.shard, np.arange(n_buckets + 1))


def _emit_bigrams(n_buckets: int):
    def emit(payload: bytes, answers: dict[int, bytes]):
        counts, stream, bucket, held, _ = take(payload)
        total, number = np.zeros(len(bucket), np.int64), np.zeros(len(bucket), np.uint64)
        at, ends = by_bucket(bucket, n_buckets)
        tokens = distinct = 0
        for b in range(n_buckets):
            head, c, rank = take(answers[b])
            i = at[ends[b] : ends[b + 1]]
            tokens, distinct = tokens + int(head[0]), distinct + int(head[1])
            total[i], number[i] = c, 1 + rank.astype(np.uint64) * np.uint64(n_buckets) + np.uint64(b)
        block = _Block(counts, stream, number, n_buckets)
        train = np.bincount(block.inverse[np.repeat(held == 0, counts)], minlength=len(block.v))
        packs = {}
        for b in range(n_buckets):
            x, y = block.ends[b], block.ends[b + 1]
            if y > x:
                v, w = block.v[x:y], block.w[x:y]
                step = np.where(np.r_[False, v[1:] == v[:-1]], np.diff(w, prepend=np.uint64(0)), w)
                packs[b] = put(small(np.diff(v, prepend=np.uint64(0))), small(step), small(train[x:y]))
        return put(payload, small(total), small(number), np.array([tokens, distinct], np.uint64)), packs

    return emit


def _bigrams(pack: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dv, step, c = take(pack)
    v = np.cumsum(dv, dtype=np.uint64)
    start = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    run = np.cumsum(step, dtype=np.uint64)
    run -= np.repeat(np.where(start > 0, run[start - 1], np.uint64(0)), np.diff(np.r_[start, len(v)]))
    return v, run, c.astype(np.int64)


def train(v: np.ndarray, w: np.ndarray, c: np.ndarray) -> bytes:
    """A trie shard from bigrams with training counts; equal ones may repeat, and those never counted stay out."""
    v, w, c = v[c > 0], w[c > 0], c[c > 0]
    wide = np.uint64(32)
    narrow = not len(v) or max(int(v.max()), int(w.max())) >> 32 == 0
    order = np.argsort(v << wide | w, kind="stable") if narrow else np.lexsort((w, v))  # one sort of runs that ascend, if both fit
    v, w, c = v[order], w[order], c[order]
    if len(v):
        first = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])])
        v, w, c = v[first], w[first], np.add.reduceat(c, first)
    start = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.zeros(0, np.int64)
    after = np.diff(np.r_[start, len(v)])
    seen = np.add.reduceat(c, start) if len(v) else c
    step = step_of(int(seen.max()) if len(seen) else 0)
    known = code((c - DISCOUNT) / np.repeat(seen, after), step)
    left = 1 - np.add.reduceat(value(known, step), start) if len(v) else np.zeros(0)
    # A sum of rounded terms can be off in the last digits; the unquantised weight is a lower bound of what is left.
    return BigramTrie.build(v, w, known, code(np.maximum(left - 1e-12, 0.5 * DISCOUNT * after / np.maximum(seen, 1)), step), step)


def _query(_: list[int], packs: list[bytes]) -> list[bytes]:
    read = [_bigrams(p) for p in packs]
    trie = BigramTrie.mapped(train(*(np.concatenate(x) for x in zip(*read))))
    return [put(*trie.lookup(v, w), np.array([trie.step])) for v, w, _ in read]


def _end(payload: bytes | None, answers: dict[int, bytes], names: list[str], n_buckets: int) -> pd.DataFrame:
    if payload is None:
        return pd.DataFrame({n: pd.Series(dtype="object") for n in [*names, *OUT]})
    payload, total, number, (tokens, distinct) = take(payload)
    counts, stream, _, _, carried = take(payload)
    block = _Block(counts, stream, number.astype(np.uint64), n_buckets)
    p, b = np.zeros(len(block.v)), np.zeros(len(block.v))
    for s in range(n_buckets):
        x, y = block.ends[s], block.ends[s + 1]
        if y > x:
            known, backoff, step = take(answers[s])
            p[x:y], b[x:y] = value(known, step[0]), value(backoff, step[0])
    total = total.astype(np.int64)
    unigram = (total + 1) / (int(tokens) + int(distinct) + 1)
    below = np.where(b > 0, b, 1.0)[block.inverse] * unigram[stream]
    logs = np.log10(p[block.inverse] + below)
    first = np.r_[0, np.cumsum(counts)[:-1]].astype(np.int64)
    frame = unipc(carried).to_pandas()[names] if names else pd.DataFrame(index=range(len(counts)))
    return frame.assign(
        n_tokens=counts.astype(np.int64), n_known=np.add.reduceat((total > 0)[stream].astype(np.int64), first), train_tokens=int(tokens),
        base_score=np.add.reduceat(np.log10(unigram)[stream], first), score=np.add.reduceat(logs, first),
    )


def score(df: DataFrame, held_out: Column, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, n_tokens, n_known, train_tokens, base_score and score; rows with held_out are scored only."""
    p, names = buckets(df.sparkSession), [c for c in carry if c not in OUT]
    # Carried columns travel under numbers, so that none can clash.
    held = [f"c{i}" for i in range(len(names))]
    kept = [F.col(f"`{c}`").alias(h) for c, h in zip(names, held)]
    rows = df.select(*kept, F.coalesce(held_out, F.lit(False)).cast("int").alias("held"), F.col(f"`{text}`").cast("string").alias("text"))
    x = scatter(rows, "text", _emit_words(p))
    y = rescatter(x, answer(x, _count_words), _emit_bigrams(p))
    kinds = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in held)
    schema = f"{kinds}n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = finish(y, answer(y, _query), lambda d, a: _end(d, a, held, p), schema)
    return out.select(*[F.col(h).alias(n) for h, n in zip(held, names)], *OUT)


def fold(key: str, n: int) -> Column:
    """crc32 of a key as text, modulo n."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % n


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("held_out", fold("doc_id", 7) == 2)
    out = score(docs, F.col("held_out"), carry=("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
