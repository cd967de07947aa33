"""Operator 2, substring dedup by seed and extend: words in passages that an earlier document has too are removed.

Method. Seeds: the hashes of five-word shingles are winnowed over every thirteen-word window, so each window has
one anchor that follows from its words alone, and any repeat of thirteen words or more shares an anchor. Documents
are joined on their anchors; anchors of a single document end there. Extension: for each occurrence of a shared anchor
the eight words before and after it meet those of all other occurrences. Occurrences are classed word by word, to
the right and to the left: two stay in one class as long as the next word is the same word. A window of l words before
the anchor and 8 - l after it repeats where two occurrences are in one left class l and one right class 8 - l, and
the smallest document in the class is its source. All comparisons are of words, not of their hashes. Windows of
a document that overlap or touch and have the same source join into one match; matches are maximal repeats of at
least the threshold, and the words that they cover are removed.

Both joins are packed exchanges (see packs): per block and bucket, the distinct anchors, then the distinct contexts
of shared anchors with the block's smallest document. A passage that a third of all documents share is one entry per
block. Texts are shuffled twice, compressed.

Defined cases: a null or empty text has no words; a document of fewer words than the threshold loses none; rows
with equal doc_id count as one document, so they don't remove each other's words; a row whose doc_id is null
neither loses words nor takes them from others; an empty table gives an empty result; doc_id must be castable to a 64-bit
integer; only the columns named in `carry` are taken along, and one with an output's name is replaced.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.hashing import GOLD, WordHashes, mix, ngram_hashes
from vigil.llm.packs import answer, by_bucket, finish, ipc, join_bytes, put, rescatter, scatter, small, split_bytes, squeeze, take, unipc, unsqueeze
from vigil.llm.shared import buckets

LENGTH, SHINGLE = 13, 5
BLOCK_BYTES, MEMO_WORDS = 8_000_000, 300_000
OUT = ("n_words", "n_removed", "matches", "kept_text")
_HASHES = WordHashes()


class Windows:
    """The windows of a block's documents: where they start, whose they are, and their anchors."""

    def __init__(self, texts: list[bytes], ids: np.ndarray, known: np.ndarray, length: int):
        if len(_HASHES) > MEMO_WORDS:
            _HASHES.clear()
        self.texts, self.length, self.ids = [t.split() for t in texts], length, ids
        parts = [_HASHES.of(t) for t in self.texts]
        self.n_words = np.array([len(p) for p in parts], np.int64)
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        n = np.where(known, np.maximum(self.n_words - length + 1, 0), 0)
        self.offset = np.cumsum(self.n_words) - self.n_words
        self.doc = np.repeat(np.arange(len(texts)), n)
        self.start = np.repeat(self.offset - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        self.grams = ngram_hashes(self.words, SHINGLE)

    def anchors(self) -> np.ndarray:
        """Per window, the smallest of its shingles' hashes."""
        least, width, span = self.grams, 1, self.length - SHINGLE + 1
        while 2 * width <= span:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        if width < span and len(least):
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        return least[self.start] if len(self.start) else np.zeros(0, np.uint64)

    def narrow(self, mask: np.ndarray) -> None:
        self.doc, self.start = self.doc[mask], self.start[mask]

    def contexts(self, anchors: np.ndarray) -> Contexts:
        """The contexts that the windows stand in, given the windows' anchors."""
        reach = self.length - SHINGLE
        at = self.start + reach
        for k in range(reach - 1, -1, -1):  # the leftmost place of the least hash
            at = np.where(self.grams[self.start + k] == anchors, self.start + k, at)
        place, first, window = np.unique(at, return_index=True, return_inverse=True)
        doc = self.doc[first]
        begin, end = self.offset[doc], self.offset[doc] + self.n_words[doc]
        span = place[:, None] + np.arange(-reach, SHINGLE + reach)
        inside = (span >= begin[:, None]) & (span < end[:, None])
        # Numbers of the distinct words around anchors; 0 is no word.
        numbers: dict[bytes, int] = {}
        near = np.unique(span[inside])
        flat = list(chain.from_iterable(self.texts)) if len(near) else []
        local = np.zeros(max(len(self.words), 1), np.uint32)
        local[near] = np.fromiter((numbers.setdefault(flat[i], len(numbers) + 1) for i in near.tolist()), np.uint32, len(near))
        rows = np.where(inside, local[np.where(inside, span, 0)], np.uint32(0))
        distinct, number = _distinct(rows)
        least = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(least, number, self.ids[doc])
        hashes = np.zeros(len(distinct), np.uint64)
        hashes[number] = self.grams[place] if len(place) else 0
        return Contexts(list(numbers), distinct, least, hashes, number[window], at - self.start)


class Contexts:
    """Distinct rows of word numbers around anchors, each with the block's least document and the anchor's hash; per window its row and the words before its anchor."""

    def __init__(self, words: list[bytes], rows: np.ndarray, least: np.ndarray, hashes: np.ndarray, of_window: np.ndarray, before: np.ndarray):
        self.words, self.rows, self.least, self.hashes, self.of_window, self.before = words, rows, least, hashes, of_window, before

    def packs(self, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
        return by_bucket((self.hashes % np.uint64(n_buckets)).astype(np.int64), n_buckets)


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and each row's number among them."""
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    whole = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).reshape(-1)
    _, first, number = np.unique(whole, return_index=True, return_inverse=True)
    return rows[first], number


def _load(payload: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, bytes]:
    lengths, data, ids, known, carried = take(payload)
    return split_bytes(lengths, data), ids.view(np.int64), known.astype(bool), carried


def _anchor_packs(w: Windows, a: np.ndarray, n_buckets: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per bucket the distinct anchors, ascending, and whether this block alone has them in two documents."""
    order = np.argsort(a, kind="stable")
    s = a[order]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    ids = w.ids[w.doc[order]]
    many = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first) if len(first) else np.zeros(0, bool)
    s = s[first]
    at, ends = by_bucket((mix(s + GOLD) % np.uint64(n_buckets)).astype(np.int64), n_buckets)
    return [s[at[x:y]] for x, y in zip(ends, ends[1:])], [many[at[x:y]] for x, y in zip(ends, ends[1:])]


def _emit_anchors(n_buckets: int, length: int):
    def emit(rows: pa.Table, texts: pa.ChunkedArray):
        raw = [(t or "").encode("utf-8") for t in texts.to_pylist()]
        key = rows.column("key").combine_chunks()
        known = key.is_valid().to_numpy(zero_copy_only=False)
        ids = key.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        w = Windows(raw, ids, known, length)
        packs = zip(*_anchor_packs(w, w.anchors(), n_buckets))
        carried = ipc(rows.combine_chunks().to_batches()[0])
        payload = put(small(np.fromiter(map(len, raw), np.int64, len(raw))), b"".join(raw), ids.view(np.uint64), known.astype(np.uint8), carried)
        return payload, {b: put(np.diff(s, prepend=np.uint64(0)), many.astype(np.uint8)) for b, (s, many) in enumerate(packs) if len(s)}

    return emit


def _shared_anchors(_: list[int], packs: list[bytes]) -> list[bytes]:
    """Per pack, which anchors stand in at least two documents."""
    read = [take(p) for p in packs]
    anchors = [np.cumsum(d, dtype=np.uint64) for d, _ in read]
    values, inverse, times = np.unique(np.concatenate(anchors), return_inverse=True, return_counts=True)
    shared = times > 1
    np.logical_or.at(shared, inverse, np.concatenate([m for _, m in read]).astype(bool))
    found, at, out = shared[inverse], 0, []
    for a in anchors:
        out.append(squeeze(np.packbits(found[at : at + len(a)]).tobytes()))
        at += len(a)
    return out


def _emit_contexts(n_buckets: int, length: int):
    def emit(payload: bytes, answers: dict[int, bytes]):
        w = Windows(*_load(payload)[:3], length)
        a = w.anchors()
        by, _ = _anchor_packs(w, a, n_buckets)
        shared = [s[np.unpackbits(np.frombuffer(unsqueeze(answers[b]), np.uint8), count=len(s)).astype(bool)] for b, s in enumerate(by) if len(s)]
        shared = np.sort(np.concatenate(shared)) if shared else np.zeros(0, np.uint64)
        at = np.minimum(np.searchsorted(shared, a), max(len(shared) - 1, 0))
        mask = shared[at] == a if len(shared) else np.zeros(len(a), bool)
        w.narrow(mask)
        c = w.contexts(a[mask])
        at, ends = c.packs(n_buckets)
        packs = {}
        for b in range(n_buckets):
            i = at[ends[b] : ends[b + 1]]
            if len(i):
                used, rows = np.unique(c.rows[i], return_inverse=True)
                words = [c.words[k - 1] if k else b"" for k in used.tolist()]
                packs[b] = put(*join_bytes(words), small(rows.reshape(-1)), c.least[i].view(np.uint64))
        return put(payload, np.packbits(mask)), packs

    return emit


def _classes(classes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Classes split by one further word."""
    return np.unique(classes * np.int64(int(words.max()) + 1) + words, return_inverse=True)[1]


def _extend(length: int):
    reach = length - SHINGLE

    def reduce(_: list[int], packs: list[bytes]) -> list[bytes]:
        """Per pack, context and number of words before the anchor: whether a document smaller than the block's least has the window, and the smallest such."""
        numbers, parts, least = {b"": 0}, [], []
        for pack in packs:
            n, data, rows, ids = take(pack)
            local = np.fromiter((numbers.setdefault(w, len(numbers)) for w in split_bytes(n, data)), np.int64, len(n))
            parts.append(local[rows].reshape(-1, 2 * reach + SHINGLE))
            least.append(ids.view(np.int64))
        rows, own = np.concatenate(parts), np.concatenate(least)
        anchor = np.zeros(len(rows), np.int64)
        for k in range(SHINGLE):
            anchor = _classes(anchor, rows[:, reach + k])
        left, right = [anchor], [anchor]
        for k in range(reach):
            left.append(_classes(left[-1], rows[:, reach - 1 - k]))
            right.append(_classes(right[-1], rows[:, reach + SHINGLE + k]))
        source = np.empty((len(rows), reach + 1), np.int64)
        for k in range(reach + 1):
            window = _classes(left[k], right[reach - k])
            first = np.full(int(window.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(first, window, own)
            source[:, k] = first[window]
        out, at = [], 0
        for ids in least:
            mine = source[at : at + len(ids)]
            less = mine < ids[:, None]
            out.append(put(np.packbits(less.reshape(-1)), mine[less].view(np.uint64)))
            at += len(ids)
        return out

    return reduce


def _end(payload: bytes | None, answers: dict[int, bytes], names: list[str], n_buckets: int, length: int) -> pd.DataFrame:
    if payload is None:
        return pd.DataFrame({n: pd.Series(dtype="object") for n in [*names, *OUT]})
    payload, mask = take(payload)
    texts, ids, known, carried = _load(payload)
    w = Windows(texts, ids, known, length)
    mask = np.unpackbits(mask, count=len(w.start)).astype(bool)
    a = w.anchors()[mask]
    w.narrow(mask)
    c, reach = w.contexts(a), length - SHINGLE
    source = np.repeat(c.least[:, None], reach + 1, axis=1)
    at, ends = c.packs(n_buckets)
    for b in range(n_buckets):
        i = at[ends[b] : ends[b + 1]]
        if len(i):
            bits, values = take(answers[b])
            less = np.unpackbits(bits, count=len(i) * (reach + 1)).astype(bool).reshape(len(i), reach + 1)
            part = source[i]
            part[less] = values.view(np.int64)
            source[i] = part
    source = source[c.of_window, c.before]
    gone = source < ids[w.doc]
    start, doc, source = w.start[gone], w.doc[gone], source[gone]
    edge = np.zeros(len(w.words) + length + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    removed = np.cumsum(edge)[: len(w.words)] > 0
    # Windows with the same source that overlap or touch are one match.
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (source[1:] != source[:-1]) | (start[1:] > start[:-1] + length)]) if len(start) else np.zeros(0, np.int64)
    last = np.r_[new[1:], len(start)][: len(new)] - 1
    matches: list[list] = [[] for _ in texts]
    for d, x, y, o in zip(doc[new].tolist(), start[new].tolist(), start[last].tolist(), source[new].tolist()):
        matches[d].append({"first": x - int(w.offset[d]), "last": y + length - 1 - int(w.offset[d]), "source": o})
    kept, n_removed = [], []
    for words, at, n in zip(w.texts, w.offset.tolist(), w.n_words.tolist()):
        out = removed[at : at + n]
        if out.any():
            words = [x for x, o in zip(words, out.tolist()) if not o]
        n_removed.append(n - len(words))
        kept.append(b" ".join(words).decode("utf-8"))
    return unipc(carried).to_pandas()[names].assign(n_words=w.n_words, n_removed=n_removed, matches=matches, kept_text=kept)


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ("doc_id",), length: int = LENGTH) -> DataFrame:
    """The carried columns, n_words, n_removed, matches (first and last word of each maximal repeat, and the smallest document that has it) and kept_text."""
    p, names = buckets(df.sparkSession), [c for c in carry if c not in OUT]
    # Carried columns travel under numbers, so that none can clash.
    rows = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    x = scatter(rows, "text", _emit_anchors(p, length), BLOCK_BYTES)
    y = rescatter(x, answer(x, _shared_anchors), _emit_contexts(p, length))
    held = [f"c{i}" for i in range(len(names))]
    kinds = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in held)
    schema = f"{kinds}n_words long, n_removed long, matches array<struct<first: int, last: int, source: long>>, kept_text string"
    out = finish(y, answer(y, _extend(length)), lambda d, a: _end(d, a, held, p, length), schema)
    return out.select(*[F.col(h).alias(n) for h, n in zip(held, names)], *OUT)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS p, unnest([w[i : i + 12] FOR i IN range(1, len(w) - 11)]) AS g FROM d),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(p, p + 13)))) AS places
         FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) AS least FROM wins) WHERE least < doc_id GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(len(places), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN places IS NULL THEN w ELSE [w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(places, i)] END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""
