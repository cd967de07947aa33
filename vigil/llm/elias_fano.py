"""Elias-Fano sequences and an n-gram trie over them, in flat buffers that can be memory-mapped."""

from __future__ import annotations

import tempfile

import numpy as np

_CHUNK = 1 << 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
#: Ones of each byte, and where its k-th one is; 8 where there is none.
_ONES = _BITS.sum(axis=1, dtype=np.uint8)
_PLACE = np.full((256, 64), 8, np.uint8)
_PLACE[_BITS.nonzero()[0], (np.cumsum(_BITS, axis=1) - 1)[_BITS > 0]] = _BITS.nonzero()[1]


class EliasFano:
    """A non-decreasing sequence: l low bits of each value packed one after the other, the high parts in unary.

    Value i is ((position of the i-th one) - i) << l | low bits. Values with high part h stand between the h-th and
    the next zero, so a successor is searched among few values. About 2 + log2(universe / n) bits a value.
    """

    def __init__(self, head: np.ndarray, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.l = int(head[0]), int(head[1])
        self.low, self.high, self.ones = low, high, ones

    @staticmethod
    def build(values: np.ndarray) -> list[np.ndarray]:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        part = values & np.uint64((1 << bits) - 1)
        each = ((part[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        low = np.r_[np.packbits(each.reshape(-1), bitorder="little"), np.zeros(8, np.uint8)]
        at = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = -(-(int(at[-1]) + 2 if n else 1) // 64) * 64
        flags = np.zeros(size, np.uint8)
        flags[at] = 1
        ones = np.r_[0, np.cumsum(flags.reshape(-1, 64).sum(axis=1, dtype=np.int64))].astype(np.uint64)
        return [np.array([n, bits], np.uint64), low, np.packbits(flags, bitorder="little"), ones]

    def _select(self, k: np.ndarray, before: np.ndarray, ones: bool) -> np.ndarray:
        """Position of the k-th one or zero; before: how many there are ahead of each 64-bit word."""
        word = np.searchsorted(before, k, "right") - 1
        out = np.empty(len(k), np.int64)
        blocks = self.high.reshape(-1, 8)
        for a in range(0, len(k), _CHUNK):
            w = word[a : a + _CHUNK]
            part = blocks[w] if ones else ~blocks[w]
            left = (k[a : a + _CHUNK] - before[w]).astype(np.uint8)
            run = np.cumsum(_ONES[part], axis=1, dtype=np.uint8)
            at = np.minimum((run <= left[:, None]).sum(axis=1), 7)
            row = np.arange(len(w))
            here = part[row, at]
            out[a : a + _CHUNK] = w * 64 + at * 8 + _PLACE[here, left - (run[row, at] - _ONES[here])]
        return out

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), np.uint64)
        window = np.ndarray((len(self.low) - 7,), "<u8", self.low, 0, (1,))
        at = i * self.l
        return (window[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.l) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        high = self._select(i, self.ones.astype(np.int64), True) - i
        return (high.astype(np.uint64) << np.uint64(self.l)) | self._low(i)

    def find(self, values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each value its place in [begin, end), or -1: the successor there, if it is equal."""
        zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones.astype(np.int64)
        high, low = (values >> np.uint64(self.l)).astype(np.int64), values & np.uint64((1 << self.l) - 1)
        there = high < zeros[-1]
        h = np.where(there, high, 0)
        first = np.where(h > 0, self._select(np.maximum(h - 1, 0), zeros, False) - np.maximum(h - 1, 0), 0)
        last = self._select(h, zeros, False) - h
        a, b = np.maximum(first, begin), np.minimum(last, end)
        top = b.copy()
        while (open_ := there & (a < b)).any():
            q = np.flatnonzero(open_)
            mid = (a[q] + b[q]) >> 1
            less = self._low(mid) < low[q]
            a[q] = np.where(less, mid + 1, a[q])
            b[q] = np.where(less, b[q], mid)
        ok = there & (a < top)
        ok[ok] = self._low(a[ok]) == low[ok]
        return np.where(ok, a, -1)


class BigramTrie:
    """Two levels: contexts with back-off codes and pointers to their successors; successors with probability codes.

    Pointers and contexts are Elias-Fano sequences. Successors are stored relative to their context: each range has
    the last value of the range before added, which makes the whole level non-decreasing; a query adds the same
    base and searches the successor within its context's range.
    """

    PARTS = 4

    def __init__(self, buffer: np.ndarray):
        sizes = buffer[: 8 * 14].view(np.int64)
        at, parts = 8 * 14, []
        for n in sizes.tolist():
            parts.append(buffer[at : at + n])
            at += -(-n // 8) * 8
        sequences = [EliasFano(p[0].view(np.uint64), p[1], p[2], p[3].view(np.uint64)) for p in (parts[0:4], parts[4:8], parts[8:12])]
        self.contexts, self.pointers, self.successors = sequences
        self.backoff, self.probability = parts[12].view(np.uint16), parts[13].view(np.uint16)
        self.step = float(buffer[at : at + 8].view(np.float64)[0])

    @staticmethod
    def build(context: np.ndarray, word: np.ndarray, probability: np.ndarray, backoff: np.ndarray, step: float = 0.0) -> bytes:
        """Rows ascend by (context, word); backoff has one code per distinct context; step is that of the codes, in log10."""
        first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(context) else np.zeros(0, np.int64)
        begin = np.r_[first, len(context)]
        highest = word[begin[1:] - 1].astype(np.uint64) if len(first) else np.zeros(0, np.uint64)
        base = np.r_[np.uint64(0), np.cumsum(highest, dtype=np.uint64)[:-1]] if len(first) else highest
        shifted = word.astype(np.uint64) + np.repeat(base, np.diff(begin))
        arrays = [*EliasFano.build(context[first]), *EliasFano.build(begin), *EliasFano.build(shifted), backoff, probability]
        raw = [np.ascontiguousarray(a).view(np.uint8).tobytes() for a in arrays]
        return np.array([len(r) for r in raw], np.int64).tobytes() + b"".join(r + b"\0" * (-len(r) % 8) for r in raw) + np.array([step]).tobytes()

    @staticmethod
    def mapped(data: bytes) -> BigramTrie:
        """The trie over a memory-mapped scratch file that is gone as soon as nothing maps it."""
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            return BigramTrie(np.memmap(f, np.uint8, "r"))

    def lookup(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability code and back-off code of each pair; 0 where it isn't there."""
        none = np.zeros(len(context), np.uint16)
        if not len(self.backoff) or not len(context):
            return none, none.copy()
        # Equal contexts in a row are looked up once.
        start = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
        times = np.diff(np.r_[start, len(context)])
        zero = np.zeros(len(start), np.int64)
        c = self.contexts.find(context[start].astype(np.uint64), zero, zero + len(self.backoff))
        at, each = c[c >= 0], times[c >= 0]
        begin, end = self.pointers.access(at).astype(np.int64), self.pointers.access(at + 1).astype(np.int64)
        base = np.where(begin > 0, self.successors.access(np.maximum(begin - 1, 0)), np.uint64(0))
        known = np.flatnonzero(np.repeat(c >= 0, times))
        found = self.successors.find(word[known].astype(np.uint64) + np.repeat(base, each), np.repeat(begin, each), np.repeat(end, each))
        p, b = none, none.copy()
        p[known] = np.where(found >= 0, self.probability[np.maximum(found, 0)], 0)
        b[known] = np.repeat(self.backoff[at], each)
        return p, b
