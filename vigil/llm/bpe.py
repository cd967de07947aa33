"""Byte-pair merging over a heap and a linked list, and the vocabularies that it runs on.

A word's symbols form a doubly linked list. Every adjacent pair that the vocabulary can merge waits in a heap
under (rank, position), so the lowest rank comes first and, of equal ranks, the leftmost. A popped pair whose
symbols have changed since it was pushed is stale and skipped. Each merge pushes at most two new pairs, so a
word of n symbols takes O(n log n) steps however long it is.
"""

from __future__ import annotations

import base64
import json
from functools import lru_cache
from heapq import heapify, heappop, heappush


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def merge(symbols: list, ranks: dict) -> tuple[list, int]:
    """Merge by rank until nothing merges: the remaining symbols and the number of merges.

    ranks maps (left, right) to the pair's rank; the merged symbol is left + right.
    """
    n = len(symbols)
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    if not heap:
        return symbols, 0
    heapify(heap)
    symbol: list = list(symbols)
    after = [*range(1, n), -1]
    before = [*range(-1, n - 1)]
    merges = 0
    while heap:
        _, i, left, right = heappop(heap)
        j = after[i]
        if symbol[i] != left or j < 0 or symbol[j] != right:
            continue
        merges += 1
        joined = symbol[i] = left + right
        symbol[j] = None
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            if (r := ranks.get((joined, symbol[k]))) is not None:
                heappush(heap, (r, i, joined, symbol[k]))
        h = before[i]
        if h >= 0 and (r := ranks.get((symbol[h], joined))) is not None:
            heappush(heap, (r, h, symbol[h], joined))
    return [s for s in symbol if s is not None], merges


class TokenRanks(dict):
    """(left bytes, right bytes) -> rank of the token that they form; computed from a vocabulary of byte strings."""

    def __init__(self, tokens: dict[bytes, int]):
        self.tokens = tokens

    def get(self, pair, default=None):
        return self.tokens.get(pair[0] + pair[1], default)


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    """A .tiktoken file: token bytes -> id, which is also the merge rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def load_word_bpe(path: str) -> tuple[dict[tuple[str, str], int], list[str], str]:
    """A tokenizers .json of word BPE: (merge ranks, special strings, end-of-word suffix)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    suffix, vocab = model["end_of_word_suffix"], model["vocab"]
    if any(s + e not in vocab for s in byte_symbols() for e in ("", suffix)):
        raise ValueError(f"{path}: not every byte is in the vocabulary")
    ranks = {tuple(pair if isinstance(pair, list) else pair.split(" ")): r for r, pair in enumerate(model["merges"])}
    return ranks, [t["content"] for t in spec["added_tokens"]], suffix
