"""A generalised suffix automaton over the words of benchmark items, and the matching of texts against it.

States stand for the sets of word sequences that end at the same places of the items; a link leads to the longest
suffix with more places. Reading a text word by word keeps the longest suffix of what was read that occurs in an item.
"""

from __future__ import annotations

import re
from collections import defaultdict

#: Byte by byte: A-Z to a-z, what may be in a word stays, everything else becomes a space. Lengths don't change.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
WORD = re.compile(rb"[^\x20]+")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(NORMAL).split() if text else []


class Automaton:
    """Pieces are (item, words, whole): whole says that the words are the whole of an item, not a stretch of a longer one."""

    def __init__(self, pieces: list[tuple[str, list[bytes], bool]], window: int):
        self.window, self.ids = window, {}
        self.go: dict[int, int] = {}  # (state << 32 | word) -> state; the root is 0
        self.link, self.length, self._out = [-1], [0], [[]]
        paths = []
        for item, words, whole in pieces:
            state, path = 0, []
            for w in words:
                path.append(state := self._extend(state, self.ids.setdefault(w, len(self.ids))))
            paths.append((item, path, whole))
        self._mark(paths)
        self._out = None
        self.least = min([window, *(len(p) for _, p, whole in paths if whole and p)])
        self.runs = re.compile(b"\x01{%d,}" % self.least)

    def _new(self, length: int, link: int, like: int | None = None) -> int:
        s = len(self.link)
        self.link.append(link)
        self.length.append(length)
        self._out.append([])
        for w in self._out[like] if like is not None else ():
            self._connect(s, w, self.go[like << 32 | w])
        return s

    def _connect(self, state: int, word: int, to: int) -> None:
        if self.go.get(state << 32 | word) is None:
            self._out[state].append(word)
        self.go[state << 32 | word] = to

    def _split(self, p: int, word: int, q: int) -> int:
        """A state for the sequences of q of at most length[p] + 1 words; the transitions into q from p and its suffixes go there."""
        s = self._new(self.length[p] + 1, self.link[q], q)
        self.link[q] = s
        while p >= 0 and self.go.get(p << 32 | word) == q:
            self.go[p << 32 | word] = s
            p = self.link[p]
        return s

    def _extend(self, last: int, word: int) -> int:
        known = self.go.get(last << 32 | word)
        if known is not None:  # another piece went this way
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new, p = self._new(self.length[last] + 1, 0), last
        while p >= 0 and self.go.get(p << 32 | word) is None:
            self._connect(p, word, new)
            p = self.link[p]
        if p >= 0:
            q = self.go[p << 32 | word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def _mark(self, paths) -> None:
        """Which items have the window that ends in a state, and which short items end in it."""
        n = len(self.link)
        order = sorted(range(1, n), key=self.length.__getitem__)
        self.at_window = [-1] * n  # the state of the last `window` words
        for s in order:
            if self.length[s] >= self.window:
                up = self.link[s]
                self.at_window[s] = s if self.length[up] < self.window else self.at_window[up]
        items, short = defaultdict(set), defaultdict(set)
        for item, path, whole in paths:
            for s in path:
                if self.at_window[s] >= 0:
                    items[self.at_window[s]].add(item)
            if whole and 0 < len(path) < self.window:
                short[path[-1]].add(item)
        self.items, self.short = {s: tuple(v) for s, v in items.items()}, {s: tuple(v) for s, v in short.items()}
        self.at_short = [-1] * n  # the nearest state, itself or up the links, at which a short item ends
        for s in order:
            self.at_short[s] = s if s in short else self.at_short[self.link[s]]

    def match(self, words: list[bytes]) -> tuple[list[list[int]], set[str], int]:
        """Spans [first, last] of words inside occurrences, the items that occur, and the longest match in words.

        A word that no item has ends every match, so only runs of known words that can hold an occurrence are read.
        """
        spans, found, longest = [], set(), 0
        known, go, link, length = self.ids, self.go, self.link, self.length
        for run in self.runs.finditer(bytes(map(known.__contains__, words))):
            s = n = 0
            for i in range(run.start(), run.end()):
                w = known[words[i]]
                t = go.get(s << 32 | w)
                if t is None:
                    while t is None:
                        s = link[s]
                        t = go.get(s << 32 | w)
                    n = length[s]
                s, n = t, n + 1
                longest = max(longest, n)
                first = i + 1
                if n >= self.window:
                    first = i - n + 1
                    found.update(self.items[self.at_window[s]])
                t = self.at_short[s]
                while t > 0:
                    if length[t] <= n:
                        first = min(first, i - length[t] + 1)
                        found.update(self.short[t])
                    t = self.at_short[link[t]]
                if first <= i:
                    while spans and spans[-1][1] >= first - 1:
                        first = min(first, spans.pop()[0])
                    spans.append([first, i])
        return spans, found, longest
