"""Generalised suffix automaton over word numbers, and the matching of texts against it."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import repeat

import numpy as np

#: A-Z to a-z; every byte that is no word character to a space. Bytes from 0x80 up belong to words.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
PAIR_BITS = 20


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


class ItemAutomaton:
    """All substrings (by words) of a block of items; finds where windows of items occur in a text.

    A window is ``window`` consecutive words of an item, or the whole of a shorter one.
    """

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.names: list[str] = []
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.len = [0]
        texts = []
        for name, ws in items:
            if ws:
                texts.append([self.vocab.setdefault(w, len(self.vocab)) for w in ws])
                self.names.append(name)
        for ids in texts:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.shortest = min([window, *map(len, texts)])
        self._windows(texts)
        self._pairs(texts)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        cur = self._state(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return cur

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.len.append(length)
        return len(self.len) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.len[p] + 1)
        self.next[clone] = dict(self.next[q])
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _windows(self, texts: list[list[int]]) -> None:
        """full: items by state that holds one of their windows; short: (length, item) of whole shorter items by state."""
        full: dict[int, set[int]] = {}
        short: dict[int, list[tuple[int, int]]] = {}
        for item, ids in enumerate(texts):
            s = 0
            w = min(self.window, len(ids))
            for i, c in enumerate(ids):
                s = self.next[s][c]
                if i + 1 >= w:
                    t = s
                    while self.len[self.link[t]] >= w:
                        t = self.link[t]
                    if w == self.window:
                        full.setdefault(t, set()).add(item)
                    else:
                        short.setdefault(t, []).append((w, item))
        self.full = {t: tuple(sorted(x)) for t, x in full.items()}
        # What a state's own and shorter suffixes say about short items.
        self.short: dict[int, tuple[tuple[int, int], ...]] = {}
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            if got := tuple(short.get(s, ())) + self.short.get(self.link[s], ()):
                self.short[s] = got

    def _pairs(self, texts: list[list[int]]) -> None:
        """Hash table of adjacent word pairs: a text is followed word by word only where all its pairs may occur."""
        self.pairs = np.zeros(1 << PAIR_BITS, bool)
        for ids in texts:
            a = np.array(ids, np.int64)
            self.pairs[self._pair(a[:-1], a[1:])] = True

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * 0x9E3779B1 + b * 0x85EBCA6B) >> 7) & ((1 << PAIR_BITS) - 1)

    def stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Word ranges [start, end) of known words and pairs that are long enough for a window."""
        known = ids >= 0
        if len(ids) < self.shortest or not known.any():
            return []
        if self.shortest == 1:
            flags, more = known, 0
        else:
            flags, more = known[:-1] & known[1:] & self.pairs[self._pair(ids[:-1], ids[1:])], 1
        edge = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + more
        long = ends - starts >= self.shortest
        return list(zip(starts[long].tolist(), ends[long].tolist()))

    def match(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged word ranges [start, end) covered by windows of items, and the items whose windows occur."""
        ids = np.fromiter(map(self.vocab.get, ws, repeat(-1)), np.int64, len(ws))
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        nxt, link, length, window = self.next, self.link, self.len, self.window

        def hit(start: int, end: int) -> None:
            while spans and spans[-1][1] >= start:
                start = min(start, spans.pop()[0])
            spans.append((start, end))

        for start, end in self.stretches(ids):
            s = n = 0
            for i, c in enumerate(ids[start:end].tolist(), start):
                while s and c not in nxt[s]:
                    s = link[s]
                    n = length[s]
                if c in nxt[s]:
                    s = nxt[s][c]
                    n += 1
                if n >= window:
                    t = s
                    while length[link[t]] >= window:
                        t = link[t]
                    if t in self.full:
                        found.update(self.full[t])
                        hit(i + 1 - window, i + 1)
                for w, item in self.short.get(s, ()):
                    if w <= n:
                        found.add(item)
                        hit(i + 1 - w, i + 1)
        return spans, found
