"""A compressed full-text index of word sequences: wavelet matrix, backward search, matching statistics."""

from __future__ import annotations

import numpy as np


class Wavelet:
    """Whole numbers below 2**levels as one packed bit vector a level; ``rank`` takes a step for each level."""

    def __init__(self, symbols: np.ndarray, levels: int) -> None:
        self.levels, n = levels, len(symbols)
        self.words = np.zeros((levels, n // 64 + 1), np.uint64)
        self.before = np.zeros((levels, n // 64 + 1), np.int32)
        self.zeros = np.zeros(levels, np.int64)
        for level in range(levels):
            bit = (symbols >> (levels - 1 - level)) & 1
            packed = np.zeros(self.words.shape[1] * 8, np.uint8)
            bytes_ = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed[: len(bytes_)] = bytes_
            self.words[level] = packed.view(np.uint64)
            np.cumsum(np.bitwise_count(self.words[level][:-1]), out=self.before[level][1:])
            self.zeros[level] = n - int(bit.sum())
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Place that ``at`` comes to among equal symbols; less that of 0, it is the number of them before ``at``."""
        at = at.copy()
        for level in range(self.levels):
            block, rest = at >> 6, (at & 63).astype(np.uint64)
            below = self.words[level][block] & ((np.uint64(1) << rest) - np.uint64(1))
            ones = self.before[level][block] + np.bitwise_count(below)
            at = np.where((symbol >> (self.levels - 1 - level)) & 1, self.zeros[level] + ones, at - ones)
        return at


def _dense(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order numbers of pairs."""
    return np.unique(a.astype(np.int64) * (int(b.max()) + 1) + b, return_inverse=True)[1].ravel()


def _shifted(a: np.ndarray, by: int) -> np.ndarray:
    """``a[i + by]``, and 0 beyond the end, which stands for the separator there."""
    out = np.zeros_like(a)
    out[: max(0, len(a) - by)] = a[by:]
    return out


class FMIndex:
    """Index of texts one after the other, each ended by a separator; matches of up to ``depth`` words are told apart.

    Suffixes are ordered by their first ``depth`` words, which is all that backward search to that length needs. Kept are the
    wavelet matrix of the words before the suffixes, the lengths that neighbouring suffixes share, and the suffixes' places.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray, depth: int) -> None:
        self.depth = depth
        self.alphabet = np.unique(words)
        text = self.text(words, lengths)
        n = self.n = len(text)
        order, own, done = text, {1: text}, 1
        while done * 2 <= depth:
            own[done * 2] = _dense(own[done], _shifted(own[done], done))
            done *= 2
        order = own[done]
        for step in sorted((s for s in own if s < done), reverse=True):
            if done + step <= depth:
                order, done = _dense(order, _shifted(own[step], done)), done + step
        # Stable, so of suffixes that agree the first in the text is the first here.
        self.places = order.argsort(kind="stable").astype(np.int32)
        padded = np.concatenate([text, np.zeros(depth, text.dtype)])
        self.shared = np.zeros(n + 1, np.uint8)
        alive, a, b = np.ones(n - 1, bool), self.places[:-1], self.places[1:]
        for d in range(depth):
            alive = alive & (padded[a + d] == padded[b + d]) & (padded[a + d] > 0)
            self.shared[1:n] += alive
        self._edges: dict[int, np.ndarray] = {}
        levels = max(1, len(self.alphabet).bit_length())
        self.wavelet = Wavelet(text[self.places - 1], levels)
        symbols = np.arange(len(self.alphabet) + 1)
        first = np.searchsorted(text[self.places], symbols)
        self.shift = first - self.wavelet.rank(symbols, np.zeros(len(symbols), np.int64))

    def text(self, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Symbols from 1 on, -1 for words that the index does not have, and a 0 after each of the texts."""
        at = np.minimum(np.searchsorted(self.alphabet, words), max(0, len(self.alphabet) - 1))
        found = self.alphabet[at] == words if len(self.alphabet) else np.zeros(len(words), bool)
        out = np.zeros(len(words) + len(lengths), np.int64)
        out[np.arange(len(words)) + np.repeat(np.arange(len(lengths)), lengths)] = np.where(found, at + 1, -1)
        return out

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose suffixes begin with ``symbol`` and then what those from ``low`` to ``high`` begin with."""
        both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + np.tile(self.shift[symbol], 2)
        return both[: len(low)], both[len(low) :]

    def shorter(self, low: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that share ``length`` words with the row ``low``."""
        if length not in self._edges:
            self._edges[length] = np.append(np.flatnonzero(self.shared[:-1] < length), self.n) if length else np.array([0, self.n])
        edges = self._edges[length]
        at = np.searchsorted(edges, low, side="right")
        return edges[at - 1], edges[at]

    def matching_statistics(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of ``text`` (from ``self.text``) the length of the longest match that starts there, at most
        ``depth``, and the first row of its interval. All texts are searched at once, each from its end."""
        ends = np.flatnonzero(text == 0)
        lengths = np.diff(ends, prepend=-1) - 1
        by = np.argsort(-lengths, kind="stable")
        ends, lengths = ends[by], lengths[by]
        out, rows = np.zeros(len(text), np.int32), np.zeros(len(text), np.int64)
        low, high, size = np.zeros(len(ends), np.int64), np.full(len(ends), self.n), np.zeros(len(ends), np.int64)
        for step in range(int(lengths[0]) if len(lengths) else 0):
            live = int(np.searchsorted(-lengths, -step, side="left"))
            at = ends[:live] - 1 - step
            symbol, l, h, s = text[at], low[:live], high[:live], size[:live]
            full = np.flatnonzero(s == self.depth)
            l[full], h[full] = self.shorter(l[full], self.depth - 1)
            s[full] = self.depth - 1
            todo = np.flatnonzero(symbol > 0)
            lost = np.flatnonzero(symbol < 0)
            while len(todo):
                a, b = self.extend(symbol[todo], l[todo], h[todo])
                good = a < b
                l[todo[good]], h[todo[good]] = a[good], b[good]
                s[todo[good]] += 1
                # No such match: the longest shorter one that has other neighbours is tried next.
                todo = todo[~good]
                lost = np.concatenate([lost, todo[s[todo] == 0]])
                todo = todo[s[todo] > 0]
                less = np.maximum(self.shared[l[todo]], self.shared[h[todo]])
                for d in np.unique(less):
                    some = todo[less == d]
                    l[some], h[some] = self.shorter(l[some], int(d))
                    s[some] = d
            l[lost], h[lost], s[lost] = 0, self.n, 0
            out[at], rows[at] = s, l
        return out, rows
