"""Bidirectional FM-index over a delimited list of words, searched for many patterns at once.

Plain helper of ``spelling``: what a task does with one bucket of words. Intervals of suffix ranks are kept in numpy
arrays, one entry a pattern, so that each step is a few array operations. Memory follows the letters of the bucket.
"""

from __future__ import annotations

import numpy as np

#: What a search may do to the pattern: replace a letter, leave one out, put one in.
REPLACE, DELETE, INSERT = 0, 1, 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes by prefix doubling; the last symbol is less than all others."""
    rank, k, n = text.astype(np.int64), 1, len(text)
    while True:
        second = np.zeros(n, np.int64)
        second[: max(n - k, 0)] = rank[k:] + 1
        pair = rank * (n + 2) + second
        order = np.argsort(pair, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(np.diff(pair[order]) != 0)))
        if n < 2 or new[order[-1]] == n - 1:
            return order
        rank, k = new, 2 * k


class Half:
    """Suffix array of one direction, and its transform as one sorted array of (symbol, rank)."""

    def __init__(self, text: np.ndarray):
        self.sa, self.n1 = suffix_array(text), len(text) + 1
        before = text[self.sa - 1].astype(np.int64)
        self.keys = np.sort(before * self.n1 + np.arange(len(text)))

    def step(self, symbol, rank) -> np.ndarray:
        """The rank that ``rank`` becomes when ``symbol`` is put in front of the pattern."""
        return np.searchsorted(self.keys, symbol * self.n1 + rank)


class FMIndex:
    def __init__(self, words: list[str]):
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.letters = np.unique(letters)
        lengths = np.array([len(w) for w in words])
        body = np.ones(len(letters) + len(words) + 1, np.int64)
        at = np.concatenate(([0], np.cumsum(lengths + 1)))  # of the delimiters
        inside = np.ones(len(body), bool)
        inside[at] = False
        body[inside] = np.searchsorted(self.letters, letters) + 2
        self.word_at = np.full(len(body), -1)
        self.word_at[at] = np.arange(len(at))
        self.symbols = len(self.letters) + 2
        self.text, self.n = body, len(body)
        #: Extends to the left, and to the right.
        self.halves = [Half(np.append(body, 0)), Half(np.append(body[::-1], 0))]

    def codes(self, text: str) -> np.ndarray:
        return np.searchsorted(self.letters, np.frombuffer(text.encode("utf-32-le"), np.uint32)) + 2

    def exact(self, patterns: list[str], right: bool) -> tuple[np.ndarray, np.ndarray]:
        """Intervals, for going on in the other direction, of patterns that occur at a delimiter.

        A pattern is matched from its inner end outwards, to the right (``right``) or to the left, up to the delimiter;
        the interval of the other direction is carried along: within it the found part comes behind all smaller symbols.
        """
        index = self.halves[right]
        tracks, offsets, sizes = self.tracks([p if right else p[::-1] for p in patterns])
        lo, other, size = np.zeros(len(patterns), np.int64), np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n + 1)
        every = np.arange(self.symbols)
        for j in range(int(sizes.max(initial=0))):
            now = np.nonzero(j < sizes)[0]
            c = tracks[offsets[now] + j]
            starts, ends = (index.step(every[None, :], x[:, None]) for x in (lo[now], lo[now] + size[now]))
            counts = ends - starts
            row = np.arange(len(now))
            other[now] += np.where(every[None, :] < c[:, None], counts, 0).sum(1)
            lo[now], size[now] = starts[row, c], counts[row, c]
        return other, size

    def tracks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The symbols of all texts, a delimiter behind each; where each starts; and its length with the delimiter."""
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        offsets = np.concatenate(([0], np.cumsum(sizes)))[:-1].astype(np.int64)
        out = np.ones(int(sizes.sum()), np.int64)
        inside = np.ones(len(out), bool)
        inside[offsets + sizes - 1] = False
        out[inside] = self.codes("".join(texts))
        return out, offsets, sizes

    def near(self, rests: list[str], middle: np.ndarray, kinds: np.ndarray, lo: np.ndarray, size: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, word) of all words that an interval's pattern and its rest give with exactly one error of the pattern's kind.

        ``rests`` are read in the direction of the search; the error is among their first ``middle`` letters (an
        insertion, up to behind them). Every pattern is itself in the index, so that an interval of one word holds no other.
        """
        index = self.halves[right]
        tracks, offsets, sizes = self.tracks(rests)
        letters = np.arange(2, self.symbols)
        q, lo, hi = np.arange(len(rests)), lo, lo + size
        found: list[tuple[np.ndarray, ...]] = []  # pattern, next place, interval: with their error behind them
        for j in range(int(middle.max(initial=0)) + 1):
            alive = (hi - lo > 1) & (j < middle[q] + (kinds[q] == INSERT))
            q, lo, hi = q[alive], lo[alive], hi[alive]
            if not len(q):
                break
            c = tracks[offsets[q] + j]
            cut = kinds[q] == DELETE
            found.append((q[cut], np.full(cut.sum(), j + 1), lo[cut], hi[cut]))
            w = np.nonzero(~cut)[0]
            starts, ends = (index.step(letters[None, :], x[w][:, None]) for x in (lo, hi))
            at, to = np.nonzero((ends > starts) & ((letters[None, :] != c[w][:, None]) | (kinds[q[w]] == INSERT)[:, None]))
            found.append((q[w[at]], j + (kinds[q[w[at]]] == REPLACE), starts[at, to], ends[at, to]))
            lo, hi = index.step(c, lo), index.step(c, hi)
        if not found:
            return np.array([], np.int64), np.array([], np.int64)
        q, at, lo, hi = (np.concatenate(x) for x in zip(*found))
        done: list[np.ndarray] = []
        while len(q):
            c = tracks[offsets[q] + at]
            lo, hi, at = index.step(c, lo), index.step(c, hi), at + 1
            alive = hi > lo
            q, at, lo, hi = q[alive], at[alive], lo[alive], hi[alive]
            over = at == sizes[q]
            done.append(np.stack((q[over], lo[over])))
            q, at, lo, hi = q[~over], at[~over], lo[~over], hi[~over]
        # a letter next to its like can be left out or put in at several places, with one result
        q, lo = np.unique(np.concatenate(done, axis=1), axis=1) if done else (np.array([], np.int64),) * 2
        place = index.sa[lo]
        return q, self.word_at[self.n - 1 - place] - 1 if right else self.word_at[place]
