"""A compressed full-text index: backward search over many texts of integer symbols.

The texts, each closed by a separator of its own, are one string. Kept are the
first row of every symbol and, instead of the Burrows-Wheeler transform, its
inverse step psi: for the rows of one symbol it is increasing, so that the rank of
a row among them is found by bisection, and that is all a backward search needs.
psi also leads from a row to the one that starts a symbol later, so that a match
can be extended to the right too. psi is stored in a plane of 16 and one of 8 or
16 bits; the positions of chosen places (anchors) are sampled. Neither the texts
nor the suffix array are kept.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of a string whose repeated stretches all end before a unique symbol, and its inverse."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    s = text[order]
    head = np.ones(n, bool)
    head[1:] = s[1:] != s[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    width = 1
    while True:
        slots = np.flatnonzero(~(head & np.append(head[1:], True))) if n else np.zeros(0, np.int64)
        if not len(slots):
            return order, rank
        at = order[slots]
        key = rank[at] * n + rank[at + width]  # equal stretches end before a separator, so at + width is inside
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        order[slots] = at
        head[slots] = new
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        width *= 2


class TextIndex:
    """Index of texts given end to end (``symbols``, ``sizes``), with the positions of ``anchors`` (places in ``symbols``) sampled."""

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray, anchors: np.ndarray):
        self.alphabet, ids = np.unique(symbols, return_inverse=True)
        texts, total = len(sizes), len(symbols)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        number = np.repeat(np.arange(texts), sizes)  # the text of every symbol
        place = np.arange(total) + number  # with the separators between
        n = total + texts
        if n >= 1 << 31:
            raise ValueError("an index holds fewer than 2^31 symbols")
        string = np.empty(n, np.int64)
        string[place] = ids + texts
        string[ends + np.arange(texts)] = np.arange(texts)
        order, row = suffix_order(string)
        psi = row[np.append(np.arange(1, n), 0)[order]] if n else order
        self.n = n
        self._low = (psi & 0xFFFF).astype(np.uint16)
        self._high = (psi >> 16).astype(np.uint8 if n < 1 << 24 else np.uint16)
        self.first = np.concatenate([[texts], texts + np.cumsum(np.bincount(ids, minlength=len(self.alphabet)))]).astype(np.int32)
        sampled = row[place[anchors]]
        by = np.argsort(sampled)
        self._rows = sampled[by].astype(np.int32)
        self._text = number[anchors][by].astype(np.int32)
        self._offset = (anchors - starts[number[anchors]])[by].astype(np.int32)

    def nbytes(self) -> int:
        """Bytes of the index without the alphabet."""
        return sum(x.nbytes for x in (self._low, self._high, self.first, self._rows, self._text, self._offset))

    def psi(self, row: np.ndarray) -> np.ndarray:
        """The rows whose suffixes start one symbol later."""
        return self._low[row] + self._high[row].astype(np.int64) * 65536

    def ids(self, symbols: np.ndarray) -> np.ndarray:
        """Numbers of the symbols in the alphabet, -1 for those that no text has."""
        if not len(self.alphabet):
            return np.full(len(symbols), -1)
        at = np.minimum(np.searchsorted(self.alphabet, symbols), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == symbols, at, -1)

    def _below(self, c: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The first row of symbol c whose psi is not below ``row``."""
        lo, hi = self.first[c], self.first[c + 1]
        while (open_ := lo < hi).any():
            mid = np.where(open_, lo + (hi - lo >> 1), 0)
            less = open_ & (self.psi(mid) < row)
            lo = np.where(less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        return lo

    def step(self, lo: np.ndarray, hi: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of the backward search: the rows of c followed by what the rows [lo, hi) start with; an unknown c (-1) has none."""
        known = np.maximum(c, 0)
        a, b = self._below(known, lo), self._below(known, hi)
        return np.where(c < 0, 0, a), np.where(c < 0, 0, b)

    def search(self, symbols: np.ndarray) -> tuple[int, int]:
        """The rows that start with a whole pattern."""
        c = self.ids(np.asarray(symbols, np.int64))
        if not len(c) or (c < 0).any():
            return 0, 0
        lo, hi = self.first[c[-1:]], self.first[c[-1:] + 1]
        for k in range(len(c) - 2, -1, -1):
            lo, hi = self.step(lo, hi, c[k : k + 1])
        return int(lo[0]), int(max(lo[0], hi[0]))

    def anchored(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The samples [a, b) that start with symbol c; none for -1."""
        if not len(self.alphabet):
            return np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
        known = np.maximum(c, 0)
        a, b = np.searchsorted(self._rows, self.first[known]), np.searchsorted(self._rows, self.first[known + 1])
        return np.where(c < 0, 0, a), np.where(c < 0, 0, b)

    def located(self, sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text number and offset of samples."""
        return self._text[sample], self._offset[sample]

    def extended(self, sample: np.ndarray, ids: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The maximal matches through samples: how far each goes to the left and right, until it breaks.

        Sample k is matched by the query symbol ``ids[at[k]]``, whose text is ``ids[lo[k]:hi[k]]``.
        """
        left, right = np.zeros(len(sample), np.int64), np.zeros(len(sample), np.int64)
        live = np.flatnonzero(at > lo)
        row = self._rows[sample[live]]
        while len(live):
            c = ids[at[live] - left[live] - 1]
            a, b = self.step(row, row + 1, c)
            ok = b > a
            live, row = live[ok], a[ok]
            left[live] += 1
            more = at[live] - left[live] > lo[live]
            live, row = live[more], row[more]
        live = np.flatnonzero(at + 1 < hi)
        row = self._rows[sample[live]]
        while len(live):
            row = self.psi(row)
            c = ids[at[live] + right[live] + 1]
            known = np.maximum(c, 0)
            ok = (c >= 0) & (row >= self.first[known]) & (row < self.first[known + 1])
            live, row = live[ok], row[ok]
            right[live] += 1
            more = at[live] + right[live] + 1 < hi[live]
            live, row = live[more], row[more]
        return left, right
