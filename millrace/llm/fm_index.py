"""A full-text index of a sequence of word numbers: suffix order, BWT, wavelet ranks, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray, bits: int) -> np.ndarray:
    """Order of all suffixes of ``seq``, by prefix doubling on the suffixes not yet told apart.

    The first sort takes as many symbols at once as fit into 60 bits; each round doubles the
    length compared and touches only suffixes that still tie.  Shorter suffixes come first.
    """
    n = len(seq)
    if n < 2:
        return np.arange(n)
    k = min(n, max(1, 60 // (bits + 1)))
    key = np.zeros(n, np.int64)
    for i in range(k):
        key <<= bits + 1
        key[: n - i] |= seq[i:].astype(np.int64) + 1  # 0: past the end
    sa = np.argsort(key)
    ordered = key[sa]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a group's rank is its first place
    while True:
        edge = np.r_[np.flatnonzero(new), n]
        size = np.diff(edge)
        open_at = edge[:-1][size > 1]
        if not len(open_at):
            return sa
        length = size[size > 1]
        places = np.repeat(open_at - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())
        s = sa[places]
        nxt = s + k
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        first = np.repeat(np.arange(len(open_at), dtype=np.int64), length)
        order = np.argsort(first * (n + 2) + second)
        s, second = s[order], second[order]
        sa[places] = s
        fresh = np.r_[True, (second[1:] != second[:-1]) | (first[1:] != first[:-1])]
        new[places] = fresh
        rank[s] = np.maximum.accumulate(np.where(fresh, places, 0))
        k *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector and its counts per bit of the symbol."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        """``levels``: the bits of the symbols, highest first, each level in the order that those above give."""
        self.bits = len(levels)
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for bit in levels:
            count = np.zeros(len(bit) + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(bit) - int(count[-1]))

    @staticmethod
    def levels(seq: np.ndarray, bits: int) -> list[np.ndarray]:
        out, seq = [], seq.astype(np.int32)
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level) & 1 == 1
            out.append(bit)
            seq = np.concatenate([seq[~bit], seq[bit]])
        return out

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol occurs among the first ``upto`` of the sequence."""
        lo, hi = np.zeros(len(symbol), np.int64), upto.astype(np.int64)
        for i, (count, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = (symbol >> (self.bits - 1 - i)) & 1 == 1
            a, b = count[lo], count[hi]
            lo = np.where(one, zeros + a, lo - a)
            hi = np.where(one, zeros + b, hi - b)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at the given places."""
        at, symbol = at.astype(np.int64), np.zeros(len(at), np.int64)
        for count, zeros in zip(self.ones, self.zeros, strict=True):
            a = count[at]
            one = count[at + 1] > a
            symbol = symbol * 2 + one
            at = np.where(one, zeros + a, at - a)
        return symbol

    def below(self, symbol: np.ndarray) -> np.ndarray:
        """How many of the sequence are less than each symbol: what turns to the zeros where the symbol has a one."""
        lo, hi, less = np.zeros(len(symbol), np.int64), np.full(len(symbol), len(self.ones[0]) - 1, np.int64), np.zeros(len(symbol), np.int64)
        for i, (count, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = (symbol >> (self.bits - 1 - i)) & 1 == 1
            a, b = count[lo], count[hi]
            less += np.where(one, (hi - b) - (lo - a), 0)
            lo = np.where(one, zeros + a, lo - a)
            hi = np.where(one, zeros + b, hi - b)
        return less


class FMIndex:
    """Backward search and location of patterns in a sequence of numbers from 0 to ``top``.

    0 separates: patterns must not hold it.  Of the suffix positions one in ``every`` is kept.
    """

    def __init__(self, levels: list[np.ndarray], marked: np.ndarray, kept: np.ndarray) -> None:
        self.n, self.levels, self.marked, self.kept = len(marked), levels, marked, kept
        self.tree = WaveletMatrix(levels)
        self.marks = np.r_[0, np.cumsum(marked)].astype(np.int32)

    @classmethod
    def build(cls, seq: np.ndarray, top: int, every: int = 16) -> FMIndex:
        # a symbol below all others ends the sequence: each suffix then has one predecessor, in the same order
        seq = np.r_[seq.astype(np.int64) + 1, 0]
        bits = cls._bits(top)
        sa = suffix_array(seq, bits)
        marked = sa % every == 0
        return cls(WaveletMatrix.levels(seq[sa - 1], bits), marked, sa[marked].astype(np.int32))

    @staticmethod
    def _bits(top: int) -> int:
        return max(1, int(top + 1).bit_length())

    def packed(self) -> tuple[bytes, bytes, bytes]:
        """Wavelet bits, marks and kept positions as bytes."""
        return b"".join(np.packbits(x).tobytes() for x in self.levels), np.packbits(self.marked).tobytes(), self.kept.tobytes()

    @classmethod
    def unpacked(cls, length: int, top: int, tree: bytes, marks: bytes, kept: bytes) -> FMIndex:
        """The index of a sequence of ``length`` numbers from what ``packed`` gave."""
        n, wide = length + 1, -(-(length + 1) // 8)
        bits = np.frombuffer(tree, np.uint8).reshape(cls._bits(top), wide)
        flags = np.unpackbits(np.frombuffer(marks, np.uint8), count=n).astype(bool)
        return cls([np.unpackbits(x, count=n) for x in bits], flags, np.frombuffer(kept, np.int32))

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges [lo, hi) in suffix order of rows of patterns of one length; empty ones have lo = hi."""
        m = len(patterns)
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        live = np.arange(m)
        for c in range(patterns.shape[1] - 1, -1, -1):
            s = patterns[live, c] + 1
            both = self.tree.rank(np.r_[s, s], np.r_[lo[live], hi[live]])
            first = self.tree.below(s)
            a, b = first + both[: len(s)], first + both[len(s) :]
            lo[live], hi[live] = a, b
            live = live[b > a]
            if not len(live):
                break
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of rows in suffix order: steps back to a kept position."""
        pos, steps = np.full(len(rows), -1, np.int64), 0
        at, who = rows.astype(np.int64), np.arange(len(rows))
        while len(who):
            here = self.marks[at + 1] > self.marks[at]
            pos[who[here]] = self.kept[self.marks[at[here]]] + steps
            at, who = at[~here], who[~here]
            if len(who):
                s = self.tree.access(at)
                at = self.tree.below(s) + self.tree.rank(s, at)
                steps += 1
        return pos
