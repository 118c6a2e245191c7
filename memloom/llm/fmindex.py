"""A compressed FM-index over a sequence of words: BWT in a wavelet tree, backward search in lock step.

What is kept for each symbol is its BWT bits (one a level of the tree), two marks, and one text position for
each distinct run of `window` symbols: no suffix order, ranks or common prefixes remain after the build.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Bits in 64-bit words with running counts: ranks and selects for many places at once."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros(len(bits) // 64 * 64 + 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.counts = np.zeros(len(self.words) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.counts[1:])
        self.size = len(bits)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        block = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[block] + np.bitwise_count(self.words[block] & below)

    def select(self, number: np.ndarray) -> np.ndarray:
        """The place of the set bit with so many set bits before it; the size where there is none."""
        inside = number < self.counts[-1]
        block = np.minimum(np.searchsorted(self.counts, number, "right") - 1, len(self.words) - 1)
        word, left = self.words[block], number - self.counts[block]
        at = np.zeros(len(number), dtype=np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count((word >> at.astype(np.uint64)) & np.uint64((1 << half) - 1)).astype(np.int64)
            up = low <= left
            left, at = left - np.where(up, low, 0), at + np.where(up, half, 0)
        return np.where(inside, block * 64 + at, self.size)


class WaveletTree:
    """Ranks of symbols in a sequence; one bit vector a level."""

    def __init__(self, seq: np.ndarray, sigma: int) -> None:
        self.levels, self.bits, self.zeros = max(1, int(sigma - 1).bit_length()), [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level) & 1
            self.bits.append(BitVector(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        self.base = self._down(np.arange(sigma), np.zeros(sigma, dtype=np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, (bits, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            ones = bits.rank(at)
            at = np.where((symbol >> (self.levels - 1 - i)) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._down(symbol, at) - self.base[symbol]


def _ordered_by(seq: np.ndarray, depth: int) -> np.ndarray:
    """For each place the rank of the depth symbols from there on, equal ones sharing theirs (doubling, then what is missing)."""
    n = len(seq)
    pair = lambda r, q, h: np.unique(r * (n + 2) + np.concatenate([q[h:] + 1, np.zeros(min(h, n), np.int64)])[:n], return_inverse=True)[1].astype(np.int64)
    power, h = np.unique(seq, return_inverse=True)[1].astype(np.int64), 1
    done, have = None, 0
    while True:
        if depth & h:
            done, have = (power if done is None else pair(done, power, have)), have + h
        if have == depth:
            return done
        power, h = pair(power, power, h), 2 * h


class FMIndex:
    """Index of texts given as arrays of symbols from 1 up, for patterns of up to `window` symbols.

    Suffixes are ordered by their first `window` symbols, equal ones by their place in the text: all that
    backward search up to that depth needs, and the first of an interval of full depth is the earliest occurrence.
    """

    def __init__(self, texts: list[np.ndarray], sigma: int, window: int) -> None:
        self.window = window
        #: Texts one after the other, each ended by symbol 0.
        self.starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        seq = np.zeros(int(sum(len(t) + 1 for t in texts)), dtype=np.int64)
        for s, t in zip(self.starts, texts, strict=True):
            seq[s : s + len(t)] = t
        self.size = len(seq)
        whole = _ordered_by(seq, window)
        order = np.argsort(whole, kind="stable")
        changes = lambda r: np.concatenate([[True], np.diff(r[order]) != 0]) if len(r) else np.zeros(0, bool)
        heads = changes(whole)
        #: First of each group of suffixes that share `window` symbols, and the text position of that one alone.
        self.heads, self.earliest = BitVector(heads), order[heads].astype(np.int32)
        #: First of each group of suffixes that share all but the last of these symbols.
        self.shorter = BitVector(changes(_ordered_by(seq, window - 1)) if window > 1 else np.arange(self.size) == 0)
        self.bwt = WaveletTree(seq[order - 1], sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma))])

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with a symbol put in front; a negative symbol occurs nowhere."""
        s = np.maximum(symbol, 0)
        both = self.bwt.rank(np.concatenate([s, s]), np.concatenate([low, high]))
        low, high = self.first[s] + both[: len(s)], self.first[s] + both[len(s) :]
        return low, np.where(symbol < 0, low, high)

    def search(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns symbols[start : start + length], from their ends backward."""
        low, high = np.zeros(len(start), np.int64), np.full(len(start), self.size)
        for t in range(int(length.max(initial=0))):
            live = np.flatnonzero((t < length) & (low < high))
            low[live], high[live] = self.step(symbols[start[live] + length[live] - 1 - t], low[live], high[live])
        return low, high

    def matching_statistics(self, lanes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each symbol of each streamed lane (one after the other): how many symbols from there on occur in the index, up to `window`; and where these are all of the window, the earliest place in the text, else -1.

        Lanes move one symbol to the left at a time. A match of full length drops its last symbol; one that
        cannot grow is cut to the longest that can, found by halving. A symbol that the index lacks must be -1.
        """
        lengths = np.array([len(x) for x in lanes], dtype=np.int64)
        ends = np.cumsum(lengths)
        symbols = np.concatenate(lanes) if lanes else np.zeros(0, dtype=np.int64)
        length, found = np.zeros(len(symbols), np.int64), np.full(len(symbols), -1)
        by = np.argsort(-lengths, kind="stable")
        d, lo, hi = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64), np.full(len(lanes), self.size)
        for t in range(int(lengths.max(initial=0))):
            live = by[: np.searchsorted(-lengths[by], -t, "left")]
            here = ends[live] - 1 - t
            full = live[d[live] == self.window]
            if len(full):
                group = self.shorter.rank(lo[full] + 1) - 1
                lo[full], hi[full], d[full] = self.shorter.select(group), self.shorter.select(group + 1), self.window - 1
            low, high = self.step(symbols[here], lo[live], hi[live])
            grown = low < high
            won, lost = live[grown], live[~grown]
            lo[won], hi[won], d[won] = low[grown], high[grown], d[won] + 1
            if len(lost):
                start, short, long = ends[lost] - 1 - t, np.zeros(len(lost), np.int64), d[lost]
                while (short < long).any():  # short occurs, long + 1 does not
                    middle = (short + long + 1) // 2
                    low, high = self.search(symbols, start, middle)
                    ok = low < high
                    short, long = np.where(ok, middle, short), np.where(ok, long, middle - 1)
                lo[lost], hi[lost] = self.search(symbols, start, short)
                d[lost] = short
            length[here] = d[live]
            whole = d[live] == self.window
            found[here[whole]] = self.earliest[self.heads.rank(lo[live][whole] + 1) - 1]
        return length, found
