"""A compressed FM-index over integer symbols: wavelet matrix, backward search, all in numpy.

The index answers many searches at once: every operation takes arrays of intervals.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Bits with constant-time rank: 64-bit words and a running count per word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.uint32)
        self.zeros = len(bits) - int(bits.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.height = max(1, int(sigma - 1).bit_length())
        self.levels = []
        now = symbols.astype(np.int64)
        for k in range(self.height - 1, -1, -1):
            bits = (now >> k & 1).astype(np.uint8)
            self.levels.append(BitVector(bits))
            now = np.concatenate([now[bits == 0], now[bits == 1]])
        self.start = self.down(np.arange(sigma), np.zeros(sigma, np.int64))

    def down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level in zip(range(self.height - 1, -1, -1), self.levels):
            ones = level.rank(i)
            i = np.where(symbol >> k & 1, level.zeros + ones, i - ones)
        return i

    def occurrences(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self.down(symbol, i) - self.start[symbol]


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix numbers in the order of their first ``depth`` symbols at least, by prefix doubling."""
    rank = text.astype(np.int64)
    done = 1
    while done < depth:
        # A shard's memory peaks here: no array lives longer than it is needed.
        pair = rank * (int(rank.max(initial=0)) + 2)
        pair[: max(0, len(rank) - done)] += rank[done:] + 1
        del rank
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        new = np.zeros(len(pair), bool)
        new[1:] = pair[1:] != pair[:-1]
        rank = np.cumsum(new, out=pair)
        rank[order] = rank.copy()
        del pair, new, order
        done *= 2
    return np.argsort(rank, kind="stable")


class FMIndex:
    """Searches patterns of up to ``depth`` symbols. Symbols are 0 to sigma - 1."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int):
        suffixes = sorted_suffixes(text, depth)
        self.wavelet = WaveletMatrix(text[suffixes - 1], sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma), dtype=np.int64)[:-1]])
        self.size = len(text)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one symbol put before them."""
        at = self.first[symbol]
        return at + self.wavelet.occurrences(symbol, low), at + self.wavelet.occurrences(symbol, high)


def repeated_windows(index: FMIndex, text: np.ndarray, usable: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """For each text[start:end], a bit mask of its windows (of ``window`` symbols) that occur twice or more.

    Matching statistics at a threshold. A search goes from the end of the last open window to the left
    as long as the match occurs twice: every window inside the match repeats. Where it ends, the next search
    starts with the first window it has not told. All texts are searched side by side. A symbol that is
    not ``usable`` occurs once: no window across it repeats. Texts hold up to 32 windows.
    """
    masks = np.zeros(len(starts), np.uint32)
    run = np.flatnonzero(ends - starts >= window)
    begin = starts[run]
    last = ends[run] - window  # the window that is looked at
    at = ends[run] - 1
    low, high = np.zeros(len(run), np.int64), np.full(len(run), index.size, np.int64)

    def mark(which, lo, hi):
        """Windows lo to hi of the texts."""
        count = (hi - lo + 1).astype(np.uint64)
        bits = ((np.uint64(1) << count) - np.uint64(1)) << (lo - begin[which]).astype(np.uint64)
        masks[run[which]] |= bits.astype(np.uint32)

    while len(run):
        symbol = text[at]
        new_low, new_high = index.extend(symbol, low, high)
        known = usable[symbol]
        good = known & (new_high - new_low >= 2)
        low, high = np.where(good, new_low, 0), np.where(good, new_high, index.size)
        through = np.flatnonzero(good & (at == begin))
        mark(through, begin[through], last[through])
        failed = np.flatnonzero(~good)
        told = failed[at[failed] + 1 <= last[failed]]
        mark(told, at[told] + 1, last[told])
        following = np.where(at[failed] < last[failed], at[failed], last[failed] - 1)
        following = np.where(known[failed], following, np.minimum(following, at[failed] - window))
        at = at - 1
        last[failed] = following
        at[failed] = following + window - 1
        stay = np.ones(len(run), bool)
        stay[through] = False
        stay[failed[following < begin[failed]]] = False
        run, begin, last, at, low, high = (x[stay] for x in (run, begin, last, at, low, high))
    return masks
