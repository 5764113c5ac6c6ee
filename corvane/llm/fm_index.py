"""A compressed FM-index over word ids, with truncated matching statistics, in numpy."""

from __future__ import annotations

import numpy as np


#: Words that are streamed at once, padding included.
STREAM_CELLS = 1 << 19


#: For each position in a word the bits below it.
_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class BitRank:
    """A packed bit vector with the number of ones before any position."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[:-1].astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & _BELOW[i & 63])


class WaveletTree:
    """Rank of any symbol in a sequence, a bit vector for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray):
        self.levels = max(1, int(symbols.max(initial=0)).bit_length())
        self.bits, self.zeros = [], []
        for level in reversed(range(self.levels)):
            bit = (symbols >> level) & 1
            self.bits.append(BitRank(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def place(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position ``i`` falls among ``symbol`` on the last level; differences are ranks."""
        for level, bits, zeros in zip(reversed(range(self.levels)), self.bits, self.zeros):
            ones = bits.ones(i)
            i = np.where((symbol >> level) & 1, zeros + ones, i - ones)
        return i


class FMIndex:
    """Index of a shard's passages (arrays of word ids from 1 up), each with a weight.

    ``matches`` streams passages from their ends by backward search. The interval is kept at a matched length
    of ``depth``: after a word is added in front, it is widened to all suffixes that share ``depth`` words.
    """

    def __init__(self, passages: list[np.ndarray], weights: np.ndarray, depth: int):
        self.depth = depth
        lengths = np.array([len(p) for p in passages])
        ends = np.cumsum(lengths + 1) - 1
        n = int(ends[-1]) + 1
        text = np.zeros(n, np.int64)
        mask = np.ones(n, bool)
        mask[ends] = False
        text[mask] = np.concatenate(passages)
        order, same = self._sorted(text, ends)
        # intervals of suffixes that share ``depth`` words: a bit where one begins, its bounds and the least weight in it
        first = np.flatnonzero(~same)
        self.begins, self.bounds = BitRank(~same), np.append(first, n).astype(np.int32)
        owner = np.repeat(np.arange(len(passages)), lengths + 1)
        self.least = np.minimum.reduceat(weights[owner[order]], first)
        bwt = text[order - 1]
        self.tree = WaveletTree(bwt)
        counts = np.bincount(text, minlength=int(text.max(initial=0)) + 1)
        smaller = np.cumsum(counts) - counts
        every = np.arange(len(counts))
        self.shift = smaller - self.tree.place(every, np.zeros(len(every), np.int64))
        self.n = n

    def _sorted(self, text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix array by doubling, every end a symbol of its own; whether each suffix shares ``depth`` words
        with the one before it."""
        n = len(text)
        rank = text + len(ends)
        rank[ends] = np.arange(len(ends))
        rank = np.unique(rank, return_inverse=True)[1]
        order, open_ = np.argsort(rank, kind="stable"), np.ones(n, bool)
        by_power = []
        k = 1
        while True:
            by_power.append(rank)
            # only suffixes that share a rank are sorted on, each within the places of its rank
            places = np.flatnonzero(open_)
            suffixes = order[places]
            ahead = np.where(suffixes + k < n, rank[np.minimum(suffixes + k, n - 1)] + 1, 0)
            key = rank[suffixes] * (n + 2) + ahead
            within = np.argsort(key, kind="stable")
            suffixes, key = suffixes[within], key[within]
            order[places] = suffixes
            differs = np.concatenate(([True], key[1:] != key[:-1]))
            # the rank of a group is the place of its first suffix
            rank = rank.copy()
            rank[suffixes] = np.maximum.accumulate(np.where(differs, places, 0))
            single = differs & np.append(differs[1:], True)
            open_[places[single]] = False
            k *= 2
            if k >= n or (k >= self.depth and not open_.any()):
                break
            if not open_.any():
                by_power += [rank] * (max(0, (self.depth // k).bit_length() - 1))
                break
        by_power.append(rank)
        same = np.ones(n, bool)
        same[0] = False
        at = 0
        for power in reversed(range(len(by_power))):
            if self.depth - at >= 1 << power:
                r = by_power[power]
                i = np.minimum(order + at, n - 1)
                same[1:] &= (r[i[1:]] == r[i[:-1]]) & (order[1:] + at < n) & (order[:-1] + at < n)
                at += 1 << power
        return order, same & (at == self.depth)

    def _front(self, word: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.tree.place(np.concatenate((word, word)), np.concatenate((lo, hi)))
        at += np.tile(self.shift[word], 2)
        return at[: len(word)], at[len(word) :]

    def matches(self, passages: list[np.ndarray]) -> list[np.ndarray]:
        """For each window of ``depth`` words the least weight of an indexed passage that holds it. Each window is in some passage."""
        lengths = np.array([len(p) for p in passages])
        out = [np.zeros(max(0, m - self.depth + 1), np.int64) for m in lengths.tolist()]
        live = np.flatnonzero(lengths >= self.depth)
        live = live[np.argsort(-lengths[live], kind="stable")]
        while len(live):  # passages of about one length at a time, so that padding stays small
            n = max(1, STREAM_CELLS // int(lengths[live[0]]))
            part, live = live[:n], live[n:]
            self._stream(part, passages, lengths, out)
        return out

    def _stream(self, live: np.ndarray, passages: list[np.ndarray], lengths: np.ndarray, out: list[np.ndarray]) -> None:
        width = int(lengths[live[0]])
        table = np.zeros((len(live), width), np.int64)  # passages from their last word to their first
        for row, p in enumerate(live.tolist()):
            table[row, : lengths[p]] = passages[p][::-1]
        found = np.zeros((len(live), width - self.depth + 1), np.int64)
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        for step in range(width):
            m = int(np.searchsorted(-lengths[live], -step, side="left"))  # passages longer than step
            lo, hi = self._front(table[:m, step], lo[:m], hi[:m])
            if step >= self.depth - 1:
                ok = hi > lo
                group = self.begins.ones(np.minimum(lo, self.n - 1) + 1) - 1
                found[:m, step - self.depth + 1] = np.where(ok, self.least[group], np.iinfo(np.int64).max)
                lo, hi = np.where(ok, self.bounds[group], 0), np.where(ok, self.bounds[group + 1], 0)
        for row, p in enumerate(live.tolist()):
            out[p] = found[row, : len(out[p])][::-1]
