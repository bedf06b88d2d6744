"""An FM-index over the word codes of a few documents: suffix order, wavelet matrix, sampled places.

NumPy helpers of one shard; :mod:`decontamination` deals shards out. Every document ends in a
mark of its own (symbol 0), marks being ordered by document, so that all suffixes differ and no
match crosses documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Every so many words of a document the place of a suffix is kept.
SAMPLE = 8
#: Rows whose places are looked up together.
ROWS = 1 << 20


def suffix_order(text: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order; ``text`` ends in a mark, ``marks`` are the marks' places.

    Ranks by the first word are doubled in reach until all differ; only those that still tie are
    sorted again. No suffix is read beyond its document's mark.
    """
    n = len(text)
    first = text.astype(np.int64) + len(marks)
    first[marks] = np.arange(len(marks))
    order = np.argsort(first)
    opens = np.ones(n, bool)
    opens[1:] = first[order[1:]] != first[order[:-1]]
    rank = np.empty(n, np.int64)
    reach = 1
    while True:
        heads = np.flatnonzero(opens)
        sizes = np.diff(np.append(heads, n))
        if reach == 1:
            rank[order] = np.repeat(heads, sizes)
        tied = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if not len(tied):
            return order
        places = order[tied]
        key = rank[places] * n + rank[places + reach]
        by = np.argsort(key)
        places, key = places[by], key[by]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        order[tied] = places
        opens[tied] = new
        heads = np.flatnonzero(new)
        rank[places] = np.repeat(tied[heads], np.diff(np.append(heads, len(key))))
        reach *= 2


class Bits:
    """A bit vector with the number of ones before any place."""

    def __init__(self, words: np.ndarray, before: np.ndarray):
        self.words, self.before = words, before

    @classmethod
    def of(cls, bits: np.ndarray) -> Bits:
        packed = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        eights = np.packbits(bits, bitorder="little")
        packed[: len(eights)] = eights
        words = packed.view("<u8")
        before = np.zeros(len(words), np.uint32)
        np.cumsum(np.bitwise_count(words[:-1]), out=before[1:], dtype=np.uint32)
        return cls(words, before)

    def rank(self, i: np.ndarray) -> np.ndarray:
        w, part = i >> 6, (i & 63).astype(np.uint64)
        low = self.words[w] & ((np.uint64(1) << part) - np.uint64(1))
        return self.before[w].astype(np.int64) + np.bitwise_count(low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


@dataclass
class FmIndex:
    """``counts`` by symbol, ``levels`` of the wavelet matrix over the last column, ``zeros`` of each level,
    ``marked`` rows whose place is in ``places``."""

    counts: np.ndarray
    levels: list[Bits]
    zeros: np.ndarray
    marked: Bits
    places: np.ndarray

    @classmethod
    def build(cls, codes: np.ndarray, sizes: np.ndarray, symbols: int) -> FmIndex:
        """Of documents of ``sizes`` words, ``codes`` being all their words (from 0) in a row."""
        n = len(codes) + len(sizes)
        marks = np.cumsum(sizes + 1) - 1
        text, inside = np.zeros(n, np.int32), np.ones(n, bool)
        inside[marks] = False
        text[inside] = codes + 1
        order = suffix_order(text, marks)
        last = text[order - 1]  # of the first place it is the last mark
        depth = max(1, int(symbols).bit_length())
        levels, zeros, left = [], np.zeros(depth, np.int64), last
        for level in range(depth):
            ones = (left >> (depth - 1 - level)) & 1 != 0
            levels.append(Bits.of(ones))
            left = np.concatenate([left[~ones], left[ones]])
            zeros[level] = n - int(levels[-1].rank(np.array([n]))[0])
        own = np.arange(n) - np.repeat(np.concatenate([[0], marks[:-1] + 1]), sizes + 1)
        kept = (own % SAMPLE == 0)[order]
        return cls(np.bincount(text, minlength=symbols + 1), levels, zeros, Bits.of(kept), order[kept].astype(np.int32))

    def __post_init__(self):
        depth = len(self.levels)
        codes = np.arange(len(self.counts))
        turned = np.zeros(len(codes), np.int64)
        for b in range(depth):
            turned |= ((codes >> b) & 1) << (depth - 1 - b)
        by = np.argsort(turned)
        begins = np.empty(len(codes), np.int64)
        begins[by] = np.cumsum(self.counts[by]) - self.counts[by]
        self.first = np.cumsum(self.counts) - self.counts
        self.base = self.first - begins  # what turns a place below the matrix into a row

    def step(self, symbol: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The rows of the suffixes that are one ``symbol`` longer: its first row and its ranks before ``rows``."""
        at, depth = rows, len(self.levels)
        for level, bits in enumerate(self.levels):
            ones = bits.rank(at)
            at = np.where((symbol >> (depth - 1 - level)) & 1 != 0, self.zeros[level] + ones, at - ones)
        return self.base[symbol] + at

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-but-one row of each phrase (codes from 0, left-aligned, -1 is a word that is not here)."""
        count = len(phrases)
        lo, hi = np.zeros(count, np.int64), np.full(count, int(self.counts.sum()), np.int64)
        for back in range(phrases.shape[1] if count else 0):
            live = np.flatnonzero((lo < hi) & (sizes > back))
            if not len(live):
                break
            word = phrases[live, sizes[live] - 1 - back]
            known = word >= 0
            lo[live[~known]] = hi[live[~known]] = 0
            live, symbol = live[known], word[known] + 1
            both = self.step(np.concatenate([symbol, symbol]), np.concatenate([lo[live], hi[live]]))
            lo[live], hi[live] = both[: len(live)], both[len(live) :]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places of suffixes by their rows: back to the next sample, which is in the same document."""
        out, gone = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live, at, depth = np.arange(len(rows)), rows.astype(np.int64), len(self.levels)
        while len(live):
            found = self.marked.get(at)
            here = live[found]
            out[here] = self.places[self.marked.rank(at[found])] + gone[here]
            live, at = live[~found], at[~found]
            gone[live] += 1
            symbol, low = np.zeros(len(at), np.int64), at
            for level, bits in enumerate(self.levels):
                one, ones = bits.get(low), bits.rank(low)
                symbol |= one.astype(np.int64) << (depth - 1 - level)
                low = np.where(one, self.zeros[level] + ones, low - ones)
            at = self.base[symbol] + low
        return out

    def to_bytes(self) -> dict[str, bytes]:
        """The arrays by name; :meth:`from_bytes` reads them back."""
        return {
            "counts": self.counts.astype("<i4").tobytes(),
            "bits": b"".join(b.words.tobytes() for b in self.levels),
            "ranks": b"".join(b.before.astype("<u4").tobytes() for b in self.levels),
            "zeros": self.zeros.astype("<i8").tobytes(),
            "marked": self.marked.words.tobytes(),
            "marked_ranks": self.marked.before.astype("<u4").tobytes(),
            "places": self.places.astype("<i4").tobytes(),
        }

    @classmethod
    def from_bytes(cls, held: dict[str, bytes]) -> FmIndex:
        zeros = np.frombuffer(held["zeros"], "<i8")
        bits = np.frombuffer(held["bits"], "<u8").reshape(len(zeros), -1)
        ranks = np.frombuffer(held["ranks"], "<u4").reshape(len(zeros), -1)
        marked = Bits(np.frombuffer(held["marked"], "<u8"), np.frombuffer(held["marked_ranks"], "<u4"))
        return cls(np.frombuffer(held["counts"], "<i4").astype(np.int64), [Bits(b, r) for b, r in zip(bits, ranks)], zeros, marked, np.frombuffer(held["places"], "<i4"))


FIELDS = ("counts", "bits", "ranks", "zeros", "marked", "marked_ranks", "places")
