"""Elias-Fano sequences and a trie of contexts and followers in memory-mapped arrays, all queries vectorised."""

from __future__ import annotations

import tempfile

import numpy as np

_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: _ZERO[b, r], _ONE[b, r]: place of the r-th zero or one of byte b, lowest first.
_ZERO, _ONE = np.full((256, 8), 8, np.uint8), np.full((256, 8), 8, np.uint8)
for _b in range(256):
    for _table, _bit in ((_ZERO, 0), (_ONE, 1)):
        for _r, _p in enumerate([i for i in range(8) if (_b >> i & 1) == _bit]):
            _table[_b, _r] = _p


#: Questions are answered, and values packed, so many at a time: what a step makes for the next then stays in the processor's caches.
PIECE = 1 << 14


def mapped(array: np.ndarray) -> np.ndarray:
    """The array in an anonymous file in the task's temporary folder: its pages can go and come back."""
    if not array.nbytes:
        return array
    f = tempfile.TemporaryFile()
    array.tofile(f)
    return np.memmap(f, array.dtype, "r", shape=array.shape)


class Bits:
    """Integers of `width` bits each, side by side."""

    def __init__(self, values: np.ndarray, width: int):
        self.width = width
        if width:
            words = np.zeros(len(values) * width // 64 + 2, np.uint64)
            for a in range(0, len(values), PIECE):
                part = values[a : a + PIECE].astype(np.uint64)
                bit = np.arange(a, a + len(part), dtype=np.uint64) * np.uint64(width)
                word, off = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
                # values are no wider than a word, so each word between has one that begins there, and one at most that goes on
                new = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                words[word[new]] |= np.bitwise_or.reduceat(part << off, new)
                split = off > np.uint64(64 - width)
                words[word[split] + 1] |= part[split] >> (np.uint64(64) - off[split])
            self.words = mapped(words)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        bit = i.astype(np.uint64) * np.uint64(self.width)
        word, off = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        out = (self.words[word] >> off) | (self.words[word + 1] << np.uint64(1) << (np.uint64(63) - off))
        return out & np.uint64((1 << self.width) - 1)


class EliasFano:
    """A monotone sequence below `u`: low bits side by side, high parts in unary, with ones and zeros counted ahead of each byte."""

    def __init__(self, values: np.ndarray, u: int):
        self.n, self.u = len(values), max(1, int(u))
        self.l = max(0, (self.u // max(1, self.n)).bit_length() - 1)
        values = values.astype(np.uint64)
        self.low = Bits(values & np.uint64((1 << self.l) - 1), self.l)
        high = (values >> np.uint64(self.l)).astype(np.int64)
        self.buckets = (self.u >> self.l) + 1
        bits = np.zeros(-(-(self.n + self.buckets + 1) // 8) * 8, np.uint8)
        bits[high + np.arange(self.n)] = 1
        packed = np.packbits(bits, bitorder="little")
        self.bits = mapped(packed)
        ones = np.zeros(len(packed) + 1, np.int64)
        np.cumsum(_ONES[packed], out=ones[1:])
        zeros = 8 * np.arange(len(ones)) - ones
        small = np.uint32 if 8 * len(packed) < 1 << 32 else np.int64
        self.ones, self.zeros = mapped(ones.astype(small)), mapped(zeros.astype(small))

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """Values by index: the place of the i-th one, less the ones before it, is the high part."""
        byte = np.searchsorted(self.ones, i, side="right") - 1
        place = byte * 8 + _ONE[self.bits[byte], i - self.ones[byte].astype(np.int64)]
        return ((place - i).astype(np.uint64) << np.uint64(self.l)) | self.low[i]

    def _before(self, bucket: np.ndarray) -> np.ndarray:
        """How many values have a high part below each bucket: the place of its preceding zero, less the zeros."""
        out = np.zeros(len(bucket), np.int64)
        some = bucket > 0
        k = bucket[some] - 1  # the k-th zero, from 0
        byte = np.searchsorted(self.zeros, k, side="right") - 1
        out[some] = byte * 8 + _ZERO[self.bits[byte], k - self.zeros[byte].astype(np.int64)] - k
        return out

    def successor(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of each x: the index of the first value not below it (n if none), and whether that value is x; sought from lo to hi where given."""
        at, found = np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        for a in range(0, len(x), PIECE):
            piece = slice(a, a + PIECE)
            at[piece], found[piece] = self._successor(x[piece].astype(np.uint64), *((lo[piece], hi[piece]) if lo is not None else (None, None)))
        return at, found

    def _successor(self, x: np.ndarray, lo: np.ndarray | None, hi: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        high = np.minimum((x >> np.uint64(self.l)).astype(np.int64), self.buckets - 1)
        low = x & np.uint64((1 << self.l) - 1)
        a, b = self._before(high), self._before(high + 1)
        if lo is not None:
            a, b = np.maximum(a, lo), np.minimum(b, hi)
            b = np.maximum(a, b)
        end = b.copy()
        open_ = np.flatnonzero(a < b)
        while len(open_):  # halving within the bucket
            mid = (a[open_] + b[open_]) // 2
            less = self.low[mid] < low[open_]
            a[open_[less]] = mid[less] + 1
            b[open_[~less]] = mid[~less]
            open_ = open_[a[open_] < b[open_]]
        found = np.zeros(len(x), bool)
        inside = a < end
        found[inside] = self.low[a[inside]] == low[inside]
        return a, found & (x < np.uint64(min(self.u, (1 << 64) - 1)))


#: Quantised log10 probabilities: 16 bits over this many decades; 0 stands for none.
DECADES = 14.0


def quantise(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities; 0 has code 0."""
    with np.errstate(divide="ignore"):
        code = 1 + np.rint(np.clip(-np.log10(p), 0, DECADES) * (65534 / DECADES))
    return np.where(p > 0, code, 0).astype(np.uint16)


def restore(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10.0 ** (-(code.astype(float) - 1) * (DECADES / 65534)), 0.0)


class Trie:
    """Contexts; pointers to where each one's followers begin; followers. A follower has its smoothed probability, count
    / (total + prior), and a context its back-off weight, prior / (total + prior).

    Followers are one monotone sequence: each context's words are raised beyond the last value of the context before,
    which is found through the pointers. A follower is sought from its context's pointer to the next one.
    """

    def __init__(self, context: np.ndarray, word: np.ndarray, count: np.ndarray, prior: float):
        """Parallel arrays, sorted by context (uint64) then word (from 0); all counts positive."""
        new = np.ones(len(context), bool)
        new[1:] = context[1:] != context[:-1]
        starts = np.flatnonzero(new)
        sizes = np.diff(starts, append=len(context))
        total = np.add.reduceat(count, starts) if len(starts) else np.zeros(0, np.int64)
        which = np.repeat(np.arange(len(starts)), sizes)
        self.probability, self.backoff = mapped(quantise(count / (total[which] + prior))), mapped(quantise(prior / (total + prior)))
        self.first = context[0] if len(context) else np.uint64(0)
        apart = context[starts] - self.first
        self.contexts = EliasFano(apart, int(apart[-1]) + 1 if len(apart) else 1)
        self.pointers = EliasFano(np.append(starts, len(context)), len(context) + 1)
        base = np.concatenate([[0], np.cumsum(word[starts + sizes - 1] + 1)]).astype(np.int64) if len(starts) else np.zeros(1, np.int64)
        self.followers = EliasFano(word + base[which] if len(word) else word, int(base[-1]) + 1)

    def contexts_of(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, or -1 where the context is unknown; back-off code, 0 there) of each."""
        at, known = self.contexts.successor(context - self.first)
        known &= context >= self.first
        code = np.zeros(len(context), np.uint16)
        code[known] = self.backoff[at[known]]
        return np.where(known, at, -1), code

    def lookup(self, at: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Probability codes of followers of contexts by index; 0 where there is none."""
        out = np.zeros(len(word), np.uint16)
        known = np.flatnonzero(at >= 0)
        # pointers and bases are read once a run of questions about one context
        mine = at[known]
        new = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]])) if len(mine) else np.zeros(0, np.int64)
        runs = np.diff(new, append=len(mine))
        lo, hi = (self.pointers[mine[new] + i].astype(np.int64) for i in (0, 1))
        base = np.zeros(len(new), np.int64)
        some = lo > 0
        base[some] = self.followers[lo[some] - 1].astype(np.int64) + 1
        lo, hi, base = (np.repeat(x, runs) for x in (lo, hi, base))
        place, found = self.followers.successor(base + word[known], lo, hi)
        out[known[found]] = self.probability[place[found]]
        return out
