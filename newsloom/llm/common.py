"""What the operators share: reading tables, materialising, and vectorised word hashing inside tasks."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import HOT_ROWS, settle, table, with_hot  # noqa: F401  what the operators use of them

# a worker's large Arrow buffers go back to the system when they are done with, rather than into a pool; and so do its large
# arrays, where the C library can be told to map each on its own
pa.set_memory_pool(pa.system_memory_pool())
_TRIM_THRESHOLD, _MMAP_THRESHOLD = -1, -3


def _mallopt(option: int, value: int) -> None:
    try:
        ctypes.CDLL(None).mallopt(option, value)
    except (AttributeError, OSError):
        pass


_mallopt(_MMAP_THRESHOLD, 1 << 20)


def keep_heap() -> None:
    """In this worker, from now on: arrays of a few MB come from a heap that keeps up to 128 MB it has free. Where a task makes
    hundreds of arrays of that size one after the other, mapping each on its own takes as long as the work on it."""
    _mallopt(_MMAP_THRESHOLD, 8 << 20)
    _mallopt(_TRIM_THRESHOLD, 128 << 20)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows named by three numbers each are broadcast up to so many.
NARROW = 500_000


def without(docs: DataFrame, gone: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs less the rows that `gone` names, (doc_id, same): same is xxhash64 of the text, null as empty. A null id is an id
    like others, and rows that share an id are told apart by their texts. No name of docs clashes with the join's. gone: best a settled table."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    named = gone.select(F.col("doc_id").alias("_id"), F.col("same").alias("_same"))
    named = F.broadcast(named) if gone.count() <= NARROW else named  # else whole rows shuffle
    there = F.col(f"_row.`{id_col}`").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(F.col(f"_row.`{text}`"), F.lit(""))) == F.col("_same"))
    return rows.join(named, there, "left_anti").select("_row.*")


def pair(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> list[Column]:
    """The columns (doc_id, same) by which `without` knows a row."""
    return [F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("same")]


def crc_fold(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


# ---- words and hashes over Arrow string buffers ------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RNG = np.random.default_rng(20240229)
_BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWERED = _BYTE_VALUE.copy()
_LOWERED[65:91] = _BYTE_VALUE[97:123]
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Arrays as long as a text's bytes or words are worked on in pieces of so many elements, so that what a worker keeps doesn't
#: grow with its longest text. Words longer than `LONG` bytes are hashed one by one: powers modulo 2^64 make long words of
#: certain patterns collide whatever the base. Runs of values are `WIDEST` at most.
PIECE, LONG, WIDEST = 1 << 18, 32, 1 << 14
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to PIECE and WIDEST more."""
    if base not in _powers:
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            out = np.full(PIECE + WIDEST + 2, b, np.uint64)
            out[0] = 1
            made.append(np.multiply.accumulate(out))
        _powers[base] = (made[0], made[1])
    return _powers[base]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(values: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hash of every run of `width` consecutive values (width: WIDEST at most)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if n > PIECE:
        return np.concatenate([rolling(values[a : a + PIECE + width - 1], width, which) for a in range(0, n, PIECE)])
    up, down = _power(_BASES[which])
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[:n], which + 1)


def _pieces(data: np.ndarray):
    """(start, end) of pieces of one text, cut before white space, PIECE long at most but for a longer word."""
    at, n = 0, len(data)
    while n - at > PIECE:
        space = np.flatnonzero(_SPACE[data[at + 1 : at + PIECE]])
        if len(space):
            end = at + 1 + int(space[-1])
        else:  # a word longer than a piece: up to its end
            end = at + PIECE
            while end < n and not len(space := np.flatnonzero(_SPACE[data[end : end + PIECE]])):
                end = min(n, end + PIECE)
            end = end if end >= n else end + int(space[0])
        yield at, end
        at = end
    yield at, n


class Words:
    """The words of a chunk of documents: starts, ends (bytes in `data`), the row of each, and 64-bit hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, seeds: int = 1):
        self.data, self.offsets = data, offsets
        if len(data) <= PIECE:
            self.starts, self.ends, self.hashes = self._scan(data, offsets, lower, seeds)
        else:
            parts = []
            for a, b in ((x + offsets[r], y + offsets[r]) for r in range(len(offsets) - 1) for x, y in _pieces(data[offsets[r] : offsets[r + 1]])):
                s, e, h = self._scan(data[a:b], np.array([0, b - a]), lower, seeds)
                parts.append((s + a, e + a, h))
            self.starts, self.ends = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            self.hashes = [np.concatenate([p[2][k] for p in parts]) for k in range(seeds)]
        self.row = np.searchsorted(offsets, self.starts, side="right") - 1
        self.bounds = np.searchsorted(self.starts, offsets)  # words of row i: bounds[i] to bounds[i + 1]

    @staticmethod
    def _scan(data: np.ndarray, offsets: np.ndarray, lower: bool, seeds: int):
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), [np.zeros(0, np.uint64)] * seeds
        word = ~_SPACE[data]
        first = word.copy()
        first[1:] &= ~word[:-1]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[heads] = word[heads]
        last = word.copy()
        last[:-1] &= ~word[1:]
        tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        last[tails] = word[tails]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        long = np.flatnonzero(ends - starts > LONG)
        apart = [xxhash.xxh3_128_intdigest(raw.lower() if lower else raw) for raw in (data[starts[i] : ends[i]].tobytes() for i in long.tolist())]
        hashes = []
        values = (_LOWERED if lower else _BYTE_VALUE)[data] if n <= PIECE + LONG else None
        for k in range(seeds):
            if values is None:
                h = np.zeros(len(starts), np.uint64)  # such a piece is one word, and long
            else:
                up, down = _power(_BASES[k])
                sums = np.zeros(n + 1, np.uint64)
                np.cumsum(values * up[:n], out=sums[1:])
                h = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64), k + 7)
            h[long] = [(x >> 64 * k) & (2**64 - 1) for x in apart]  # both halves where there are two seeds
            hashes.append(h)
        return starts, ends, hashes

    def windows(self, width: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of `width` words within one document."""
        h = rolling(self.hashes[which], width, which)
        at = np.flatnonzero(self.row[: len(h)] == self.row[width - 1 :]) if len(h) else np.zeros(0, np.int64)
        return at, h[at]


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = PIECE):
    """(first row, end row, bytes, offsets) of runs of rows with about `limit` bytes, so that temporary arrays stay small."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
