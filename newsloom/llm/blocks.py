"""Documents in blocks, and questions from blocks to shards of a key space.

Statistics over very many keys (word counts, window counts) are too large for one machine and too many for one row
each. So documents are dealt into blocks; a block asks about its distinct keys, sorted, in packed arrays, one row for
each lane of the key space; a shard adds up what all blocks sent, works out the answers, and each block gets one row a
lane back, in the order of what it sent. Blocks and shards are sized by bytes and keys, so their number grows with the
input.

While blocks times shards are `ROWS` at most, a lane is a shard. Beyond that the exchange has two levels: blocks stand in
groups and shards in lanes, about as many of either as the root of the number of blocks or shards; each group's questions on
a lane are merged, sent to the shards of the lane, and the answers handed on. So a group has on a lane about as many
keys as a block or a shard has, and there are about as many such pairs as blocks: rows and groups, which
cost a fixed time each whatever they hold, take little beside the work on keys. There are `FAN` groups and lanes at most,
so with two levels a block sends `FAN` rows at most and a shard receives `FAN`. One level takes less disk, as it sends all once.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text bytes a block holds, about; and how many keys a shard serves. Either keeps a worker's arrays below some 100 MB.
BLOCK_BYTES = 3 << 20
SHARD_KEYS = 1 << 19
LEAST_BLOCKS = 48
#: Most rows that a block sends or a shard receives with two levels, and most that all blocks send with one.
FAN, ROWS = 2048, 1 << 23


def measure(docs: DataFrame, text: str = "text") -> int:
    """Bytes of text; one narrow pass."""
    return docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0


@dataclass(frozen=True)
class Plan:
    blocks: int
    shards: int
    fan: int

    @property
    def per_lane(self) -> int:
        return -(-self.shards // self.fan)

    @property
    def per_group(self) -> int:
        return -(-self.blocks // self.fan)

    @property
    def lanes(self) -> int:
        return -(-self.shards // self.per_lane)

    @property
    def direct(self) -> bool:
        return self.per_lane == 1 and self.per_group == 1


def plan(n_bytes: int, n_keys: int, *, block_bytes: int | None = None, shard_keys: int | None = None, fan: int | None = None) -> Plan:
    """How many blocks and shards so many bytes of text with so many keys take, and how many groups and lanes."""
    blocks, shards = (max(LEAST_BLOCKS, -(-n // each)) for n, each in ((n_bytes, block_bytes or BLOCK_BYTES), (n_keys, shard_keys or SHARD_KEYS)))
    most = max(blocks, shards)
    return Plan(blocks, shards, fan or (most if blocks * shards <= ROWS else min(FAN, math.isqrt(most - 1) + 1)))


def in_blocks(docs: DataFrame, blocks: int, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(block, doc_id, text). Dealt by id and text, so that neither null nor repeated ids crowd a block."""
    return docs.select(F.pmod(F.xxhash64(id_col, text), F.lit(blocks)).cast("int").alias("block"), F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))


# ---- arrays as bytes ---------------------------------------------------------------------------

@cache
def _codec():
    """A worker's compressor and decompressor: made anew for each short array they take as long as the array."""
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def planes(values: np.ndarray) -> bytes:
    """Values in any order, in byte planes, compressed: words follow few patterns and high bytes are empty. Booleans as bits."""
    if not len(values):
        return b""
    raw = np.packbits(values) if values.dtype == bool else np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return _codec()[0].compress(raw)


def from_planes(data: bytes, n: int, kind=None) -> np.ndarray:
    """n values; their width in bytes is that of the data, or they are booleans."""
    raw = _codec()[1].decompress(data) if n else b""
    if kind is bool:
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)
    width = len(raw) // n if n else 8
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(f"u{width}").ravel() if n else np.zeros(0, np.uint64)


def pack(ordered: np.ndarray) -> bytes:
    """Ordered values as differences in byte planes."""
    steps = ordered.copy()
    steps[1:] -= ordered[:-1]
    return planes(steps)


def unpack(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(from_planes(data, n), dtype=np.uint64)


# ---- the exchange ------------------------------------------------------------------------------

#: The block of rows that are for nobody: what `tally` made.
TALLY = -1
FIELDS = "block int, lane int, n int, cols array<binary>, note binary"


def _table(rows):
    import pyarrow as pa

    kinds = {"block": pa.int32(), "lane": pa.int32(), "n": pa.int32(), "cols": pa.list_(pa.binary()), "note": pa.binary()}
    return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(kinds.items())})


def block_of(table) -> int:
    return table.column("block")[0].as_py()


def narrowed(keys: list[np.ndarray]) -> list[np.ndarray]:
    """Columns that compare as the keys do, as few as their bits fit in: most ids are small, and one sort is faster than four."""
    out, bits = [], 0
    for k in keys:
        need = int(k.max()).bit_length() if len(k) else 0
        if out and bits + need <= 64:
            out[-1], bits = (out[-1] << np.uint64(need)) | k if need else out[-1], bits + need
        else:
            out.append(k)
            bits = need
    return out


def in_order(narrow: list[np.ndarray]) -> np.ndarray:
    """Their order; equal keys in any. A further column is sorted together with the rank by those before it, as one integer:
    two fast sorts take a fraction of a stable one of two columns. Where rank and column don't fit in 64 bits, that one."""
    so_far = narrow[0]
    order = np.argsort(so_far)
    for k in narrow[1:] if len(order) else ():
        rank = np.zeros(len(order), np.uint64)
        rank[order[1:]] = np.cumsum(so_far[order[1:]] != so_far[order[:-1]])
        need = int(k.max()).bit_length()
        if int(rank[order[-1]]).bit_length() + need > 64:
            return np.lexsort(narrow[::-1])
        so_far = (rank << np.uint64(need)) | k if need < 64 else k
        order = np.argsort(so_far)
    return order


def _merged(keys: list[np.ndarray], values: list[np.ndarray], least: bool):
    """(distinct keys in order, their values added up or the least ones, place of each input's key, the input that is first)."""
    narrow = narrowed(keys)
    order = np.lexsort([*values[::-1], *narrow[::-1]]) if least else in_order(narrow)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in (x[order] for x in narrow)])
    at = np.flatnonzero(new)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    if least:
        values = [v[order[at]] for v in values]
    else:
        values = [np.add.reduceat(v[order].astype(np.uint64), at) if len(at) else v.astype(np.uint64) for v in values]
    return [k[order[at]] for k in keys], values, place, order[at]


class Exchange:
    """Questions about keys and their answers.

    keys: how many uint64 columns make a key; they come in order and distinct within a block. A key's shard follows from
    its `place` below `span`: by default its first column, else a function of the columns. Values are unsigned integers.
    By default they are added up over all blocks, and `answer` gets distinct keys in order with their sums and returns an
    array for each of `replies` (kinds). With `least`, the reply says whether the block's own values are the least of all
    blocks' for the key. A block's `note` on a lane comes back to it untouched. `tally`, of a shard's keys and sums, makes
    the note of a row of the block TALLY.
    """

    def __init__(self, plan: Plan, span: int, keys: int, replies: tuple, answer: Callable | None = None, least: bool = False, tally: Callable | None = None, place: Callable | None = None):
        self.plan, self.keys, self.replies, self.answer, self.least, self.tally, self.place = plan, keys, (bool,) if least else replies, answer, least, tally, place
        self.width = -(-span // plan.shards)

    def _runs(self, keys: list[np.ndarray], per: int, lo: int, n: int):
        """(order, bounds): the keys dealt by their shard // per, from lo on, n runs; keys keep their order within a run."""
        place = self.place(keys) if self.place else keys[0]
        which = (place // np.uint64(self.width)).astype(np.int64) // per - lo
        which = which.astype(np.uint16) if n < 1 << 16 else which
        order = np.argsort(which, kind="stable")
        return order, np.searchsorted(which[order], np.arange(n + 1)).tolist()

    def _lanes(self, keys):
        return self._runs(keys, self.plan.per_lane, 0, self.plan.lanes)

    @staticmethod
    def _packed(keys, values, which) -> list[bytes]:
        return [pack(keys[0][which]), *(planes(x[which]) for x in (*keys[1:], *values))]

    def ask(self, block: int, keys: list[np.ndarray], values: list[np.ndarray], note: Callable[[np.ndarray], bytes] | None = None, own: bytes | None = None):
        """A block's questions. note: bytes for the keys at these places; own: bytes for the block, with no keys."""
        rows = []
        if len(keys[0]):
            order, at = self._lanes(keys)
            for lane, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                if a < b:
                    which = order[a:b]
                    rows.append((block, lane, b - a, self._packed(keys, values, which), note(which) if note else None))
        if own is not None:
            rows.append((block, block % self.plan.lanes, 0, [], own))
        return _table(rows)

    def _open(self, table):
        """(blocks, lanes, notes, cut points, keys, values) of rows with keys."""
        cols, n = table.column("cols").to_pylist(), table.column("n").to_pylist()
        parts = [[unpack(c[0], k), *(from_planes(x, k) for x in c[1:])] for c, k in zip(cols, n, strict=True)]
        every = [np.concatenate(x) for x in zip(*parts, strict=True)]
        return table.column("block").to_pylist(), table.column("lane").to_pylist(), table.column("note").to_pylist(), np.cumsum([0, *n]), every[: self.keys], every[self.keys :]

    def _apart(self, table):
        """(rows without keys, rows with keys)."""
        import pyarrow.compute as pc

        bare = pc.equal(table.column("n"), 0)
        return table.filter(bare), table.filter(pc.invert(bare))

    def _serve(self, table):
        import pyarrow as pa

        own, table = self._apart(table)
        if not table.num_rows:
            return own
        block, lane, note, cut, keys, values = self._open(table)
        keys, values, place, first = _merged(keys, values, self.least)
        if self.least:
            told = [np.isin(np.arange(len(place)), first)]
        else:
            told = [x[place] for x in self.answer(keys, values)]
        rows = [(b, ln, cut[i + 1] - cut[i], [planes(x[cut[i] : cut[i + 1]].astype(k)) for x, k in zip(told, self.replies, strict=True)], n) for i, (b, ln, n) in enumerate(zip(block, lane, note, strict=True))]
        if self.tally:
            rows.append((TALLY, lane[0], 0, [], self.tally(keys, values)))
        return pa.concat_tables([_table(rows), own])

    def _told(self, n: int, order: np.ndarray, at: list[int], rows: dict[int, list[bytes]]) -> list[np.ndarray]:
        """Answers by run, in the order of the keys."""
        out = []
        for j, k in enumerate(self.replies):
            told = np.zeros(n, k)
            if n:
                told[order] = np.concatenate([from_planes(rows[i][j], b - a, k if k is bool else None) for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if a < b])
            out.append(told)
        return out

    def run(self, asked: DataFrame) -> DataFrame:
        """(block, lane, n, cols, note): the replies to the rows of `ask`."""
        p = self.plan
        serve = lambda table: self._serve(table)  # noqa: E731  Spark counts a method's self as an argument
        if p.direct:
            return asked.groupBy("lane").applyInArrow(serve, FIELDS)
        asked = asked.withColumn("grp", F.floor(F.col("block") / p.per_group).cast("int"))
        fields = ["block", "lane", "n", "cols", "note"]

        def shards(keys, lane: int):
            lo = lane * p.per_lane
            return lo, *self._runs(keys, 1, lo, min(p.per_lane, p.shards - lo))

        def gather(table):
            """The questions of a group's blocks on one lane, merged, to the lane's shards."""
            _, rows = self._apart(table.select(fields))
            if not rows.num_rows:
                return _table([])
            grp, lane = table.column("grp")[0].as_py(), rows.column("lane")[0].as_py()
            keys, values, _, _ = _merged(*self._open(rows)[4:], self.least)
            lo, order, at = shards(keys, lane)
            return _table([(grp, lo + i, b - a, self._packed(keys, values, order[a:b]), None) for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if a < b])

        def hand_on(table, told):
            import pyarrow as pa

            own, rows = self._apart(table.select(fields))
            if not rows.num_rows:
                tallies = [(TALLY, 0, 0, [], n) for g, n in zip(told.column("grp").to_pylist(), told.column("note").to_pylist(), strict=True) if g == TALLY]
                return pa.concat_tables([own, _table(tallies)])
            block, lane, note, cut, keys, values = self._open(rows)
            keys, _, place, first = _merged(keys, values, self.least)
            lo, order, at = shards(keys, lane[0])
            by_shard = {s - lo: c for s, c in zip(told.column("shard").to_pylist(), told.column("cols").to_pylist(), strict=True)}
            reply = [x[place] for x in self._told(len(keys[0]), order, at, by_shard)]
            if self.least:
                reply[0] &= np.isin(np.arange(len(place)), first)
            out = [(b, lane[0], cut[i + 1] - cut[i], [planes(x[cut[i] : cut[i + 1]].astype(k)) for x, k in zip(reply, self.replies, strict=True)], n) for i, (b, n) in enumerate(zip(block, note, strict=True))]
            return pa.concat_tables([_table(out), own])

        merged = asked.groupBy("grp", "lane").applyInArrow(gather, FIELDS)
        told = merged.groupBy("lane").applyInArrow(serve, FIELDS).select(F.col("block").alias("grp"), F.floor(F.col("lane") / p.per_lane).cast("int").alias("lane"), F.col("lane").alias("shard"), "cols", "note")
        return asked.groupBy("grp", "lane").cogroup(told.groupBy("grp", "lane")).applyInArrow(hand_on, FIELDS)

    def read(self, replies, keys: list[np.ndarray]) -> list[np.ndarray]:
        """The answers to a block's keys, in their order. replies: the block's rows."""
        _, replies = self._apart(replies)
        order, at = self._lanes(keys)
        return self._told(len(keys[0]), order, at, dict(zip(replies.column("lane").to_pylist(), replies.column("cols").to_pylist(), strict=True)))

    def notes(self, replies) -> tuple[list[tuple[int, list[bytes], bytes]], list[bytes]]:
        """(number of keys, answers and note of each of a block's lanes in order; the block's own)."""
        own, replies = self._apart(replies)
        rows = sorted(zip(*(replies.column(c).to_pylist() for c in ("lane", "n", "cols", "note")), strict=True))
        return [r[1:] for r in rows], own.column("note").to_pylist()
