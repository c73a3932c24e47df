"""Importance resampling towards a target, over tries of words.

A document's features are its runs of 1 to `ORDER` words; a feature's bucket is the crc32 of its words, joined by one
space, modulo `BUCKETS`. A task reads its texts in pieces of about a megabyte and grows a trie of each: a node is a run
of words, its children are the runs one word longer. Nodes hold how often they occur and the state of their crc32, which
a child carries on from its parent's: the state moves over the word's bytes as over so many zeros, then takes in the
word's own crc, for all nodes of a level at once. Only a task's totals by bucket leave it, and are added up; so neither
a piece's trie nor what is sent grows with the input. For scores the gains of the buckets are attached to the nodes of
each piece's trie again, and a document's weight is the sum along its paths, word by word.

The draw keeps the highest scores: weights plus Gumbel noise by a hash of the id. Ranks come from one global sort, range
by range, numbered within partitions and shifted by the sizes of the partitions before.

Defined cases: null and empty texts have no words, no features and weight 0; a null id is hashed as an empty one and
ranks before others of its score; rows that repeat an id are rows of their own, equal ones in any order; a word of
any length is one word; without target texts all targets count as 0; an empty table gives none. Other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

ORDER, BUCKETS, LEAST_WORDS, PERCENT, SEED = 2, 10_000, 20, 25, 7
#: A piece has about so many bytes; a task keeps the crcs of so many words between pieces; longer words go by zlib alone.
PIECE, KNOWN, SHORT = 1 << 20, 200_000, 48

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def _zero_step() -> np.ndarray:
    """What a crc32 state's low byte adds as it moves over one zero byte."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


_STEP = _zero_step()


@dataclass
class Level:
    """A trie's nodes of one depth: crc32 state and count of each, and the node that each run of the piece ends at."""

    crc: np.ndarray
    count: np.ndarray
    path: np.ndarray
    row: np.ndarray


class Trie:
    """Grows tries of one task's pieces; keeps the crcs of words, alone and after a space."""

    def __init__(self, order: int):
        self.order, self.known = order, {}

    def _crcs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > KNOWN:
            self.known.clear()
        out = np.empty((len(words), 2), np.uint32)
        for i, w in enumerate(words):
            c = self.known.get(w)
            if c is None:
                c = (zlib.crc32(w), zlib.crc32(b" " + w))
                if len(w) <= SHORT:
                    self.known[w] = c
            out[i] = c
        return out[:, 0], out[:, 1]

    @staticmethod
    def _carried(state: np.ndarray, tail: np.ndarray, length: np.ndarray, word: np.ndarray, words: list[bytes]) -> np.ndarray:
        """crc32 of each parent's bytes, a space and the word's; tail is the crc of the latter two, length theirs."""
        order = np.argsort(-length, kind="stable")
        c, n = state[order].copy(), length[order]
        first = int(np.searchsorted(-n, -SHORT))  # words before it are long
        for i in range(int(n[first]) if first < len(n) else 0):
            last = int(np.searchsorted(-n, -i))  # nodes up to it have a byte left
            part = c[first:last]
            c[first:last] = (part >> np.uint32(8)) ^ _STEP[part & np.uint32(255)]
        out = np.empty_like(state)
        out[order] = c
        out ^= tail
        for i in order[:first].tolist():
            out[i] = zlib.crc32(b" " + words[word[i]], int(state[i]))
        return out

    def grow(self, data: np.ndarray, offsets: np.ndarray, lead: int) -> list[Level]:
        """The levels of a piece; the first `lead` words were counted before and are there as parents only."""
        data = _LOWER[data]
        inside = _IN_WORD[data]
        head = np.zeros(len(data) + 1, bool)
        head[offsets] = True
        start = inside.copy()
        start[1:] &= ~inside[:-1] | head[1:-1]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | head[1:-1]
        starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        if not len(starts):
            return []
        row = np.searchsorted(offsets, starts, side="right") - 1
        at = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=at[1:])
        listed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[inside]))]).dictionary_encode()
        words, path = listed.dictionary.to_pylist(), listed.indices.to_numpy().astype(np.int64)
        alone, spaced = self._crcs(words)
        size = np.array([len(w) + 1 for w in words])
        levels, runs, mine = [], path, row
        for depth in range(1, self.order + 1):
            if depth == 1:
                crc, runs = alone, path
            else:  # a run of `depth` words ends at each word whose predecessor's run is of the same row
                going = row[depth - 1 :] == row[: len(row) - depth + 1]
                node, runs = np.unique(np.where(going, runs[:-1] * len(words) + path[depth - 1 :], -1), return_inverse=True)
                if not len(node) or node[-1] < 0:
                    break
                some = int(node[0] < 0)
                parent, word = np.divmod(node[some:], len(words))
                crc, runs, mine = self._carried(crc[parent], spaced[word], size[word], word, words), runs - some, row[depth - 1 :]
            ending = np.flatnonzero((runs >= 0) & (np.arange(len(runs)) + depth > lead))
            levels.append(Level(crc, np.bincount(runs[ending], minlength=len(crc)), runs[ending], mine[ending]))
        return levels


def _pieces(data: np.ndarray, offsets: np.ndarray, keep: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, offsets, lead) of pieces of whole rows; a longer row comes in several, each but the first led by the
    last `keep` words of what went before."""
    for row, _, block, at in common.chunks(data, offsets, PIECE):
        if len(at) > 2 or len(block) <= 2 * PIECE:
            yield row, block, at, 0
            continue
        a, led, lead = 0, np.zeros(0, np.uint8), 0
        while a < len(block):
            b = min(len(block), a + PIECE)
            while b < len(block) and not len(gap := np.flatnonzero(~_IN_WORD[_LOWER[block[b : b + PIECE]]])):
                b = min(len(block), b + PIECE)  # within a word: on to its end
            b = len(block) if b >= len(block) else b + int(gap[0])
            piece = np.concatenate([led, block[a:b]])
            yield row, piece, np.array([0, len(piece)]), lead
            a = b
            led, lead = _last_words(piece, keep)


def _last_words(piece: np.ndarray, keep: int) -> tuple[np.ndarray, int]:
    """The last `keep` words of a piece with a space after each, and their number."""
    inside = np.concatenate([[False], _IN_WORD[_LOWER[piece]], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)[-keep:] if keep else np.zeros((0, 2), np.int64)
    kept = b"".join(piece[x:y].tobytes() + b" " for x, y in edges.tolist())
    return np.frombuffer(kept, np.uint8), len(edges)


def totals(docs: DataFrame, *, text: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket: a number for each, whatever the input."""

    def run(batches):
        trie, found = Trie(order), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, at, lead in _pieces(*common.buffers(batch.column(0)), order - 1):
                for level in trie.grow(data, at, lead):
                    found += np.bincount(level.crc % buckets, weights=level.count, minlength=buckets).astype(np.int64)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select(F.col(f"`{text}`")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket 1000 ln of how much commoner it is in the target, with one more of each bucket on both sides, floored."""
    s, t, k = source.astype(float), target.astype(float), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, *, id_col: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """(id, n_words, n_features, weight) of every row: the floored mean of the gains along its paths."""

    def run(batches):
        trie = Trie(order)
        for batch in batches:
            data, offsets = common.buffers(batch.column(1))
            words, features, total = (np.zeros(len(offsets) - 1, np.int64) for _ in range(3))
            for first, piece, at, lead in _pieces(data, offsets, order - 1):
                for depth, level in enumerate(trie.grow(piece, at, lead)):
                    rows, n = slice(first, first + len(at) - 1), len(at) - 1
                    count = np.bincount(level.row, minlength=n)
                    features[rows] += count
                    words[rows] += count if depth == 0 else 0
                    total[rows] += np.bincount(level.row, weights=gain[level.crc % len(gain)][level.path], minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(features), pa.array(total // np.maximum(features, 1))], ["id", "n_words", "n_features", "weight"])

    kind = docs.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`")).mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long").withColumnRenamed("id", id_col)


def resampled(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text: str = "text", order: int = ORDER, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row: `percent` of the rows with `least_words` words or more,
    those of the highest scores, have a rank."""
    gain = gains(totals(docs, text=text, order=order, buckets=buckets), totals(target, text=text, order=order, buckets=buckets))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 32))
    rows = common.settle(weighed(docs, gain, id_col=id_col, text=text, order=order).withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(uniform)))))
    part, place = F.shiftright("_i", 33), F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))
    able = F.col("n_words") >= least_words
    # an id that numbers a sorted partition's rows from 0, after the partition's own number
    ordered = common.settle(rows.filter(able).orderBy(F.desc("score"), id_col, "n_features", "weight").withColumn("_i", F.monotonically_increasing_id()))
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.broadcast(sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all")))
    numbered = ordered.join(before, part == F.col("_part")).withColumn("rank", F.col("_before") + place + 1)
    numbered = numbered.withColumn("rank", F.when(F.col("rank") <= F.floor(F.lit(percent) * F.col("_all") / 100), F.col("rank"))).select(*rows.columns, "rank")
    return numbered.unionByName(rows.filter(~able).withColumn("rank", F.lit(None).cast("long")))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampled(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


_BYTES = "list_transform(range(1, length(hex(encode({0}))), 2), lambda i: CAST(16 * (instr('0123456789ABCDEF', hex(encode({0}))[i]) - 1) + instr('0123456789ABCDEF', hex(encode({0}))[i + 1]) - 1 AS UINTEGER))"
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), '%s', '%s'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')" % (common.UPPER, common.LOWER)
OP11_SQL = f"""
WITH RECURSIVE steps AS (SELECT CAST(range AS UINTEGER) AS b, CAST(range AS UINTEGER) AS c, 0 AS k FROM range(256)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UINTEGER)) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
step AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
texts AS (SELECT 1 AS side, doc_id AS id, {_WORDS} AS w FROM documents UNION ALL SELECT 2, item_id, {_WORDS} FROM benchmark),
runs AS (SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM texts),
counted AS (SELECT side, id, f, count(*) AS n FROM runs GROUP BY 1, 2, 3),
bucketed AS (SELECT f, xor(list_reduce(list_concat([CAST(4294967295 AS UINTEGER)], {_BYTES.format('f')}), lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) AS BIGINT) + 1])), CAST(4294967295 AS UINTEGER)) % {BUCKETS} AS bucket
  FROM (SELECT DISTINCT f FROM counted), step),
totals AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 1), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE side = 2), 0)::DOUBLE AS t FROM counted JOIN bucketed USING (f) GROUP BY 1),
whole AS (SELECT sum(s) AS s, sum(t) AS t FROM totals),
gains AS (SELECT bucket, floor(1000 * ln((totals.t + 1) * (whole.s + {BUCKETS}) / ((totals.s + 1) * (whole.t + {BUCKETS}))))::BIGINT AS g FROM totals, whole),
weights AS (SELECT id, sum(n)::BIGINT AS n, sum(n * g)::BIGINT AS g FROM counted JOIN bucketed USING (f) JOIN gains USING (bucket) WHERE side = 1 GROUP BY 1),
scored AS (SELECT id AS doc_id, len(w) AS words, coalesce(n, 0)::BIGINT AS n_features, coalesce(CASE WHEN g % n < 0 THEN g // n - 1 ELSE g // n END, 0)::BIGINT AS weight FROM texts LEFT JOIN weights USING (id) WHERE side = 1),
noisy AS (SELECT *, weight + floor(-1000 * ln(-ln((CAST('0x' || sha256('{SEED}:' || doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM noisy WHERE words >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN r <= {PERCENT} * n // 100 THEN r END::BIGINT AS rank FROM noisy LEFT JOIN placed USING (doc_id)
"""
