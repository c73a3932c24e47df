"""Substring dedup: windows of `width` words that start anywhere earlier lose their later copies.

A count-min sketch over all windows goes first. Each block of documents sketches its windows: two rows of cells, a
window in one cell of each; the shards of the sketch add the blocks' cells up and tell every block which of its cells
hold two windows or more. Cells only ever overestimate, so a window that repeats is always passed on; one that doesn't
rarely is (the sketch has `cells_per_window` cells a window in each row, however many windows there are, so its accuracy
doesn't fall as the input grows). Then the windows passed on, and only those, are grouped exactly, by 128 bits of their
word sequence; every one but the first by (document, start) is marked, and the words under marked windows go. Windows
are judged on the input, not on what is left.

Words are runs of characters other than space and 0x09-0x0D, unchanged.

Defined cases: null and empty texts have no words; a text of fewer than `width` words keeps all; ids are ordered as
signed integers, rows with null id come after all others; rows with one id (null ids too) stand in an order of their
own, the same in every run; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, common

WIDTH = 20
CELLS_PER_WINDOW = 4


def _read(table):
    """(ids, which are null, texts as Arrow) of a block, by id and text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    table = table.select(["doc_id", "text"])
    ids = table.column("doc_id")
    apart = ids.null_count < 2 and pc.count_distinct(ids).as_py() == len(ids) - ids.null_count
    table = table.sort_by([("doc_id", "ascending")] if apart else [("doc_id", "ascending"), ("text", "ascending")])
    ids = table.column("doc_id")
    return pc.fill_null(ids, 0).to_numpy(), pc.is_null(ids).to_numpy(), table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())


def _windows(table, width: int, seeds: int = 1):
    """Per chunk of a block: (ids, which are null, Words, index of each window's first word, its hashes)."""
    ids, null, text = _read(table)
    data, offsets = common.buffers(text)
    for row, end, part, at in common.chunks(data, offsets):
        w = common.Words(part, at, lower=False, seeds=seeds)
        found = [w.windows(width, k) for k in range(seeds)]
        yield ids[row:end], null[row:end], w, found[0][0], [h for _, h in found]


def _cells(h: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the cells of windows in both rows of the sketch, distinct and in order; each window's place in the first row, in the second)."""
    both = np.concatenate([common.mix(h, 11) % np.uint64(total), common.mix(h, 12) % np.uint64(total) + np.uint64(total)])
    cells, place = np.unique(both, return_inverse=True)
    return cells, place[: len(h)], place[len(h) :]


def marked_windows(blocked: DataFrame, n_bytes: int, plan: blocks.Plan, width: int = WIDTH, cells_per_window: int = CELLS_PER_WINDOW) -> DataFrame:
    """Of each block, what `_marks` reads: which of its windows (by their ordinals) start earlier elsewhere too."""
    import pyarrow as pa

    # a word takes two bytes at least, so there are fewer windows than this; typical texts have a third of them
    total = max(1 << 16, n_bytes * cells_per_window // 4)
    sketch = blocks.Exchange(plan, 2 * total, 1, (bool,), lambda keys, sums: [sums[0] > 1])
    exact = _exact(plan)

    def asked(table: pa.Table) -> pa.Table:
        h = np.concatenate([np.zeros(0, np.uint64), *(x[4][0] for x in _windows(table, width))])
        cells, a, b = _cells(h, total)
        count = np.bincount(a, minlength=len(cells)) + np.bincount(b, minlength=len(cells))
        return sketch.ask(blocks.block_of(table), [cells], [np.minimum(count, 2).astype(np.uint8)])

    def passed(table: pa.Table, replies: pa.Table) -> pa.Table:
        """The windows that both rows of the sketch take for repeated, to the shards of the exact grouping."""
        parts = [(own[w.row[at]], null[w.row[at]], x, y) for own, null, w, at, (x, y) in _windows(table, width, 2)]
        if not parts:
            return exact.ask(0, [np.zeros(0, np.uint64)] * 2, [])
        ids, null, h1, h2 = (np.concatenate(p) for p in zip(*parts, strict=True))
        cells, a, b = _cells(h1, total)
        (many,) = sketch.read(replies, [cells])
        keep = np.flatnonzero(many[a] & many[b])
        # of a block's equal windows only the first can be the first of all: the others are marked here and don't travel as keys
        order = keep[np.lexsort((keep, h2[keep], h1[keep]))]
        first = np.ones(len(order), bool)
        first[1:] = (h1[order[1:]] != h1[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])
        later, order = np.sort(order[~first]), order[first]
        block = blocks.block_of(table)
        values = [null[order].astype(np.uint8), ids[order].astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63), np.full(len(order), block, np.uint32)]
        ordinals = order.astype(np.uint32)
        return exact.ask(block, [h1[order], h2[order]], values, lambda which: blocks.planes(ordinals[which]), later.astype(np.uint32).tobytes() if len(later) else None)

    replies = sketch.run(blocked.groupBy("block").applyInArrow(asked, blocks.FIELDS))
    return exact.run(blocked.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(passed, blocks.FIELDS))


def _exact(plan: blocks.Plan) -> blocks.Exchange:
    """Windows by 128 bits; the reply says whether a block's (null id, id, block) is the least of all that have it."""
    return blocks.Exchange(plan, 1 << 64, 2, (bool,), least=True)


def _marks(replies) -> np.ndarray:
    """Ordinals of a block's marked windows, in order."""
    lanes, own = _exact(blocks.Plan(1, 1, 1)).notes(replies)
    gone = [np.frombuffer(x, np.uint32) for x in own]
    for n, cols, note in lanes:
        gone.append(blocks.from_planes(note, n)[~blocks.from_planes(cols[0], n, bool)])
    return np.sort(np.concatenate([np.zeros(0, np.int64), *gone]).astype(np.int64))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, cells_per_window: int = CELLS_PER_WINDOW, digest: bool = False, fan: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, text): kept words joined by one space; with `digest` its sha256 (kept_sha256) instead."""
    import pyarrow as pa

    n_bytes = blocks.measure(docs, text)
    # a shard of a sketch's cells holds a byte a cell: four times as many as keys of eight bytes
    plan = blocks.plan(n_bytes, n_bytes * cells_per_window // 4, shard_keys=blocks.SHARD_KEYS * cells_per_window, fan=fan)
    blocked = blocks.in_blocks(docs, plan.blocks, id_col=id_col, text=text)
    marked = marked_windows(blocked, n_bytes, plan, width, cells_per_window)
    name = "kept_sha256" if digest else "text"

    def cut(table: pa.Table, replies: pa.Table) -> pa.Table:
        gone = _marks(replies)
        first, out = 0, []
        for own, null, w, at, _ in _windows(table, width, 1):
            a, b = np.searchsorted(gone, [first, first + len(at)])
            starts = at[gone[a:b] - first]
            first += len(at)
            edge = np.zeros(len(w.starts) + width, np.int32)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + width, -1)
            kept = np.cumsum(edge)[: len(w.starts)] == 0
            data = w.data.tobytes()
            lost = np.concatenate([[0], np.cumsum(~kept)])
            for i, doc in enumerate(own):
                words = data[w.offsets[i] : w.offsets[i + 1]].split()
                x, y = w.bounds[i], w.bounds[i + 1]
                if n_lost := int(lost[y] - lost[x]):
                    left = b" ".join(compress(words, kept[x:y].tolist()))
                else:
                    left = b" ".join(words)
                out.append((None if null[i] else int(doc), len(words), n_lost, hashlib.sha256(left).hexdigest() if digest else left.decode()))
        return pa.table({"doc_id": pa.array([x[0] for x in out], pa.int64()), "n_words": pa.array([x[1] for x in out], pa.int64()), "n_removed": pa.array([x[2] for x in out], pa.int64()), name: pa.array([x[3] for x in out], pa.string())})

    return blocked.groupBy("block").cogroup(marked.groupBy("block")).applyInArrow(cut, f"doc_id long, n_words long, n_removed long, {name} string")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)


OP10_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {WIDTH - 1}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WIDTH - 2})) AS i FROM d)),
later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WIDTH})) AS i FROM later),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT a.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY a.i) AS t FROM words a LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.i = g.i WHERE g.i IS NULL GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
