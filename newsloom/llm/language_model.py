"""Language-model scores from a sharded trigram trie.

Words get their training counts first: documents stand in blocks; a block asks the shards of the vocabulary about its
distinct words and gets their counts and ids. Then it asks the shards of contexts about its distinct trigrams: a
context is the ids of the two words before, and its follower a word id; its shard is a hash of the context. A shard adds
up the training counts and builds its trie (Elias-Fano levels of contexts, pointers and followers; 16-bit smoothed
probabilities and back-off weights; all in memory-mapped arrays) and answers by successor search within the context's
pointers. Nothing of the model is on one machine, and its number of shards grows with the input.

Every level is a mixture with the one below, with a prior of `PRIORS` observations (Dirichlet smoothing):

    p(w)       = (c(w) + 0.5) / (N + 0.5 (V + 1))
    p(w | v)   = (c(v w) + k2 p(w)) / (c(v) + k2)
    p(w | u v) = (c(u v w) + k3 p(w | v)) / (c(u v) + k3)

A text starts after two starts, which are no tokens. The trie stores c(u v w) / (c(u v) + k3) and k3 / (c(u v) + k3). A bigram's count is its
count as a context, so bigrams need no exchange of their own: the answer to the trigram that follows holds it, and the
end of a text is followed by one more token, 0.

A context of two very common words would be a hot shard. So followers of a pair whose rarer word has more than `DEALT`
training tokens (the pair can't have more) are dealt into parts by hash, and the block asks about the pair's own count
as a key of its own; so it does where the follower is a word that no training text has.

Defined cases: null and empty texts are one end token; a null id counts as training and as not held out; without
training rows N = V = 0 and every token has p = 1; rows with one id are scored each; an empty table gives none.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, common
from .elias_fano import Trie, restore

FOLDS, HELD_OUT = 5, 1
PRIORS = (200.0, 5.0)
DEALT = 1 << 20
_END = np.uint64(0x5851F42D4C957F2D)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Ids that are no words': what comes after a text's end, a dealt pair as a whole, a text's start.
_AFTER, _WHOLE, _START, _FIRST_ID = 0, 1, 2, 3


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


class _Block:
    """The tokens of a block: hashes, lengths of rows, and which are training tokens."""

    def __init__(self, table):
        common.keep_heap()
        table = table.select(["doc_id", "text"])
        self.ids = table.column("doc_id").to_pylist()
        data, offsets = common.buffers(table.column("text").combine_chunks()) if table.num_rows else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
        parts, lengths = [], []
        for _, _, part, at in common.chunks(data, offsets):
            w = common.Words(part, at, lower=True)
            parts.append(np.insert(w.hashes[0], w.bounds[1:], _END))
            lengths.append(np.diff(w.bounds) + 1)
        self.lengths = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        self.held = np.array([held_out(i) for i in self.ids], bool)
        self.train = np.repeat(~self.held, self.lengths)
        self.words, self.which = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_inverse=True)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def trigrams(self, count: np.ndarray, ids: np.ndarray):
        """(keys: words u and v, part, follower; training counts: distinct, in order; places of: each token's own key, its
        context's whole, the key after it, that key's whole; -1 where there is none)."""
        n, rows = len(self.which), len(self.lengths)
        # ids by their rank within the block: they compare as ids do, and three fit in one integer whatever the vocabulary
        known = int((ids != _NONE).sum())
        by_id = np.argsort(ids)
        named, none = np.concatenate([np.arange(_FIRST_ID, dtype=np.uint64), ids[by_id[:known]], np.array([_NONE])]), np.uint64(_FIRST_ID + known)
        ids = np.full(len(ids), none, np.uint64)
        ids[by_id[:known]] = np.arange(_FIRST_ID, _FIRST_ID + known, dtype=np.uint64)
        # every row's tokens, with two starts before and what comes after the end; there are as many starts as ends
        starts = count[np.searchsorted(self.words, _END)] if len(self.words) else 0
        at = np.arange(n) + 3 * np.repeat(np.arange(rows), self.lengths) + 2
        size = n + 3 * rows
        word, c = np.full(size, _START, np.uint64), np.full(size, starts, np.int64)
        word[at], c[at] = ids[self.which], count[self.which]
        after = at[self.starts + self.lengths - 1] + 1 if rows else np.zeros(0, np.int64)
        word[after] = _AFTER
        keyed = np.sort(np.concatenate([at, after]))
        u, v, w = word[keyed - 2], word[keyed - 1], word[keyed]
        ok = (u != none) & (v != none)  # a pair with an unseen word has no count
        least = np.minimum(c[keyed - 2], c[keyed - 1])
        parts = np.maximum(1, -(-least // DEALT)).astype(np.uint64)
        dealt = parts > 1
        part = np.zeros(len(w), np.uint64)
        part[dealt] = common.mix(named[w[dealt]], 24) % parts[dealt] + np.uint64(1)
        train = np.zeros(size, bool)
        train[at] = self.train
        train[after] = ~self.held
        one, own = ok & (w != none), ok & (dealt | (w == none))
        many, zero = int(own.sum()), np.uint64(0)
        keys = [np.concatenate(x) for x in ((u[one], u[own]), (v[one], v[own]), (part[one], np.full(many, zero)), (w[one], np.full(many, _WHOLE, np.uint64)))]
        told = np.concatenate([train[keyed][one], train[keyed][own]])
        narrow = blocks.narrowed(keys)
        order = blocks.in_order(narrow)
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in (x[order] for x in narrow)])
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        total = np.bincount(place, weights=told, minlength=int(new.sum())).astype(np.uint32)
        mine, whole = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        mine[keyed[one]], whole[keyed[own]] = place[: int(one.sum())], place[int(one.sum()) :]
        distinct = order[new]
        return [k[distinct] if i == 2 else named[k[distinct]] for i, k in enumerate(keys)], total, (mine[at], whole[at], mine[at + 1], whole[at + 1])


def scores(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", priors: tuple[float, float] = PRIORS, fan: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    import pyarrow as pa

    n_bytes = blocks.measure(docs, text)
    plan = blocks.plan(n_bytes, n_bytes // 6, shard_keys=2 * blocks.SHARD_KEYS, fan=fan)
    blocked = blocks.in_blocks(docs, plan.blocks, id_col=id_col, text=text)
    k2, k3 = priors
    width = -(-(1 << 64) // plan.shards)

    def number(keys, sums):
        """Counts, and ids of the words that training rows have: the shard's commonest words have the smallest ids, so that
        the ids of running text pack well."""
        count = sums[0].astype(np.int64)
        rank = np.empty(len(count), np.uint64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(count), dtype=np.uint64)
        shard = int(keys[0][0]) // width
        return count, np.where(count > 0, rank * np.uint64(plan.shards) + np.uint64(shard + _FIRST_ID), _NONE)

    def context(keys) -> np.ndarray:
        """64 bits for a pair of words, and a part of its followers."""
        return common.mix(common.mix(common.mix(keys[0], 21) + keys[1], 22) + keys[2], 23)

    def answer(keys, sums):
        common.keep_heap()
        hashed, follow = context(keys), keys[3].astype(np.int64)
        # keys come in order, so a context's are together: contexts are sorted, and theirs follow in runs
        begin = np.flatnonzero(np.concatenate([[True], hashed[1:] != hashed[:-1]])) if len(hashed) else np.zeros(0, np.int64)
        which = np.repeat(np.arange(len(begin)), np.diff(begin, append=len(hashed)))
        by_hash = np.argsort(hashed[begin])
        some = np.flatnonzero(sums[0])
        sizes = np.bincount(which[some], minlength=len(begin))
        first = (np.cumsum(sizes) - sizes)[by_hash]
        sizes = sizes[by_hash]
        some = some[np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(some))]
        trie = Trie(hashed[some], follow[some], sums[0][some].astype(np.int64), k3)
        # asked in the trie's own order, so that the search reads its levels from front to back
        runs = np.diff(begin, append=len(hashed))[by_hash]
        ordered = np.repeat(begin[by_hash] - (np.cumsum(runs) - runs), runs) + np.arange(len(hashed))
        at, backoff = trie.contexts_of(hashed[begin][by_hash])
        code, back = np.empty(len(hashed), np.uint16), np.empty(len(hashed), np.uint16)
        back[ordered] = np.repeat(backoff, runs)
        code[ordered] = trie.lookup(np.repeat(at, runs), follow[ordered])
        # both codes are logarithms, and most counts are 1: their difference is nearly the same everywhere
        return code - back, back

    def tally(keys, sums):
        return np.array([sums[0].sum(), (sums[0] > 0).sum()], np.uint64).tobytes()

    words = blocks.Exchange(plan, 1 << 64, 1, (np.uint64, np.uint64), number, tally=tally)
    grams = blocks.Exchange(plan, 1 << 64, 4, (np.uint16, np.uint16), answer, place=context)

    def ask_words(table: pa.Table) -> pa.Table:
        b = _Block(table)
        return words.ask(blocks.block_of(table), [b.words], [np.bincount(b.which[b.train], minlength=len(b.words)).astype(np.uint32)])

    def totals(table: pa.Table) -> pa.Table:
        """N and V, added up over the vocabulary's shards, to every block."""
        notes = table.column("note").to_pylist() if blocks.block_of(table) == blocks.TALLY else []
        sums = np.sum([np.frombuffer(x, np.uint64) for x in notes], axis=0).tobytes() if notes else b""
        n = plan.blocks if notes else 0
        return pa.table({"block": pa.array(range(n), pa.int32()), "lane": pa.array([0] * n, pa.int32()), "n": pa.array([0] * n, pa.int32()), "cols": pa.array([[]] * n, pa.list_(pa.binary())), "note": pa.array([sums] * n, pa.binary()), "kind": pa.array([2] * n, pa.int32())})

    def ask_grams(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return grams.ask(0, [np.zeros(0, np.uint64)] * 4, [])
        b = _Block(table)
        count, ids = words.read(replies, [b.words])
        keys, total, _ = b.trigrams(count.astype(np.int64), ids)
        return grams.ask(blocks.block_of(table), keys, [total])

    def score(table: pa.Table, replies: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        if not table.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))})
        b = _Block(table)
        kind = replies.column("kind")
        part = lambda k: replies.filter(pc.equal(kind, k)).drop_columns(["kind"])
        total, types = np.frombuffer(part(2).column("note")[0].as_py(), np.uint64).tolist()
        count, ids = words.read(part(0), [b.words])
        count = count.astype(np.int64)
        keys, _, (mine, whole, after, after_whole) = b.trigrams(count, ids)
        code, back = grams.read(part(1), keys)
        code = code + back  # modulo 2**16, as it was taken
        code, back = np.append(restore(code), 0.0), np.append(np.where(back > 0, restore(back), 1.0), 1.0)  # the last: none
        pairs = lambda m, w: np.rint(k3 / np.where(w >= 0, back[w], back[m]) - k3)  # noqa: E731  a context's count
        c = count[b.which].astype(float)
        base = (c + 0.5) / (total + 0.5 * (types + 1))
        before = np.empty(len(c))
        before[1:] = c[:-1]
        before[b.starts] = count[np.searchsorted(b.words, _END)] if len(b.words) else 0
        second = (pairs(after, after_whole) + k2 * base) / (before + k2)
        # of a dealt pair the trie knows a part's count only: the answer's ratio gives the follower's count back
        third = np.where(whole >= 0, code[mine] * k3 / back[mine], 0.0)
        pair = np.where(whole >= 0, k3 / back[whole] - k3, 0.0)
        mixed = np.where(whole >= 0, (third + k3 * second) / (pair + k3), code[mine] + back[mine] * second)
        by_row = lambda v: np.add.reduceat(v, b.starts)
        return pa.table({
            "doc_id": pa.array(b.ids, pa.int64()), "held_out": pa.array(b.held), "n_tokens": pa.array(b.lengths, pa.int64()), "n_known": pa.array(by_row((c > 0).astype(np.int64)), pa.int64()),
            "train_tokens": pa.array(np.full(len(b.ids), total), pa.int64()), "base_score": pa.array(by_row(np.log10(base))), "score": pa.array(by_row(np.log10(mixed))),
        })

    asked = blocked.groupBy("block").applyInArrow(ask_words, blocks.FIELDS)
    known = words.run(asked)
    told = grams.run(blocked.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(ask_grams, blocks.FIELDS))
    sums = known.groupBy("block").applyInArrow(totals, blocks.FIELDS + ", kind int")
    every = known.withColumn("kind", F.lit(0)).unionByName(told.withColumn("kind", F.lit(1))).unionByName(sums)
    return blocked.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(common.table(spark, sf_dir, "documents"))
