"""N-gram Jaccard join: links between documents whose shingle sets are similar, and their components.

Exact: 100 |x & y| >= threshold |x | y| decides, on 64-bit hashes of the shingles of whole texts. Steps:

1. Every text becomes its sorted set. Equal sets (128-bit fingerprint) are one set, a node, from here on.
2. Shingles are ordered by rarity, their number of documents in the whole corpus (levels of log2), ties by hash. Any
   fixed order is right; this one makes index lists short, and shingles of one document need no list at all.
3. A set's first few shingles in this order are its postings; two similar sets share one. An index list is split into
   blocks by set size. From a posting's place and its set's size follows how large a partner can be that still reaches
   the overlap; a set probes only the blocks up to there, and so skips the others unread.
4. Each list has a leader, the set in which the list's shingle comes first. Sets are verified against their leaders, and
   the sets linked to a leader take its answer: they need no look at one another.
5. Of sets in one list that are still in different components, those pairs are verified which the answers computed so
   far leave open: where both similarities to the leader are known, they bound the pair's (Jaccard distance is a metric),
   and pairs that can't reach the threshold are skipped. Components are closed over all links.

Copies are never expanded into pairs; a list's cost is its length, and only unlike sets that share rare shingles meet.

Defined cases: a text of fewer words than the shingle's is one shingle; null, empty and blank texts have no set and
no link, and are their own component; rows are told apart by id and text, so rows that repeat an id come back each and
are linked by their own texts; a component's name is its smallest id that isn't null, or null; an empty table gives an
empty table.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, common

WORDS, THRESHOLD = 4, 85
#: Shingles that a task of verification gets at once, about.
VERIFY = 400_000


def _sets(part, at, words: int):
    """Per text of a chunk: its sorted distinct shingle hashes (uint64)."""
    w = common.Words(part, at, lower=True)
    idx, h = w.windows(words)
    row = w.row[idx]
    bounds = np.searchsorted(row, np.arange(len(at)))
    for i in range(len(at) - 1):
        n = w.bounds[i + 1] - w.bounds[i]
        if n == 0:
            yield np.zeros(0, np.uint64)
        elif n < words:
            run = w.hashes[0][w.bounds[i] : w.bounds[i + 1]]
            yield common.mix(common.rolling(run, int(n)), 100 + int(n))
        else:
            yield np.unique(h[bounds[i] : bounds[i + 1]])


def _each(batch, words: int, column: int = 1):
    data, offsets = common.buffers(batch.column(column))
    for _, _, part, at in common.chunks(data, offsets):
        yield from _sets(part, at, words)


def _print(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    with np.errstate(over="ignore"):
        a, b = common.mix(s, 3).sum(dtype=np.uint64), common.mix(s, 5).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, same, n, h1, h2) of (doc_id, same, text)."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            n, h1, h2 = [], [], []
            for s in _each(batch, words, 2):
                a, b = _print(s)
                n.append(len(s))
                h1.append(a)
                h2.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], ["doc_id", "same", "n", "h1", "h2"])

    return docs.mapInArrow(run, "doc_id long, same long, n long, h1 long, h2 long")


def _least(n, threshold: int):
    """The smallest intersection that a link needs with |x| + |y| = n."""
    return -(-threshold * n // (100 + threshold))


def postings(docs: DataFrame, n_bytes: int, words: int = WORDS, threshold: int = THRESHOLD, fan: int | None = None) -> DataFrame:
    """(token, block, top, h1, n, pos): those of each set's first shingles by rarity that other documents have too.

    Documents' blocks ask the shards of the shingles' space about their distinct shingles and get the counts over all
    documents back, as levels: 0 for a shingle of one document, else on a scale of log2. A set's order is by level,
    then hash. Shingles of one document keep their places in it but make no postings, so a set of mostly own shingles
    makes none. `block` is the set's size on a scale of 1/threshold, `top` the last block whose sets this posting can
    reach the overlap with. Of a block's equal sets one sends postings.
    """
    import pyarrow as pa

    plan = blocks.plan(n_bytes, n_bytes // 6, fan=fan)
    blocked = blocks.in_blocks(docs, plan.blocks)
    step = math.log(100 / threshold)
    drop = np.uint64(16)  # 48 bits tell shingles apart well enough for counts

    def level(keys, sums):
        return [np.minimum(255, np.rint(16 * np.log2(np.maximum(1, sums[0])))).astype(np.uint8)]

    rarity = blocks.Exchange(plan, 1 << 48, 1, (np.uint8,), level)

    def sets_of(table: pa.Table) -> dict[tuple[int, int], np.ndarray]:
        out: dict[tuple[int, int], np.ndarray] = {}
        for x in _each(table, words, table.column_names.index("text")):
            if len(x):
                out.setdefault(_print(x), x)
        return out

    def keys_of(found):
        return np.unique(np.concatenate([np.zeros(0, np.uint64), *found.values()]) >> drop, return_inverse=True, return_counts=True)

    def ask(table: pa.Table) -> pa.Table:
        keys, _, count = keys_of(sets_of(table))
        return rarity.ask(blocks.block_of(table), [keys], [count.astype(np.uint32)])

    def post(table: pa.Table, replies: pa.Table) -> pa.Table:
        found = sets_of(table)
        keys, which, _ = keys_of(found)
        levels = rarity.read(replies, [keys])[0][which]
        out, first = [], 0
        for (h1, _), x in found.items():
            size, level = len(x), levels[first : first + len(x)]
            first += size
            # two linked sets' first common shingle has a place from which at least _least of the smallest partner are left
            prefix = size - int(_least(size + -(-threshold * size // 100), threshold)) + 1
            if np.count_nonzero(level == 0) >= prefix:
                continue
            order = np.lexsort((x, level))[:prefix]
            pos = np.flatnonzero(level[order] > 0)
            # at place p the overlap can be size - p at most: so large may the partner be
            most = np.minimum((size - pos) * (100 + threshold) // threshold - size, 100 * size // threshold)
            top = np.where(most >= size, (np.log(np.maximum(1, most)) / step + 1e-9).astype(np.int64), int(math.log(size) / step))
            out.append((x[order[pos]], np.full(len(pos), h1), np.full(len(pos), size), pos, np.full(len(pos), int(math.log(size) / step)), top))
        cols = [np.concatenate([np.zeros(0, np.int64), *(o[i].astype(np.uint64).view(np.int64) if i == 0 else o[i] for o in out)]) for i in range(6)]
        kinds = (("token", pa.int64()), ("h1", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("block", pa.int32()), ("top", pa.int32()))
        return pa.table({c: pa.array(v.astype(np.int64)).cast(t) for (c, t), v in zip(kinds, cols, strict=True)})

    replies = rarity.run(blocked.groupBy("block").applyInArrow(ask, blocks.FIELDS))
    return blocked.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(post, "token long, h1 long, n int, pos int, block int, top int")


def _reachable(a: str, b: str, threshold: int):
    """The size filter, and the bound on the overlap from a first common shingle at these places."""
    na, nb = F.col(f"{a}.n").cast("long"), F.col(f"{b}.n").cast("long")
    need = F.ceil(F.lit(threshold) * (na + nb) / F.lit(100 + threshold))
    fits = (100 * F.least(na, nb) >= threshold * F.greatest(na, nb))
    return fits & (F.least(na - F.col(f"{a}.pos"), nb - F.col(f"{b}.pos")) >= need)


def verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b, similarity, link) of pairs of nodes. nodes: (node, doc_id, same, n), the row that has a node's text.

    Texts travel, not sets: they are smaller. b's texts go once a pair; a's, which may be a leader in very many pairs,
    once for each task that has some of its pairs. Tasks are dealt by the shingles they get.
    """
    import pyarrow as pa

    pairs = common.settle(pairs)
    if pairs.isEmpty():
        return pairs.select("a", "b", F.lit(0.0).alias("similarity"), F.lit(False).alias("link"))
    size = nodes.select(F.col("node").alias("b"), "n")
    led = common.settle(pairs.join(size, "b").groupBy("a").agg(F.sum("n").alias("n")))
    tasks = max(1, -(-(led.agg(F.sum("n")).first()[0] or 0) // VERIFY))
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes, "node").select("node", F.col("doc_id").alias("_id"), F.col("same").alias("_same"))
    needed = common.settle(needed)
    needed = F.broadcast(needed) if needed.count() <= common.NARROW else needed
    texts = common.settle(docs.join(needed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("same") == F.col("_same"))).select("node", "text"))
    parts = led.select("a", F.greatest(F.lit(1), F.ceil(F.col("n") / VERIFY)).cast("int").alias("parts"))
    task = lambda: F.pmod(F.xxhash64("a", "part"), F.lit(tasks)).cast("int").alias("task")
    left = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("a", task()).distinct()
    left = left.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    right = common.with_hot(pairs, parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part")).select("a", "b", task())
    right = common.with_hot(right, texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    right = right.select(F.col("task").alias("told"), F.col("a").alias("x"), F.col("b").alias("y"), "tb")

    def run(leaders: pa.Table, others: pa.Table) -> pa.Table:
        heads = dict(zip(leaders.column("a").to_pylist(), _each(leaders, words, leaders.column_names.index("ta")), strict=True)) if leaders.num_rows else {}
        a, b, sim, link = others.column("x").to_pylist(), others.column("y").to_pylist(), [], []
        if others.num_rows:
            for x, t in zip(a, _each(others, words, others.column_names.index("tb")), strict=True):
                s = heads[x]
                both = len(np.intersect1d(s, t, assume_unique=True))
                union = len(s) + len(t) - both
                sim.append(both / union)
                link.append(100 * both >= threshold * union)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "similarity": pa.array(sim, pa.float64()), "link": pa.array(link, pa.bool_())})

    return left.groupBy("task").cogroup(right.groupBy("told")).applyInArrow(run, "a long, b long, similarity double, link boolean").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component: smallest node reachable) of (a, b) links, by rounds of minimum labels with pointer jumping.

    Each round is a join and a grouping over the links; tables are checkpointed, only a count comes to the driver. A node
    with very many links, or a component with very many nodes, doesn't meet them in one task (`with_hot`).
    """
    edges = common.settle(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = common.settle(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    n_edges, n_nodes = edges.count(), label.count()
    while True:
        near = common.with_hot(edges, label.select(F.col("node").alias("b"), F.col("component").alias("other")), "b", total=n_edges).groupBy("a").agg(F.min("other").alias("other"))
        told = label.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("component").alias("was"), F.least("component", "other").alias("component"))
        told = common.settle(told) if n_nodes > common.HOT_ROWS else told
        # every component is a node, so each finds its own
        jump = told.select(F.col("node").alias("component"), F.col("component").alias("top"))
        new = common.settle(common.with_hot(told, jump, "component", total=n_nodes).select("node", "was", F.least("component", "top").alias("component")))
        label = new.select("node", "component")
        if new.filter("was <> component").isEmpty():
            return label


def classified(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", words: int = WORDS, threshold: int = THRESHOLD, fan: int | None = None) -> DataFrame:
    """(doc_id, same, n_shingles, class, component_id) of every row; same: xxhash64 of its text; class: null without a set."""
    doc_id, same = common.pair(docs, id_col=id_col, text=text)
    docs = docs.select(doc_id.cast("long").alias("doc_id"), same, F.col(text).alias("text"))
    prints = common.settle(fingerprints(docs, words))
    # a node is a set's h1; of the few sets that may share one the later ones have their h2
    sets = prints.filter("n > 0").groupBy("h1", "h2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "same")).alias("r"), F.max("n").alias("n"))
    of_h1 = sets.groupBy("h1").agg(F.array_sort(F.collect_list(F.struct("h2", "r", "n"))).alias("s")).select("h1", F.posexplode("s").alias("i", "s"))
    nodes = common.settle(of_h1.select(F.when(F.col("i") == 0, F.col("h1")).otherwise(F.col("s.h2")).alias("node"), "h1", "s.h2", "s.r.doc_id", "s.r.same", "s.n"))
    # equal sets of different blocks send equal postings: they combine by all four columns, so no token is a hot key here
    lists = common.settle(postings(docs, blocks.measure(docs), words, threshold, fan).dropDuplicates(["token", "h1", "n", "pos"]))
    # only shingles that two sets have make lists; the leader is the set where the shingle comes first
    heads = lists.groupBy("token").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.min(F.struct("pos", "h1", "n")).alias("lead")).filter("lo <> hi").select("token", "lead")
    lists = common.settle(common.with_hot(lists, heads, "token"))
    led = lists.select(F.col("lead.h1").alias("x"), F.col("h1").alias("y"), F.struct("n", "pos").alias("p"), F.col("lead").alias("q")).filter("x <> y").filter(_reachable("p", "q", threshold))
    ids = nodes.select("h1", "node")

    def named(pairs: DataFrame) -> DataFrame:
        """Pairs of h1 as pairs of nodes, the leader first."""
        out = common.with_hot(common.settle(pairs.select("x", "y").distinct()), ids.select(F.col("h1").alias("x"), F.col("node").alias("a")), "x").join(ids.select(F.col("h1").alias("y"), F.col("node").alias("b")), "y")
        return out.select("a", "b").filter("a <> b")

    first = common.settle(verify(named(led), nodes, docs, words, threshold))
    links = first.filter("link")
    label = components(links)
    by_h1 = ids.join(label, "node", "left").select("h1", F.coalesce("component", "node").alias("c"))
    # lists that still hold sets of more than one component
    told = common.settle(lists.join(by_h1, "h1"))
    open_ = told.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("token")
    known = first.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "similarity")
    told = told.join(open_, "token", "left_semi").join(known, (F.col("lead.h1") == F.col("_a")) & (F.col("h1") == F.col("_b")), "left")
    told = common.settle(told.select("token", "block", "top", "h1", "n", "pos", "c", F.when(F.col("lead.h1") == F.col("h1"), 1.0).otherwise(F.col("similarity")).alias("similarity")))
    other = told.withColumn("block", F.explode(F.sequence("block", F.greatest("block", "top"))))
    x, y = told.alias("x"), other.alias("y")
    near = F.abs(F.col("x.similarity") - F.col("y.similarity")) <= 1 - threshold / 100 + 1e-9
    meet = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.c") != F.col("y.c")) & _reachable("x", "y", threshold) & F.coalesce(near, F.lit(True)))
    second = named(meet.select(F.least("x.h1", "y.h1").alias("x"), F.greatest("x.h1", "y.h1").alias("y")))
    rest = second.join(first, ["a", "b"], "left_anti").join(first.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti")
    more = common.settle(verify(rest, nodes, docs, words, threshold).filter("link"))
    if not more.isEmpty():
        label = components(links.unionByName(more))
    top = common.settle(nodes.join(label, "node", "left").select("h1", "h2", "doc_id", F.coalesce("component", "node").alias("class")))
    names = top.groupBy("class").agg(F.min("doc_id").alias("name"))
    top = common.with_hot(top, names, "class").select("h1", "h2", "class", "name")
    out = common.with_hot(prints.filter("n > 0").withColumn("h", F.struct("h1", "h2")), top.select(F.struct("h1", "h2").alias("h"), "class", "name"), "h")
    out = out.select("doc_id", "same", F.col("n").alias("n_shingles"), "class", F.col("name").alias("component_id"))
    return out.unionByName(prints.filter("n = 0").select("doc_id", "same", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("class"), F.col("doc_id").alias("component_id")))


def classes(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", words: int = WORDS, threshold: int = THRESHOLD, fan: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    return classified(docs, id_col=id_col, text=text, words=words, threshold=threshold, fan=fan).select("doc_id", "n_shingles", "component_id")


def leaders(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """docs with one row of each class: the one with the smallest id that isn't null, then the smallest hash of its text.
    Of rows that repeat both one stays. Rows without a set stay all."""
    found = common.settle(classified(docs, id_col=id_col, text=text, words=words, threshold=threshold).filter("class is not null").select("doc_id", "same", "class"))
    best = found.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "same")).alias("r"))
    best = best.select(F.col("r.doc_id").alias("doc_id"), F.col("r.same").alias("same"))
    gone = found.select("doc_id", "same").distinct().exceptAll(best)
    out = common.without(docs, common.settle(gone), id_col=id_col, text=text)
    again = common.settle(found.groupBy("doc_id", "same").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", "same"))
    if again.isEmpty():
        return out
    lone = common.without(out, again, id_col=id_col, text=text)
    rows = out.select(F.struct(*(F.col(f"`{c}`") for c in out.columns)).alias("_row"))
    key = [c.alias(n) for c, n in zip(common.pair(docs, id_col=f"_row.`{id_col}`", text=f"_row.`{text}`"), ("_id", "_same"), strict=True)]
    there = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_same") == F.col("same"))
    one = rows.select("_row", *key).join(again, there).groupBy("_id", "_same").agg(F.first("_row").alias("_row")).select("_row.*")
    return lone.unionByName(one)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.table(spark, sf_dir, "documents"))


OP5_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {WORDS - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WORDS - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= {THRESHOLD} * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY 1) USING (doc_id)
"""
