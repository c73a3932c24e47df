"""Approximate nearest neighbours over balanced posting lists.

Centroids come from a bounded sample (`SAMPLE` rows, smallest hash of the id): k-means with a penalty on full clusters,
one centroid for about `LIST` vectors of the table, `MAX_LISTS` at most. Every vector goes to the list of its nearest
centroid, full ones counted as further off by the same penalty, and boundary vectors to further ones: those within
(1 + `CLOSURE`) of the nearest distance, `REPLICAS` at most in all. A query walks a graph over the centroids, in memory,
from a few entry points to its nearest ones, and reads those lists whose centroid is within (1 + `RATIO`) of the nearest,
`LEAST_PROBES` at least and `PROBES` at most. Lists longer than `PART` rows (copies of one vector cannot be told apart by
centroids) are dealt into parts, and the queries of a list into parts of about `ASKED`, so a list is never one task's
alone; each part gives its own best k, which a ranking by query brings together. Queries whose lists held fewer than k
vectors are asked of all lists. Distances are Euclidean in double precision, on the original vectors.

The graph serves queries. Postings are assigned by one matrix product with all centroids: for the 16,384 there are at
most, that is faster in numpy than a walk for each vector.

Defined cases: vectors that are null, zero, or hold a null or non-finite component take no part, nor do vectors of
another length than most have; ties go to the smaller id; rows that repeat an id count once; an empty table gives none.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K, LIST, MAX_LISTS, SAMPLE = 10, 64, 1 << 14, 40_000
REPLICAS, CLOSURE, BALANCE = 4, 0.15, 0.05
PROBES, LEAST_PROBES, RATIO = 96, 8, 0.6
PART, ASKED = 4096, 512
DEGREE, WALK = 24, 128


def valid(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v: array<double>) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    fine = v.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(fine)
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("v") == (most["d"] if most else 0))


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(centroids of clusters of like size, penalties): a cluster's squared distance grows by its penalty, with how full it is."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    full = np.ones(k)
    spread = None
    for _ in range(rounds):
        nearest, dist = np.empty(len(x), np.int64), np.empty(len(x))
        for a in range(0, len(x), 4096):
            d = _square(x[a : a + 4096], c)
            if spread is None:
                spread = float(np.median(d.min(axis=1))) or 1.0
            d = d + BALANCE * spread * (full - 1)
            nearest[a : a + 4096], dist[a : a + 4096] = d.argmin(axis=1), d.min(axis=1)
        count = np.bincount(nearest, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, nearest, x)
        some = count > 0
        c[some] = sums[some] / count[some, None]
        if (~some).any():  # an empty cluster starts anew within a full one
            crowded = np.flatnonzero(count[nearest] >= np.quantile(count[nearest], 0.5))
            c[~some] = x[rng.choice(crowded, (~some).sum())]
        full = count * k / len(x)
    c, first = np.unique(c, axis=0, return_index=True)
    return c, BALANCE * (spread or 0.0) * np.maximum(0, full[first] - 1)


def _square(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None], 0)


class Index:
    """Centroids and the graph over them."""

    def __init__(self, centroids: np.ndarray, penalty: np.ndarray):
        self.c, self.penalty, n = centroids, penalty, len(centroids)
        self.links: list[np.ndarray] = []
        for a in range(0, n, 1024):
            d = _square(centroids[a : a + 1024], centroids)
            near = np.argpartition(d, min(n - 1, DEGREE), axis=1)[:, : DEGREE + 1]
            for i, row in enumerate(near):
                row = row[row != a + i]
                self.links.append(row[np.argsort(d[i, row])])
        back: list[list[int]] = [[] for _ in range(n)]
        for i, row in enumerate(self.links):
            for j in row[: DEGREE // 2]:
                back[j].append(i)
        rng = np.random.default_rng(3)  # long links keep the graph connected
        self.links = [np.unique(np.concatenate([row, np.array(b, np.int64), rng.integers(0, n, 4)])) for row, b in zip(self.links, back, strict=True)]
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int64))

    def nearest(self, q: np.ndarray, walk: int = WALK) -> list[tuple[float, int]]:
        """Best-first walk: (squared distance, centroid), nearest first."""
        seen = set(self.entries.tolist())
        start = [(float(d), int(i)) for d, i in zip(((self.c[self.entries] - q) ** 2).sum(axis=1), self.entries, strict=True)]
        heap = list(start)
        heapq.heapify(heap)
        best = [(-d, i) for d, i in start]
        heapq.heapify(best)
        while heap:
            d, i = heapq.heappop(heap)
            if len(best) >= walk and d > -best[0][0]:
                break
            new = [j for j in self.links[i].tolist() if j not in seen]
            if not new:
                continue
            seen.update(new)
            for e, j in zip(((self.c[new] - q) ** 2).sum(axis=1).tolist(), new, strict=True):
                if len(best) < walk or e < -best[0][0]:
                    heapq.heappush(heap, (e, j))
                    heapq.heappush(best, (-e, j))
                    if len(best) > walk:
                        heapq.heappop(best)
        return sorted((-d, i) for d, i in best)

    def probes(self, q: np.ndarray) -> list[int]:
        found = self.nearest(q)
        limit = found[0][0] * (1 + RATIO) ** 2
        return [i for r, (d, i) in enumerate(found[:PROBES]) if r < LEAST_PROBES or d <= limit]

    def lists(self, x: np.ndarray) -> Iterator[tuple[int, int]]:
        """(row, centroid) of every list that each vector belongs to."""
        top = min(len(self.c), 4 * REPLICAS)
        d = _square(x, self.c) + self.penalty
        near = np.argpartition(d, top - 1, axis=1)[:, :top]
        for i in range(len(x)):
            order = near[i][np.argsort(d[i, near[i]], kind="stable")]
            limit, chosen = d[i, order[0]] * (1 + CLOSURE) ** 2, [int(order[0])]
            for j in order[1:]:
                if d[i, j] > limit or len(chosen) == REPLICAS:
                    break
                chosen.append(int(j))
            for j in chosen:
                yield i, j


def _matrix(column) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def _sampled(rows: DataFrame, n: int) -> DataFrame:
    """Rows whose id's hash lies below a bound that about 1.2 * SAMPLE of n rows pass: among them are the SAMPLE smallest. So
    what tasks send to be ordered is bounded in all, however many tasks there are. Where ids repeat so much that fewer pass, the sample is smaller."""
    share = 1.2 * SAMPLE / n
    return rows if share >= 1 else rows.filter(F.xxhash64("vec_id") < int(-(2**63) + share * 2**64))


def build(rows: DataFrame) -> tuple[Index | None, int]:
    """The index over the centroids, from a bounded sample; and the number of rows."""
    n = rows.count()
    if not n:
        return None, 0
    sample = np.array([r["v"] for r in _sampled(rows, n).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()])
    distinct = np.unique(sample, axis=0)
    k = int(max(1, min(n // LIST, MAX_LISTS, len(distinct) // 2 or 1)))
    return Index(*kmeans(distinct, k)), n


def search(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found among rows, the query's own id left out. Both: (vec_id, v)."""
    import pyarrow as pa

    index, n = build(rows)
    spark = rows.sparkSession
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    held = spark.sparkContext.broadcast(index)  # MAX_LISTS centroids and DEGREE links each at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                pairs = list(held.value.lists(_matrix(part.column(1))))
                yield pa.RecordBatch.from_arrays([pa.array([j for _, j in pairs], pa.int32()), *(c.take(pa.array([i for i, _ in pairs], pa.int64())) for c in part.columns)], ["list", "vec_id", "v"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(i, j) for i, q in enumerate(_matrix(batch.column(1))) for j in held.value.probes(q)]
            yield pa.RecordBatch.from_arrays([pa.array([j for _, j in pairs], pa.int32()), *(c.take(pa.array([i for i, _ in pairs], pa.int64())) for c in batch.columns)], ["list", "query_id", "q"])

    posted = rows.mapInArrow(assign, "list int, vec_id long, v array<double>")
    one = F.count(F.lit(1))
    held_rows = posted.groupBy("list").agg(F.ceil(one / PART).cast("int").alias("parts"))
    held_rows = common.settle(held_rows)  # a row a list: MAX_LISTS at most

    def asked_of(questions: DataFrame) -> DataFrame:
        """(query_id, vec_id, score): the best k of every part of every list that (list, query_id, q) asks."""
        wanted = questions.groupBy("list").agg(F.ceil(one / ASKED).cast("int").alias("asked"))
        sizes = F.broadcast(common.settle(held_rows.join(wanted, "list")))
        dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = posted.join(sizes, "list").select("list", dealt("vec_id", "parts").alias("part"), every("asked").alias("ask"), "vec_id", "v")
        right = questions.join(sizes, "list").select("list", every("parts").alias("part"), dealt("query_id", "asked").alias("ask"), "query_id", "q")
        return left.groupBy("list", "part", "ask").cogroup(right.groupBy("list", "part", "ask")).applyInArrow(scan, "query_id long, vec_id long, score double")

    def scan(lists: pa.Table, wanted: pa.Table) -> pa.Table:
        ids, out = lists.column("vec_id").to_numpy() if lists.num_rows else np.zeros(0, np.int64), []
        if lists.num_rows and wanted.num_rows:
            x = _matrix(lists.column("v").combine_chunks())
            q = _matrix(wanted.column("q").combine_chunks())
            for query, one in zip(wanted.column("query_id").to_pylist(), q, strict=True):
                d = np.sqrt(((x - one) ** 2).sum(axis=1))
                d[ids == query] = np.inf
                if len(d) > k:
                    edge = np.partition(d, k - 1)[k - 1]
                    near = np.flatnonzero(d <= edge)
                else:
                    near = np.arange(len(d))
                near = near[np.lexsort((ids[near], d[near]))][:k]
                out += [(query, int(ids[i]), float(d[i])) for i in near if np.isfinite(d[i])]
        return pa.table({"query_id": pa.array([o[0] for o in out], pa.int64()), "vec_id": pa.array([o[1] for o in out], pa.int64()), "score": pa.array([o[2] for o in out], pa.float64())})

    best = lambda found: found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    found = common.settle(best(asked_of(queries.mapInArrow(probe, "list int, query_id long, q array<double>"))))
    full = found.groupBy("query_id").agg(one.alias("n")).filter(F.col("n") >= min(k, n - 1)).select("query_id")
    short = common.settle(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).join(full, "query_id", "left_anti"))
    if not short.isEmpty():
        lists = F.explode(F.sequence(F.lit(0), F.lit(len(index.c) - 1))).alias("list")
        rest = asked_of(short.select(lists, "query_id", "q"))
        found = found.join(short.select("query_id"), "query_id", "left_anti").unionByName(best(rest))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = valid(common.table(spark, sf_dir, "embeddings"))
    return search(rows, rows.filter("vec_id % 100 = 0"))
