"""Whitening of embeddings by an exact integer scatter.

Entries are quantised, c to x = floor(`SCALE` * c) + `OFFSET`, and the fit list holds each distinct x vector once. Every
task subtracts the shift (the quantiser's offset) and multiplies blocks of rows so small that the products' sums are
whole numbers that a double holds exactly; entries of 2^20 and more go in limbs of 20 bits. The blocks are added up as
Python integers, of any size, and leave a task as limbs of 32 bits, which Spark adds up as longs. The driver gets the
sums of one table, a fixed number by dimension: n, S and XᵀX. It forms n·XᵀX - S·Sᵀ exactly, and only then converts to
doubles and decomposes. The shift cancels out there, so its choice can't change a result.

Defined cases: rows whose vector is null, empty, or holds a null or non-finite entry drop out, and so do those with an
entry beyond ±2^62 when scaled, and vectors of another length than most distinct ones have (ties: the shorter). Rows that
repeat an id or a vector come back each; null ids are ids like others. Components without variance (a rank below the
dimension, one distinct vector) have null for `whitened` and take no part in `identity_error`; without any variance
`explained` and `identity_error` are null. An empty table gives none. Other columns of the input aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Entries below 2^LIMB are multiplied as they are, PIECE rows at a time at most; longs leave a task in limbs of WORD bits.
LIMB, WORD, PIECE = 20, 32, 4096
_WIDTHS = ((1, np.int8), (2, np.int16), (4, np.int32), (8, np.int64))


def _quantised(column, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their x - OFFSET as longs) of an Arrow list column, by vector length; rows that drop out aren't there."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    length = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values, starts = column.values.to_numpy(zero_copy_only=False).astype(float), column.offsets.to_numpy()[:-1]
    for d in np.unique(length[length > 0]).tolist():
        at = np.flatnonzero(length == d)
        for a in range(0, len(at), PIECE):
            rows = at[a : a + PIECE]
            with np.errstate(over="ignore", invalid="ignore"):
                y = np.floor(values[starts[rows][:, None] + np.arange(d)] * scale)
                fine = (np.abs(y) < 2.0**62).all(axis=1)  # not so for NaN, which nulls are here
            yield rows[fine], y[fine].astype(np.int64)


def pack(y: np.ndarray) -> bytes:
    """A vector of longs in as few bytes an entry as hold them, after a byte that says how many: equal vectors, equal bytes."""
    top = max(int(y.max()), -int(y.min()) - 1)
    width, kind = next((w, k) for w, k in _WIDTHS if top < 1 << (8 * w - 1))
    return bytes([width]) + y.astype(kind).tobytes()


def unpack(packed: list[bytes]) -> Iterator[np.ndarray]:
    """Matrices of longs, PIECE rows at most, of packed vectors of one length."""
    for width, kind in _WIDTHS:
        rows = [p for p in packed if p[0] == width]
        for a in range(0, len(rows), PIECE):
            block = rows[a : a + PIECE]
            yield np.frombuffer(b"".join(p[1:] for p in block), kind).reshape(len(block), -1).astype(np.int64)


def scatter(y: np.ndarray) -> np.ndarray:
    """yᵀy as Python integers, exactly: limbs below 2^20 and at most 2^13 rows keep every sum within a double's 53 bits."""
    d, limbs, rest = y.shape[1], [], y
    while (np.abs(rest) >= 1 << LIMB).any():
        limbs.append((rest & ((1 << LIMB) - 1)).astype(float))
        rest = rest >> LIMB
    limbs.append(rest.astype(float))
    out = np.zeros((d, d), object)
    for a in range(0, len(y), 1 << 13):
        for i, p in enumerate(limbs):
            for j, q in enumerate(limbs):
                out += (p[a : a + (1 << 13)].T @ q[a : a + (1 << 13)]).astype(np.int64).astype(object) << LIMB * (i + j)
    return out


def _sums(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    """(entry, limb, value) of a task's rows, entry by entry of the upper triangle of zᵀz, where z is 1 and then the vector:
    n, S and XᵀX. An entry is the sum of its values times 2^(32 limb), in any number of tasks."""
    total = np.zeros((d + 1, d + 1), object)
    for batch in batches:
        for y in unpack(batch.column(0).to_pylist()):
            total += scatter(np.hstack([np.ones((len(y), 1), np.int64), y]))
    entry, limb, value = [], [], []
    for e, v in enumerate(total[np.triu_indices(d + 1)].tolist()):
        sign, left, k = (-1 if v < 0 else 1), abs(v), 0
        while left:
            entry.append(e)
            limb.append(k)
            value.append(sign * (left & ((1 << WORD) - 1)))
            left, k = left >> WORD, k + 1
    yield pa.RecordBatch.from_arrays([pa.array(entry, pa.int32()), pa.array(limb, pa.int32()), pa.array(value, pa.int64())], ["entry", "limb", "value"])


@dataclass
class Whitener:
    """What the fit found: n distinct vectors, their sums S of x - OFFSET, eigenvalues by falling size, unit eigenvectors as
    columns, the trace, the largest deviation of whitened's covariance from the identity."""

    dimension: int
    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float | None
    scale: int = SCALE

    def residuals(self, y: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: longs where those hold it, else Python integers."""
        if self.n * int(np.abs(y).max(initial=0)) + max(map(abs, self.sums)) < 1 << 62:
            return self.n * y - np.array(self.sums, np.int64)
        return self.n * y.astype(object) - np.array(self.sums, object)

    def whitened(self, residuals: np.ndarray) -> np.ndarray:
        """Projections over the roots of the eigenvalues; NaN where there is no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, (residuals / self.n).astype(float) @ self.components / np.sqrt(self.values), np.nan)

    def transform(self, vectors: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """A row for each remaining vector and component: (id, component, n, deviation: decimal, null beyond 38 digits,
        whitened, explained, identity_error)."""
        k, explained = len(self.values), [v / self.trace if self.trace else None for v in np.maximum(self.values, 0).tolist()]

        def run(batches):
            for batch in batches:
                for rows, y in _quantised(batch.column(1), self.scale):
                    if y.shape[1] != self.dimension or not len(y):
                        continue
                    r = self.residuals(y)
                    if r.dtype == np.int64 and int(np.abs(r).max()) ** 2 * self.dimension < 1 << 63:
                        deviation = pa.array((r * r).sum(axis=1)).cast(pa.decimal128(38, 0))
                    else:
                        exact = [int(x) for x in (r.astype(object) ** 2).sum(axis=1)]
                        deviation = pa.array([Decimal(x) if x < 10**38 else None for x in exact], pa.decimal128(38, 0))
                    w, each = self.whitened(r).ravel(), pa.array(np.repeat(np.arange(len(rows)), k))
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array(rows)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), deviation.take(each),
                        pa.array(w, mask=np.isnan(w)), pa.array(explained * len(rows), pa.float64()),
                    ], [id_col, "component", "deviation", "whitened", "explained"])

        kind = vectors.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
        schema = f"`{id_col}` {kind}, component int, deviation decimal(38,0), whitened double, explained double"
        out = vectors.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{vector}`")).mapInArrow(run, schema)
        return out.withColumns({"n": F.lit(self.n).cast("long"), "identity_error": F.lit(self.identity_error).cast("double")})


def fit(vectors: DataFrame, *, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> Whitener | None:
    """The whitener of a table's distinct quantised vectors; None without any."""

    def packed(batches):
        for batch in batches:
            for _, y in _quantised(batch.column(0), scale):
                yield pa.RecordBatch.from_arrays([pa.array([y.shape[1]] * len(y), pa.int32()), pa.array([pack(v) for v in y], pa.binary())], ["d", "packed"])

    # equal vectors combine before they shuffle, so a vector that many rows repeat is a row a task
    rows = common.settle(vectors.select(F.col(f"`{vector}`")).mapInArrow(packed, "d int, packed binary").distinct())
    most = rows.groupBy("d").count().orderBy(F.desc("count"), "d").first()
    if most is None:
        return None
    d, listed = most["d"], rows.filter(F.col("d") == most["d"]).select("packed")
    sums = listed.mapInArrow(lambda batches: _sums(batches, d), "entry int, limb int, value long").groupBy("entry", "limb").agg(F.sum("value").alias("value")).collect()
    flat = [0] * ((d + 1) * (d + 2) // 2)
    for r in sums:
        flat[r["entry"]] += r["value"] << (WORD * r["limb"])
    total = np.zeros((d + 1, d + 1), object)
    total[np.triu_indices(d + 1)] = flat
    n, s = total[0, 0], total[0, 1:].tolist()
    exact = [[n * (total[i + 1, j + 1] if i <= j else total[j + 1, i + 1]) - s[i] * s[j] for j in range(d)] for i in range(d)]
    values, unit = np.linalg.eigh(np.array([[v / (n * n) for v in row] for row in exact]))
    k = min(components, d)
    values, unit = values[::-1][:k].copy(), unit[:, ::-1][:, :k].copy()
    values[values <= d * np.finfo(float).eps * values[0]] = 0
    unit *= np.where(unit[np.abs(unit).argmax(axis=0), np.arange(k)] < 0, -1, 1)
    found = Whitener(d, n, s, values, unit, sum(exact[i][i] for i in range(d)) / (n * n), None, scale)
    found.identity_error = _identity_error(listed, found)
    return found


def _identity_error(listed: DataFrame, found: Whitener) -> float | None:
    """How far the covariance of the fit list's whitened vectors, measured, is from the identity."""
    k = int((found.values > 0).sum())
    if not k:
        return None

    def run(batches):
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            for y in unpack(batch.column(0).to_pylist()):
                if len(y):
                    w = np.hstack([np.ones((len(y), 1)), found.whitened(found.residuals(y))[:, :k]])
                    total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange((k + 1) ** 2)), pa.array(total.ravel())], ["entry", "value"])

    total = np.zeros((k + 1) ** 2)
    for r in listed.mapInArrow(run, "entry long, value double").groupBy("entry").agg(F.sum("value").alias("value")).collect():
        total[r["entry"]] = r["value"]
    total = total.reshape(k + 1, k + 1) / found.n
    return float(np.abs(total[1:, 1:] - np.outer(total[0, 1:], total[0, 1:]) - np.eye(k)).max())


_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`deviation` is null where a long can't hold it."""
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = fit(vectors)
    if found is None:
        return spark.createDataFrame([], _SCHEMA)
    out = found.transform(vectors)
    return out.select("vec_id", "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error")
