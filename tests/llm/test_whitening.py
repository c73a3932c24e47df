"""Whitening against Python integers and fractions."""

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.llm import whitening


def _plain(rows, scale=64):
    """(n, S, V as fractions, x by id) of rows (id, list)."""
    xs = {}
    for i, v in rows:
        if v and all(c is not None and np.isfinite(c) for c in v):
            xs[i] = [int(np.floor(c * scale)) + whitening.OFFSET for c in v]
    fit = sorted(set(map(tuple, xs.values())))
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    cov = [[Fraction(n * sum(x[i] * x[j] for x in fit) - s[i] * s[j], n * n) for j in range(d)] for i in range(d)]
    return n, s, cov, xs


def _rows(seed=3, n=120, d=6, spread=1.0):
    rng = np.random.default_rng(seed)
    out = [(i, (rng.normal(size=d) * spread * np.linspace(0.2, 2, d)).astype(np.float32).tolist()) for i in range(n)]
    out += [(1000 + i, out[5][1]) for i in range(80)]  # a vector that many rows repeat
    return out + [(2000, None), (2001, []), (2002, [1.0] * (d - 1)), (2003, [float("nan")] * d), (2004, [1.0, None] + [0.0] * (d - 2)), (2005, [float("-inf")] + [0.0] * (d - 1)), (5, out[6][1])]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("n", "packed", "component", "d", "entry")})


@pytest.mark.parametrize("spread", [1.0, 3e4, 1e12])
def test_equals_fractions(spark, spread):
    rows = _rows(spread=spread)
    df = _frame(spark, rows).repartition(7)
    found = whitening.fit(df, components=4)
    whole = [(i, (None if v is not None and len(v) != 6 else v)) for i, v in enumerate(v for _, v in rows)]
    n, s, cov, xs = _plain(whole)
    assert found.n == n and [x + n * whitening.OFFSET for x in found.sums] == s
    values, unit = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    got = found.transform(df).collect()
    ids = sorted(rows[i][0] for i in xs)
    assert sorted(r.vec_id for r in got if r.component == 1) == ids and len(got) == 4 * len(ids)
    by_vector = {}
    for r in got:
        by_vector.setdefault((r.vec_id, int(r.deviation)), {})[r.component] = r
    signs = np.sign((unit[:, ::-1][:, :4] * found.components).sum(axis=0))
    for i, x in xs.items():
        res = [n * a - b for a, b in zip(x, s, strict=True)]
        dev = sum(a * a for a in res)
        rs = by_vector[rows[i][0], dev]
        for c in range(4):
            want = float(np.dot([float(Fraction(a, n)) for a in res], unit[:, -1 - c])) / np.sqrt(values[-1 - c]) * signs[c]
            assert rs[c + 1].whitened == pytest.approx(want, rel=1e-7, abs=1e-7)
            assert rs[c + 1].explained == pytest.approx(values[-1 - c] / float(sum(cov[j][j] for j in range(6))), rel=1e-9)
            assert rs[c + 1].identity_error < 1e-9 and rs[c + 1].n == n


def test_scatter_is_exact_at_any_size():
    rng = np.random.default_rng(1)
    for top in (1 << 10, 1 << 20, 1 << 40, 1 << 61):
        y = rng.integers(-top, top, (9000 if top < 1 << 21 else 50, 4))
        want = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True)) for j in range(4)] for i in range(4)]
        assert whitening.scatter(y).tolist() == want
        assert np.array_equal(np.vstack(list(whitening.unpack([whitening.pack(v) for v in y]))), y[np.argsort([whitening.pack(v)[0] for v in y], kind="stable")])


def test_limbs_add_up():
    y = np.array([[-(1 << 61), 3], [(1 << 61) - 5, -7], [0, 0]])
    out = list(whitening._sums(iter([pa.RecordBatch.from_arrays([pa.array([whitening.pack(v) for v in y], pa.binary())], ["packed"])]), 2))[0].to_pylist()
    flat = [0] * 6
    for r in out:
        flat[r["entry"]] += r["value"] << (32 * r["limb"])
    a, b = [int(v) for v in y[:, 0]], [int(v) for v in y[:, 1]]
    assert flat == [3, sum(a), sum(b), sum(x * x for x in a), sum(x * z for x, z in zip(a, b, strict=True)), sum(x * x for x in b)]


def test_degenerate(spark):
    assert whitening.fit(_frame(spark, [(1, None), (2, [])])) is None
    same = _frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert [(r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in whitening.fit(same).transform(same).collect()] == [(1, 0, None, None, None)] * 4
    line = _frame(spark, [(i, [i / 8, i / 4]) for i in range(9)])  # rank one of two
    got = whitening.fit(line).transform(line).collect()
    assert all(r.whitened is None and r.explained == 0 for r in got if r.component == 2) and all(r.identity_error < 1e-9 for r in got)


def test_query_over_a_table(spark):
    got = whitening.op13_whitening(spark, "/root/testdata/sf0.001")
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.count() == 500 * 16 and got.filter("whitened is null or deviation is null or identity_error > 1e-6").isEmpty()


def test_query_over_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert whitening.op13_whitening(spark, str(tmp_path)).count() == 0
