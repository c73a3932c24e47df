"""Bounded samples and narrowed sort keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import blocks, neighbours


@pytest.mark.parametrize("parts", [2, 200])
def test_a_sample_is_cut_before_it_is_ordered(spark, monkeypatch, parts):
    monkeypatch.setattr(neighbours, "SAMPLE", 500)
    rows = spark.range(20_000).withColumnRenamed("id", "vec_id").repartition(parts)
    smallest = {r.vec_id for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(500).collect()}
    cut = {r.vec_id for r in neighbours._sampled(rows, 20_000).collect()}
    assert smallest <= cut and len(cut) < 750  # whatever the number of partitions
    assert neighbours._sampled(rows.limit(400), 400).count() == 400


@pytest.mark.parametrize("widths", [(8, 8, 1, 8), (40, 20, 3, 30), (64, 64), (63, 1, 64, 1), (1, 1, 1, 1), (64, 0, 5)])
def test_narrowed_keys_sort_alike(widths):
    rng = np.random.default_rng(sum(widths))
    keys = [rng.integers(0, 1 << w, 2000, dtype=np.uint64, endpoint=False) if w < 64 else rng.integers(0, 2**64 - 1, 2000, dtype=np.uint64) for w in widths]
    keys = [np.concatenate([k, k[:500]]) for k in keys]
    keys[0][:50] &= np.uint64(1)
    order, want = blocks.in_order(blocks.narrowed(keys)), np.lexsort(keys[::-1])
    assert all(np.array_equal(k[order], k[want]) for k in keys)
    assert len(blocks.narrowed([k[:0] for k in keys])) == 1
    distinct, sums, place, _ = blocks._merged(keys, [np.ones(2500, np.uint8)], False)
    rows = np.unique(np.stack(keys, 1), axis=0, return_counts=True)
    assert np.array_equal(np.stack(distinct, 1), rows[0]) and np.array_equal(sums[0], rows[1]) and all(np.array_equal(d[place], k) for d, k in zip(distinct, keys, strict=True))
