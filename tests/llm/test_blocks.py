"""Keys of several columns in order."""

import numpy as np
import pytest
from newsloom.llm import blocks


def _columns(n: int, bits: tuple[int, ...]) -> list[np.ndarray]:
    rng = np.random.default_rng(5)
    return [rng.integers(0, 1 << b, n, dtype=np.uint64, endpoint=b < 64) if b < 64 else rng.integers(0, 2**64 - 1, n, dtype=np.uint64, endpoint=True) for b in bits]


@pytest.mark.parametrize("bits", [(21, 21, 3, 21), (40, 30), (2, 63), (64, 20), (3, 62, 50), (0, 64), (64, 64, 64)])
@pytest.mark.parametrize("n", [0, 1, 5000])
def test_columns_beyond_64_bits_are_ordered_as_a_stable_sort_has_them(bits, n):
    keys = _columns(n, bits)
    keys = [np.concatenate([k, k[: n // 2]]) for k in keys]  # with repeats
    narrow = blocks.narrowed(keys)
    order = blocks.in_order(narrow)
    assert sorted(order.tolist()) == list(range(len(keys[0])))
    for k in keys:
        assert np.array_equal(k[order], k[np.lexsort(keys[::-1])])


def test_trigrams_of_large_vocabularies_take_no_stable_sort(monkeypatch):
    """Three ids of 21 bits and a part of 3 don't fit in one integer, but their ranks do."""
    narrow = blocks.narrowed(_columns(5000, (21, 21, 3, 21)))
    assert len(narrow) == 2
    monkeypatch.setattr(np, "lexsort", lambda *a: pytest.fail("a stable sort"))
    blocks.in_order(narrow)


@pytest.mark.parametrize("gb", [1, 3, 6, 7, 12, 60, 600])
def test_rows_and_groups_stay_few_at_any_size(gb):
    """A row or a group takes a fixed time whatever it holds: a second level's pairs are about as many as blocks, and hold a block's or a shard's keys."""
    p = blocks.plan(gb * 10**9, gb * 10**9 // 6, shard_keys=2 * blocks.SHARD_KEYS)
    if p.direct:
        assert p.blocks * p.shards <= blocks.ROWS
        return
    groups = -(-p.blocks // p.per_group)
    assert groups * p.lanes <= 1.1 * p.blocks
    assert p.blocks * p.lanes + groups * p.shards <= 2 * p.blocks**1.5 + blocks.ROWS
    assert p.per_group <= 1.3 * p.lanes and p.per_lane <= 1.3 * groups


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_packed_keys_come_back(n):
    keys = np.unique(_columns(n, (64,))[0])
    before = keys.copy()
    assert np.array_equal(blocks.unpack(blocks.pack(keys), len(keys)), before) and np.array_equal(keys, before)
