"""What the language model's work costs beside the work itself: temporary arrays, and memory taken and given back."""

import subprocess
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pytest
from newsloom.llm import elias_fano


def _peak(work) -> int:
    """Bytes that the work holds at most beyond what it starts with."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("width", [1, 13, 32, 63, 64])
@pytest.mark.parametrize("size", [0, 1, 63, elias_fano.PIECE - 1, elias_fano.PIECE, 3 * elias_fano.PIECE + 5])
def test_values_of_any_width_are_read_as_packed(width, size):
    values = np.random.default_rng(width).integers(0, (1 << width) - 1, size, dtype=np.uint64, endpoint=True)
    bits = elias_fano.Bits(values, width)
    assert np.array_equal(bits[np.arange(size)], values)
    # one whole number, lowest value first
    assert sum(int(v) << i * width for i, v in enumerate(values[:500])) == int.from_bytes(bits.words.tobytes(), "little") & (1 << min(size, 500) * width) - 1


def test_packing_takes_no_array_of_single_bits():
    values = np.random.default_rng(1).integers(0, 1 << 40, 1 << 17, dtype=np.uint64)
    assert _peak(lambda: elias_fano.Bits(values, 40)) < 4 * values.nbytes


def test_a_search_keeps_answers_only():
    """Of many questions at once, what a step makes for the next is a piece's."""
    rng = np.random.default_rng(2)
    sequence = elias_fano.EliasFano(np.sort(rng.integers(0, 1 << 40, 1 << 17)), 1 << 40)
    questions = np.sort(rng.integers(0, 1 << 40, 1 << 19)).astype(np.uint64)
    assert _peak(lambda: sequence.successor(questions)) < 2 * 9 * len(questions)


_REPEATED = """
import resource, sys
import numpy as np, pyarrow as pa
from newsloom.llm import language_model
rng = np.random.default_rng(3)
words = np.array([f"w{i}" for i in range(60000)])
texts = [" ".join(words[(rng.random(500) ** 3 * len(words)).astype(int)]) for _ in range(1000)]
table = pa.table({"doc_id": list(range(len(texts))), "text": texts})
def work():
    b = language_model._Block(table)
    b.trigrams(np.full(len(b.words), 7), np.arange(3, 3 + len(b.words), dtype=np.uint64))
work(), work()
before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
work(), work()
print((resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before) // 2)
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="the C library's own settings")
def test_a_workers_next_block_takes_the_memory_of_the_last():
    """A block's arrays of a few MB, each mapped and touched anew, took some ten thousand page faults a block."""
    told = subprocess.run([sys.executable, "-c", _REPEATED], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=120, check=True)
    assert int(told.stdout) < 2000
