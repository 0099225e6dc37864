import tracemalloc

import numpy as np

from lodestar.llm import sentencepiece_lattice

ODD = [0x7F, 0x80, 0x7FF, 0x800, 0xFFFF, 0x10000, 0x10FFFF, 0x2581]


def test_table_of_a_block_stays_in_arrays():
    """Characters without a piece become their bytes in their place; a block of a million ids needs no list of ids."""
    rng = np.random.default_rng(1)
    size = rng.integers(0, 7, 300_000)
    flat = rng.integers(300, 32_000, int(size.sum())).astype("<i4")
    at = rng.choice(len(flat), 4000, replace=False)
    flat[at] = -np.array(ODD, "<i4")[rng.integers(0, len(ODD), len(at))]
    number = rng.permutation(len(size))
    half, ids = len(size) // 2, int(size[: len(size) // 2].sum())
    parts = [number[:half], number[half:]], [size[:half], size[half:]], [flat[:ids], flat[ids:]]
    tracemalloc.start()
    start, length, out = sentencepiece_lattice._table(*parts, 259)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * len(flat)
    ends = np.cumsum(size)
    for k in [*range(2000), *np.searchsorted(ends, at[:500], "right").tolist()]:
        want = [j for i in flat[ends[k] - size[k] : ends[k]].tolist() for j in ([i] if i >= 0 else [259 + b for b in chr(-i).encode()])]
        a = start[number[k]]
        assert out[a : a + length[number[k]]].tolist() == want
    assert (out >= 0).all() and length.sum() == len(out) > len(flat)
