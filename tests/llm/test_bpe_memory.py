"""What joining ids to a chunk's texts holds at a time."""

import tracemalloc

import numpy as np

from hilandera.llm import bpe


def test_ids_of_a_chunk_are_gathered_text_by_text():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 5, 1000)
    words = bpe.Lists(np.arange(sizes.sum(), dtype="<u4"), sizes)
    places, n = rng.integers(0, 1000, 3_000_000).astype(np.uint32), np.array([0, 700_000, *[999] * 2302, 302, 0])
    assert n.sum() == len(places)
    tracemalloc.start()
    got, ends = [], np.cumsum(n)
    for start, stop, (ids,) in bpe._texts(words, places, n, "", False):
        for k in range(start, stop, 211):
            got.append((k, ids[k - start].as_py()))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for k, ids in got:
        each = [words.flat[words.first[p] : words.first[p] + words.sizes[p]] for p in places[ends[k] - n[k] : ends[k]][:5000]]
        assert ids[: 4 * sum(map(len, each))] == np.concatenate([np.empty(0, "<u4"), *each]).tobytes()
    # the longest text has 700,000 words; all at once would take four times as much
    assert most < 60e6


def test_numbers_of_words_stay_narrow():
    ranks = np.array([0, 223, 224, 70_000, 1 << 22, 223 + (31 << 16), 224 + (31 << 16)] * 9, np.uint32)
    again = bpe._ranks(bpe._squeezed_ranks(ranks))
    assert again.tolist() == ranks.tolist() and again.itemsize == 4
