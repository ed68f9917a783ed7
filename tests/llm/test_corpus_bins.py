"""Numbers of bins against best-fit-decreasing, piece by piece."""

import bisect
import os
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from eraframe.llm import packing
from eraframe.llm.tokens import encoder


def best_fit_decreasing(lengths, size):
    gaps, bins = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, x)
        if i == len(gaps):
            bins += 1
            gap = size - x
        else:
            gap = gaps.pop(i) - x
        bisect.insort(gaps, gap)
    return bins


def planned(lengths, size):
    counts = np.bincount(lengths, minlength=size + 1)
    bins = packing.fewest_bins(counts, size)
    used = np.zeros(size + 1, np.int64)
    for times, need in bins:
        assert sum(x * k for x, k in need.items()) <= size
        for x, k in need.items():
            used[x] += times * k
    assert (used == counts).all()
    return sum(times for times, _ in bins)


@pytest.mark.parametrize("seed", range(12))
def test_not_more_bins_than_best_fit_decreasing(seed):
    rng = random.Random(seed)
    size = rng.choice([100, 2048])
    top = rng.choice([size // 7, size // 3, size // 2, size])
    lengths = [min(size, max(1, int(rng.choice([rng.uniform(1, top), rng.gauss(top / 2, top / 9), rng.expovariate(8 / top)])))) for _ in range(rng.choice([30, 400, 3000]))]
    assert planned(lengths, size) <= best_fit_decreasing(lengths, size)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_given_tables(sf):
    path = f"/root/testdata/{sf}/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("needs the given tables")
    texts = [t or "" for t in pq.read_table(path, columns=["text"])["text"].to_pylist()]
    lengths = [n for ids in encoder(packing.byte_bpe()).encode(texts) for _, n in packing.cut(len(ids) // 4 + 1, 2048)]
    assert planned(lengths, 2048) <= best_fit_decreasing(lengths, 2048)
