"""SpotSigs likeness against bags of chains counted one by one."""

import os
import random
import string
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from eraframe.llm import common, spotsigs

MASK = (1 << 64) - 1


def plain_mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def plain_bag(text):
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    words = [w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") or w for w in text.translate(lower).split(" ") if w]
    code = {w: int(common.Words(pa.array([w], pa.large_string())).hashes()[0]) for w in set(words)}
    anchors = set(spotsigs.ANCHORS)

    def value(chain, whole):
        v = code[chain[0]] + whole & MASK
        for k in range(spotsigs.CHAIN):
            v = plain_mix(v * 0x9E3779B97F4A7C15 + (code[chain[k + 1]] if k + 1 < len(chain) else 0) + k + 1 & MASK)
        return v

    spots = Counter()
    content = [i for i, w in enumerate(words) if w not in anchors]
    for i, w in enumerate(words):
        after = [words[j] for j in content if j > i][: spotsigs.CHAIN]
        if w in anchors and len(after) == spotsigs.CHAIN:
            spots[value([w, *after], 1)] += 1
    every = Counter(value(words[i : i + spotsigs.CHAIN + 1], 0) for i in range(len(words)))
    nth = lambda bag: [(plain_mix(v + k * 0xD6E8FEB86659FD93 & MASK), k) for v, n in bag.items() for k in range(n)]
    low = lambda x: x < (1 << 64) // spotsigs.SHARE
    chosen = {x for rank, (x, _) in enumerate(sorted(nth(every))) if rank < spotsigs.LEAST or low(x)}
    return chosen | {x for x, k in nth(spots) if not k or low(x)}, spots, every


def test_likeness_is_that_of_bags():
    rng = random.Random(4)
    words = ["the", "of", "and", "stone", "river", "Grün", "x.", "(light)", "des", "42", "wall,"]
    texts = [" ".join(rng.choices(words[: rng.randint(3, 11)], k=rng.randint(1, 90))) for _ in range(40)]
    texts += [texts[3] + " " + texts[3], "stone " * 200, "stone " * 150 + "river"]
    sets = spotsigs.spot_sets(pa.array(texts, pa.large_string()), spotsigs._anchor_keys())
    bags = [plain_bag(t) for t in texts]
    for i in range(len(texts)):
        assert set(sets[i].tolist()) == bags[i][0]
        for j in range(i):
            if all(b[2].total() <= spotsigs.LEAST and max(b[1].values(), default=1) == 1 for b in (bags[i], bags[j])):  # nothing is left out
                both = sum((bags[i][k] & bags[j][k]).total() for k in (1, 2))
                assert spotsigs.likeness(sets[i], sets[j]) == pytest.approx(both / sum((bags[i][k] | bags[j][k]).total() for k in (1, 2)))


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="needs the given tables")
def test_edited_texts_stay_alike():
    rows = sorted(pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist(), key=lambda r: r["doc_id"])
    texts = [r["text"] or "" for r in rows]
    changed = [spotsigs.edited(t, texts[(i + 1) % len(texts)]) for i, t in enumerate(texts)]
    anchors = spotsigs._anchor_keys()
    own, new = (spotsigs.spot_sets(pa.array(x, pa.large_string()), anchors) for x in (texts, changed))
    near = np.array([spotsigs.likeness(a, b) for a, b in zip(own, new, strict=True)])
    long = np.array([len(t.split()) > 100 for t in texts])
    assert long.sum() > 300 and near[long].min() >= 0.4
