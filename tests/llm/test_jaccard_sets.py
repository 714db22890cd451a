"""Sets of the pipeline's setting and size, keys that collide, and signatures of unrelated sets."""

import random
from collections import Counter

import numpy as np
import pytest
from test_texts import brute_groups, noisy

from quarry.llm import jaccard


def test_two_thousand_long_texts(spark):
    """1,000 to 5,000 words at 80 %: links around the limit, chains, and unrelated texts."""
    rng = random.Random(5)
    texts = []
    for i in range(2_000):
        if i % 3 == 0:
            texts.append([f"w{rng.randrange(4_000)}" for _ in range(rng.randrange(1_000, 5_000))])
        else:
            w = list(rng.choice(texts[-300:]))
            for _ in range(rng.randrange(len(w) // 20)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            texts.append(w)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    got = {r["doc_id"]: tuple(r)[1:] for r in jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), 5, 80, 100).collect()}
    want = brute_groups(rows, 5, 80, 100)
    assert got == want
    assert 100 < sum(i != c for i, (_, c) in want.items())


@pytest.mark.parametrize("bits", [1, 5])
def test_colliding_keys(spark, bits):
    rows = noisy(150)
    got = {r["doc_id"]: tuple(r)[1:] for r in jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80, 100, key_bits=bits).collect()}
    assert got == brute_groups(rows, 3, 80, 100)


@pytest.mark.parametrize("num,size", [(80, 12), (80, 60), (80, 1_000), (90, 40), (90, 1_000)])
def test_unrelated_sets_share_no_signature(num, size):
    rng, bands = np.random.default_rng(size), jaccard.Bands(num, 100)
    found = Counter(x for _ in range(400) for x in set(jaccard.signatures(np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64)), bands).tolist()))
    assert max(found.values()) == 1


@pytest.mark.parametrize("num", [70, 80, 90])
def test_similar_sets_share_a_signature(num):
    """Also where so many signatures are empty that a set keeps these."""
    rng, bands = random.Random(num), jaccard.Bands(num, 100)
    tried = 0
    for _ in range(3_000):
        size = rng.choice([rng.randrange(4, 30), rng.randrange(30, 300)])
        a = {rng.getrandbits(64) if rng.random() < 0.5 else rng.getrandbits(20) * 2**20 * 3 for _ in range(size)}
        gone = rng.randrange(size // 4 + 1)
        b = set(rng.sample(sorted(a), max(1, len(a) - gone))) | {rng.getrandbits(64) for _ in range(rng.randrange(size // 4 + 1))}
        if 100 * len(a & b) >= num * len(a | b) and a != b:
            tried += 1
            x, y = (np.sort(np.array(list(s), np.uint64)) for s in (a, b))
            assert set(jaccard.signatures(x, bands).tolist()) & set(jaccard.signatures(y, bands).tolist())
            assert jaccard.may_link(len(x), jaccard.sketch(x), len(y), jaccard.sketch(y), num, 100)
    assert tried > 100


def test_sketches_of_unrelated_large_sets():
    rng = np.random.default_rng(1)
    for size in (1_000, 3_000, 20_000):
        a, b = (np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (size, size + size // 10))
        assert not jaccard.may_link(len(a), jaccard.sketch(a), len(b), jaccard.sketch(b), 80, 100)
