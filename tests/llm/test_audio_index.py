"""The fingerprint index meets every place of a key, however many there are."""

import numpy as np
import pytest

from hostlight.llm import audio

SIGNS = audio.SIGNS & 0xFFFFFFFF


def _places(codes):
    """Place, key and frames around, of each place that doesn't go on with the run before it."""
    s = [int(c) & SIGNS for c in codes]
    at = lambda i: s[i] if 0 <= i < len(s) else None
    last = None
    for i in range(len(s)):
        run = tuple(at(i + 4 * f) for f in range(9))
        if run != last:
            yield i, run[:3], [at(i + f) for f in audio.AROUND]
        last = run


@pytest.mark.parametrize("asked, bucket", [(300_000, 64), (0, 64), (0, 3)])
def test_frequent_keys_lose_no_hit(spark, monkeypatch, asked, bucket):
    rng = np.random.default_rng(5)
    words = rng.integers(0, 1 << 32, (3, 12), dtype=np.uint64)
    tunes = [np.concatenate([words[w] for w in rng.integers(0, 3, 4)])[rng.integers(0, 6) :] for _ in range(120)]
    tunes = [np.where(rng.random(len(t)) < 0.1, t ^ (np.uint64(1) << rng.integers(0, 32, len(t)).astype(np.uint64)), t).astype(np.uint32) for t in tunes]
    listed = [list(_places(t)) for t in tunes]
    sizes: dict = {}
    for one in listed:
        for _, key, _ in one:
            sizes[key] = sizes.get(key, 0) + 1
    assert max(sizes.values()) > 100
    want = []
    for q in range(0, 120, 4):
        for k in range(120):
            for i, key, a in listed[q] if q != k else []:
                for j, other, b in listed[k]:
                    pairs = [(x, y) for x, y in zip(a, b, strict=True) if x is not None and y is not None]
                    if key == other and sum((x ^ y).bit_count() for x, y in pairs) <= audio.AROUND_ERROR * 12 * len(pairs):
                        want.append((q, k, i - j))
    monkeypatch.setattr(audio, "ASKED", asked)
    monkeypatch.setattr(audio, "BUCKET", bucket)
    reps = spark.createDataFrame([(k, k % 4 == 0, [int(c) for c in t.view(np.int32)]) for k, t in enumerate(tunes)], "key long, asks boolean, codes array<int>")
    assert sorted(map(tuple, audio.hits(reps).collect())) == sorted(want) and len(want) > 1_000
