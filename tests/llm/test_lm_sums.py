"""Expected and observed counts of the language model, in pieces of any size."""

import numpy as np

from hostlight.llm import lm_score


def test_sums_in_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    model = lm_score.Maxent(rng.integers(0, 50, lm_score.LEAVES))
    model.weights = rng.normal(0, 0.3, model.weights.shape).astype(np.float32)
    p1, p2 = rng.integers(0, 40, (2, 500)).astype(np.uint64)
    leaf, n = rng.integers(0, lm_score.LEAVES, 500), rng.integers(1, 9, 500)
    want = np.zeros((2, *model.weights.shape))
    for rows, logs, branch in model.levels(model.features(p1, p2), leaf):
        for j in range(3):
            np.add.at(want[0], (rows[:, j], branch), n)
            np.add.at(want[1], rows[:, j], np.exp(logs) * n[:, None])
    for size in (7, 500):
        monkeypatch.setattr(lm_score, "AT_ONCE", size)
        got = np.zeros((2, *model.weights.shape), np.float32)
        model.add(p1, p2, leaf, n, *got)
        assert np.allclose(got, want, atol=1e-3)
