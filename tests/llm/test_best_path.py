"""Paths that leave the best single language altogether."""

from __future__ import annotations

from itertools import product

import numpy as np

from sparsemill.llm import language


def test_two_runs_for_one_switch():
    assert language.viterbi(np.array([[0.0, 9, -15, -20], [0, -15, 9, -20]]), 12.0).tolist() == [1, 2]


def test_best_path_near_the_penalty():
    rng = np.random.default_rng(1)
    weigh = lambda s, q, p: sum(s[k][x] for k, x in enumerate(q)) - p * sum(a != b for a, b in zip(q, q[1:], strict=False))
    for _ in range(500):
        s = rng.integers(-15, 10, (int(rng.integers(2, 5)), 4)).astype(float)
        s[:, 0] = 0
        assert weigh(s, language.viterbi(s, 12.0).tolist(), 12.0) == max(weigh(s, q, 12.0) for q in product(range(4), repeat=len(s)))
