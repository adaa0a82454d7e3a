"""The lasso of the quality rules meets its optimum conditions."""

import numpy as np
import pytest

from tierflow.llm import quality


@pytest.mark.parametrize("penalty", [3e-4, 3e-3, 3e-2])
def test_subgradient_is_zero(penalty):
    rng = np.random.default_rng(4)
    x = (rng.random((600, 25)) < rng.random(25)).astype(float)
    x[:, 3], x[:, 4] = x[:, 2], 1.0  # a repeated column and a constant one
    y = (rng.random(600) < 1 / (1 + np.exp(-(2 * x[:, 0] - 3 * x[:, 1] + x[:, 2])))).astype(float)
    b, w = quality.lasso(x, y, penalty)
    spread = x.std(0)
    p = 1 / (1 + np.exp(-(b + x @ w)))
    slope = x.T @ (p - y) / len(y)
    assert abs((p - y).mean()) < 1e-3 and w[4] == 0
    for j in np.flatnonzero(spread):
        g = slope[j] / spread[j]
        assert abs(g + penalty * np.sign(w[j])) < 1e-3 if w[j] else abs(g) <= penalty + 1e-3
    assert not quality.lasso(x, y, 10.0)[1].any()


def test_a_fold_of_one_kind_still_fits():
    x = np.array([[0.0], [0.0], [1.0], [1.0]])
    b, w = quality.best_lasso(x, np.array([0.0, 0.0, 1.0, 1.0]), np.array([True, True, False, False]), (1e-3, 1e-2))
    assert b + w[0] > 0 > b
