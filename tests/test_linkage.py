import time

import numpy as np
import pytest

from tessella.operators import cluster


def plain(distance, method):
    """Merges by a search of the whole matrix each time; ties to the lowest pair of rows."""
    d, n = distance.astype(float).copy(), len(distance)
    np.fill_diagonal(d, np.inf)
    names, sizes, out = list(range(n)), [1] * n, []
    for step in range(n - 1):
        i, j = sorted(divmod(int(np.argmin(d)), n))
        out.append((*sorted((names[i], names[j])), d[i, j], sizes[i] + sizes[j]))
        row = {"average": (sizes[i] * d[i] + sizes[j] * d[j]) / (sizes[i] + sizes[j]), "single": np.minimum(d[i], d[j]), "complete": np.maximum(d[i], d[j])}[method]
        d[i], d[:, i] = row, row
        d[j], d[:, j], d[i, i] = np.inf, np.inf, np.inf
        names[i], sizes[i] = n + step, sizes[i] + sizes[j]
    return np.array(out).reshape(-1, 4)


@pytest.mark.parametrize("method", ["average", "single", "complete"])
@pytest.mark.parametrize("levels", [3, 10_000])
def test_equal_to_a_plain_search(method, levels):
    rng = np.random.default_rng(levels)
    for n in (1, 2, 3, 17, 60):
        x = rng.integers(1, levels, (n, n)).astype(float)
        d = np.triu(x, 1) + np.triu(x, 1).T
        assert np.allclose(cluster.linkage(d, method), plain(d, method))


def test_many_features():
    x = np.random.default_rng(1).normal(0, 1, (1500, 8))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    began = time.perf_counter()
    assert len(cluster.linkage(d)) == 1499 and time.perf_counter() - began < 10
