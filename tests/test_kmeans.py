import numpy as np
import pytest

from tessella.operators.cluster import FrequencyRankedKMeans


def table(spark, x):
    return spark.createDataFrame([(i, None if v is None else list(map(float, v))) for i, v in enumerate(x)], "row_idx long, vec array<double>").repartition(3)


def test_planted_groups(spark):
    rng = np.random.default_rng(3)
    at, size = np.array([[9, 0, 0], [0, 9, 0], [0, 0, 9], [9, 9, 9]]), [40, 20, 80, 10]
    x = np.vstack([a + rng.normal(0, 0.3, (n, 3)) for a, n in zip(at, size)])
    model = FrequencyRankedKMeans(k=4, normalise=False)
    rows = table(spark, [*x, None])
    got = {r.row_idx: r.label for r in model.fit(rows).transform(rows).collect()}
    truth = np.repeat([1, 2, 0, 3], size)  # by falling frequency
    assert [got[i] for i in range(150)] == truth.tolist() and got[150] is None
    centres = np.array(model.centroids)
    for k in range(4):
        assert np.allclose(centres[k], x[truth == k].mean(axis=0))


def test_labels_are_the_nearest_centres(spark):
    x = np.random.default_rng(1).normal(0, 1, (200, 5))
    model = FrequencyRankedKMeans(k=6)
    got = {r.row_idx: r.label for r in model.fit(table(spark, x)).transform(table(spark, x)).collect()}
    unit, centres = x / np.linalg.norm(x, axis=1, keepdims=True), np.array(model.centroids)
    near = ((unit[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert [got[i] for i in range(200)] == near.tolist()
    counts = np.bincount(near, minlength=6)
    assert (np.diff(counts) <= 0).all()
    # no worse than Lloyd's steps from random starts
    cost = ((unit - centres[near]) ** 2).sum()
    c = unit[np.random.default_rng(0).choice(200, 6, replace=False)]
    for _ in range(30):
        n = ((unit[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([unit[n == k].mean(axis=0) if (n == k).any() else c[k] for k in range(6)])
    assert cost < 1.1 * ((unit[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).sum()


def test_edges(spark):
    same = table(spark, [[1.0, 2.0]] * 5)
    assert {r.label for r in FrequencyRankedKMeans(k=3).fit(same).transform(same).collect()} == {0}
    for bad in (table(spark, [None]), table(spark, [[1.0], [1.0, 2.0]]), same.limit(0)):
        with pytest.raises(ValueError):
            FrequencyRankedKMeans(k=2).fit(bad)
    with pytest.raises(RuntimeError):
        FrequencyRankedKMeans().transform(same)
