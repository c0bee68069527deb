import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import filters, raster


def frame(spark, a, **more):
    rows = [(int(y), int(x), float(a[y, x])) for y, x in np.argwhere(~np.isnan(a))]
    return spark.createDataFrame(rows, "y long, x long, v double").repartition(3)


def array(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.y, r.x] = r.v
    return out


def brute(a, runs, function):
    out = np.full(a.shape, np.nan)
    for y, x in np.argwhere(~np.isnan(a)):
        seen = [a[y + dy, x + dx] for dy, low, high in runs for dx in range(low, high + 1) if 0 <= y + dy < a.shape[0] and 0 <= x + dx < a.shape[1] and not np.isnan(a[y + dy, x + dx])]
        out[y, x] = function(np.array(seen))
    return out


def entropy_of(values):
    p = np.unique(values, return_counts=True)[1] / len(values)
    return float(-(p * np.log2(p)).sum())


@pytest.mark.parametrize("runs", [filters.square(3), filters.square(4), filters.disk(2), filters.square(13)], ids=str)
def test_filters_against_brute_force(spark, runs):
    rng = np.random.default_rng(len(runs))
    a = rng.integers(0, 9, (40, 75)).astype(float)
    a[rng.random(a.shape) < 0.2] = np.nan
    px = frame(spark, a)
    for got, function in ((filters.dilated(px, runs), np.max), (filters.eroded(px, runs), np.min), (filters.median(px, runs), np.median), (filters.quantile(px, runs, 0.3), lambda v: np.quantile(v, 0.3)), (filters.entropy(px, runs), entropy_of)):
        assert np.allclose(array(got, a.shape), brute(a, runs, function), equal_nan=True)


def otsu_of(v, bins=256):
    h = np.bincount(v.astype(int).ravel(), minlength=bins)
    best, at = -1, 0
    for t in range(bins):
        n0, n1 = h[: t + 1].sum(), h[t + 1 :].sum()
        if n0 and n1:
            m0, m1 = (h[: t + 1] * np.arange(t + 1)).sum() / n0, (h[t + 1 :] * np.arange(t + 1, bins)).sum() / n1
            if n0 * n1 * (m0 - m1) ** 2 > best + 1e-6:
                best, at = n0 * n1 * (m0 - m1) ** 2, t
    return at


def filled(mask):
    out = np.pad(mask.astype(bool), 1)
    outside, queue = np.zeros(out.shape, bool), [(0, 0)]
    while queue:
        y, x = queue.pop()
        if 0 <= y < out.shape[0] and 0 <= x < out.shape[1] and not outside[y, x] and not out[y, x]:
            outside[y, x] = True
            queue += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    return ~outside[1:-1, 1:-1]


def test_tissue_mask(spark):
    rng = np.random.default_rng(2)
    image = np.full((44, 52, 3), 240) + rng.integers(0, 4, (44, 52, 3))
    image[8:34, 10:40] = rng.integers(40, 220, (26, 30, 3))
    image[18:22, 20:24] = 240
    pixels = spark.createDataFrame([(y, x, c, int(image[y, x, c])) for y in range(44) for x in range(52) for c in range(3)], "y long, x long, c long, v long")
    got = array(filters.tissue_mask(pixels, entropy_size=2, median_size=5, closing=1, dilation=1), (44, 52))
    top, low = image.max(axis=2), image.min(axis=2)
    grey = np.rint((top - low) * 255.0 / top)
    e = brute(grey, filters.disk(2), entropy_of)
    e = np.floor((e - e.min()) / (e.max() - e.min()) * 255)
    m = np.floor(brute(e, filters.square(5), np.median))
    mask = filled(m > otsu_of(m)).astype(float)
    mask = brute(brute(mask, filters.disk(1), np.max), filters.disk(1), np.min)
    assert np.array_equal(got, brute(mask, filters.disk(1), np.max)) and 0 < got.mean() < 1
    by_quantile = array(filters.tissue_mask(pixels, entropy_size=3, percentile=0.2, kernel="square", remove_light=0.5), (44, 52))
    lower = lambda share: brute(grey, filters.square(3), lambda v: np.sort(v)[math.floor((len(v) - 1) * share)])
    want = filled(lower(0.2) > otsu_of(lower(0.2))) & (lower(0.5) > otsu_of(lower(0.5)))
    assert np.array_equal(by_quantile, want.astype(float))


def test_fluorescence_mask(spark):
    rng = np.random.default_rng(6)
    a = rng.integers(0, 3, (40, 50)).astype(float)
    a[10:30, 12:36] = rng.integers(200, 4000, (20, 24))
    got = array(filters.fluorescence_mask(frame(spark, a), dilation=4, least=30), a.shape)
    logged = np.log1p(a)
    grey = np.rint(np.maximum((logged - logged.mean()) / np.ptp(logged), 0) * 255)
    e = brute(grey, filters.square(5), entropy_of)
    bins = np.minimum(np.floor((e - e.min()) / np.ptp(e) * 256), 255)
    mask = (e > e.min() + (otsu_of(bins) + 0.5) / 256 * np.ptp(e)).astype(float)
    assert np.array_equal(got, brute(mask, filters.square(4), np.max)) and got[20, 20] == 1 and got[0, -1] == 0
    base = filters.resized_mask(filters.fluorescence_mask(frame(spark, a), dilation=4, least=30), spark, (40, 50), (80, 100))
    assert np.array_equal(array(base, (80, 100)), got.repeat(2, 0).repeat(2, 1))


@pytest.mark.parametrize("n", [1, 5, 60])
def test_nearest_seed_against_brute_force(spark, n):
    rng = np.random.default_rng(n)
    seeds = [(int(x), int(y), int(k)) for x, y, k in zip(rng.integers(-40, 300, n), rng.integers(-20, 90, n), rng.integers(0, 4, n))]
    px = raster.canvas(spark, 45, 70)
    got = {(r.y, r.x): (r.d2, r.nearest) for r in raster.nearest_seed(px, spark.createDataFrame(seeds, "x long, y long, label long"), tile=8).collect()}
    assert len(got) == 45 * 70
    for (y, x), found in got.items():
        assert found == min(((sx - x) ** 2 + (sy - y) ** 2, k) for sx, sy, k in seeds)


def test_nearest_seed_plan(spark):
    seeds = spark.createDataFrame([(1, 2, 3)], "x long, y long, label long")
    plan = raster.nearest_seed(raster.canvas(spark, 5, 5), seeds)
    assert "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()
    assert raster.nearest_seed(raster.canvas(spark, 5, 5), seeds.limit(0)).count() == 0


def test_bilinear_and_cubic_keep_a_plane(spark):
    px = raster.canvas(spark, 9, 11).withColumn("v", F.col("y") * 2.0 - F.col("x"))
    for out in (raster.bilinear(px, spark, (9, 11), (18, 33)), raster.resized_cubic(px, spark, (9, 11), (18, 33), a=-0.5)):
        for r in out.where("y BETWEEN 4 AND 13 AND x BETWEEN 6 AND 26").collect():
            assert abs(r.v - (2 * ((r.y + 0.5) / 2 - 0.5) - ((r.x + 0.5) / 3 - 0.5))) < 1e-9


def test_training_mask_cleans_first(spark):
    a = np.zeros((20, 24))
    a[2:12, 3:15] = 2
    a[5, 6] = 0  # a small hole
    a[16, 20] = 2  # a small part
    dense = spark.createDataFrame([(int(y), int(x), int(a[y, x])) for y, x in np.ndindex(a.shape)], "y long, x long, v long")
    got = array(filters.training_mask(dense, spark, (20, 24), (20, 24), [2], 3, cleanup=4), a.shape)
    assert abs(got[5, 6] - 1) < 1e-9 and abs(got[16, 20]) < 1e-9
    assert 0 < got[2, 8] < 1 and array(filters.training_mask(dense, spark, (20, 24), (20, 24), [2], 3), a.shape)[16, 20] > 0.2
