import itertools
import random

import pytest

from tessella.operators import geometry


def brute(left, right):
    out = {}
    for shape in {r[0] for r in left} & {r[0] for r in right}:
        a, b = ([r[1:] for r in sorted(t, key=lambda r: r[1]) if r[0] == shape] for t in (left, right))
        pairs = [((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2, i, j) for (i, p), (j, q) in itertools.product(enumerate(a), enumerate(b)) if None not in p + q]
        if pairs:
            d, i, j = min(pairs)
            out[shape] = (i, j, d**0.5)
    return out


@pytest.mark.parametrize("apart", [0, 7, 40_000])
def test_against_all_pairs(spark, apart):
    rng = random.Random(apart)
    spot = lambda shift: (rng.randint(0, 30) + shift, rng.randint(0, 30))
    left = [(s, 10 * k, *spot(0)) for s in range(5) for k in range(40)] + [(9, 0, 1, 1), (5, 1, None, 2), (5, 2, 0, 0)]
    right = [(s, 10 * k + 3, *spot(apart * (s % 3))) for s in range(5) for k in range(30)] + [(8, 0, 1, 1), (5, 0, 4, 3), (5, 7, 4, None)]
    schema = "shape long, place long, x long, y long"
    got = geometry.nearest_vertices(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).collect()
    want = brute(left, right)
    assert {r.shape: (r.i, r.j) for r in got} == {s: w[:2] for s, w in want.items()}
    assert all(abs(r.distance - want[r.shape][2]) < 1e-9 for r in got) and len(got) == len(want)


def test_empty(spark):
    none = spark.createDataFrame([], "shape long, place long, x long, y long")
    assert geometry.nearest_vertices(none, none).count() == 0
