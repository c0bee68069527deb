import numpy as np

from tessella.operators import adaptive, polygons


def rings_of(spark, mask):
    rows = [("a", int(y), int(x), int(mask[y, x])) for y, x in np.argwhere(mask > 0)]
    return adaptive.mask_polygons(spark.createDataFrame(rows, "image string, y long, x long, v long"))


def test_holes_are_opened(spark):
    mask = np.zeros((40, 50), int)
    mask[2:30, 3:45] = 1
    mask[5:9, 6:10] = mask[12:20, 20:30] = mask[24, 40] = 0
    mask[14:17, 23:26] = 1  # an island in a hole
    mask[33:38, 5:20] = 2
    rings = rings_of(spark, mask).collect()
    got = polygons.cut_holes(rings_of(spark, mask)).collect()
    assert sorted(r.label for r in got) == [1, 1, 2] and sum(r.is_hole for r in rings) == 3
    for label in (1, 2):
        area = sum(r.area for r in got if r.label == label)
        assert (mask == label).sum() - 12 < area <= (mask == label).sum()
    # every pixel's middle is where it was, but for those that a corridor passes
    wrong = 0
    for y, x in np.ndindex(mask.shape):
        for label in (1, 2):
            inside = sum(polygons.contains(np.array([p.split(",") for p in r.points.split()], dtype=float), x + 0.5, y + 0.5) for r in got if r.label == label)
            assert inside <= (mask[y, x] == label)
            wrong += inside != (mask[y, x] == label)
    assert wrong <= 16  # ways of 4, 10 and 2 pixels


def test_small_parts():
    a, b = np.array([[0.0, 0], [4, 0], [4, 4], [0, 4]]), np.array([[1.0, 1], [1, 3], [3, 3], [3, 1]])
    assert polygons.nearest_pair(a, b) == (0, 0) and polygons.rotated(a, 2).tolist() == [[4, 4], [0, 4], [0, 0], [4, 0]]
    assert np.allclose(polygons.side_step(a[0], a[1], 0.5), [0, 0.5]) and np.allclose(polygons.side_step(a[0], a[0], 0.5), [0.5, 0])
    ring = polygons.opened(a, [b], 0.1)
    assert 16 - 4 - 0.2 * 2**0.5 <= adaptive.ring_area(ring) < 16 - 4
    assert polygons.opened(a, [], 0.1).tolist() == a.tolist()
