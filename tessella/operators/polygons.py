"""Rings without holes: each hole is opened to its outer ring through a narrow corridor.

The rings of one image and label (what ``adaptive.mask_polygons`` gives) are one pandas group: they are the outlines of
one mask, not its pixels. Vertices are compared in numpy blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .adaptive import ring_area

BLOCK = 2048


def nearest_pair(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Numbers of the closest points of two rings, the first pair on ties."""
    best = (np.inf, 0, 0)
    for at in range(0, len(a), BLOCK):
        d = ((a[at : at + BLOCK, None] - b[None]) ** 2).sum(axis=2)
        i, j = divmod(int(d.argmin()), len(b))
        best = min(best, (float(d[i, j]), at + i, j))
    return best[1], best[2]


def rotated(ring: np.ndarray, start: int) -> np.ndarray:
    """The ring from a vertex on."""
    return np.concatenate([ring[start:], ring[:start]])


def side_step(a: np.ndarray, b: np.ndarray, size: float) -> np.ndarray:
    """A step of a size to the left of the way from a to b; along x where they are one point."""
    way = b - a
    length = float(np.hypot(*way))
    return np.array([size, 0.0]) if length == 0 else np.array([-way[1], way[0]]) / length * size


def contains(ring: np.ndarray, x: float, y: float) -> bool:
    """Even-odd rule."""
    after = np.roll(ring, -1, axis=0)
    spans = (ring[:, 1] > y) != (after[:, 1] > y)
    a, b = ring[spans], after[spans]
    return bool((x < (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]).sum() % 2)


def opened(outer: np.ndarray, holes: list[np.ndarray], half: float) -> np.ndarray:
    """One ring: the outer one with a way of width 2 ``half`` to each hole and back, the nearest holes first."""
    ring = outer if ring_area(outer) > 0 else outer[::-1]
    left = [h if ring_area(h) < 0 else h[::-1] for h in holes]
    while left:
        found = [nearest_pair(ring, h) for h in left]
        k = min(range(len(left)), key=lambda n: (((ring[found[n][0]] - left[n][found[n][1]]) ** 2).sum(), n))
        hole, (i, j) = left.pop(k), found[k]
        outside, inside = rotated(ring, i), rotated(hole, j)
        step = side_step(outside[0], inside[0], half)
        ring = np.concatenate([[outside[0] - step], outside[1:], [outside[0] + step], [inside[0] + step], inside[1:], [inside[0] - step]])
    return ring


def cut_holes(rings: DataFrame, half: float = 0.25) -> DataFrame:
    """(image, label, ring, is_hole, area, points) to rings without holes (image, label, ring, area, points).

    A hole belongs to the smallest outer ring around it. ``half``, half a corridor's width, is to be under half the
    distance of any two vertices. A hole without an outer ring is left out.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        points = [np.array([p.split(",") for p in text.split()], dtype=float) for text in rows["points"]]
        numbers = np.flatnonzero(~rows["is_hole"].to_numpy())
        holes: dict[int, list[np.ndarray]] = {int(k): [] for k in numbers}
        by_area = sorted(holes, key=lambda k: (rows["area"].iloc[k], k))
        for k in np.flatnonzero(rows["is_hole"].to_numpy()).tolist():
            x, y = points[k][np.lexsort((points[k][:, 1], points[k][:, 0]))[0]] + 0.5  # the corner's own pixel lies in the hole
            around = next((o for o in by_area if contains(points[o], x, y)), None)
            if around is not None:
                holes[around].append(points[k])
        out = []
        for k, own in holes.items():
            ring = opened(points[k], own, half)
            out.append((rows["image"].iloc[0], int(rows["label"].iloc[0]), int(rows["ring"].iloc[k]), abs(ring_area(ring)), " ".join(f"{x:g},{y:g}" for x, y in ring.tolist())))
        return pd.DataFrame(out, columns=["image", "label", "ring", "area", "points"])

    return rings.groupBy("image", "label").applyInPandas(one, "image string, label long, ring long, area double, points string")
