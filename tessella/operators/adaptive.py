"""Piecewise-linear interpolation, contours, raster components and adaptive quadtree sampling.

Triangulation, tracing and components need one image's samples or mask together: they run per image (and label)
in pandas groups. Refinement is a driver loop over Spark jobs; each epoch's tables are checkpointed.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import geometry as G
from . import raster as R


#: Parts of one that coordinates of a triangulation are rounded to.
SCALE = 1 << 16


def curve_order(points: np.ndarray) -> np.ndarray:
    """Points along a Morton curve: neighbours in the order lie near each other."""
    low, span = points.min(axis=0), max(float(np.ptp(points, axis=0).max()), 1e-12)
    cells = np.minimum((points - low) / span * 65536, 65535).astype(np.uint64)
    key = np.zeros(len(points), dtype=np.uint64)
    for bit in range(16):
        key |= (cells[:, 0] >> np.uint64(bit) & np.uint64(1)) << np.uint64(2 * bit) | (cells[:, 1] >> np.uint64(bit) & np.uint64(1)) << np.uint64(2 * bit + 1)
    return np.argsort(key, kind="stable")


def delaunay(points: np.ndarray) -> np.ndarray:
    """Triangles (indices) of distinct points by insertion along a curve.

    Each point is found by a walk from the last triangle, and only the triangles around it are rebuilt. Coordinates are
    integers of 1 / 65,536, so that sides of lines and circles are exact.
    """
    n = len(points)
    whole = np.rint(np.asarray(points, dtype=float) * SCALE).astype(np.int64)
    span = max(int(np.ptp(whole, axis=0).max()), SCALE) * 1000
    mid = whole.mean(axis=0).astype(np.int64)
    p = [tuple(v) for v in whole.tolist()] + [(int(mid[0] + dx * span), int(mid[1] + dy * span)) for dx, dy in ((-3, -1), (3, -1), (0, 3))]
    corners: list = [(n, n + 1, n + 2)]
    beyond: list = [[-1, -1, -1]]  # across the side that faces each corner

    def side(a: int, b: int, q: tuple) -> int:
        (ax, ay), (bx, by) = p[a], p[b]
        return (bx - ax) * (q[1] - ay) - (by - ay) * (q[0] - ax)

    def in_circle(t: int, q: tuple) -> bool:
        (ax, ay), (bx, by), (cx, cy) = (p[k] for k in corners[t])
        qx, qy = q
        ax, ay, bx, by, cx, cy = ax - qx, ay - qy, bx - qx, by - qy, cx - qx, cy - qy
        return (ax * ax + ay * ay) * (bx * cy - cx * by) - (bx * bx + by * by) * (ax * cy - cx * ay) + (cx * cx + cy * cy) * (ax * by - bx * ay) > 0

    at = 0
    for i in curve_order(whole.astype(float)).tolist():
        q = p[i]
        while True:  # a straight walk ends, as the triangles are Delaunay's
            a, b, c = corners[at]
            if side(b, c, q) < 0:
                at = beyond[at][0]
            elif side(c, a, q) < 0:
                at = beyond[at][1]
            elif side(a, b, q) < 0:
                at = beyond[at][2]
            else:
                break
        hole, stack, edges = {at}, [at], []
        while stack:
            t = stack.pop()
            for k in range(3):
                o = beyond[t][k]
                if o in hole:
                    continue
                a, b = corners[t][k - 2], corners[t][k - 1]
                if o >= 0 and (in_circle(o, q) or side(a, b, q) <= 0):
                    hole.add(o)
                    stack.append(o)
                else:
                    edges.append((a, b, o))
        edges = [e for e in edges if e[2] not in hole]
        free = list(hole)
        made = {}
        for a, b, o in edges:
            if free:
                t = free.pop()
                corners[t], beyond[t] = (a, b, i), [-1, -1, o]
            else:
                t = len(corners)
                corners.append((a, b, i))
                beyond.append([-1, -1, o])
            made[a] = t
            if o >= 0:
                for k in range(3):
                    if corners[o][k] != a and corners[o][k] != b:
                        beyond[o][k] = t
        for a, t in made.items():
            follower = made[corners[t][1]]
            beyond[t][0] = follower  # across b, i
            beyond[follower][1] = t  # across i, a of the next
        at = t
    found = np.array(corners)
    return found[(found < n).all(axis=1)]


def linear_raster(points: np.ndarray, values: np.ndarray, height: int, width: int) -> np.ndarray:
    """Barycentric interpolation over the triangulation; zero outside the hull."""
    out = np.zeros((height, width))
    if len(points) < 3:
        return out
    for t in delaunay(points):
        a, b, c = points[t].astype(float)
        d = (b[1] - c[1]) * (a[0] - c[0]) + (c[0] - b[0]) * (a[1] - c[1])
        if abs(d) < 1e-12:
            continue
        (x0, y0), (x1, y1) = np.floor(points[t].min(axis=0)).astype(int), np.ceil(points[t].max(axis=0)).astype(int)
        x0, y0, x1, y1 = max(x0, 0), max(y0, 0), min(x1, width - 1), min(y1, height - 1)
        if x0 > x1 or y0 > y1:
            continue
        yy, xx = np.mgrid[y0 : y1 + 1, x0 : x1 + 1]
        u = ((b[1] - c[1]) * (xx - c[0]) + (c[0] - b[0]) * (yy - c[1])) / d
        v = ((c[1] - a[1]) * (xx - c[0]) + (a[0] - c[0]) * (yy - c[1])) / d
        w = 1 - u - v
        hit = (u >= -1e-9) & (v >= -1e-9) & (w >= -1e-9)
        out[y0 : y1 + 1, x0 : x1 + 1][hit] = (u * values[t[0]] + v * values[t[1]] + w * values[t[2]])[hit]
    return out


def interpolate_linear(samples: DataFrame, height: int, width: int, downsample: int = 1, mapping: dict[int, float] | None = None) -> DataFrame:
    """(image, x, y, label) to (image, y, x, v): linear between samples, mapped labels if a mapping is given (else 0)."""
    value = F.col("label").cast("double")
    if mapping is not None:
        value = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in mapping.items() for x in (int(k), float(v))]), F.col("label").cast("int")), F.lit(0.0))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["y", "x"]).drop_duplicates(["x", "y"], keep="last")
        raster = linear_raster(rows[["x", "y"]].to_numpy(float) / downsample, rows["label"].to_numpy(float), height, width)
        yy, xx = np.mgrid[0:height, 0:width]
        return pd.DataFrame({"image": rows["image"].iloc[0], "y": yy.ravel(), "x": xx.ravel(), "v": raster.ravel()})

    return samples.select("image", "x", "y", value.alias("label")).groupBy("image").applyInPandas(one, "image string, y long, x long, v double")


def gradient(pixels: DataFrame) -> DataFrame:
    """Sobel magnitude of (image, y, x, v); missing neighbours repeat nothing: they count as zero."""
    kernel = [(dy, dx, {(-1, -1): 1, (-1, 0): 2, (-1, 1): 1, (1, -1): -1, (1, 0): -2, (1, 1): -1}.get((dy, dx), 0)) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    parts = F.array(*(F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), (F.col("v") * w).alias("gy"), (F.col("v") * {(-1, -1): 1, (0, -1): 2, (1, -1): 1, (-1, 1): -1, (0, 1): -2, (1, 1): -1}.get((dy, dx), 0)).alias("gx")) for dy, dx, w in kernel))
    spread = pixels.select("image", F.explode(parts).alias("p")).groupBy("image", F.col("p.y").alias("y"), F.col("p.x").alias("x")).agg(F.sum("p.gy").alias("gy"), F.sum("p.gx").alias("gx"))
    return pixels.select("image", "y", "x").join(spread, ["image", "y", "x"]).select("image", "y", "x", (F.hypot("gy", "gx") / 4).alias("v"))


def trace(mask: np.ndarray) -> list[np.ndarray]:
    """Closed rings of pixel-corner points around a mask: outer rings have positive area, holes negative."""
    m = np.pad(mask.astype(bool), 1)
    follow: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for dy, dx, (ay, ax), (by, bx) in ((-1, 0, (0, 0), (0, 1)), (0, 1, (0, 1), (1, 1)), (1, 0, (1, 1), (1, 0)), (0, -1, (1, 0), (0, 0))):
        for y, x in np.argwhere(m & ~np.roll(m, (-dy, -dx), (0, 1))).tolist():
            follow.setdefault((x + ax - 1, y + ay - 1), []).append((x + bx - 1, y + by - 1))
    rings = []
    while follow:
        start = min(follow)
        ring, at, before = [start], start, None
        while True:
            options = follow[at]
            turn = 0
            if len(options) > 1 and before is not None:  # two corners touch: keep to the same pixel
                way = (at[0] - before[0], at[1] - before[1])
                turn = max(range(len(options)), key=lambda i: way[0] * (options[i][1] - at[1]) - way[1] * (options[i][0] - at[0]))
            after = options.pop(turn)
            if not options:
                del follow[at]
            before, at = at, after
            if at == start:
                break
            ring.append(at)
        points = np.array(ring)
        step, back = np.roll(points, -1, 0) - points, points - np.roll(points, 1, 0)
        rings.append(points[(step[:, 0] * back[:, 1] - step[:, 1] * back[:, 0]) != 0])
    return rings


def ring_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0].astype(float), ring[:, 1].astype(float)
    return float((x * np.roll(y, -1) - y * np.roll(x, -1)).sum() / 2)


def mask_polygons(labels: DataFrame, background: int = 0) -> DataFrame:
    """(image, y, x, v) to rings (image, label, ring, is_hole, area, points) of each label."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = rows["y"].min(), rows["x"].min()
        mask = np.zeros((rows["y"].max() - y0 + 1, rows["x"].max() - x0 + 1), dtype=bool)
        mask[rows["y"] - y0, rows["x"] - x0] = True
        out = []
        for k, ring in enumerate(trace(mask)):
            area = ring_area(ring)
            out.append((rows["image"].iloc[0], int(rows["v"].iloc[0]), k, area < 0, abs(area), " ".join(f"{x + x0},{y + y0}" for x, y in ring.tolist())))
        return pd.DataFrame(out, columns=["image", "label", "ring", "is_hole", "area", "points"])

    return labels.where(F.col("v") != background).groupBy("image", "v").applyInPandas(one, "image string, label long, ring long, is_hole boolean, area double, points string")


def component_sizes(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(component number of each pixel with four neighbours, 0 outside; sizes by number)."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        new = label.copy()
        for axis, step in ((0, 1), (0, -1), (1, 1), (1, -1)):
            moved = np.roll(label, step, axis)
            edge = [slice(None)] * 2
            edge[axis] = 0 if step == 1 else -1
            moved[tuple(edge)] = 0
            new = np.where(mask & (moved > new), moved, new)
        if (new == label).all():
            break
        label = np.where(mask, new.reshape(-1)[np.maximum(new, 1) - 1], 0)  # jump to the pointer's own label
    _, number, sizes = np.unique(label, return_inverse=True, return_counts=True)
    return number.reshape(mask.shape), sizes


def cleaned_mask(pixels: DataFrame, least: int, fill: bool = True) -> DataFrame:
    """(image, y, x, v in 0/1): components under ``least`` pixels go, holes are filled."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        h, w = rows["y"].max() + 1, rows["x"].max() + 1
        mask = np.zeros((h, w), dtype=bool)
        mask[rows["y"], rows["x"]] = rows["v"] > 0
        number, sizes = component_sizes(mask)
        mask &= sizes[number] >= least
        if fill:
            outside, _ = component_sizes(~np.pad(mask, 1))
            mask = outside[1:-1, 1:-1] != outside[0, 0]
        yy, xx = np.mgrid[0:h, 0:w]
        return pd.DataFrame({"image": rows["image"].iloc[0], "y": yy.ravel(), "x": xx.ravel(), "v": mask.ravel().astype(int)})

    return pixels.groupBy("image").applyInPandas(one, "image string, y long, x long, v long")


def refine_epoch(cells: DataFrame, samples: DataFrame, labeler: Callable[[DataFrame], DataFrame], height: int, width: int, threshold: float, least: int, mapping: dict[int, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(cells, samples) of the next epoch: cells whose mean gradient is over the threshold get their corners
    labelled and, while over the least size, split; the others stay."""
    slopes = gradient(interpolate_linear(samples, height, width, mapping=mapping))
    scored = R.integral_cells(slopes, cells, threshold, by=("image",))
    active = scored.where("active").select("image", "x0", "y0", "size")
    idle = scored.where("NOT active").select("image", "x0", "y0", "size")
    new = labeler(G.unsampled_corners(active, samples).where((F.col("x") < width) & (F.col("y") < height)))
    split = G.children(active.where(F.col("size") > least))
    return idle.unionByName(split).distinct(), samples.unionByName(new.select("image", "x", "y", "label"))


def adaptive_samples(cells: DataFrame, samples: DataFrame, labeler: Callable[[DataFrame], DataFrame], height: int, width: int, threshold: float = 0.1, least: int = 32, most_epochs: int = 20, mapping: dict[int, float] | None = None) -> DataFrame:
    """Samples after refinement, until no cell is left or an epoch after the first adds nothing.

    Epochs are checkpointed in the session's folder, or in the one that ``spark.checkpoint.dir`` names; only where
    neither is set, as on one machine, is a folder of our own made. ``mapping`` gives labels their values (others: 0).
    """
    session = samples.sparkSession
    context = session.sparkContext
    if context.getCheckpointDir() is None:
        named = session.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessella-"))
    before = samples.count()
    for epoch in range(1, most_epochs + 1):
        cells, samples = refine_epoch(cells, samples, labeler, height, width, threshold, least, mapping)
        cells, samples = cells.checkpoint(), samples.checkpoint()
        now = samples.count()
        if cells.isEmpty() or (epoch > 1 and now == before):
            break
        before = now
    return samples
