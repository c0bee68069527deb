"""The catalogue's queries without SQL, each held against a plain version over the same table."""

import itertools

import numpy as np
import pyarrow.parquet as pq
import pytest

from tessella.operators.autoencoder import hash_embedder
from tessella.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors():
    t = pq.read_table(f"{SF}/embeddings.parquet")
    return np.array(t["vec_id"]), np.array(t["embedding"].to_pylist(), dtype=np.float64), np.array(t["label"])


def run(spark, name):
    return catalogue.QUERIES[name](spark, SF).collect()


def strict_overlaps(x):
    score = np.where(x - 0.15 > 0, x - 0.15, 0)
    most = score.max(axis=0)
    on = (score / np.where(most == 0, 1, most) > 0.5).astype(float)
    common, size = on.T @ on, on.sum(axis=0)
    union = size[:, None] + size[None] - common
    return np.round(np.where(union > 0, common / np.where(union == 0, 1, union), 0), 6)


def average_clusters(d, threshold):
    """Merges of the nearest two groups, by mean distance of their members, up to a threshold."""
    groups = [[i] for i in range(len(d))]
    while len(groups) > 1:
        means = {(a, b): d[np.ix_(groups[a], groups[b])].mean() for a, b in itertools.combinations(range(len(groups)), 2)}
        (a, b), least = min(means.items(), key=lambda m: m[1])
        if least > threshold:
            break
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


def test_random_sample(spark):
    rows = run(spark, "random_sample")
    known = {(r.table_name, r.row_idx): r.score for r in catalogue.scored_events(spark, SF).collect()}
    picked = [(r.table_name, r.row_idx) for r in rows]
    assert len(picked) == 100 == len(set(picked)) and all(known[p] == r.score for p, r in zip(picked, rows))
    assert picked == [(r.table_name, r.row_idx) for r in run(spark, "random_sample")]
    counts = [sum(t == name for t, _ in picked) for name in {t for t, _ in known}]
    assert min(counts) > 5  # five tables of about equal size


def test_linkage_and_heatmap(spark, vectors):
    iou = strict_overlaps(vectors[1])
    np.fill_diagonal(iou, 1)
    got = run(spark, "feature_linkage")
    groups = {}
    for r in got:
        groups.setdefault(r.cluster, set()).add(r.feature)
    assert {frozenset(g) for g in groups.values()} == average_clusters(1 - iou, 0.9 + 1e-9)
    assert sorted(r.place for r in got) == list(range(64))
    place = {r.feature: r.place for r in got}
    for g in groups.values():  # a cluster is one stretch of leaves
        at = sorted(place[f] for f in g)
        assert at == list(range(at[0], at[0] + len(at)))
    cells = run(spark, "feature_heatmap")
    feature = {p: f for f, p in place.items()}
    assert len(cells) == 64 * 64 and all(abs(c.iou - iou[feature[c.row], feature[c.col]]) < 1e-9 for c in cells)


def test_kmeans(spark, vectors):
    ids, x, _ = vectors
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = {r.row_idx: r.label for r in run(spark, "kmeans_frequency_ranked")}
    labels = np.array([label[i] for i in ids])
    counts = np.bincount(labels, minlength=10)
    assert (np.diff(counts) <= 0).all() and counts.min() > 0
    centres = np.stack([x[labels == k].mean(axis=0) for k in range(10)])
    near = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (near == labels).mean() > 0.95  # nearly settled
    rng = np.random.default_rng(0)
    other = []
    for _ in range(5):
        c = x[rng.choice(len(x), 10, replace=False)]
        for _ in range(25):
            n = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            c = np.stack([x[n == k].mean(axis=0) if (n == k).any() else c[k] for k in range(10)])
        other.append(((x - c[n]) ** 2).sum())
    assert ((x - centres[labels]) ** 2).sum() < 1.05 * np.median(other)


def test_linear_interpolation(spark):
    value = {(r.y, r.x): r.v for r in run(spark, "linear_interpolation")}
    seeds = {}
    for x, y, k in catalogue.SEEDS:
        seeds[x, y] = k
    assert len(value) == 1600
    for (x, y), k in seeds.items():
        if (x, y) != (11, 25):  # two seeds on one spot
            assert value[y, x] == pytest.approx(k)
    hull = [(39, 0), (30, 30), (0, 39), (3, 4)]  # in order of their angle

    def inside(x, y):
        return all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0 for (ax, ay), (bx, by) in zip(hull, hull[1:] + hull[:1]))

    for (y, x), v in value.items():
        assert (1 - 1e-9 <= v <= 4 + 1e-9) if inside(x, y) else v == 0 or (x, y) in seeds or v >= 0


def test_polygons_have_the_mask_s_area(spark):
    rows = run(spark, "mask_polygons")
    raster = np.zeros((40, 40), int)
    raster[2:30, 2:18], raster[5:20, 10:25] = 1, 2
    for label in (1, 2):
        area = sum(-r.area if r.is_hole else r.area for r in rows if r.label == label)
        assert area == (raster == label).sum()
    for r in rows:
        p = np.array([tuple(map(int, q.split(","))) for q in r.points.split(" ")])
        x, y = p[:, 0], p[:, 1]
        assert abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2 == r.area
        assert ((np.roll(p, -1, 0) - p) == 0).any(axis=1).all()  # along the pixels' edges


def parts(mask):
    seen, out = np.zeros(mask.shape, bool), []
    for start in map(tuple, np.argwhere(mask)):
        if seen[start]:
            continue
        stack, part = [start], []
        seen[start] = True
        while stack:
            y, x = stack.pop()
            part.append((y, x))
            for a, b in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not seen[a, b]:
                    seen[a, b] = True
                    stack.append((a, b))
        out.append(part)
    return out


def test_cleaned_mask(spark):
    px = catalogue.pixels(spark, SF).collect()
    h, w = max(r.y for r in px) + 1, max(r.x for r in px) + 1
    mask = np.zeros((h, w), bool)
    for r in px:
        mask[r.y, r.x] = r.v > 300
    for part in parts(mask):
        if len(part) < 4:
            for p in part:
                mask[p] = False
    padded = np.pad(mask, 1)
    outside = next(p for p in parts(~padded) if (0, 0) in p)
    want = np.ones(padded.shape, bool)
    for p in outside:
        want[p] = False
    got = {(r.y, r.x): r.v for r in run(spark, "cleaned_mask")}
    assert len(got) == h * w and all(got[y, x] == want[y + 1, x + 1] for y, x in got)


def test_embed_patches(spark, vectors):
    embed = hash_embedder(16)
    got = {r.row_idx: r.vec for r in run(spark, "embed_patches")}
    assert got.keys() == set(vectors[0].tolist())
    for i in vectors[0][:50].tolist():
        assert np.array_equal(np.float32(got[i]), embed([str(i).encode()])[0])


def test_sae(spark, vectors):
    from tessella.operators.autoencoder import SparseAutoencoder

    rows = run(spark, "sae_fit_transform")
    assert rows and all(r.score > 0 for r in rows) and {r.row_idx for r in rows} <= set(vectors[0].tolist()) and {r.feature for r in rows} <= set(range(128))
    frame = catalogue.table(spark, SF, "embeddings").selectExpr("vec_id AS row_idx", "embedding AS vec")
    model = SparseAutoencoder(expansion=2, steps=100, rate=1e-3, target=0.05).fit(frame)
    x = (vectors[1] - model.centre) / model.scale
    h = np.maximum(x @ model.p["w"].T + model.p["b"], 0)
    want = {(int(vectors[0][i]), int(k)): h[i, k] for i, k in np.argwhere(h > 1e-9)}
    got = {(r.row_idx, r.feature): r.score for r in rows if r.score > 1e-9}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)
    assert ((h @ model.p["d"].T - x) ** 2).mean() < (x**2).mean()  # better than the mean


def test_token_clusters(spark, vectors):
    ids, x, label = vectors
    centres = np.stack([x[label == k].mean(axis=0) for k in range(10)])
    near = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    positive = ids // 25 % 2 == 0
    a, b = (np.bincount(near[m], minlength=10) / (m.sum() + 1e-12) for m in (positive, ~positive))
    rank = {k: n for n, k in enumerate(sorted(range(10), key=lambda k: (-(a - b)[k], k)))}
    got = {(r.row_idx, r.y, r.x): r.v for r in run(spark, "token_clusters")}
    assert len(got) == len(ids)
    for i, k in zip(ids.tolist(), near.tolist()):
        assert got[i // 25, i % 25 // 5, i % 25 % 5] == 9 - rank[k]


def test_adaptive_samples(spark):
    rows = run(spark, "adaptive_samples")
    assert len({(r.image, r.x, r.y) for r in rows}) == len(rows)
    for r in rows:
        assert r.label == ((r.x - 20) ** 2 + (r.y - 14) ** 2 < 70) and 0 <= r.x < 41 and 0 <= r.y < 25 and r.x % 4 == 0 and r.y % 4 == 0
    first = {(i, x, y) for i in ("s0", "s1") for x in range(0, 41, 8) for y in range(0, 25, 8)}
    new = {(r.image, r.x, r.y) for r in rows} - first
    assert first <= {(r.image, r.x, r.y) for r in rows} and new
    # new places lie by the edge of the disk, none where a wide surrounding is all of one class
    assert all(abs(np.hypot(x - 20, y - 14) - 70**0.5) < 17 for _, x, y in new)
