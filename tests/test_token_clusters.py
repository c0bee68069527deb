import math

from tessella.operators.cluster import FrequencyRankedKMeans, TokenClusters


def test_saliency_follows_its_mode(spark):
    grid, height, width = 3, 7, 9
    labels = {(r, p): (r * 3 + p * p) % 8 for r in range(2) for p in range(grid * grid)}
    model = FrequencyRankedKMeans(k=8, normalise=False, centroids=[[float(i)] for i in range(8)])
    tokens = spark.createDataFrame([(r, p, [float(v)]) for (r, p), v in labels.items()], "row_idx long, position long, vec array<double>")
    order = {i: 37 * i % 8 * 10 for i in range(8)}

    def blended(r, y, x):
        sy = min(max((y + 0.5) * grid / height - 0.5, 0), grid - 1)
        sx = min(max((x + 0.5) * grid / width - 0.5, 0), grid - 1)
        y0, x0 = math.floor(sy), math.floor(sx)
        y1, x1 = min(y0 + 1, grid - 1), min(x0 + 1, grid - 1)
        at = lambda a, b: order[labels[r, a * grid + b]]
        top = at(y0, x0) * (1 - sx + x0) + at(y0, x1) * (sx - x0)
        low = at(y1, x0) * (1 - sx + x0) + at(y1, x1) * (sx - x0)
        return math.floor(round(top * (1 - sy + y0) + low * (sy - y0), 9) + 0.5)

    near = lambda r, y, x: order[labels[r, y * grid // height * grid + x * grid // width]]
    for mode, want in (("nearest", near), ("bilinear", blended)):
        rows = TokenClusters(model, grid=grid, mode=mode, order=order).saliency(tokens, height, width).collect()
        assert {(r.row_idx, r.y, r.x): r.v for r in rows} == {(r, y, x): want(r, y, x) for r in range(2) for y in range(height) for x in range(width)}
        assert len(rows) == 2 * height * width
